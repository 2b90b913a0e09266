"""Line dedup by distinct-site spread (DataFrame functions only).

Each line has a HyperLogLog sketch of the sites it occurs on; sketches merge
map-side and in one shuffle of fixed-size rows, together with the number of the
line's occurrences. A line with fewer occurrences than `min_sites` cannot be
boilerplate; of the others, those whose estimate is well above the threshold
keep the sketch's verdict, and all the rest get an exact distinct count. So a
low estimate loses no line. Nor does a high one add any: up to an estimate of
80 the sketch (128 registers) counts linearly, from the registers hit, of which
there are at most as many as sites; nine sites give 9.3 at most, and only 14 or
more is well above `MIN_SITES`. A line on `min_sites` sites or more is boilerplate and goes, but for
its first occurrence (smallest doc_id, then line number), so that a text which
all sites copy survives once.

Defined results: null text counts as empty, null source as a site of its own.
Blank lines are never boilerplate. Rows that repeat a doc_id and text are
treated alike, each with its own row; a null doc_id comes first. A document may
end up empty, it is never dropped here. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.llm.common import ASCII_SPACE, materialize

#: Sites from which a line is boilerplate, the sketch's relative error, and how many of these above the threshold still count as near.
MIN_SITES, ERROR, NEAR = 10, 0.1, 4


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, site, text and a 128-bit key of doc_id and text."""
    body = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("site"), F.coalesce("text", F.lit("")).alias("text"))
    return body.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(7), "doc_id")})


def lines(rows: DataFrame) -> DataFrame:
    """doc_id, site, k1, k2, pos, h1, h2 of each line that is not blank; a line is known by 128 bits of hash."""
    cut = rows.select("doc_id", "site", "k1", "k2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    full = cut.filter(F.btrim("line", F.lit(ASCII_SPACE)) != "")
    return full.select("doc_id", "site", "k1", "k2", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 of the lines on at least min_sites sites, with `first`, their first (doc_id, pos)."""
    sketched = found.groupBy("h1", "h2").agg(F.approx_count_distinct("site", ERROR).alias("sites"), F.count(F.lit(1)).alias("n"))
    high = min_sites * (1 + NEAR * ERROR)
    candidates, _ = materialize(sketched.filter(F.col("n") >= min_sites).select("h1", "h2", (F.col("sites") < high).alias("near")), "lines")
    by_site = (
        found.join(candidates, ["h1", "h2"])
        .withColumn("site", F.when(F.col("near"), F.col("site")))
        .groupBy("h1", "h2", "near", "site")
        .agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    )
    counted = by_site.groupBy("h1", "h2", "near").agg(F.count(F.lit(1)).alias("exact"), F.min("first").alias("first"))
    return counted.filter(~F.col("near") | (F.col("exact") >= min_sites)).select("h1", "h2", "first")


def removed_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, (k1, k2, removed): the line numbers that go)."""
    rows = keyed(docs)
    found = lines(rows)
    bad, _ = materialize(boilerplate(found, min_sites), "boilerplate")
    again = found.join(bad, ["h1", "h2"]).filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos"))))
    return rows, again.groupBy("k1", "k2").agg(F.collect_set("pos").alias("removed"))


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """row (a struct of all columns of docs, text reduced to the lines that stay), lines and removed, the numbers of all and of removed lines."""
    _, gone = removed_lines(docs, min_sites)
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", body).alias("k1"), F.xxhash64(body, F.lit(7), "doc_id").alias("k2"))
    text = F.col("row.text")
    joined = rows.join(gone, ["k1", "k2"], "left").withColumn("parts", F.split(F.coalesce(text, F.lit("")), "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("removed"))
    kept = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n"))
    return joined.select(F.col("row").withField("text", kept).alias("row"), F.size("parts").cast("long").alias("lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("removed"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_chars, kept_sha256."""
    kept = cleaned(docs.select("doc_id", "source", "text"), min_sites)
    body = F.coalesce("row.text", F.lit(""))
    return kept.select("row.doc_id", F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"), F.length(body).cast("long").alias("kept_chars"), F.sha2(body, 256).alias("kept_sha256"))
