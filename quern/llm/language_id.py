"""Language identification by compression.

Per language, whole labelled documents are joined to a zstandard raw-content
dictionary. A text, reduced to its lower-cased letter runs, is
compressed whole with each dictionary; the smallest result names the language.

Bounded fit: of the distinct labelled texts of a language, in the order of a
hash of the text, at most `SAMPLE` whole ones that together have at most
`BUDGET` characters (where none fits, the shortest one drawn). Prediction reads
whole texts and nothing but the text.

A margin of at most `MARGIN` of the smallest result between it and the next one
counts as narrow, and the document as rejected; equal sizes go to the language
with more labelled documents, then by name.

Defined results: null text or text without letters gives `und`, score 0 and
rejected. Without any labelled document all rows are `und`. Rows keep their
number; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quern.llm.common import resident, small_batches

SAMPLE, BUDGET, LEVEL, MARGIN = 256, 1 << 18, 6, 0.01
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def letters(text: str) -> bytes:
    """Lower-cased letter runs between single spaces."""
    return (" " + " ".join(LETTERS.findall(text.lower())) + " ").encode()


def held_out() -> Column:
    """Documents whose crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(labelled: DataFrame, sample: int = SAMPLE, budget: int = BUDGET) -> dict[str, bytes]:
    """Dictionary content by language, the languages with most labelled documents first.

    labelled: doc_id, text, lang. The driver gets the lengths of about 2 * sample texts a language, then the texts that `drawn` takes.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("k"))
    counts = {r["lang"]: r for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("k").alias("texts")).collect()}
    if not counts:
        return {}
    space = 1 << 30
    keyed = usable.withColumn("h", F.pmod(F.xxhash64("k", F.lit(3)), F.lit(space)))
    limits = F.create_map(*[F.lit(x) for k, r in sorted(counts.items()) for x in (k, int(space * min(1.0, 2 * sample / max(1, r["texts"]))))])
    rows = keyed.filter(F.col("h") < limits[F.col("lang")]).select("lang", "h", "k", F.length("text").alias("size"), "text")
    offered: dict[str, set] = {}
    for r in rows.select("lang", "h", "k", "size").distinct().collect():
        offered.setdefault(r["lang"], set()).add((r["h"], r["k"], r["size"]))
    taken = [(lang, k) for lang, found in offered.items() for k in drawn(sorted(found), sample, budget)]
    wanted = F.broadcast(labelled.sparkSession.createDataFrame(taken, "lang string, k long")) if taken else keyed.select("lang", "k").limit(0)
    found: dict[str, list] = {}
    for r in rows.join(wanted, ["lang", "k"], "left_semi").groupBy("lang", "h", "k").agg(F.first("text").alias("t")).collect():
        found.setdefault(r["lang"], []).append((r["h"], r["t"]))
    order = sorted(found, key=lambda x: (-counts[x]["n"], x))
    return {x: b"".join(letters(t) for _, t in sorted(found[x])) for x in order}


def drawn(offered: list[tuple[int, int, int]], sample: int, budget: int) -> list[int]:
    """Keys of the first `sample` of (hash, key, length) whose lengths fit into what is left of `budget`; the shortest one where none fits."""
    taken, left = [], budget
    for _, key, size in offered:
        if size <= left and len(taken) < sample:
            taken.append(key)
            left -= size
    return taken or [min(offered, key=lambda x: (x[2], x[0]))[1]]


class Classifier:
    """The fitted dictionaries, ready to compress."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL) -> None:
        self.compressors = []
        for name, content in dictionaries.items():
            params = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False)
            if len(content) >= 8:
                raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                raw.precompute_compress(compression_params=params)
                self.compressors.append((name, zstandard.ZstdCompressor(dict_data=raw, compression_params=params)))
            else:
                self.compressors.append((name, zstandard.ZstdCompressor(compression_params=params)))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        body = letters(text or "")
        if len(body) <= 2 or not self.compressors:
            return UNKNOWN, 0.0, True
        sizes = [(len(c.compress(body)), k) for k, (_, c) in enumerate(self.compressors)]
        best, at = min(sizes)
        score = 1.0 / sum(math.exp(max(-60.0, (best - s) / 2)) for s, _ in sizes)
        narrow = any(s - best <= MARGIN * best for s, k in sizes if k != at)
        return self.compressors[at][0], score, narrow


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL) -> DataFrame:
    """All columns of docs (none of these names), with lang_pred, score and rejected."""
    schema = docs.schema.fieldNames()
    at = schema.index("text")

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = resident(("languages", level, hash(tuple(dictionaries.items()))), lambda: Classifier(dictionaries, level))
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(at)]
            extra = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*schema, "lang_pred", "score", "rejected"])

    small_batches(docs.sparkSession)
    extra_fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return docs.mapInArrow(classify, T.StructType([*docs.schema.fields, *extra_fields]))


def recognised(docs: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL) -> DataFrame:
    """The rows of docs, with all columns, that are not rejected."""
    rest = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    kept = identify(docs.select(rest, "text"), dictionaries, level).filter(~F.col("rejected"))
    return kept.select(*[F.col(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def language_id(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected; fitted on those not held out."""
    dictionaries = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), dictionaries).drop("text")
