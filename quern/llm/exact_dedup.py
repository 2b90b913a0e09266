"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut where its content says so, each chunk gets an identifier whose
uniqueness is verified against the SHA-256 digests of all chunks, and two texts
are equal exactly if their ordered identifier lists are. Only distinct pairs of
identifier and digest cross the network, for the verification; neither long
documents nor their chunks ever move.

Boundaries: a text is split into tokens (up to and with the next white space and
punctuation, 64 characters of a kind at most), and a rolling hash of the last
WINDOW tokens ends a chunk where EVERY divides it and FIRST the code of the
last token's first character. So a boundary depends on the few
characters before it alone: wherever two texts hold the same passage, their
cuts fall into step within a chunk, whatever stands before. A stretch of over
LONG tokens without a boundary (periodic text, most of all) is cut at every hash
that is the least of the NEAR before and after it.

Defined results: null text counts as empty (an empty recipe). Rows that repeat
a doc_id with the same text share one decision. A group whose doc_ids are all
null keeps every row (keep_id null), so that nothing is lost. Any further
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import join_groups, materialize

#: Tokens that the rolling hash sees; divisors of it and of the last token's first character (looked at first, as that costs less);
#: tokens from which a stretch without a boundary is cut otherwise, and how far its hashes are compared.
WINDOW, EVERY, FIRST, LONG, NEAR = 2, 64, 4, 1024, 8
#: White space or punctuation ends a token.
TOKEN = r"[^\s\p{P}]{0,63}+[\s\p{P}]{1,64}+|[^\s\p{P}]{1,64}+"
#: Identifiers that more than one content share and that the driver holds; some 70 are expected among 5 * 10**10 chunks.
MAX_WIDE = 100_000


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: as a lambda's variable it is not evaluated again for each element of an inner one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunks(text: Column, every: int = EVERY, long: int = LONG) -> Column:
    """The content-defined chunks of a text, in order; none for an empty text."""
    none = F.array().cast("array<int>")

    def ends(tokens: Column) -> Column:
        n = F.size(tokens)
        hashed = lambda i: F.xxhash64(*[F.get(tokens, i - b) for b in range(WINDOW, 0, -1)])
        places = lambda a, b: F.when(b - a > 1, F.sequence(a + 1, b - 1)).otherwise(none)
        marks = F.filter(places(F.lit(0), n), lambda i: (F.ascii(F.get(tokens, i - 1)) % FIRST == 0) & (F.pmod(hashed(i), F.lit(every)) == 0))

        def least(s: Column) -> Column:
            def found(h: Column) -> Column:
                near = lambda i: F.slice(h, F.greatest(i - NEAR, F.lit(1)), F.lit(2 * NEAR + 1))
                return F.filter(F.sequence(F.lit(1), F.size(h)), lambda i: F.get(h, i - 1) == F.array_min(near(i)))

            return F.transform(_let(F.transform(places(s["a"], s["b"]), hashed), found), lambda i: s["a"] + i)

        def refined(cuts: Column) -> Column:
            stretches = F.filter(_spans(cuts, n), lambda s: s["b"] - s["a"] > long)
            return F.array_sort(F.concat(cuts, F.flatten(F.transform(stretches, least))))

        return _let(marks, refined)

    def parts(tokens: Column, cuts: Column) -> Column:
        filled = F.filter(_spans(cuts, F.size(tokens)), lambda s: s["b"] > s["a"])
        return F.transform(filled, lambda s: F.array_join(F.slice(tokens, s["a"] + 1, s["b"] - s["a"]), ""))

    return _let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda tokens: _let(ends(tokens), lambda cuts: parts(tokens, cuts)))


def _spans(cuts: Column, n: Column) -> Column:
    """Structs (a, b) of the stretches between cuts, from 0 to n."""
    return F.arrays_zip(F.concat(F.array(F.lit(0)), cuts).alias("a"), F.concat(cuts, F.array(n)).alias("b"))


def _narrow(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def collisions(pieces: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one content. pieces: id and wide, the content's SHA-256."""
    distinct = pieces.groupBy("id", "wide").agg(F.lit(1).alias("one"))
    return distinct.groupBy("id").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1")


def recipes(docs: DataFrame, text: str = "text", identify=_narrow) -> DataFrame:
    """docs with `recipe`, the ordered list of verified chunk identifiers, in place of the text.

    Chunks are cut once, into a written table of their 64-bit identifiers and
    SHA-256 digests. An identifier is verified if all its chunks have one
    digest; that takes an action while the plan is built. Where some are not,
    identifiers are pairs (id, wide): the digest too for such chunks, and null
    for the others.
    """
    cut = F.transform(chunks(F.coalesce(F.col(text), F.lit(""))), lambda c: F.struct(identify(c).alias("id"), F.sha2(c, 256).alias("wide")))
    listed, _ = materialize(docs.withColumn("_pieces", cut).drop(text), "recipes")
    pieces = listed.select(F.explode("_pieces").alias("p")).select("p.id", "p.wide")
    shared = [r["id"] for r in collisions(pieces).select("id").limit(MAX_WIDE + 1).collect()]
    if len(shared) > MAX_WIDE:
        raise RuntimeError("too many chunk contents share a 64-bit identifier")
    recipe = lambda p: p["id"]
    if shared:
        known = F.lit(sorted(shared))
        recipe = lambda p: F.struct(p["id"].alias("id"), F.when(F.array_contains(known, p["id"]), p["wide"]).alias("wide"))
    return listed.withColumn("recipe", F.transform("_pieces", recipe)).drop("_pieces")


def exact_dedup(docs: DataFrame, identify=_narrow) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest doc_id stays. The group table has one row per
    distinct recipe, summed map-side; the rows of hot groups do not move to it.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = recipes(docs.select("doc_id", F.sha2(body, 256).alias("text_sha256"), "text"), identify=identify)
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return join_groups(rows, groups, "recipe", "group_size", rows.count()).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
