"""Document fingerprints by SimHash (DataFrame functions only).

Terms are pairs of neighbouring lower-cased words; the hash of a term votes
with the term's weight, its number of occurrences, on each of 64 signed bits.
`neighbours` finds all fingerprints within a Hamming radius through permuted
block tables; the query asks it for every document whose id is divisible by 50.

Defined results: null counts as empty; a text without words has fingerprint 0.
Equal texts have equal fingerprints. doc_id may have any type that sorts, with
any spread. Rows that repeat a doc_id are rows of their own, ordered by a hash
of their text; null doc_ids come first. With one document the next document is
itself. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from quern.llm.common import hex16, lanes, majority, materialize, words

#: Bytes of text in a sort bucket that the bounds aim at, buckets at most, and sampled rows a bucket, of which every such one is a bound.
BUCKET_BYTES, MAX_BUCKETS, SAMPLED = 4 << 20, 1 << 16, 8
#: Documents whose id this divides ask for their neighbours.
ASKING = 50
#: Permuted tables: six blocks, of which radius may differ and the others are the key.
BLOCKS, RADIUS = 6, 3


def terms(w: Column) -> Column:
    """Array of structs of two neighbouring words, from a column of words; a single word is one, no word none."""
    size = F.size(w)
    pairs = F.arrays_zip(*[F.slice(w, i + 1, F.greatest(size - 1, F.lit(0))).alias(f"w{i}") for i in range(2)])
    single = F.array(F.struct(w[0].alias("w0"), F.lit(None).cast("string").alias("w1")))
    return F.when(w[0] == "", F.filter(single, lambda _: F.lit(False))).when(size < 2, single).otherwise(pairs)


def fingerprint_by(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and `fp` (long) of the texts with those keys; needs no exchange where rows are clustered by a key."""
    split = rows.select(*keys, words(F.lower(F.coalesce(F.col(text), F.lit("")))).alias("w"))
    hashed = split.select(*keys, F.explode_outer(terms(F.col("w"))).alias("t")).select(*keys, F.when(F.col("t").isNotNull(), F.xxhash64("t.w0", "t.w1")).alias("h"))
    counted = hashed.groupBy(*keys).agg(F.count("h").alias("n"), *[F.sum(x).alias(f"c{i}") for i, x in enumerate(lanes(F.col("h")))])
    fp = F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(majority([F.col(f"c{i}") for i in range(32)], F.col("n")))
    return counted.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def ordered_buckets(body: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> Column:
    """An int that never falls as (doc_id, th) grows, with about bucket_bytes of text for each value.

    body: doc_id, th, text. The bounds come from a sample of at most
    2 * SAMPLED * MAX_BUCKETS rows, in which a row stands in proportion to its
    bytes; one task sorts it and the driver gets one row a bucket. Each row
    finds its place by bisection. Ids are only compared, so they may have any
    type.
    """
    n = F.octet_length("text").cast("long")
    rows, size = body.agg(F.count(F.lit(1)), F.sum(n)).first()
    buckets = min(MAX_BUCKETS, (size or 0) // bucket_bytes, rows)
    if buckets < 2:
        return F.lit(0)
    wanted, scale = SAMPLED * buckets, 1 << 30
    share = n.cast("double") * (wanted * scale / size)
    sampled = body.filter(F.pmod(F.xxhash64("doc_id", "th", F.lit(9)), F.lit(scale)) < share).select(F.struct("doc_id", "th").alias("at")).limit(2 * wanted)
    found = sampled.agg(F.filter(F.sort_array(F.collect_list("at")), lambda _, i: i % SAMPLED == SAMPLED - 1).alias("edges")).first()["edges"]
    if not found:
        return F.lit(0)
    kind = body.schema["doc_id"].dataType
    ids, hashes = F.lit([e["doc_id"] for e in found]).cast(ArrayType(kind)), F.lit([e["th"] for e in found]).cast("array<bigint>")
    # Two literals, of which a step reads one place each: zipped, they would be copied whole at every step of every row.
    edge, value = lambda at: F.struct(F.get(ids, at).alias("doc_id"), F.get(hashes, at).alias("th")), F.struct("doc_id", "th")
    steps = F.lit([1 << i for i in range(len(found).bit_length() - 1, -1, -1)]).cast("array<int>")
    beyond = lambda at: at >= len(found)
    return F.aggregate(steps, F.lit(0), lambda place, step: F.when(~beyond(place + step - 1) & (edge(place + step - 1) <= value), place + step).otherwise(place))


def with_next(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """bucket, rn (together a row's key), doc_id, text, next_text, next_bucket, next_rn, in ascending doc_id, the last followed by the first.

    Texts cross the network once, to their bucket; the first text of each bucket goes to the bucket before.
    """
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    dealt = body.withColumn("bucket", ordered_buckets(body, bucket_bytes))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "th")
    rows = dealt.withColumns({"rn": F.row_number().over(order), "lead_text": F.lead("text").over(order)})
    firsts = rows.filter("rn = 1").select("bucket", F.col("text").alias("first_text"))
    # One row a bucket, at most 2 * MAX_BUCKETS and one: small enough for one task.
    chain = Window.orderBy("bucket")
    known = dealt.groupBy("bucket").agg(F.lit(1).alias("one"))
    linked = known.select("bucket", F.coalesce(F.lead("bucket").over(chain), F.min("bucket").over(Window.partitionBy(F.lit(1)))).alias("next_bucket"))
    # The texts of as many rows as there are buckets: never broadcast.
    ends = linked.join(firsts.withColumnRenamed("bucket", "next_bucket").hint("merge"), "next_bucket")
    last = F.col("lead_text").isNull()
    return rows.join(ends.hint("merge"), "bucket").select(
        "bucket", "rn", "doc_id", "text", F.coalesce("lead_text", "first_text").alias("next_text"),
        F.when(last, F.col("next_bucket")).otherwise(F.col("bucket")).alias("next_bucket"), F.when(last, F.lit(1)).otherwise(F.col("rn") + 1).alias("next_rn"),
    )


def fingerprint_documents(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, radius: int = RADIUS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, neighbours of every document.

    The edited text has its last floor(n / 2) code points replaced by as many
    of the next document's first ones, or all of them. neighbours is the number
    of other fingerprints of the table within `radius` bits, for documents
    whose id ASKING divides; null for the others.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs, bucket_bytes).select(
        "bucket", "rn", "doc_id", "next_bucket", "next_rn", n.cast("long").alias("n_chars"), "text",
        F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)).alias("edited"),
    )
    both = rows.select(
        "bucket", "rn",
        F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))).alias("b"),
    ).select("bucket", "rn", "b.kind", "b.body")
    voted = fingerprint_by(both, ["bucket", "rn", "kind"], "body")
    found = voted.groupBy("bucket", "rn").agg(*[F.max(F.when(F.col("kind") == k, F.col("fp"))).alias(c) for k, c in enumerate(("fp", "edited_fp"))])
    about = rows.select("bucket", "rn", "doc_id", "next_bucket", "next_rn", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    asks = F.coalesce(F.col("doc_id").try_cast("long") % ASKING == 0, F.lit(False)).alias("asks")
    # A written table: its fingerprints are read three times below.
    table, _ = materialize(about.join(found, ["bucket", "rn"]).select("*", asks), "fingerprints")
    following = table.select(F.col("bucket").alias("next_bucket"), F.col("rn").alias("next_rn"), F.col("fp").alias("next_fp"))
    asking = table.filter("asks").select("fp").distinct()
    near = neighbours(asking, table, radius).filter("distance > 0").groupBy("query").agg(F.count(F.lit(1)).alias("others"))
    counts = asking.join(near, asking["fp"] == near["query"], "left").select(F.lit(True).alias("asks"), F.col("fp").alias("key"), F.coalesce("others", F.lit(0).cast("long")).alias("neighbours"))
    # Rows that do not ask get keys of their own, so that they spread.
    keyed = table.withColumn("key", F.when(F.col("asks"), F.col("fp")).otherwise(F.xxhash64("bucket", "rn")))
    return keyed.join(following, ["next_bucket", "next_rn"]).join(counts, ["asks", "key"], "left").select(
        "doc_id", "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "neighbours",
    )


def _block_masks(blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def block_tables(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fps (column fp) once for each permuted table: table (a bit for each block of its key), key (the bits of these blocks), fp."""
    masks = _block_masks(blocks)
    tables = [F.struct(F.lit(sum(1 << b for b in chosen)).alias("table"), F.lit(_signed(sum(masks[b] for b in chosen))).cast("long").alias("mask")) for chosen in combinations(range(blocks), blocks - radius)]
    return fps.select("fp", F.explode(F.array(*tables)).alias("t")).select(F.col("t.table").alias("table"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"), "fp")


def neighbours(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fp, distance) for all distinct fingerprints of fps within radius of a distinct query (columns fp).

    At most `radius` blocks differ, so the others agree in one of the tables.
    A pair counts in the table of its first equal blocks, and only there.
    """
    asked = block_tables(queries.select("fp").distinct(), radius, blocks).withColumnRenamed("fp", "query").alias("a")
    held = block_tables(fps.select("fp").distinct(), radius, blocks).alias("b")
    differ = F.col("query").bitwiseXOR(F.col("fp"))
    equal = F.lit(0)
    for b, mask in enumerate(_block_masks(blocks)):
        equal = equal + F.when(differ.bitwiseAND(F.lit(_signed(mask))) == 0, F.lit(1 << b)).otherwise(F.lit(0))
    first, rest = F.lit(0), equal
    for _ in range(blocks - radius):
        lowest = rest.bitwiseAND(-rest)
        first, rest = first + lowest, rest - lowest
    meets = (F.col("a.table") == F.col("b.table")) & (F.col("a.key") == F.col("b.key")) & (F.bit_count(differ) <= radius) & (first == F.col("a.table"))
    return asked.join(held, meets).select("query", "fp", F.bit_count(differ).alias("distance"))
