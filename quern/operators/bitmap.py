"""Bitmap indexes as tables: (index_name, value, bucket, bits), 32 768 row ids a bucket.

A predicate on an indexed column is a union of a few stored bit vectors; AND
and OR of predicates are aggregations by bucket, a count is a popcount. Row ids
are 1-based surrogate keys of the base table: id = (bucket - 1) * 32768 +
position + 1. Buckets spread an index over the cluster; a value's vector is
never in one place.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quern.operators.relational import numbered

BUCKET = 32_768


def with_row_ids(df: DataFrame, order: list[Column], name: str = "rid") -> DataFrame:
    """The base table with a 1-based row id, its place in a stable order."""
    return numbered(df, order, name)


def build(base: DataFrame, index: str, code: Column, rid: str = "rid") -> DataFrame:
    """Equality encoding: one bit vector a value code. For group encoding, pass the group's code (a month, a bin)."""
    parts = base.select(code.cast("long").alias("value"), F.expr(f"bitmap_bucket_number({rid})").alias("bucket"), F.expr(f"bitmap_bit_position({rid})").alias("position"))
    # Rows move by bucket and meet in the order (bucket, value): their vectors are made one at a time, where OR by bucket finds them.
    found = parts.filter(F.col("value").isNotNull()).repartition("bucket").groupBy("bucket", "value").agg(F.bitmap_construct_agg("position").alias("bits"))
    return found.select(F.lit(index).alias("index_name"), "value", "bucket", "bits")


def range_or(index: DataFrame, start: int, count: int) -> DataFrame:
    """OR of `count` consecutive vectors: (bucket, bits)."""
    return index.filter(F.col("value").between(start, start + count - 1)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def value_or(index: DataFrame, values: DataFrame) -> DataFrame:
    """OR of the vectors of all values in a table (column value): a join on a foreign key as a predicate."""
    return index.join(values.select("value").distinct(), "value", "left_semi").groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def conjunction(*selections: DataFrame) -> DataFrame:
    """AND: buckets that a selection lacks are all zero, so only buckets of every selection count."""
    tagged = [s.withColumn("k", F.lit(i)) for i, s in enumerate(selections)]
    merged = reduce(DataFrame.unionByName, tagged).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bitmap_and_agg("bits").alias("bits"))
    return merged.filter(F.col("n") == len(selections)).select("bucket", "bits")


def disjunction(*selections: DataFrame) -> DataFrame:
    """OR of selections."""
    return reduce(DataFrame.unionByName, selections).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def count(selection: DataFrame) -> DataFrame:
    """Number of set bits, one row."""
    return selection.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def row_ids(selection: DataFrame, rid: str = "rid") -> DataFrame:
    """The ids of set bits: bytes that are zero are skipped, a byte's bits are tested one by one."""
    size = BUCKET // 8
    octets = selection.select("bucket", F.hex("bits").alias("h")).select("bucket", F.posexplode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.struct(i.alias("i"), F.substring("h", i * 2 + 1, F.lit(2)).alias("b"))), lambda s: s["b"] != "00")).alias("p", "s"))
    byte = F.conv(F.col("s.b"), 16, 10).cast("int")
    bits = octets.select("bucket", F.col("s.i").alias("i"), byte.alias("byte"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).filter(F.col("byte").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("bit"))) != 0)
    return bits.select(((F.col("bucket") - 1) * BUCKET + F.col("i") * 8 + F.col("bit") + 1).alias(rid))


def fetch(base: DataFrame, selection: DataFrame, columns: Iterable[str], rid: str = "rid") -> DataFrame:
    """Only the wanted columns of the selected rows."""
    return base.select(rid, *columns).join(row_ids(selection, rid), rid, "left_semi").drop(rid)


def apply_changes(index: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """An index after changes: removed and added are indexes of the old and new codes of the changed rows.

    Only buckets that a change touches are computed anew; the others pass.
    """
    keys = ["index_name", "value", "bucket"]
    zero = F.lit(bytes(BUCKET // 8))
    touched = index.withColumn("kind", F.lit(0)).unionByName(removed.withColumn("kind", F.lit(1))).unionByName(added.withColumn("kind", F.lit(2)))
    sides = touched.groupBy(*keys).agg(*[F.bitmap_or_agg(F.when(F.col("kind") == k, F.col("bits")).otherwise(zero)).alias(n) for k, n in enumerate(("old", "gone", "new"))])
    # old AND NOT gone is old XOR (old AND gone), byte by byte in hex pairs.
    def pairs(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BUCKET // 32 - 1)), lambda i: F.conv(F.substring(F.hex(c), i * 8 + 1, F.lit(8)), 16, 10).cast("long"))

    left = F.zip_with(pairs("old"), pairs("gone"), lambda a, b: a.bitwiseXOR(a.bitwiseAND(b)))
    merged = F.zip_with(left, pairs("new"), lambda a, b: a.bitwiseOR(b))
    bits = F.unhex(F.array_join(F.transform(merged, lambda v: F.lpad(F.hex(v), 8, "0")), ""))
    return sides.select(*keys, bits.alias("bits")).filter(F.bitmap_count("bits") > 0)
