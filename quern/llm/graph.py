"""Connected components of an edge table, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.llm.common import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns u, v, any order) that is not its component's smallest node.

    Alternates large-star and small-star steps until the edges form stars
    around each component's smallest node. A step is a partial aggregation and
    a join on a node, so the many neighbours of a hub are summed before they
    move and adaptive execution may split them. Each round is cut by a written
    table. Self loops and repeats are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    ordered = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, path = materialize(ordered, "edges")
    mark = _mark(current)
    while mark[0]:
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(smallest, "u")
        small = met.select("u", F.col("m").alias("v")).union(met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after, new_path = materialize(small.distinct(), "edges")
        discard(spark, path)
        current, path, before, mark = after, new_path, mark, _mark(after)
        if mark == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
