"""Recursive queries that Spark SQL's WITH RECURSIVE (UNION ALL) cannot express."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from quern.operators.shared import dropped, written


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... UNION: rounds of step over the new rows until none is new; rows seen are not visited again.

    Each round appends a folder with its new rows in the shared folder, so no
    row is written twice, the plan stays short and lost executors recompute one
    round only.
    """
    spark = seed.sparkSession
    fresh, path = written(seed.distinct(), "seen")
    paths = [path]
    for _ in range(max_rounds):
        found = step(fresh).distinct()
        seen = spark.read.schema(fresh.schema).parquet(*paths)
        match = [seen[c].eqNullSafe(found[c]) for c in seed.columns]
        new, new_path = written(found.join(seen, match, "left_anti"), "seen")
        if new.isEmpty():
            dropped(spark, new_path)
            return seen
        fresh = new
        paths.append(new_path)
    raise RecursionError(f"no fixpoint after {max_rounds} rounds")


def recursive_using_key(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], key: Sequence[str], max_rounds: int = 1000) -> DataFrame:
    """WITH RECURSIVE ... USING KEY: step(new rows, all rows) may change a key's other columns; the last value stays.

    Of several rows of a key in one round the least in its other columns wins,
    in the order of the columns, nulls first. A round ends the recursion when
    it changes no row.
    """
    spark = seed.sparkSession
    rest = [c for c in seed.columns if c not in key]

    def winners(rows: DataFrame) -> DataFrame:
        if not rest:
            return rows.distinct()
        return rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__w")).select(*[F.col(c) if c in key else F.col("__w")[c].alias(c) for c in seed.columns])

    held, path = written(winners(seed), "held")
    fresh = held
    for _ in range(max_rounds):
        found = winners(step(fresh, held))
        match = [held[c].eqNullSafe(found[c]) for c in seed.columns]
        new, new_path = written(found.join(held, match, "left_anti"), "fresh")
        if new.isEmpty():
            dropped(spark, new_path)
            return held
        same = [held[c].eqNullSafe(new[c]) for c in key]
        after, after_path = written(held.join(new, same, "left_anti").unionByName(new), "held")
        fresh, held, old, path = new, after, path, after_path
        dropped(spark, old)
    raise RecursionError(f"no fixpoint after {max_rounds} rounds")


def reachable(edges: DataFrame, start: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """All nodes that the nodes of start (column node) reach."""
    hop = edges.select(F.col(source).alias("node"), F.col(target).alias("__next"))
    return recursive_union(start.select("node"), lambda new: new.join(hop, "node").select(F.col("__next").alias("node")))
