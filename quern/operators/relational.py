"""Relational helpers for what Spark SQL has no clause for."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_ROW = "__quern_row"


def distinct_on(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """DISTINCT ON: the first row of each key in the given order.

    row_number = 1 lets Catalyst push a group limit below the exchange, so a
    hot key sends one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(_ROW, rank).filter(F.col(_ROW) == 1).drop(_ROW)


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """QUALIFY: filter on a condition that holds window functions."""
    return df.withColumn(_ROW, condition).filter(F.col(_ROW)).drop(_ROW)


def limit_percent(df: DataFrame, percent: float, order: Sequence[Column]) -> DataFrame:
    """LIMIT p%: the first floor(n * p / 100) rows; the count is one aggregate, the limit a top-n."""
    return df.orderBy(*order).limit(int(df.count() * percent / 100))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """UNION ALL BY NAME: missing columns are null."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def reservoir(df: DataFrame, n: int, seed: int) -> DataFrame:
    """USING SAMPLE n ROWS: n random rows by a distributed top-n on a seeded random key."""
    return df.orderBy(F.rand(seed)).limit(n)


def bernoulli(df: DataFrame, percent: float, seed: int) -> DataFrame:
    """USING SAMPLE p% (BERNOULLI)."""
    return df.sample(fraction=percent / 100, seed=seed)


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence[Column], right_order: Sequence[Column]) -> DataFrame:
    """Row i with row i in the given orders, padded with nulls.

    Spark rows have no place, so orders are explicit. Places come from
    `numbered`, without a single-partition window.
    """
    a, b = numbered(left, left_order, "__l"), numbered(right, right_order, "__r")
    return a.join(b, F.col("__l") == F.col("__r"), "full").drop("__l", "__r")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds the 1-based place in the order.

    Range partitioning orders the partitions; the driver gets one count per
    partition, and a row's place is its partition's base plus its place inside.
    The ranged rows are checkpointed so that both passes see the same partitions.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        from quern.operators.shared import shared_dir

        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = ranged.withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("__id", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    bases, total = {}, 0
    for p in sorted(counts):
        bases[p] = total
        total += counts[p]
    if not bases:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("__id")
    base = F.create_map(*[F.lit(x) for kv in bases.items() for x in kv])[part]
    return placed.withColumn(name, (base + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("__id")


def pivot(df: DataFrame, keys: Sequence[str], on: str, values: Sequence, **aggregates: Column) -> DataFrame:
    """PIVOT with a known value list (one pass). Absent cells: counts, named `n...`, are 0, the rest null."""
    out = df.groupBy(*keys).pivot(on, list(values)).agg(*[c.alias(a) for a, c in aggregates.items()])
    if len(aggregates) == 1:
        only = next(iter(aggregates))
        return out.fillna(0) if only.startswith("n") else out
    counted = [c for c in out.columns if any(c.endswith(f"_{a}") for a in aggregates if a.startswith("n"))]
    return out.fillna(0, counted)


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "name", value: str = "value", include_nulls: bool = False) -> DataFrame:
    """UNPIVOT: a row for each column; null cells are left out unless included."""
    out = df.unpivot([F.col(k) for k in keys], [F.col(c) for c in columns], name, value)
    return out if include_nulls else out.filter(F.col(value).isNotNull())


def summarize(df: DataFrame) -> DataFrame:
    """SUMMARIZE: for every column its type, extremes, approximate distinct count, average, deviation, quartiles, count and nulls, in one pass."""
    numbers = {f for f, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    parts = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        number = name in numbers
        none = F.lit(None).cast("double")
        quartiles = F.percentile_approx(c.cast("double"), [0.25, 0.5, 0.75], 10_000) if number else F.lit(None).cast("array<double>")
        parts.append(
            F.struct(
                F.lit(name).alias("column_name"), F.lit(kind).alias("column_type"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"),
                F.approx_count_distinct(c).alias("approx_unique"), (F.avg(c) if number else none).alias("avg"), (F.stddev_samp(c) if number else none).alias("std"),
                quartiles.alias("quartiles"), F.count(F.lit(1)).alias("count"), (100.0 * F.count_if(c.isNull()) / F.count(F.lit(1))).alias("null_percentage"),
            )
        )
    rows = df.agg(F.array(*parts).alias("r")).select(F.inline("r"))
    q = F.col("quartiles")
    return rows.select("column_name", "column_type", "min", "max", "approx_unique", "avg", "std", q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), "count", "null_percentage")


def exclude(df: DataFrame, *names: str) -> DataFrame:
    """* EXCLUDE (names)."""
    return df.drop(*names)


def replace(df: DataFrame, **columns: Column) -> DataFrame:
    """* REPLACE (expression AS name), in place."""
    return df.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def columns(df: DataFrame, pattern: str) -> list[Column]:
    """COLUMNS('regex'), as a list to select or map over."""
    import re

    return [F.col(f"`{c}`") for c in df.columns if re.search(pattern, c)]


def explode_zipped(df: DataFrame, keys: Iterable[str], **lists: Column) -> DataFrame:
    """Several UNNESTs in one select: lists side by side, the shorter padded with null."""
    zipped = F.arrays_zip(*[c.alias(n) for n, c in lists.items()])
    return df.select(*keys, F.inline(zipped).alias(*lists))
