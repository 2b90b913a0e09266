"""Aggregates that Spark lacks or defines otherwise, as Column expressions for agg()."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.operators.shared import written


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: Values of a bucket differ by under 2**SPAN; the sum of one counts in units of 2**-53 of the least of them.
_SPAN, _UNIT = 8, 53


def fsum(df: DataFrame, keys: Sequence[str], values: dict[str, str | Column]) -> DataFrame:
    """keys, and for each name the compensated sum of its values and, as <name>_n, their number.

    A value counts as a whole multiple of a unit that follows from its
    exponent; such multiples are summed exactly by exponent, so neither the
    order of rows nor their partitions matter, and equal exponents cancel
    exactly. The few sums of a group (one for each _SPAN exponents) are then
    added with compensation. Infinities and NaN count as in a plain sum; no
    value gives null.
    """
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("__c"), _c(x).cast("double").alias("__x")) for n, x in values.items()]))
    x = F.col("__x")
    odd = F.isnan(x) | (F.abs(x) == float("inf"))
    bucket = F.when(x.isNotNull() & ~odd & (x != 0), F.floor(F.log2(F.abs(x)) / _SPAN).cast("int"))
    rows = df.select(*keys, named.alias("__v")).select(*keys, "__v.*").withColumn("__b", bucket)
    # Two factors, as one could overflow; both are powers of two, so the product is exact.
    power, half = _UNIT - _SPAN * F.col("__b"), F.floor((_UNIT - _SPAN * F.col("__b")) / 2)
    whole = (x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)).cast("long").cast("decimal(38,0)")
    exact = rows.groupBy(*keys, "__c", "__b").agg(F.sum(F.when(F.col("__b").isNotNull(), whole)).alias("__s"), F.sum(F.when(odd, x)).alias("__odd"), F.count("__x").alias("__n"))
    step = 1 << 50
    high = F.call_function("div", F.col("__s"), F.lit(step))
    low = (F.col("__s") - high.cast("decimal(20,0)") * F.lit(step).cast("decimal(16,0)")).cast("double")
    scale = lambda v: v * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - power)
    parts = exact.withColumns({"__hi": scale(high.cast("double") * float(step)), "__lo": scale(low)})
    terms = F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("__b").isNotNull(), F.struct("__b", "__hi", "__lo"))), asc=False), lambda t: F.array(t["__hi"], t["__lo"])))

    def add(acc: Column, v: Column) -> Column:
        total = acc["s"] + v
        lost = F.when(F.abs(acc["s"]) >= F.abs(v), (acc["s"] - total) + v).otherwise((v - total) + acc["s"])
        return F.struct(total.alias("s"), (acc["c"] + lost).alias("c"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))
    # A sum beyond the doubles is infinite; its compensation would be NaN.
    finite = F.aggregate(terms, start, add, lambda a: F.when(F.abs(a["s"]) == float("inf"), a["s"]).otherwise(a["s"] + a["c"]))
    summed = parts.groupBy(*keys, "__c").agg(finite.alias("__f"), F.sum("__odd").alias("__odd"), F.sum("__n").alias("__n"))
    value = F.when(F.col("__n") > 0, F.coalesce(F.col("__odd") + F.col("__f"), F.col("__f")))
    columns = [c for n in values for c in (F.max(F.when(F.col("__c") == n, F.struct(value.alias("v"))))["v"].alias(n), F.sum(F.when(F.col("__c") == n, F.col("__n"))).alias(f"{n}_n"))]
    return summed.groupBy(*keys).agg(*columns)


def favg(df: DataFrame, keys: Sequence[str], values: dict[str, str | Column]) -> DataFrame:
    """keys and the compensated means by name."""
    return fsum(df, keys, values).select(*keys, *[F.try_divide(F.col(n), F.col(f"{n}_n")).alias(n) for n in values])


def least_n(df: DataFrame, keys: Sequence[str], by: str | Column, n: int, name: str, arg: str | Column | None = None, descending: bool = False) -> DataFrame:
    """keys and the n least (or greatest) values as a list, or the args at them, ties by arg; nulls do not count.

    A group limit keeps n rows of a group before they move, so hot groups stay small.
    """
    value, what = _c(by), _c(by if arg is None else arg)
    rows = df.select(*keys, value.alias("__k"), what.alias("__v")).filter(F.col("__k").isNotNull())
    order = [F.desc("__k"), F.desc("__v")] if descending else [F.asc("__k"), F.asc("__v")]
    pairs = F.sort_array(F.collect_list(F.struct("__k", "__v")), asc=not descending)
    found = top_per_group(rows, keys, order, n).groupBy(*keys).agg(F.transform(pairs, lambda p: p["__v"]).alias(name))
    return df.select(*keys).distinct().alias("l").join(found.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left").select("l.*", F.col(f"r.{name}"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; a group limit below the exchange keeps hot groups small."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", place).filter(F.col("__n") <= n).drop("__n")


def ordered_list(x: str | Column, order: str | Column) -> Column:
    """list(x ORDER BY order), nulls kept."""
    return F.transform(F.sort_array(F.collect_list(F.struct(_c(order).alias("o"), _c(x).alias("v")))), lambda s: s["v"])


def string_agg(x: str | Column, separator: str, order: str | Column) -> Column:
    """string_agg(x, separator ORDER BY order), nulls skipped."""
    return F.array_join(ordered_list(x, order), separator)


def sem(x: str | Column) -> Column:
    """Standard error of the mean."""
    return F.stddev_pop(_c(x)) / F.sqrt(F.count(_c(x)))


def skewness(x: str | Column) -> Column:
    """Bias-corrected skewness; null for two values or fewer."""
    n = F.count(_c(x)).cast("double")
    return F.when(n > 2, F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2) * F.skewness(_c(x)))


def kurtosis(x: str | Column) -> Column:
    """Sample-corrected excess kurtosis; null for three values or fewer."""
    n = F.count(_c(x)).cast("double")
    return F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(_c(x)) + 6))


def geomean(x: str | Column) -> Column:
    return F.exp(F.avg(F.ln(_c(x))))


def weighted_avg(x: str | Column, w: str | Column) -> Column:
    both = _c(x).isNotNull() & _c(w).isNotNull()
    return F.sum(F.when(both, _c(x) * _c(w))) / F.sum(F.when(both, _c(w)))


def _per_value(df: DataFrame, keys: Sequence[str], x: Column) -> DataFrame:
    """Counts of distinct values by key: partial sums before any move."""
    return df.select(*keys, x.alias("__v")).filter(F.col("__v").isNotNull()).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n"))


def entropy(df: DataFrame, keys: Sequence[str], x: str | Column, name: str = "entropy") -> DataFrame:
    """log2 entropy of the value frequencies of each group, from counts of distinct values: H = log2(N) - sum(n log2 n) / N."""
    counts = _per_value(df, keys, _c(x)).withColumn("__n", F.col("__n").cast("double"))
    total = F.sum("__n")
    return counts.groupBy(*keys).agg((F.log2(total) - F.sum(F.col("__n") * F.log2("__n")) / total).alias(name))


def histogram(df: DataFrame, keys: Sequence[str], x: str | Column, name: str = "histogram") -> DataFrame:
    """A map of value counts for each group."""
    counts = _per_value(df, keys, _c(x))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("__v", "__n")))).alias(name))


def mode(df: DataFrame, keys: Sequence[str], x: str | Column, name: str = "mode") -> DataFrame:
    """The most frequent value, of equals the smallest."""
    counts = _per_value(df, keys, _c(x))
    order = Window.partitionBy(*keys).orderBy(F.desc("__n"), "__v")
    return counts.withColumn("__r", F.row_number().over(order)).filter("__r = 1").select(*keys, F.col("__v").alias(name))


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])


def _at_ranks(df: DataFrame, keys: Sequence[str], x: Column, ranks: Sequence[Callable[[Column], Column]]) -> DataFrame:
    """keys, __n (values) and __0, __1, ...: the values at 0-based ranks, which are functions of __n.

    Counts of distinct values are range-partitioned and written, so no task
    holds a group: totals by partition tell in which one a rank lies, and only
    the rows of such partitions are added up.
    """
    counts = df.select(*keys, x.alias("__v")).groupBy(*keys, "__v").agg(F.count("__v").alias("__c"))
    stored, _ = written(counts.repartitionByRange(*keys, "__v").withColumn("__p", F.spark_partition_id()), "quantiles")
    parts = stored.groupBy(*keys, "__p").agg(F.sum("__c").alias("__s"))
    group = Window.partitionBy(*keys)
    parts = parts.withColumn("__n", F.sum("__s").over(group)).withColumn("__before", F.sum("__s").over(group.orderBy("__p")) - F.col("__s"))
    wanted = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), (rank(F.col("__n")).cast("long") - F.col("__before")).alias("at")) for i, rank in enumerate(ranks)]), lambda w: (w["at"] >= 0) & (w["at"] < F.col("__s")))
    targets = parts.select(*keys, "__p", wanted.alias("__w")).filter(F.size("__w") > 0)
    near = stored.alias("l").join(targets.alias("r"), _same([*keys, "__p"])).select("l.*", "__w")
    run = F.sum("__c").over(Window.partitionBy(*keys, "__p").orderBy("__v"))
    hits = near.withColumn("__to", run).select(*keys, "__v", F.explode(F.filter("__w", lambda w: (w["at"] < F.col("__to")) & (w["at"] >= F.col("__to") - F.col("__c")))["i"]).alias("__i"))
    found = hits.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == i, F.col("__v"))).alias(f"__{i}") for i in range(len(ranks))])
    totals = parts.groupBy(*keys).agg(F.max("__n").alias("__n"))
    return totals.alias("l").join(found.alias("r"), _same(keys), "left").select("l.*", *[F.col(f"r.__{i}") for i in range(len(ranks))])


def quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str | Column, float]], discrete: Sequence[str] = ()) -> DataFrame:
    """keys and the exact quantiles by name, (values, share): interpolated as doubles, those named in `discrete` a value that there is; nulls do not count."""
    out: DataFrame | None = None
    for x in dict.fromkeys(str(_c(x)) for x, _ in wanted.values()):
        mine = {n: (_c(v), q) for n, (v, q) in wanted.items() if str(_c(v)) == x}
        ranks: list[Callable[[Column], Column]] = []
        for name, (_, q) in mine.items():
            if name in discrete:
                ranks += [lambda n, q=q: F.greatest(F.ceil(n * F.lit(q)) - 1, F.lit(0))] * 2
            else:
                ranks += [lambda n, q=q: F.floor((n - 1) * F.lit(q)), lambda n, q=q: F.ceil((n - 1) * F.lit(q))]
        found = _at_ranks(df, keys, next(iter(mine.values()))[0], ranks)
        columns = []
        for i, (name, (_, q)) in enumerate(mine.items()):
            low, high, place = F.col(f"__{2 * i}"), F.col(f"__{2 * i + 1}"), (F.col("__n") - 1) * F.lit(q)
            between = F.when(low == high, low.cast("double")).otherwise(low + (high - low) * (place - F.floor(place)))
            columns.append((low if name in discrete else between).alias(name))
        part = found.select(*keys, *columns)
        out = part if out is None else out.alias("l").join(part.alias("r"), _same(keys)).select("l.*", *[F.col(f"r.{n}") for n in mine])
    return out.select(*keys, *wanted)


def mad(df: DataFrame, keys: Sequence[str], x: str | Column, name: str = "mad") -> DataFrame:
    """Median absolute deviation: medians by key, joined back, then the median of distances."""
    values = df.select(*keys, _c(x).alias("__v"))
    middle = quantiles(values, keys, {"__m": ("__v", 0.5)})
    far = values.alias("l").join(middle.alias("r"), _same(keys)).select(*[F.col(f"l.{k}").alias(k) for k in keys], F.abs(F.col("__v") - F.col("__m")).alias("__d"))
    return quantiles(far, keys, {name: ("__d", 0.5)})


def binned_histogram(df: DataFrame, x: str | Column, bins: Sequence[float]) -> DataFrame:
    """(bin, n): counts by the least upper bound that is not below the value; empty bins count 0, values above all go to infinity if there are any."""
    edges = sorted(set(map(float, bins)))
    value = _c(x).cast("double")
    found = df.filter(value.isNotNull()).select(F.coalesce(F.array_min(F.filter(F.lit(edges), lambda b: b >= value)), F.lit(float("inf"))).alias("bin"))
    counts = found.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    empty = df.sparkSession.createDataFrame([(b, 0) for b in edges], "bin double, n long")
    return counts.unionByName(empty).groupBy("bin").agg(F.sum("n").alias("n"))
