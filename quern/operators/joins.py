"""As-of and range joins as DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_key: str, right_key: str, how: str = "left", op: str = ">=") -> DataFrame:
    """Each left row with the nearest right row: the largest right key with left_key >= right_key (or >, and mirrored for <= and <).

    One exchange on `on` carries both sides; a window takes the last right row
    before each left row. Null keys never match: kept by left, dropped by
    inner. `right`'s columns other than `on` must not be columns of `left`.
    Without `on` the sort has no partitions to spread over; give one where the
    data are large.
    """
    payload = [c for c in right.columns if c not in on]
    forward = op in (">=", ">")
    side = F.lit(0 if op in (">=", "<=") else 2)
    lefts = left.select(*[F.col(c).alias(c) for c in on], F.col(left_key).alias("__k"), F.lit(1).alias("__s"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType).alias("__r"))
    known = right.filter(F.col(right_key).isNotNull())
    rights = known.select(*on, F.col(right_key).alias("__k"), side.alias("__s"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"), F.struct(*payload).alias("__r"))
    order = [F.col("__k").asc() if forward else F.col("__k").desc(), F.col("__s").asc()]
    w = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    matched = lefts.filter(F.col("__k").isNotNull()).union(rights).withColumn("__m", F.last("__r", ignorenulls=True).over(w)).filter(F.col("__l").isNotNull())
    out = matched.select("__l.*", *[F.col(f"__m.{c}").alias(c) for c in payload])
    if how == "inner":
        return out.filter(F.col(right_key).isNotNull())
    nulls = left.filter(F.col(left_key).isNull())
    return out.unionByName(nulls, allowMissingColumns=True)


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, on: Sequence[str] = ()) -> DataFrame:
    """Rows with low <= point <= high, as an equi-join on buckets of `width`.

    Intervals are listed under every bucket they touch, points have one, so no
    pair is missed or doubled; choose a width near the intervals' length.
    """
    cell = lambda c: F.floor(c.cast("double") / width).cast("long")
    points = left.withColumn("__b", cell(F.col(point)))
    spans = right.filter(F.col(low) <= F.col(high)).withColumn("__b", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    joined = points.join(spans, [*on, "__b"])
    return joined.filter((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__b")


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float, on: Sequence[str] = ()) -> DataFrame:
    """Pairs of closed intervals that overlap (two range predicates).

    Both sides are listed under the buckets they touch; a pair counts in the
    bucket where the later of the two begins, and only there.
    """
    cell = lambda c: F.floor(c.cast("double") / width).cast("long")
    (a, b), (c, d) = left_span, right_span
    cells = lambda df, lo, hi: df.filter(F.col(lo) <= F.col(hi)).withColumn("__b", F.explode(F.sequence(cell(F.col(lo)), cell(F.col(hi)))))
    joined = cells(left, a, b).join(cells(right, c, d), [*on, "__b"])
    meets = (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b))
    return joined.filter(meets & (F.col("__b") == F.greatest(cell(F.col(a)), cell(F.col(c))))).drop("__b")


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], salts: int, how: str = "inner") -> DataFrame:
    """Equi-join whose left keys may be hot: left rows are dealt over `salts` by a hash of all their columns, right rows repeated for each.

    Right rows without a partner (right and full joins) come once, from an anti
    join on the left side's distinct keys. Rows equal in all columns share a salt.
    """
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"no salted join of kind {how}")
    a = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    b = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = a.join(b, [*on, "__salt"], "left" if how in ("left", "full") else "inner").drop("__salt")
    if how in ("inner", "left"):
        return met
    alone = right.join(left.select(*on).distinct(), list(on), "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


def any_match(value: Column, op: str, low: Column, high: Column, count: Column, nulls: Column) -> Column:
    """`value op ANY (subquery)` from the subquery's min, max, count and null count."""
    hit = {"<": value < high, "<=": value <= high, ">": value > low, ">=": value >= low}[op]
    return F.when(F.coalesce(count, F.lit(0)) == 0, F.lit(False)).when(hit, F.lit(True)).when(nulls > 0, F.lit(None)).otherwise(hit)


def all_match(value: Column, op: str, low: Column, high: Column, count: Column, nulls: Column) -> Column:
    """`value op ALL (subquery)` from the subquery's min, max, count and null count."""
    hit = {"<": value < low, "<=": value <= low, ">": value > high, ">=": value >= high}[op]
    return F.when(F.coalesce(count, F.lit(0)) == 0, F.lit(True)).when(~hit, F.lit(False)).when(nulls > 0, F.lit(None)).otherwise(hit)
