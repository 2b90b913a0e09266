"""Window features without Spark syntax: GROUPS frames, EXCLUDE, DISTINCT and FILTER aggregates, variable offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def groups_frame(df: DataFrame, partition: Sequence[str], order: Sequence[Column], start: int, end: int, **aggregates: Column) -> DataFrame:
    """GROUPS BETWEEN start AND end peer groups: RANGE over the dense rank."""
    ranked = df.withColumn("__g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    w = Window.partitionBy(*partition).orderBy("__g").rangeBetween(start, end)
    return ranked.select(*df.columns, *[a.over(w).alias(n) for n, a in aggregates.items()])


def count_excluding(value: Column, frame: WindowSpec, exclude: str, peers: WindowSpec) -> Column:
    """count(value) OVER (frame EXCLUDE CURRENT ROW, GROUP or TIES), for frames that hold the row and its peers; `peers`: the row's peer group."""
    return _rest(F.when(value.isNotNull(), F.lit(1)).otherwise(F.lit(0)), frame, exclude, peers).cast("long")


def sum_excluding(value: Column, frame: WindowSpec, exclude: str, peers: WindowSpec, exact: bool = False) -> Column:
    """sum(value) OVER (frame EXCLUDE ...), for the same frames: null where no value is left.

    Infinities and NaN are counted apart, so a row does not lose its sum
    because an excluded row held one. exact: for integers and decimals, which
    have neither.
    """
    some = count_excluding(value, frame, exclude, peers) > 0
    if exact:
        return F.when(some, _rest(F.coalesce(value, F.lit(0)), frame, exclude, peers))
    whole = value.cast("double")
    odd = {"nan": F.isnan(whole), "up": whole == float("inf"), "down": whole == -float("inf")}
    any_odd = F.coalesce(odd["nan"] | odd["up"] | odd["down"], F.lit(False))
    total = _rest(F.when(~any_odd, F.coalesce(value, F.lit(0))).otherwise(F.lit(0)), frame, exclude, peers)
    left = {k: _rest(F.when(F.coalesce(c, F.lit(False)), F.lit(1)).otherwise(F.lit(0)), frame, exclude, peers) > 0 for k, c in odd.items()}
    nan = left["nan"] | (left["up"] & left["down"])
    out = F.when(nan, F.lit(float("nan"))).when(left["up"], F.lit(float("inf"))).when(left["down"], F.lit(-float("inf"))).otherwise(total)
    return F.when(some, out)


def _rest(x: Column, frame: WindowSpec, exclude: str, peers: WindowSpec) -> Column:
    total = F.sum(x).over(frame)
    return {"CURRENT ROW": total - x, "GROUP": total - F.sum(x).over(peers), "TIES": total - F.sum(x).over(peers) + x}[exclude]


def frame_excluding(value: Column, place: Column, group: Column, frame: WindowSpec, exclude: str) -> Column:
    """The values of any frame with EXCLUDE as an array, nulls kept, for whichever list function follows; gathers the frame.

    place tells the rows of a partition apart, group their peer groups.
    """
    rows = F.collect_list(F.struct(place.alias("p"), group.alias("g"), value.alias("v"))).over(frame)
    stays = {
        "CURRENT ROW": lambda r: ~r["p"].eqNullSafe(place),
        "GROUP": lambda r: ~r["g"].eqNullSafe(group),
        "TIES": lambda r: ~r["g"].eqNullSafe(group) | r["p"].eqNullSafe(place),
    }[exclude]
    return F.transform(F.filter(rows, stays), lambda r: r["v"])


def count_distinct_over(value: Column, window) -> Column:
    """count(DISTINCT value) OVER window."""
    return F.size(F.collect_set(value).over(window)).cast("long")


def filtered_over(aggregate, value: Column, condition: Column, window) -> Column:
    """aggregate(value) FILTER (WHERE condition) OVER window."""
    return aggregate(F.when(condition, value)).over(window)


def lag_by(df: DataFrame, partition: Sequence[str], order: Sequence[Column], value: str, offset: Column, name: str) -> DataFrame:
    """lag(value, offset) with an offset of its own for each row: an equi-join on the row's place."""
    w = Window.partitionBy(*partition).orderBy(*order)
    placed = df.withColumn("__n", F.row_number().over(w))
    other = placed.select(*partition, F.col("__n").alias("__o"), F.col(value).alias(name))
    asked = placed.withColumn("__o", (F.col("__n") - offset).cast("int"))
    return asked.join(other, [*partition, "__o"], "left").drop("__n", "__o")
