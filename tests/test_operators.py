"""Operators on small tables with nulls, ties, repeats and empty sides."""

import pytest
from pyspark.sql import Window, functions as F

from quern.operators import bitmap as B, dml, windows as W
from quern.operators.joins import all_match, any_match, asof_join, overlap_join, range_join, salted_join
from quern.operators.recursive import reachable, recursive_union
from quern.operators.relational import distinct_on, limit_percent, numbered, pivot, positional_join, summarize, unpivot


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_asof_null_keys_and_directions(spark):
    left = spark.createDataFrame([(1, 0), (1, 3), (1, 9), (1, None), (2, 5)], "g int, t int")
    right = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, None, "n"), (1, 8, "c")], "g int, u int, v string")
    assert got(asof_join(left, right, ["g"], "t", "u").select("g", "t", "v")) == sorted([(1, 0, None), (1, 3, "b"), (1, 9, "c"), (1, None, None), (2, 5, None)], key=repr)
    assert got(asof_join(left, right, ["g"], "t", "u", "inner").select("t", "v")) == sorted([(3, "b"), (9, "c")], key=repr)
    assert got(asof_join(left, right, ["g"], "t", "u", "inner", ">").select("t", "v")) == sorted([(3, "a"), (9, "c")], key=repr)
    assert got(asof_join(left, right, ["g"], "t", "u", "inner", "<=").select("t", "v")) == sorted([(0, "a"), (3, "b")], key=repr)
    assert got(asof_join(left, right, ["g"], "t", "u", "inner", "<").select("t", "v")) == sorted([(0, "a"), (3, "c")], key=repr)


def test_range_and_overlap_joins_equal_nested_loops(spark):
    import random

    random.seed(1)
    points = spark.createDataFrame([(i, random.randint(-50, 200)) for i in range(60)] + [(99, None)], "id int, t int")
    spans = spark.createDataFrame([(i, a, a + random.randint(-3, 40)) for i in range(50) for a in [random.randint(-50, 200)]], "sid int, lo int, hi int")
    want = got(points.join(spans, (F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi"))).select("id", "sid"))
    assert got(range_join(points, spans, "t", "lo", "hi", 16).select("id", "sid")) == want
    other = spans.select(F.col("sid").alias("o"), (F.col("lo") + 7).alias("a"), (F.col("hi") + 7).alias("b"))
    proper = spans.filter("lo <= hi"), other.filter("a <= b")
    want = got(proper[0].join(proper[1], (F.col("lo") <= F.col("b")) & (F.col("a") <= F.col("hi"))).select("sid", "o"))
    assert got(overlap_join(spans, other, ("lo", "hi"), ("a", "b"), 16).select("sid", "o")) == want


def test_salted_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("hot", "x"), ("cold", "y"), ("none", "z")], "k string, w string")
    for how in ("inner", "left", "right", "full"):
        assert got(salted_join(left, right, ["k"], 4, how).select("k", "v", "w")) == got(left.join(right, "k", how).select("k", "v", "w"))
    with pytest.raises(ValueError):
        salted_join(left, right, ["k"], 4, "left_anti")


@pytest.mark.parametrize(("values", "op", "any_", "all_"), [([1, 5], ">", True, False), ([], ">", False, True), ([1, None], ">", True, None), ([5, None], ">", None, False), ([5], ">", False, False)])
def test_any_all(spark, values, op, any_, all_):
    stats = spark.createDataFrame([(v,) for v in values], "x int").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("c"), F.count_if(F.col("x").isNull()).alias("z"))
    args = F.lit(3), op, F.col("lo"), F.col("hi"), F.col("c"), F.col("z")
    assert tuple(stats.select(any_match(*args), all_match(*args)).first()) == (any_, all_)


def test_positions(spark):
    a = spark.createDataFrame([(i,) for i in (5, 3, 3, 1)], "x int")
    b = spark.createDataFrame([("p",), ("q",)], "y string")
    assert got(positional_join(a, b, [F.col("x")], [F.col("y")])) == sorted([(1, "p"), (3, "q"), (3, None), (5, None)], key=repr)
    assert [r["n"] for r in numbered(a, [F.col("x")], "n").orderBy("n").collect()] == [1, 2, 3, 4]
    assert numbered(a.filter("x > 9"), [F.col("x")], "n").count() == 0


def test_relational_helpers(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("b", None, 1.0), (None, 4, 4.0)], "k string, i int, d double")
    assert got(distinct_on(df, ["k"], [F.desc_nulls_last("i")]).select("k", "i")) == sorted([("a", 2), ("b", None), (None, 4)], key=repr)
    assert limit_percent(df, 50, [F.col("i")]).count() == 2
    assert got(pivot(df, ["d"], "k", ["a", "b"], n=F.count("i")).filter("d = 1.0")) == [(1.0, 0, 0)]
    assert got(unpivot(df, ["k"], ["d"]).select("k", "value")) == sorted([("a", 2.0), ("b", 1.0), (None, 4.0)], key=repr)
    assert {r["column_name"]: r["null_percentage"] for r in summarize(df).collect()} == {"k": 25.0, "i": 25.0, "d": 25.0}


def test_recursion_on_cycles_and_empty_seeds(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (None, 9)], "src int, dst int")
    start = spark.createDataFrame([(1,)], "node int")
    assert got(reachable(edges, start)) == [(1,), (2,), (3,)]
    assert reachable(edges, start.filter("node > 5")).count() == 0
    with pytest.raises(RecursionError):
        recursive_union(start, lambda new: new.select((F.col("node") + 1).alias("node")), 3)


def test_windows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 4), ("b", 7)], "k string, v int")
    found = W.groups_frame(df, ["k"], [F.col("v")], -1, 0, s=F.sum("v"))
    assert got(found) == [("a", 1, 2), ("a", 1, 2), ("a", 2, 4), ("a", 4, 6), ("b", 7, 7)]
    odd = spark.createDataFrame([(1, 1.0), (2, float("inf")), (3, float("nan")), (4, None)], "k int, v double")
    w, peers = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1), "k")
    rest = {r["k"]: r["s"] for r in odd.filter("k <> 3").select("k", W.sum_excluding(F.col("v"), w, "CURRENT ROW", peers).alias("s")).collect()}
    assert rest == {1: float("inf"), 2: 1.0, 4: float("inf")}
    alone = odd.filter("k = 1").select(W.sum_excluding(F.col("v"), w, "GROUP", peers), W.sum_excluding(F.col("v"), w, "TIES", peers)).first()
    assert tuple(alone) == (None, 1.0)
    w = Window.partitionBy("k")
    assert got(df.select("v", W.count_distinct_over(F.col("v"), w)).filter("v = 4")) == [(4, 3)]


def test_bitmaps_follow_changes(spark):
    base = B.with_row_ids(spark.range(70_000).select((F.col("id") % 5).alias("v"), "id"), [F.col("id")])
    index = B.build(base, "v", F.col("v"))
    assert B.count(B.range_or(index, 1, 2)).first()["n"] == 28_000
    assert B.count(B.conjunction(B.range_or(index, 1, 1), B.range_or(index, 2, 1))).first()["n"] == 0
    few = B.conjunction(B.range_or(index, 3, 1), B.range_or(B.build(base, "id", F.floor(F.col("id") / 1000)), 69, 1))
    assert got(B.fetch(base, few, ["id"])) == [(i,) for i in range(69_003, 70_000, 5)]
    changed = base.filter("id < 100 AND v = 0")
    after = B.apply_changes(index, B.build(changed, "v", F.lit(0)), B.build(changed, "v", F.lit(9)))
    assert dict(got(after.groupBy("value").agg(F.sum(F.bitmap_count("bits"))))) == {0: 13_980, 1: 14_000, 2: 14_000, 3: 14_000, 4: 14_000, 9: 20}


def test_dml(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    assert got(dml.update(t, F.col("v") == "a", v=F.lit("z"))) == [(1, "z"), (2, None)]
    rows = spark.createDataFrame([(None, "new"), (1, "b")], t.schema)
    assert got(dml.merge(t.union(rows.filter("id IS NULL")), rows, ["id"], {"v": F.col("s_v")})) == sorted([(1, "b"), (2, None), (None, "new"), (None, "new")], key=repr)
    with pytest.raises(Exception, match="several rows"):
        dml.merge(t, rows.union(rows), ["id"], {"v": F.col("s_v")}).collect()
    assert got(dml.delete(t, F.col("v") == "a")) == [(2, None)]
    assert got(dml.upsert(t, spark.createDataFrame([(2, "n"), (3, "m")], t.schema), ["id"])) == [(1, "a"), (2, "n"), (3, "m")]


def test_stored_indexes_and_numbers(spark, small, capsys):
    from quern.plans.bitmap import bm_tpch, load_bitmap

    found = load_bitmap(spark, small, "discount", "quantity", "nonsense")
    assert set(found) == {"discount", "quantity"} and "nonsense" in capsys.readouterr().out
    few = B.count(B.conjunction(B.range_or(found["discount"], 5, 3), B.range_or(found["quantity"], 0, 23))).first()["n"]
    lineitem = spark.read.parquet(f"{small}/lineitem.parquet")
    assert few == lineitem.filter("l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24").count()
    assert bm_tpch(spark, small, 6).count() == 1 and bm_tpch(spark, small, 1).count() > 1
    with pytest.raises(ValueError):
        bm_tpch(spark, small, 23)
