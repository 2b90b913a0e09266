"""Queries answer for every row of their tables and for whole texts."""

import duckdb
import pytest

from quern.plans import registry
from tests.oracle import same

LINEITEM = "num_arithmetic num_division num_rounding num_powers num_trig num_special num_classes num_bits num_bitstring".split()
ORDERS = "list_access list_search list_build list_sort list_lambda list_aggregates list_range".split()


@pytest.mark.parametrize("name,table,times", [(n, "lineitem", 1) for n in LINEITEM] + [(n, "orders", 1) for n in ORDERS] + [("unpivot", "lineitem", 3)])
def test_every_row(spark, small, name, table, times):
    rows = spark.read.parquet(f"{small}/{table}.parquet").count()
    assert registry.queries()[name](spark, small).count() == rows * times
    assert "WHERE" not in registry.oracle_sql()[name]


def test_every_list_is_unnested(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("lang IS NOT NULL")
    assert registry.queries()["unnest_list"](spark, small).select("doc_id").distinct().count() == docs.count()


def test_age_borrows_the_earlier_month(spark):
    from pyspark.sql import functions as F

    from quern.functions import dates as D

    cases = [
        ("2005-06-15 00:00:00", "1996-02-20 00:00:00", "9 years 3 months 24 days"),
        ("2005-06-15 00:00:00", "1997-02-20 00:00:00", "8 years 3 months 23 days"),
        ("1996-02-20 00:00:00", "2005-06-15 00:00:00", "-9 years -3 months -24 days"),
        ("2005-06-15 00:00:00", "2005-01-31 00:00:00", "4 months 15 days"),
        ("2005-06-15 00:00:00", None, None),
    ]
    rows = spark.createDataFrame(cases, "a string, b string, want string")
    found = rows.select("want", D.age(F.col("a").cast("timestamp_ntz"), F.col("b").cast("timestamp_ntz")).alias("got")).collect()
    assert [r["got"] for r in found] == [r["want"] for r in found]


def test_whole_texts_and_null_places(spark, tmp_path):
    text = "x" * 100 + " e\u0301 \u00e9"
    spark.createDataFrame([(i, text, None if i == 30 else "en") for i in range(31)], "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["str_unicode"](spark, str(tmp_path)).first()
    assert (got["a"], got["b"]) == ("x" * 100 + " e e", "x" * 100 + " \u00e9 \u00e9")
    places = {r["doc_id"]: r["place"] for r in registry.queries()["order_nulls"](spark, str(tmp_path)).collect()}
    assert len(places) == 31 and places[30] == 31


def test_all_orders_have_an_age(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet").count()
    assert registry.queries()["date_age"](spark, small).filter("a <> ''").count() == orders


def test_lateral_ties_put_null_keys_last(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,), (None,)], "c_custkey long").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(None, 1, 5.0), (9, 1, 5.0), (8, 1, None), (None, 2, None), (4, 2, None), (None, 3, 7.0), (6, 3, 1.0), (5, None, 9.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    same(registry.queries()["join_lateral"](spark, str(tmp_path)), con, registry.oracle_sql()["join_lateral"])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_no_sketch_for_each_distinct_key(spark, small):
    plan = _plan(registry.queries()["agg_approx"](spark, small))
    sketched = [line for line in plan if "approx_percentile" in line and "Aggregate" in line]
    assert sketched and all("keys=[]" in line for line in sketched)


def test_vectors_do_not_move(spark, small):
    plan = _plan(registry.queries()["bitmap_q5_foreign_keys"](spark, small))
    made = next(i for i, line in enumerate(plan) if "bitmap_construct_agg" in line)
    moves = [line for line in plan[:made] if "Exchange" in line]
    assert len(moves) == 1 and "SinglePartition" in moves[0]
    assert sum("bucket" in line and "Exchange" in line for line in plan[made:]) == 1


def test_quantiles_hold_no_group_in_a_task(spark, small):
    from quern.functions import aggregates as A

    assert not any("percentile" in line or "median" in line for line in _plan(registry.queries()["agg_quantiles"](spark, small)))
    rows = [(g, float(i * 7 % 101)) for g in ("a", None) for i in range(100 + (g is None))] + [("a", None), ("b", None), ("c", 2.0), ("d", 1.0), ("d", float("nan")), ("d", float("inf")), ("e", 3.0), ("e", 3.0), ("e", 0.0), ("e", 0.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = (0, 0.1, 0.25, 0.5, 0.9, 1)
    wanted = {f"c{i}": ("x", q) for i, q in enumerate(shares)} | {f"d{i}": ("x", q) for i, q in enumerate(shares)}
    found = A.quantiles(df, ["g"], wanted, [f"d{i}" for i in range(len(shares))])
    names = [f"quantile_cont(x, {q}) AS c{i}, quantile_disc(x, {q}) AS d{i}" for i, q in enumerate(shares)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g VARCHAR, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    same(found, con, f"SELECT g, {', '.join(names)} FROM t GROUP BY g")
    same(A.mad(df, ["g"], "x").filter("g <> 'd' OR g IS NULL"), con, "SELECT g, mad(x) AS mad FROM t WHERE g <> 'd' OR g IS NULL GROUP BY g")


def test_long_texts_reach_python_in_small_batches(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "67108864b")
        spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
        registry.queries()["str_unicode"](spark, str(tmp_path))
        assert int(spark.conf.get(key).rstrip("b")) <= 8 << 20
    finally:
        spark.conf.set(key, before)
