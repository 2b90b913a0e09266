"""The same windows as streams over files, with late data."""

import datetime

from pyspark.sql import functions as F

from quern.streaming import windows as W


def _files(spark, folder):
    at = datetime.datetime(2024, 1, 1)
    batches = [[(0, 0, 1), (1, 5, 1), (2, 20, 2)], [(3, 130, 1), (4, 131, 2)], [(6, 400, 1)], [(5, 3, 1), (7, 800, 2)]]
    for k, rows in enumerate(batches):
        data = [(i, at + datetime.timedelta(minutes=m), u, "click", float(i), "{}") for i, m, u in rows]
        spark.createDataFrame(data, W.EVENTS).coalesce(1).write.mode("append").parquet(folder)
        import time

        time.sleep(0.02)
    return folder


def test_tumbling_leaves_out_late_rows(spark, tmp_path):
    stream = W.read_stream(spark, _files(spark, f"{tmp_path}/in"))
    out = W.run_available(W.tumbling(stream, "1 hour", [], n=F.count(F.lit(1))), "tumble", f"{tmp_path}/c")
    found = {r["window"]["start"].hour: r["n"] for r in out.collect()}
    assert found[0] == 3 and found[2] == 2


def test_first_seen_and_state(spark, tmp_path):
    folder = _files(spark, f"{tmp_path}/in")
    seen = W.run_available(W.first_seen(W.read_stream(spark, folder), ["event_id"]), "seen", f"{tmp_path}/c1")
    assert seen.count() == seen.select("event_id").distinct().count()
    totals = W.run_available(W.running_totals(W.read_stream(spark, folder)), "totals", f"{tmp_path}/c2", "update")
    assert {r["user_id"]: r["n"] for r in totals.groupBy("user_id").agg(F.max("n").alias("n")).collect()} == {1: 5, 2: 3}


def test_sessions_in_batch(spark, tmp_path):
    events = spark.read.schema(W.EVENTS).parquet(_files(spark, f"{tmp_path}/in"))
    assert W.sessions(events, "1 hour", ["user_id"], n=F.count(F.lit(1))).count() == 6
