"""Sources and sinks as round trips through the shared folder, and further functions."""

import uuid

from pyspark.sql import functions as F

from quern.functions import dates as D, nested as N
from quern.operators.relational import numbered
from quern.operators.shared import shared_dir
from quern.plans.registry import frame_query, sql_query
from quern.session import table
from quern.sources import files as S


def _path(s, name):
    return f"{shared_dir(s).rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"


def _csv(s, d):
    df = table(s, d, "customer")
    S.write_csv(df, path := _path(s, "csv"), delim="|", force_quote=True)
    return S.read_csv(s, path, schema="c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", delim="|")


def _json(s, d):
    df = table(s, d, "events")
    S.write_json(df, path := _path(s, "json"))
    return S.read_json(s, path, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def _parquet(s, d):
    df = table(s, d, "orders")
    S.write_parquet(df, path := _path(s, "parquet"), partition_by=["o_orderstatus"], sort_by=["o_custkey"], bloom=["o_custkey"])
    return S.read_parquet(s, path).filter("o_orderstatus = 'F' AND o_custkey < 100").select("o_orderkey", "o_custkey")


def _text(s, d):
    table(s, d, "region").select("r_name").coalesce(1).sortWithinPartitions("r_name").write.text(path := _path(s, "text"))
    return S.read_text(s, f"{path}/part-*").select("content", "size")


def _union_by_name(s, d):
    table(s, d, "region").write.parquet(a := _path(s, "a"))
    table(s, d, "nation").select(F.col("n_name").alias("r_name"), "n_nationkey").write.parquet(b := _path(s, "b"))
    return S.read_parquet(s, [a, b], union_by_name=True).select("r_regionkey", "r_name", "n_nationkey")


def _export(s, d):
    S.export_database({"nation": table(s, d, "nation")}, path := _path(s, "db"))
    return S.import_database(s, path, ["nation"])["nation"]


def _row_numbers(s, d):
    df = table(s, d, "nation").coalesce(1)
    df.write.parquet(path := _path(s, "rows"))
    return S.read_parquet(s, path, file_row_number=True).select("n_nationkey", "file_row_number")


frame_query("source_csv", _csv, "SELECT * FROM customer")
frame_query("source_json", _json, "SELECT * FROM events")
frame_query("source_parquet_partitioned", _parquet, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 100")
frame_query("source_text", _text, "SELECT string_agg(r_name, chr(10) ORDER BY r_name) || chr(10) AS content, CAST(sum(strlen(r_name) + 1) AS BIGINT) AS size FROM region")
frame_query("source_union_by_name", _union_by_name, "SELECT r_regionkey, r_name, NULL::INT AS n_nationkey FROM region UNION ALL SELECT NULL, n_name, n_nationkey FROM nation")
frame_query("source_export_import", _export, "SELECT * FROM nation")
frame_query("source_file_row_number", _row_numbers, "SELECT n_nationkey, CAST(n_nationkey AS BIGINT) AS file_row_number FROM nation")
frame_query("sequence_numbers", lambda s, d: numbered(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), [F.col("s_acctbal"), F.col("s_suppkey")], "n").select("s_suppkey", "n"), "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS n FROM supplier")
frame_query("range_timestamps", lambda s, d: s.range(1).select(F.explode(F.sequence(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"), F.expr("INTERVAL 6 HOURS"))).alias("t")),
            "SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02', INTERVAL 6 HOUR)) AS t")
frame_query("date_age", lambda s, d: table(s, d, "orders").select("o_orderkey", D.age(F.lit("2005-06-15 00:00:00").cast("timestamp_ntz"), "o_orderdate").alias("a")), "SELECT o_orderkey, age(TIMESTAMP '2005-06-15', o_orderdate)::VARCHAR AS a FROM orders")
frame_query("date_intervals", lambda s, d: table(s, d, "orders").select("o_orderkey", *[(F.col("o_orderdate") + D.to_interval(F.col("o_custkey").cast("int") % 5, p)).alias(p) for p in ("years", "quarters", "months", "weeks", "days", "hours", "minutes", "decades")]),
            "SELECT o_orderkey, " + ", ".join(f"o_orderdate + to_{p}(CAST(o_custkey % 5 AS INT)) AS {p}" for p in ("years", "quarters", "months", "weeks", "days", "hours", "minutes", "decades")) + " FROM orders")
sql_query("date_now", "region", "SELECT r_regionkey, now() >= TIMESTAMP '2020-01-01 00:00:00' AS n, current_date() > DATE '2020-01-01' AS d FROM region", "SELECT r_regionkey, true AS n, true AS d FROM region")
sql_query("agg_approx_top_k", "customer", "SELECT explode(transform(approx_top_k(c_nationkey, 25), x -> x.item)) AS k FROM customer", "SELECT DISTINCT c_nationkey AS k FROM customer")
sql_query("agg_approx_quantile", "lineitem", "SELECT abs(element_at(approx_percentile(l_quantity, array(0.1, 0.9)), 1) - 5) <= 2 AS lo, abs(element_at(approx_percentile(l_quantity, array(0.1, 0.9)), 2) - 45) <= 2 AS hi FROM lineitem", "SELECT true AS lo, true AS hi")
sql_query("list_subscripts", "nation", "SELECT n_nationkey, p + 1 AS i, v FROM nation LATERAL VIEW posexplode(array(n_regionkey, n_nationkey)) AS p, v", "SELECT n_nationkey, CAST(generate_subscripts([n_regionkey, n_nationkey], 1) AS INT) AS i, unnest([n_regionkey, n_nationkey]) AS v FROM nation")
frame_query("struct_unnest", lambda s, d: table(s, d, "nation").select(N.remap_struct(N.struct_concat({"a": F.col("n_nationkey"), "b": F.col("n_name")}), {"x": "b", "y": "a"}).alias("s")).select("s.*"), "SELECT n_name AS x, n_nationkey AS y FROM nation")
frame_query("map_build", lambda s, d: table(s, d, "nation").select("n_nationkey", F.map_keys(F.map_concat(F.create_map(F.lit("a"), "n_nationkey"), F.create_map(F.lit("b"), "n_regionkey"))).alias("k"), F.size(F.map_from_entries(F.array(F.struct(F.lit("z"), "n_name")))).cast("long").alias("n")),
            "SELECT n_nationkey, map_keys(map_concat(MAP {'a': n_nationkey}, MAP {'b': n_regionkey})) AS k, CAST(cardinality(map_from_entries([('z', n_name)])) AS BIGINT) AS n FROM nation")
frame_query("json_shapes", lambda s, d: table(s, d, "nation").select("n_nationkey", F.json_array_length(F.to_json(F.array("n_nationkey", "n_regionkey"))).cast("long").alias("n"), F.to_json(F.create_map("n_name", "n_regionkey")).alias("o")),
            "SELECT n_nationkey, CAST(json_array_length(json_array(n_nationkey, n_regionkey)) AS BIGINT) AS n, json_object(n_name, n_regionkey)::VARCHAR AS o FROM nation")
sql_query("summary_describe", "supplier", "SELECT count(*) AS n, count(DISTINCT s_nationkey) AS u, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier")
sql_query("window_streaming", "region", "SELECT r_regionkey, CAST(sum(r_regionkey) OVER (ORDER BY r_regionkey) AS BIGINT) AS s, CAST(row_number() OVER (ORDER BY r_regionkey) AS BIGINT) AS n FROM region")
sql_query("execute_immediate", "nation", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT max(n_nationkey) FROM nation GROUP BY n_regionkey)")
