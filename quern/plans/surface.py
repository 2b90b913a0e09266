"""Row changes, functions of the user, and statements around queries."""

from pyspark.sql import functions as F, types as T

from quern.functions import udfs as U
from quern.operators import ddl, dml
from quern.plans.registry import frame_query, sql_query
from quern.session import register, table
from quern.sources import catalog as C

_N = "FROM nation"
frame_query("dml_insert", lambda s, d: dml.insert(table(s, d, "region"), s.createDataFrame([(9, "NOWHERE")], "r_regionkey int, r_name string")), "SELECT * FROM region UNION ALL SELECT 9, 'NOWHERE'")
frame_query("dml_delete", lambda s, d: dml.delete(table(s, d, "nation"), F.col("n_regionkey") == 2), f"SELECT * {_N} WHERE n_regionkey <> 2")
frame_query("dml_update", lambda s, d: dml.update(table(s, d, "nation"), F.col("n_regionkey") == 2, n_name=F.upper(F.concat("n_name", F.lit("_x")))), f"SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN upper(n_name || '_x') ELSE n_name END AS n_name, n_regionkey {_N}")


def _rows(s):
    return s.createDataFrame([(1, "one", 1), (99, "new", 4)], "n_nationkey int, n_name string, n_regionkey int")


frame_query("dml_upsert", lambda s, d: dml.upsert(table(s, d, "nation"), _rows(s), ["n_nationkey"]), f"SELECT * {_N} WHERE n_nationkey <> 1 UNION ALL SELECT 1, 'one', 1 UNION ALL SELECT 99, 'new', 4")
frame_query("dml_insert_ignore", lambda s, d: dml.upsert(table(s, d, "nation"), _rows(s), ["n_nationkey"], "nothing"), f"SELECT * {_N} UNION ALL SELECT 99, 'new', 4")
frame_query("dml_merge", lambda s, d: dml.merge(table(s, d, "nation"), _rows(s), ["n_nationkey"], {"n_name": F.concat("n_name", F.lit("/"), "s_n_name")}), f"SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN n_name || '/one' ELSE n_name END AS n_name, n_regionkey {_N} UNION ALL SELECT 99, 'new', 4")
_NULLED = "SELECT nullif(doc_id % 7, 3) AS k, max(doc_id) AS v FROM documents GROUP BY 1"


def _merge_nulls(s, d):
    docs = table(s, d, "documents").select("doc_id", F.nullif(F.col("doc_id") % 7, F.lit(3)).alias("k"))
    target = docs.filter("k IS NULL OR k < 4").groupBy("k").agg(F.max("doc_id").alias("v"))
    return dml.merge(target, docs.groupBy("k").agg(F.max("doc_id").alias("v")), ["k"], {"v": -F.col("s_v")})


frame_query("dml_merge_nulls", _merge_nulls, f"WITH n AS ({_NULLED}) SELECT k, CASE WHEN k IS NULL THEN v ELSE -v END AS v FROM n WHERE k IS NULL OR k < 4 UNION ALL SELECT k, v FROM n WHERE k IS NULL OR k >= 4")
frame_query("dml_constraints", lambda s, d: dml.violations(table(s, d, "lineitem"), {"cheap": F.col("l_extendedprice") < 90000}, ["l_tax"], [["l_orderkey", "l_linenumber"]]),
            "SELECT 'cheap' AS constraint, count(*) FILTER (l_extendedprice >= 90000) AS n FROM lineitem UNION ALL SELECT 'not_null_l_tax', count(*) FILTER (l_tax IS NULL) FROM lineitem UNION ALL SELECT 'unique_l_orderkey_l_linenumber', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
frame_query("dml_foreign_key", lambda s, d: dml.foreign_key_violations(table(s, d, "labels"), "doc_id", table(s, d, "documents").filter("doc_id > 10"), "doc_id").select("doc_id"), "SELECT doc_id FROM labels WHERE doc_id <= 10 OR doc_id NOT IN (SELECT doc_id FROM documents)")


def _macro(s, d):
    dml.create_function(s, "gross(price DOUBLE, tax DOUBLE DEFAULT 0.1) RETURNS DOUBLE RETURN price * (1 + tax)")
    table(s, d, "part").createOrReplaceTempView("part")
    return s.sql("SELECT p_partkey, round(gross(p_retailprice), 6) AS a, round(gross(p_retailprice, 0.2), 6) AS b FROM part")


frame_query("macro_scalar", _macro, "SELECT p_partkey, round(p_retailprice * (1 + 0.1::DOUBLE), 6) AS a, round(p_retailprice * (1 + 0.2::DOUBLE), 6) AS b FROM part")


def _table_macro(s, d):
    table(s, d, "nation").createOrReplaceTempView("nation")
    dml.create_function(s, "in_region(r INT) RETURNS TABLE (k INT, name STRING) RETURN SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = r")
    return s.sql("SELECT k, name FROM in_region(3)")


frame_query("macro_table", _table_macro, f"SELECT n_nationkey AS k, n_name AS name {_N} WHERE n_regionkey = 3")


def _prepared(s, d):
    table(s, d, "orders").createOrReplaceTempView("orders")
    return dml.prepared(s, "SELECT o_orderkey FROM orders WHERE o_totalprice > :low AND o_orderstatus = :status", low=480000.0, status="F")


frame_query("prepared_statement", _prepared, "SELECT o_orderkey FROM orders WHERE o_totalprice > 480000 AND o_orderstatus = 'F'")


def _variable(s, d):
    table(s, d, "nation").createOrReplaceTempView("nation")
    dml.set_variable(s, "wanted", "4")
    return s.sql("SELECT n_name FROM nation WHERE n_regionkey = wanted")


frame_query("session_variable", _variable, f"SELECT n_name {_N} WHERE n_regionkey = 4")
sql_query("generic_functions", "nation", "SELECT n_nationkey, typeof(n_name) AS t, ifnull(nullif(n_nationkey, 3), -1) AS i, if(n_regionkey > 2, 'hi', 'lo') AS c FROM nation", f"SELECT n_nationkey, 'string' AS t, ifnull(nullif(n_nationkey, 3), -1) AS i, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS c {_N}")
sql_query("uuid_functions", "nation", "SELECT count(DISTINCT u) AS n, min(length(u)) AS l FROM (SELECT uuid() AS u FROM nation) AS t", f"SELECT count(*) AS n, CAST(36 AS INT) AS l {_N}")
frame_query("udf_scalar", lambda s, d: table(s, d, "nation").select("n_nationkey", U.scalar(lambda a, b: f"{a}:{len(b)}", T.StringType())("n_nationkey", "n_name").alias("t")), f"SELECT n_nationkey, n_nationkey || ':' || length(n_name) AS t {_N}")
frame_query("udf_aggregate", lambda s, d: table(s, d, "customer").groupBy("c_mktsegment").agg(F.round(U.trimmed_mean("c_acctbal"), 4).alias("m")),
            "WITH r AS (SELECT c_mktsegment, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_mktsegment, round(avg(c_acctbal), 4) AS m FROM r WHERE i > n // 10 AND i <= n - n // 10 GROUP BY ALL")
frame_query("udf_map", lambda s, d: U.map_rows(table(s, d, "nation").select("n_nationkey"), lambda p: p.assign(twice=p["n_nationkey"] * 2), "n_nationkey int, twice int"), f"SELECT n_nationkey, n_nationkey * 2 AS twice {_N}")


def _udtf(s, d):
    s.udtf.register("squares", U.Squares)
    return s.sql("SELECT n, square FROM squares(12)")


frame_query("udf_table", _udtf, "SELECT CAST(range AS INT) AS n, CAST(range * range AS INT) AS square FROM range(1, 13)")


def _catalog(s, d):
    register(s, d, ["nation"])
    return C.columns(s, "nation").select("column_name", "ordinal")


frame_query("catalog_columns", _catalog, "SELECT column_name, ordinal_position::INT AS ordinal FROM information_schema.columns WHERE table_name = 'nation'")
frame_query("table_repeat", lambda s, d: C.repeat(table(s, d, "region"), 3), "SELECT region.* FROM region, range(3)")
frame_query("table_histogram", lambda s, d: C.histogram_table(table(s, d, "customer"), "c_custkey", 5).select("n"),
            "WITH r AS (SELECT min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer) SELECT count(*) AS n FROM customer, r GROUP BY least(floor((c_custkey - lo) / ((hi - lo) / 5.0)), 4)")


def _query_table(s, d):
    register(s, d, ["region", "nation"])
    s.sql("CREATE OR REPLACE TEMP VIEW names AS SELECT n_name AS name FROM nation")
    s.sql("CREATE OR REPLACE TEMP VIEW regions AS SELECT r_name AS name FROM region")
    return C.query_table(s, ["names", "regions"])


frame_query("table_query_table", _query_table, "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")


def _view_and_explain(s, d):
    view = ddl.create_view(table(s, d, "orders").filter("o_totalprice > 1000"), "dear_orders")
    text = ddl.explain(s, f"SELECT o_orderkey FROM {view} WHERE o_custkey = 7")
    return s.sql(f"SELECT o_orderstatus, count(*) AS n FROM {view} GROUP BY o_orderstatus").withColumn("pushed", F.lit("EqualTo(o_custkey,7)" in text and "GreaterThan(o_totalprice,1000.0)" in text))


frame_query("view_and_explain", _view_and_explain, "SELECT o_orderstatus, count(*) AS n, true AS pushed FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")


def _ddl_table(s, d):
    schema = ddl.create_schema(s)
    name = ddl.create_table(table(s, d, "nation"), f"{schema}.nations")
    ddl.add_column(s, name, "note", "string")
    s.sql(f"INSERT INTO {name} VALUES (99, 'new', 1, 'added')")
    ddl.rename_table(s, name, f"{schema}.countries")
    gone = ddl.create_table(s.range(3), f"{schema}.gone")
    ddl.drop(s, "TABLE", gone)
    return s.table(f"{schema}.countries").withColumn("left_over", F.lit(s.catalog.tableExists(gone) or s.catalog.tableExists(name)))


frame_query("ddl_table", _ddl_table, f"SELECT *, NULL::VARCHAR AS note, false AS left_over {_N} UNION ALL SELECT 99, 'new', 1, 'added', false")


def _ddl_alter(s, d):
    name = ddl.create_table(table(s, d, "supplier"), f"{ddl.create_schema(s)}.suppliers")
    return s.table(ddl.rewrite(s, name, ("s_name",), {"s_acctbal": "balance"}, {"s_suppkey": "string"}))


frame_query("ddl_alter", _ddl_alter, "SELECT s_suppkey::VARCHAR AS s_suppkey, s_nationkey, s_acctbal AS balance FROM supplier")


def _reset(s, d):
    s.conf.set("spark.sql.quern.example", "1")
    before = s.conf.get("spark.sql.quern.example")
    ddl.reset(s, "spark.sql.quern.example")
    return s.createDataFrame([("set", before), ("reset", s.conf.get("spark.sql.quern.example", None))], "step string, value string")


frame_query("session_reset", _reset, "SELECT 'set' AS step, '1' AS value UNION ALL SELECT 'reset', NULL")
sql_query("order_by_all", "nation", "SELECT n_regionkey, n_name FROM nation ORDER BY ALL LIMIT 7")
sql_query("collation_nocase", "part", "SELECT p_partkey FROM part WHERE p_name COLLATE UTF8_LCASE = 'RED WIDGET'", "SELECT p_partkey FROM part WHERE p_name COLLATE NOCASE = 'RED WIDGET'")
sql_query("between_in", "part", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45 AND p_brand IN ('Brand#1', 'Brand#2') AND p_type NOT IN ('ECONOMY')")
sql_query("try_expressions", "customer", "SELECT c_custkey, try_divide(c_acctbal, c_custkey - c_custkey) AS d, try_add(c_custkey, 1) AS a FROM customer", "SELECT c_custkey, CAST(NULL AS DOUBLE) AS d, c_custkey + 1 AS a FROM customer")
