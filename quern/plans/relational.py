"""Scans, projections, joins, set operations, sorting and limits."""

from pyspark.sql import Window, functions as F

from quern.operators.joins import all_match, any_match, asof_join, overlap_join, range_join, salted_join
from quern.operators.recursive import reachable, recursive_using_key
from quern.operators.relational import columns, distinct_on, exclude, explode_zipped, limit_percent, numbered, pivot, positional_join, qualify, replace, reservoir, bernoulli, summarize, union_by_name, unpivot
from quern.plans.registry import frame_query, sql_query
from quern.session import table

# Scans and projections
sql_query("scan_project_filter", "orders", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000")
sql_query("dummy_scan", "", "SELECT 1 AS one, 'a' AS letter")
sql_query("values_scan", "", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)")
sql_query("empty_result", "nation", "SELECT n_nationkey, n_name FROM nation WHERE 1 = 0")
sql_query("case_coalesce_nullif", "orders", """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' END AS size,
 coalesce(nullif(o_orderstatus, 'F'), 'done') AS status FROM orders""")
sql_query("star_except", "nation", "SELECT * EXCEPT (n_regionkey) FROM nation", "SELECT * EXCLUDE (n_regionkey) FROM nation")
frame_query("star_replace", lambda s, d: replace(table(s, d, "nation"), n_name=F.lower("n_name")), "SELECT * REPLACE (lower(n_name) AS n_name) FROM nation")
frame_query("star_exclude", lambda s, d: exclude(table(s, d, "region"), "r_name"), "SELECT * EXCLUDE (r_name) FROM region")
frame_query("columns_regex", lambda s, d: table(s, d, "lineitem").agg(*[F.max(c).alias(f"max_{i}") for i, c in enumerate(columns(table(s, d, "lineitem"), "key$"))]),
            "SELECT max(l_orderkey) AS max_0, max(l_partkey) AS max_1, max(l_suppkey) AS max_2 FROM lineitem")
sql_query("lateral_alias", "part", "SELECT p_partkey, p_retailprice * 1.1 AS gross, CAST(gross AS BIGINT) AS whole FROM part WHERE p_size > 40",
          "SELECT p_partkey, p_retailprice * 1.1 AS gross, CAST(trunc(gross) AS BIGINT) AS whole FROM part WHERE p_size > 40")
sql_query("unnest_list", "documents", "SELECT doc_id, explode(split(lang, '')) AS letter FROM documents WHERE lang IS NOT NULL",
          "SELECT doc_id, unnest(string_split(lang, '')) AS letter FROM documents WHERE lang IS NOT NULL")
frame_query("unnest_zipped", lambda s, d: explode_zipped(table(s, d, "nation").withColumns({"a": F.sequence(F.lit(1), F.lit(3)), "b": F.sequence("n_regionkey", F.col("n_regionkey") + 1)}), ["n_nationkey"], x=F.col("a"), y=F.col("b")),
            "SELECT n_nationkey, unnest([1, 2, 3]) AS x, unnest([n_regionkey, n_regionkey + 1]) AS y FROM nation")

# Joins
sql_query("join_inner", "orders customer", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
sql_query("join_left", "customer orders", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000")
sql_query("join_right", "customer orders", "SELECT c_custkey, o_orderkey FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 5000")
sql_query("join_full", "customer supplier", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey * 20")
sql_query("join_semi", "customer orders", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
          "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
sql_query("join_anti", "customer orders", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
sql_query("join_mark", "customer orders", "SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 495000)")
sql_query("join_single", "nation customer", "SELECT n_name, (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS best FROM nation")
sql_query("join_cross", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql_query("join_natural", "nation region", "SELECT n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) AS r")
sql_query("join_using", "orders lineitem", "SELECT k, count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) AS a JOIN (SELECT l_orderkey AS k FROM lineitem) AS b USING (k) GROUP BY k")
sql_query("join_null_safe", "documents labels", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id")
sql_query("join_inequality", "nation", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
sql_query("join_blockwise", "nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey + r_regionkey = 4 OR n_nationkey = r_regionkey")
# The oracle's order ends with nulls.
sql_query("join_lateral", "customer orders", "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey NULLS LAST LIMIT 1) AS t",
          "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS t")
frame_query("join_salted", lambda s, d: salted_join(table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity"), table(s, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), ["l_suppkey"], 8).groupBy("s_name").agg(F.sum("l_quantity").alias("qty")),
            "SELECT s_name, sum(l_quantity) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_name")
frame_query("join_salted_full", lambda s, d: salted_join(table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_name"), table(s, d, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice"), ["k"], 8, "full"),
            "SELECT k, c_name, o_totalprice FROM (SELECT c_custkey AS k, c_name FROM customer) FULL JOIN (SELECT o_orderkey AS k, o_totalprice FROM orders) USING (k)")
sql_query("subquery_correlated", "orders", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o2.o_totalprice) * 1.8 FROM orders o2 WHERE o2.o_custkey = o.o_custkey)")
sql_query("subquery_exists", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
sql_query("subquery_in_null", "documents labels", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")


def _quantified(kind):
    def run(s, d):
        stats = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"), F.count("s_acctbal").alias("c"), F.count_if(F.col("s_acctbal").isNull()).alias("z"))
        joined = table(s, d, "customer").join(stats, F.col("c_nationkey") == F.col("n"), "left")
        test = kind(F.col("c_acctbal"), ">", F.col("lo"), F.col("hi"), F.col("c"), F.col("z"))
        return joined.filter(test).select("c_custkey")
    return run


frame_query("subquery_any", _quantified(any_match), "SELECT c_custkey FROM customer WHERE c_acctbal > ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey = c_nationkey)")
frame_query("subquery_all", _quantified(all_match), "SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = c_nationkey)")

_CLICKS = "event_type = 'click'"
_ERRORS = "event_type = 'error'"


def _asof(op, how):
    def run(s, d):
        e = table(s, d, "events")
        left = e.filter(_CLICKS).select("user_id", "event_id", "ts")
        right = e.filter(_ERRORS).select("user_id", F.col("ts").alias("err_ts"), F.col("value").alias("err_value"))
        right = right.groupBy("user_id", "err_ts").agg(F.max("err_value").alias("err_value"))
        return asof_join(left, right, ["user_id"], "ts", "err_ts", how, op).select("event_id", "err_ts", "err_value")
    return run


def _asof_sql(op, how):
    return f"""WITH r AS (SELECT user_id, ts AS err_ts, max(value) AS err_value FROM events WHERE {_ERRORS} GROUP BY ALL), l AS (SELECT user_id, event_id, ts FROM events WHERE {_CLICKS})
SELECT event_id, err_ts, err_value FROM l ASOF {how} JOIN r ON l.user_id = r.user_id AND l.ts {op} r.err_ts"""


for _op, _name in ((">=", "ge"), (">", "gt"), ("<=", "le"), ("<", "lt")):
    frame_query(f"join_asof_left_{_name}", _asof(_op, "left"), _asof_sql(_op, "LEFT"))
frame_query("join_asof_inner", _asof(">=", "inner"), _asof_sql(">=", "INNER"))


def _range(s, d):
    e = table(s, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    points = e.filter(_CLICKS).select("event_id", "t")
    spans = e.filter(_ERRORS).select(F.col("event_id").alias("err_id"), F.col("t").alias("lo"), (F.col("t") + 1_800_000_000).alias("hi"))
    return range_join(points, spans, "t", "lo", "hi", 1_800_000_000).select("event_id", "err_id")


frame_query("join_range", _range, f"SELECT a.event_id, b.event_id AS err_id FROM events a JOIN events b ON a.{_CLICKS} AND b.{_ERRORS} AND a.ts BETWEEN b.ts AND b.ts + INTERVAL 30 MINUTE")


def _overlap(s, d):
    e = table(s, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    a = e.filter(_CLICKS).select(F.col("event_id").alias("a_id"), F.col("t").alias("a_lo"), (F.col("t") + 600_000_000).alias("a_hi"))
    b = e.filter(_ERRORS).select(F.col("event_id").alias("b_id"), F.col("t").alias("b_lo"), (F.col("t") + 300_000_000).alias("b_hi"))
    return overlap_join(a, b, ("a_lo", "a_hi"), ("b_lo", "b_hi"), 600_000_000).select("a_id", "b_id")


frame_query("join_overlap", _overlap, f"""SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.{_CLICKS} AND b.{_ERRORS}
AND a.ts <= b.ts + INTERVAL 5 MINUTE AND b.ts <= a.ts + INTERVAL 10 MINUTE""")
frame_query("join_positional", lambda s, d: positional_join(table(s, d, "supplier").select("s_suppkey"), table(s, d, "nation").select("n_name"), [F.col("s_suppkey")], [F.col("n_name").desc()]),
            "SELECT s_suppkey, n_name FROM (SELECT s_suppkey FROM supplier ORDER BY s_suppkey) POSITIONAL JOIN (SELECT n_name FROM nation ORDER BY n_name DESC)")

# Set operations
for _name, _op in (("union", "UNION"), ("union_all", "UNION ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL")):
    sql_query(f"set_{_name}", "customer supplier", f"SELECT c_nationkey AS k FROM customer {_op} SELECT s_nationkey AS k FROM supplier")
frame_query("union_by_name", lambda s, d: union_by_name(table(s, d, "region").select("r_regionkey", "r_name"), table(s, d, "nation").select(F.col("n_name").alias("r_name"), "n_nationkey")),
            "SELECT r_regionkey, r_name FROM region UNION ALL BY NAME SELECT n_name AS r_name, n_nationkey FROM nation")
sql_query("cte_materialized", "orders", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT a.o_custkey FROM big a JOIN (SELECT max(t) AS m FROM big) b ON a.t = b.m",
          "WITH big AS MATERIALIZED (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT a.o_custkey FROM big a JOIN (SELECT max(t) AS m FROM big) b ON a.t = b.m")
sql_query("cte_recursive_all", "", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


def _cycle(s, d):
    nations = table(s, d, "nation")
    edges = nations.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    return reachable(edges, nations.filter("n_nationkey = 1").select(F.col("n_nationkey").alias("node")))


frame_query("cte_recursive_union", _cycle, "WITH RECURSIVE r(node) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 1 UNION SELECT (node * 7 + 3) % 25 FROM r) SELECT node FROM r")


def _distances(s, d):
    seed = s.range(1).select(F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("dist"))

    def step(new, held):
        hops = new.select(F.explode(F.array((F.col("node") * 2 + 1) % 31, (F.col("node") + 5) % 31)).alias("node"), (F.col("dist") + 1).alias("dist"))
        best = hops.groupBy("node").agg(F.min("dist").alias("dist"))
        known = held.select("node", F.col("dist").alias("old"))
        return best.join(known, "node", "left").filter(F.col("old").isNull() | (F.col("dist") < F.col("old"))).select("node", "dist")

    return recursive_using_key(seed, step, ["node"])


frame_query("cte_recursive_using_key", _distances, """WITH RECURSIVE r(node, dist) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION
  SELECT unnest([(node * 2 + 1) % 31, (node + 5) % 31]), dist + 1 FROM r WHERE dist < 31) SELECT node, min(dist) AS dist FROM r GROUP BY node""")

# Sorting, limits, samples
frame_query("order_nulls", lambda s, d: numbered(table(s, d, "documents").select("doc_id", "lang"), [F.col("lang").desc_nulls_last(), F.col("doc_id")], "place"),
            "SELECT doc_id, lang, row_number() OVER (ORDER BY lang DESC NULLS LAST, doc_id) AS place FROM documents")
sql_query("top_n", "lineitem", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 25")
sql_query("limit_offset", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 95")
frame_query("limit_percent", lambda s, d: limit_percent(table(s, d, "customer").select("c_custkey"), 5, [F.col("c_custkey")]), "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5%")
frame_query("sample_reservoir", lambda s, d: reservoir(table(s, d, "orders"), 100, 7).select(F.lit(1).alias("one")), "SELECT 1 AS one FROM orders USING SAMPLE 100 ROWS")
frame_query("sample_bernoulli", lambda s, d: bernoulli(table(s, d, "orders"), 10, 7).agg((F.count(F.lit(1)) > 0).alias("some")), "SELECT count(*) > 0 AS some FROM orders TABLESAMPLE BERNOULLI (10%)")
frame_query("distinct_on", lambda s, d: distinct_on(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]),
            "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
sql_query("distinct_rows", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
frame_query("qualify", lambda s, d: qualify(table(s, d, "customer").select("c_custkey", "c_nationkey"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_custkey"))) <= 2),
            "SELECT c_custkey, c_nationkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) <= 2")

# Reshaping
_FLAGS = ["A", "N", "R"]
frame_query("pivot_sum", lambda s, d: pivot(table(s, d, "lineitem"), ["l_linestatus"], "l_returnflag", _FLAGS, qty=F.sum("l_quantity")),
            "PIVOT (SELECT l_linestatus, l_returnflag, l_quantity FROM lineitem) ON l_returnflag IN ('A', 'N', 'R') USING sum(l_quantity)")
frame_query("pivot_multi", lambda s, d: pivot(table(s, d, "lineitem"), ["l_linestatus"], "l_returnflag", _FLAGS, qty=F.sum("l_quantity"), n=F.count(F.lit(1))),
            """SELECT l_linestatus, sum(l_quantity) FILTER (l_returnflag = 'A') AS "A_qty", count(*) FILTER (l_returnflag = 'A') AS "A_n", sum(l_quantity) FILTER (l_returnflag = 'N') AS "N_qty",
 count(*) FILTER (l_returnflag = 'N') AS "N_n", sum(l_quantity) FILTER (l_returnflag = 'R') AS "R_qty", count(*) FILTER (l_returnflag = 'R') AS "R_n" FROM lineitem GROUP BY l_linestatus""")
frame_query("unpivot", lambda s, d: unpivot(table(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax"), ["l_orderkey"], ["l_quantity", "l_discount", "l_tax"]),
            "UNPIVOT (SELECT l_orderkey, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME name VALUE value")
frame_query("summarize", lambda s, d: summarize(table(s, d, "customer")).select("column_name", "min", "max", "count", F.round("avg", 4).alias("avg")),
            """SELECT 'c_custkey' AS column_name, min(c_custkey)::VARCHAR AS min, max(c_custkey)::VARCHAR AS max, count(*) AS count, round(avg(c_custkey), 4) AS avg FROM customer
UNION ALL SELECT 'c_name', min(c_name), max(c_name), count(*), NULL FROM customer UNION ALL SELECT 'c_nationkey', min(c_nationkey)::VARCHAR, max(c_nationkey)::VARCHAR, count(*), round(avg(c_nationkey), 4) FROM customer
UNION ALL SELECT 'c_acctbal', min(c_acctbal)::VARCHAR, max(c_acctbal)::VARCHAR, count(*), round(avg(c_acctbal), 4) FROM customer
UNION ALL SELECT 'c_mktsegment', min(c_mktsegment), max(c_mktsegment), count(*), NULL FROM customer""")
