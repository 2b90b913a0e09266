"""Aggregation, grouping sets and windows."""

from pyspark.sql import Window, functions as F

from quern.functions import aggregates as A
from quern.operators import windows as W
from quern.plans.registry import frame_query, sql_query
from quern.session import table

sql_query("agg_ungrouped", "orders", "SELECT count(*) AS n, count(o_orderpriority) AS np, count(DISTINCT o_custkey) AS custs, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS mean FROM orders")
sql_query("agg_hash", "lineitem", "SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY l_suppkey")
sql_query("agg_filter", "orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_totalprice > 250000) AS big FROM orders GROUP BY o_orderpriority")
sql_query("agg_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS supps, sum(DISTINCT l_linenumber) AS lines FROM lineitem GROUP BY l_returnflag",
          "SELECT l_returnflag, count(DISTINCT l_suppkey) AS supps, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
sql_query("agg_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
sql_query("agg_group_by_all", "customer", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
sql_query("agg_grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS INT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
sql_query("agg_rollup", "customer", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
sql_query("agg_cube", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
          "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql_query("agg_bits", "lineitem", "SELECT l_returnflag, bit_and(l_partkey) AS a, bit_or(l_partkey) AS o, bit_xor(l_partkey) AS x, bool_and(l_quantity > 0) AS ba, bool_or(l_quantity > 49) AS bo FROM lineitem GROUP BY l_returnflag")
sql_query("agg_count_if", "lineitem", "SELECT count_if(l_tax > 0.05) AS n FROM lineitem", "SELECT CAST(count_if(l_tax > 0.05) AS BIGINT) AS n FROM lineitem")
sql_query("agg_any_first", "nation", "SELECT n_regionkey, min_by(n_name, n_nationkey) AS first, max_by(n_name, n_nationkey) AS last FROM nation GROUP BY n_regionkey")
frame_query("agg_product", lambda s, d: table(s, d, "region").agg(F.product(F.col("r_regionkey") + 1).alias("p")), "SELECT product(r_regionkey + 1) AS p FROM region")
sql_query("agg_stats", "lineitem", """SELECT l_returnflag, round(stddev_samp(l_quantity), 8) AS ss, round(stddev_pop(l_quantity), 8) AS sp, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp,
 round(corr(l_quantity, l_extendedprice), 8) AS r, round(covar_pop(l_quantity, l_discount), 8) AS cp, round(covar_samp(l_quantity, l_discount), 8) AS cs FROM lineitem GROUP BY l_returnflag""")
sql_query("agg_regression", "lineitem", """SELECT regr_count(l_extendedprice, l_quantity) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay,
 round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS icept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2,
 round(regr_sxx(l_tax, l_discount), 6) AS sxx, round(regr_sxy(l_tax, l_discount), 6) AS sxy, round(regr_syy(l_tax, l_discount), 6) AS syy FROM lineitem""",
 """SELECT CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay,
 round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS icept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2,
 round(regr_sxx(l_tax, l_discount), 6) AS sxx, round(regr_sxy(l_tax, l_discount), 6) AS sxy, round(regr_syy(l_tax, l_discount), 6) AS syy FROM lineitem""")
_LI = lambda s, d: table(s, d, "lineitem")
def _fsum(s, d):
    found = A.fsum(_LI(s, d), ["l_linestatus"], {"total": "l_extendedprice", "tiny": F.col("l_tax") * 1e-12, "signed": F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice"))})
    means = A.favg(_LI(s, d), ["l_linestatus"], {"mean": "l_extendedprice"})
    return found.join(means, "l_linestatus").select("l_linestatus", F.round("total", 2).alias("total"), F.round(F.col("tiny") * 1e12, 6).alias("tiny"), F.round("signed", 2).alias("signed"), F.round("mean", 6).alias("mean"))


frame_query("agg_fsum", _fsum,
            "SELECT l_linestatus, round(fsum(l_extendedprice), 2) AS total, round(fsum(l_tax * 1e-12) * 1e12, 6) AS tiny, round(fsum(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE -l_extendedprice END), 2) AS signed, round(favg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY l_linestatus")
def _min_max_n(s, d):
    c = table(s, d, "customer")
    parts = [A.least_n(c, ["c_nationkey"], "c_custkey", 3, "lo"), A.least_n(c, ["c_nationkey"], "c_custkey", 2, "hi", descending=True),
             A.least_n(c, ["c_nationkey"], "c_custkey", 2, "first", "c_name"), A.least_n(c, ["c_nationkey"], "c_custkey", 2, "last", "c_name", descending=True)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "c_nationkey")
    return out


frame_query("agg_min_max_n", _min_max_n,
            "SELECT c_nationkey, min(c_custkey, 3) AS lo, max(c_custkey, 2) AS hi, arg_min(c_name, c_custkey, 2) AS first, arg_max(c_name, c_custkey, 2) AS last FROM customer GROUP BY c_nationkey")
frame_query("agg_string_agg", lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(A.string_agg("n_name", "; ", "n_nationkey").alias("names"), A.ordered_list("n_nationkey", "n_name").alias("keys")),
            "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_nationkey) AS names, list(n_nationkey ORDER BY n_name) AS keys FROM nation GROUP BY n_regionkey")
frame_query("agg_shape", lambda s, d: table(s, d, "orders").groupBy("o_orderstatus").agg(F.round(A.sem("o_totalprice"), 6).alias("sem"), F.round(A.skewness("o_totalprice"), 8).alias("skew"), F.round(A.kurtosis("o_totalprice"), 8).alias("kurt"), F.round(F.kurtosis("o_totalprice"), 8).alias("kpop")),
            "SELECT o_orderstatus, round(stddev_pop(o_totalprice) / sqrt(count(o_totalprice)), 6) AS sem, round(skewness(o_totalprice), 8) AS skew, round(kurtosis(o_totalprice), 8) AS kurt, round(kurtosis_pop(o_totalprice), 8) AS kpop FROM orders GROUP BY o_orderstatus")
frame_query("agg_means", lambda s, d: _LI(s, d).agg(F.round(A.geomean("l_extendedprice"), 4).alias("g"), F.round(A.weighted_avg("l_discount", "l_quantity"), 8).alias("w")),
            "SELECT round(geomean(l_extendedprice), 4) AS g, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS w FROM lineitem")
frame_query("agg_entropy", lambda s, d: A.entropy(_LI(s, d), ["l_returnflag"], "l_linenumber").withColumn("entropy", F.round("entropy", 8)), "SELECT l_returnflag, round(entropy(l_linenumber), 8) AS entropy FROM lineitem GROUP BY l_returnflag")
frame_query("agg_histogram", lambda s, d: A.histogram(_LI(s, d), ["l_returnflag"], "l_linenumber").select("l_returnflag", F.explode("histogram").alias("k", "n")),
            "SELECT l_returnflag, l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY ALL")
frame_query("agg_mode", lambda s, d: A.mode(_LI(s, d), ["l_returnflag"], "l_linenumber"), "WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linenumber AS mode FROM c QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linenumber) = 1")
frame_query("agg_mad", lambda s, d: A.mad(_LI(s, d), ["l_returnflag"], "l_quantity"), "SELECT l_returnflag, mad(l_quantity) AS mad FROM lineitem GROUP BY l_returnflag")
frame_query("agg_binned_histogram", lambda s, d: A.binned_histogram(_LI(s, d), "l_quantity", [10, 20, 30, 45]),
            "SELECT bin, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN l_quantity <= 10 THEN 10.0::DOUBLE WHEN l_quantity <= 20 THEN 20 WHEN l_quantity <= 30 THEN 30 WHEN l_quantity <= 45 THEN 45 ELSE 'inf'::DOUBLE END AS bin, 1 AS n FROM lineitem) GROUP BY bin")
frame_query("agg_quantiles", lambda s, d: A.quantiles(_LI(s, d), ["l_returnflag"], {"med": ("l_extendedprice", 0.5), "q25": ("l_extendedprice", 0.25), "d90": ("l_quantity", 0.9)}, discrete=["d90"]),
          "SELECT l_returnflag, median(l_extendedprice) AS med, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_disc(l_quantity, 0.9) AS d90 FROM lineitem GROUP BY l_returnflag")
# Beside an exact distinct count in one aggregation, each distinct key would have a sketch of its own.
sql_query("agg_approx", "lineitem", """SELECT abs(a.n - d.n) < 0.15 * d.n AS near, abs(a.middle - 25) < 2 AS mid FROM (SELECT approx_count_distinct(l_partkey) AS n, approx_percentile(l_quantity, 0.5) AS middle FROM lineitem) AS a
 CROSS JOIN (SELECT count(DISTINCT l_partkey) AS n FROM lineitem) AS d""",
          "SELECT true AS near, true AS mid")
sql_query("agg_sketch_state", "lineitem", "SELECT abs(hll_sketch_estimate(hll_union_agg(s)) - (SELECT count(DISTINCT l_partkey) FROM lineitem)) < 200 AS near FROM (SELECT l_returnflag, hll_sketch_agg(l_partkey) AS s FROM lineitem GROUP BY l_returnflag) AS t", "SELECT true AS near")
frame_query("agg_bitstring", lambda s, d: table(s, d, "customer").groupBy(F.expr("bitmap_bucket_number(c_custkey + 1)").alias("bucket")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("c_custkey") + 1))).alias("present")),
            "SELECT (c_custkey // 32768) + 1 AS bucket, count(DISTINCT c_custkey) AS present FROM customer GROUP BY 1")
sql_query("agg_top_k", "customer", "SELECT c_nationkey FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 3) AS t")
frame_query("agg_top_per_group", lambda s, d: A.top_per_group(_LI(s, d).select("l_suppkey", "l_orderkey", "l_partkey", "l_extendedprice"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_partkey")], 2),
            "SELECT l_suppkey, l_orderkey, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) <= 2")
frame_query("agg_partitioned", lambda s, d: table(s, d, "orders").repartition("o_custkey").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")), "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")

# Windows
_W = "OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)"
sql_query("window_ranking", "customer", f"""SELECT c_custkey, row_number() {_W} AS rn, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS BIGINT) AS dr,
 round(percent_rank() {_W}, 8) AS pr, round(cume_dist() {_W}, 8) AS cd, CAST(ntile(4) {_W} AS BIGINT) AS nt FROM customer""".replace("row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)", f"CAST(row_number() {_W} AS BIGINT)"))
sql_query("window_values", "customer", f"""SELECT c_custkey, lag(c_custkey) {_W} AS lg, lead(c_custkey, 2, -1) {_W} AS ld, first_value(c_custkey) {_W} AS fv,
 last_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv, nth_value(c_custkey, 2) {_W} AS nv FROM customer""",
 f"""SELECT c_custkey, lag(c_custkey) {_W} AS lg, lead(c_custkey, 2, -1) {_W} AS ld, first_value(c_custkey) {_W} AS fv,
 last_value(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv, nth_value(c_custkey, 2) {_W} AS nv FROM customer""")
sql_query("window_rows", "orders", "SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders",
          "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders")
sql_query("window_range_interval", "orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW) AS n FROM orders")
sql_query("window_ignore_nulls", "labels documents", "SELECT d.doc_id, last_value(l.quality) IGNORE NULLS OVER (PARTITION BY d.lang ORDER BY d.doc_id) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
          "SELECT d.doc_id, last_value(l.quality IGNORE NULLS) OVER (PARTITION BY d.lang ORDER BY d.doc_id) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
frame_query("window_groups", lambda s, d: W.groups_frame(table(s, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), ["c_nationkey"], [F.col("c_mktsegment")], -1, 1, n=F.count(F.lit(1)), s=F.sum("c_custkey")),
            "SELECT c_custkey, c_nationkey, c_mktsegment, count(*) OVER w AS n, CAST(sum(c_custkey) OVER w AS BIGINT) AS s FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")


_KINDS = {"no_row": "CURRENT ROW", "no_group": "GROUP", "no_ties": "TIES"}
_ALL = "PARTITION BY {} ORDER BY c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE"


def _exclude(s, d):
    w, peers = Window.partitionBy("c_nationkey"), Window.partitionBy("c_nationkey", "c_mktsegment")
    counts = [W.count_excluding(F.lit(1), w, kind, peers).alias(n) for n, kind in _KINDS.items()]
    sums = [W.sum_excluding(F.col("c_custkey"), w, kind, peers, exact=True).alias(f"sum_{n}") for n, kind in _KINDS.items()]
    return table(s, d, "customer").select("c_custkey", *counts, *sums)


frame_query("window_exclude", _exclude, "SELECT c_custkey, " + ", ".join(f"count(*) OVER ({_ALL.format('c_nationkey')} {kind}) AS {n}, CAST(sum(c_custkey) OVER ({_ALL.format('c_nationkey')} {kind}) AS BIGINT) AS sum_{n}" for n, kind in _KINDS.items()) + " FROM customer")


def _exclude_single(s, d):
    # Partitions of one customer: each frame may be empty
    w, peers = Window.partitionBy("c_custkey"), Window.partitionBy("c_custkey", "c_mktsegment")
    return table(s, d, "customer").select("c_custkey", *[W.sum_excluding(F.col("c_acctbal"), w, kind, peers).alias(n) for n, kind in _KINDS.items()])


frame_query("window_exclude_single", _exclude_single, "SELECT c_custkey, " + ", ".join(f"sum(c_acctbal) OVER ({_ALL.format('c_custkey')} {kind}) AS {n}" for n, kind in _KINDS.items()) + " FROM customer")


def _exclude_any(s, d):
    frame = Window.partitionBy("c_nationkey").orderBy("c_custkey").rowsBetween(-3, 3)
    cut = {n: W.frame_excluding(F.col("c_acctbal"), F.col("c_custkey"), F.col("c_custkey"), frame, kind) for n, kind in _KINDS.items()}
    return table(s, d, "customer").select("c_custkey", F.array_max(cut["no_row"]).alias("hi"), F.array_min(cut["no_group"]).alias("lo"), F.size(F.array_distinct(cut["no_ties"])).cast("long").alias("n"))


_NEAR = "OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE"
frame_query("window_exclude_any", _exclude_any, f"SELECT c_custkey, max(c_acctbal) {_NEAR} CURRENT ROW) AS hi, min(c_acctbal) {_NEAR} GROUP) AS lo, count(DISTINCT c_acctbal) {_NEAR} TIES) AS n FROM customer")


def _distinct_filter(s, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey").rowsBetween(-5, 0)
    return table(s, d, "customer").select("c_custkey", W.count_distinct_over(F.col("c_mktsegment"), w).alias("segments"), W.filtered_over(F.count, F.col("c_custkey"), F.col("c_acctbal") > 5000, w).alias("rich"))


_LAST = "OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
frame_query("window_distinct_filter", _distinct_filter, f"SELECT c_custkey, count(DISTINCT c_mktsegment) {_LAST} AS segments, count(c_custkey) FILTER (WHERE c_acctbal > 5000) {_LAST} AS rich FROM customer")
frame_query("window_lag_variable", lambda s, d: W.lag_by(table(s, d, "customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], [F.col("c_custkey")], "c_custkey", F.col("c_custkey") % 3, "back"),
            "SELECT c_custkey, c_nationkey, lag(c_custkey, CAST(c_custkey % 3 AS INT)) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS back FROM customer")
