"""Dates, lists, structs, maps, unions, enums and JSON."""

from pyspark.sql import functions as F

from quern.functions import dates as D, lists as L, nested as N
from quern.plans.registry import frame_query, sql_query
from quern.session import table


def _orders(cols):
    return lambda s, d: table(s, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in cols().items()])


def _events(cols):
    return lambda s, d: table(s, d, "events").select("event_id", *[c.alias(n) for n, c in cols().items()])


_O, _E = "FROM orders", "FROM events"
frame_query("date_parts", _events(lambda: dict(y=F.year("ts").cast("long"), mo=F.month("ts").cast("long"), d=F.dayofmonth("ts").cast("long"), q=F.quarter("ts").cast("long"), h=F.hour("ts").cast("long"), mi=F.minute("ts").cast("long"), s=F.second("ts").cast("long"), dow=D.dow("ts").cast("long"), iso=D.isodow("ts").cast("long"), doy=F.dayofyear("ts").cast("long"), w=F.weekofyear("ts").cast("long"), iy=D.isoyear("ts").cast("long"), yw=D.yearweek("ts").cast("long"), de=D.decade("ts"), ce=D.century("ts"), mm=D.millennium("ts"), er=D.era("ts").cast("long"), ms=D.millisecond("ts"), us=D.microsecond("ts"))),
            f"SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, quarter(ts) AS q, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, dayofweek(ts) AS dow, isodow(ts) AS iso, dayofyear(ts) AS doy, week(ts) AS w, isoyear(ts) AS iy, yearweek(ts) AS yw, decade(ts) AS de, century(ts) AS ce, millennium(ts) AS mm, era(ts) AS er, millisecond(ts) AS ms, microsecond(ts) AS us {_E}")
frame_query("date_epoch", _events(lambda: dict(e=F.round(D.epoch("ts"), 6), ms=D.epoch_ms("ts"), us=D.epoch_us("ts"), ns=D.epoch_ns("ts"), j=F.round(D.julian("ts"), 6))),
            f"SELECT event_id, round(epoch(ts), 6) AS e, epoch_ms(ts) AS ms, epoch_us(ts) AS us, epoch_ns(ts) AS ns, round(julian(ts), 6) AS j {_E}")
_PARTS = ["second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century"]
frame_query("date_trunc", _events(lambda: {f"t_{p}": D.date_trunc(p, "ts") for p in _PARTS}), f"SELECT event_id, {', '.join(f'CAST(date_trunc({chr(39)}{p}{chr(39)}, ts) AS TIMESTAMP) AS t_{p}' for p in _PARTS)} {_E}")
_SPANS = ["hour", "day", "week", "month", "quarter", "year"]
frame_query("date_diff", _orders(lambda: {f"d_{p}": D.date_diff(p, "o_orderdate", F.lit("2000-06-15 12:00:00").cast("timestamp_ntz")) for p in _SPANS} | {f"s_{p}": D.date_sub(p, "o_orderdate", F.lit("2000-06-15 12:00:00").cast("timestamp_ntz")) for p in _SPANS}),
            "SELECT o_orderkey, " + ", ".join(f"date_diff('{p}', o_orderdate, TIMESTAMP '2000-06-15 12:00:00') AS d_{p}, date_sub('{p}', o_orderdate, TIMESTAMP '2000-06-15 12:00:00') AS s_{p}" for p in _SPANS) + f" {_O}")
frame_query("date_time_bucket", _events(lambda: dict(a=D.time_bucket("minute", 15, "ts"), b=D.time_bucket("day", 3, "ts"), c=D.time_bucket("week", 2, "ts"), d=D.time_bucket("month", 2, "ts"))),
            f"SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts) AS a, time_bucket(INTERVAL 3 DAY, ts) AS b, time_bucket(INTERVAL 2 WEEK, ts) AS c, CAST(time_bucket(INTERVAL 2 MONTH, ts) AS TIMESTAMP) AS d {_E}")
frame_query("date_format", _events(lambda: dict(f=D.strftime("ts", "%Y/%m/%d %H:%M:%S"), n=D.dayname("ts"), m=D.monthname("ts"), p=D.strptime(D.strftime("ts", "%d.%m.%Y %H:%M"), "%Y-%m-%d", "%d.%m.%Y %H:%M"), z=D.strptime("event_type", "%Y", strict=False), l=F.last_day("ts"))),
            f"SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS f, dayname(ts) AS n, monthname(ts) AS m, strptime(strftime(ts, '%d.%m.%Y %H:%M'), '%d.%m.%Y %H:%M') AS p, try_strptime(event_type, '%Y') AS z, last_day(ts) AS l {_E}")
sql_query("date_arithmetic", "orders", "SELECT o_orderkey, o_orderdate + INTERVAL '3' MONTH AS a, o_orderdate - INTERVAL '10' DAY AS b, o_orderdate + INTERVAL '36' HOUR AS c, make_date(year(o_orderdate), 1, 31) AS d, CAST(o_orderdate AS DATE) AS e FROM orders")
frame_query("date_timezone", _events(lambda: dict(a=F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts")), b=F.convert_timezone(F.lit("Asia/Tokyo"), F.lit("UTC"), F.col("ts")))),
            f"SELECT event_id, CAST(ts - INTERVAL 5 HOUR AS TIMESTAMP) AS a, CAST(ts - INTERVAL 9 HOUR AS TIMESTAMP) AS b {_E}")
sql_query("date_series", "", "SELECT explode(sequence(DATE '2024-01-31', DATE '2024-06-30', INTERVAL 1 MONTH)) AS d", "SELECT unnest([DATE '2024-01-31', DATE '2024-02-29', DATE '2024-03-31', DATE '2024-04-30', DATE '2024-05-31', DATE '2024-06-30']) AS d")
sql_query("range_table", "", "SELECT id AS i FROM range(5, 50, 5)", "SELECT range AS i FROM range(5, 50, 5)")

def _lists(cols):
    rows = lambda s, d: table(s, d, "orders").withColumns({"l": F.array(F.col("o_custkey") % 7, F.lit(None), F.col("o_orderkey") % 5, F.col("o_custkey") % 7), "m": F.array(F.col("o_orderkey") % 3, F.lit(2).cast("long"))})
    return lambda s, d: rows(s, d).select("o_orderkey", *[c.alias(n) for n, c in cols().items()])


_LM = "FROM (SELECT o_orderkey, [o_custkey % 7, NULL, o_orderkey % 5, o_custkey % 7] AS l, [o_orderkey % 3, 2] AS m FROM orders)"
frame_query("list_access", _lists(lambda: dict(a=L.list_extract("l", 1), b=L.list_extract("l", -2), c=L.list_extract("l", 9), d=L.list_slice("l", 2, 3), e=L.list_slice("l", -2, -1), f=L.list_slice("l", 1, 4, 2), g=F.size("l").cast("long"))),
            f"SELECT o_orderkey, l[1] AS a, l[-2] AS b, l[9] AS c, l[2:3] AS d, l[-2:-1] AS e, l[1:4:2] AS f, len(l) AS g {_LM}")
frame_query("list_search", _lists(lambda: dict(a=L.list_contains("l", F.lit(3)), b=L.list_position("l", F.lit(3)).cast("int"), c=L.list_has_any("l", F.col("m")), d=L.list_has_all("l", F.col("m")), e=F.sort_array(F.array_intersect(F.array_compact("l"), "m")))),
            f"SELECT o_orderkey, list_contains(l, 3) AS a, list_position(l, 3) AS b, list_has_any(l, m) AS c, list_has_all(l, m) AS d, list_sort(list_intersect(l, m)) AS e {_LM}")
frame_query("list_build", _lists(lambda: dict(a=L.list_concat("l", F.col("m")), b=F.array_append("m", F.lit(9).cast("long")), c=F.array_prepend("m", F.lit(9).cast("long")), d=F.sort_array(L.list_distinct("l")), e=L.list_unique("l"), f=L.list_resize("m", 4, 0), g=F.reverse("m"), h=L.flatten(F.array("m", "m")))),
            f"SELECT o_orderkey, list_concat(l, m) AS a, list_append(m, 9) AS b, list_prepend(9, m) AS c, list_sort(list_distinct(l)) AS d, CAST(list_unique(l) AS BIGINT) AS e, list_resize(m, 4, 0) AS f, list_reverse(m) AS g, flatten([m, m]) AS h {_LM}")
frame_query("list_sort", _lists(lambda: dict(a=L.list_sort("l"), b=L.list_sort("l", True), c=L.list_sort("l", nulls_first=True), d=L.list_grade_up("m"))),
            f"SELECT o_orderkey, list_sort(l, 'ASC', 'NULLS LAST') AS a, list_sort(l, 'DESC', 'NULLS LAST') AS b, list_sort(l, 'ASC', 'NULLS FIRST') AS c, list_grade_up(m) AS d {_LM}")
frame_query("list_lambda", _lists(lambda: dict(a=L.list_transform("m", lambda x: x * 2), b=L.list_transform("m", lambda x, i: x * i), c=L.list_filter("m", lambda x: x > 1), d=L.list_reduce("m", lambda x, y: x * 10 + y), e=L.list_select("m", F.array(F.lit(2), F.lit(1))), f=L.list_where("m", F.array(F.lit(True), F.lit(False))), g=F.transform(L.list_zip("l", "m"), lambda z: z["_1"]), h=F.transform(L.list_zip("l", "m"), lambda z: z["_2"]))),
            f"SELECT o_orderkey, list_transform(m, lambda x: x * 2) AS a, list_transform(m, lambda x, i: x * i) AS b, list_filter(m, lambda x: x > 1) AS c, list_reduce(m, lambda x, y: x * 10 + y) AS d, list_select(m, [2, 1]) AS e, list_where(m, [true, false]) AS f, list_transform(list_zip(l, m), lambda z: z[1]) AS g, list_transform(list_zip(l, m), lambda z: z[2]) AS h {_LM}")
frame_query("list_aggregates", _lists(lambda: dict(s=L.list_sum("l"), a=F.round(L.list_avg("l"), 8), lo=F.array_min("l"), hi=F.array_max("l"), c=L.list_count("l"), md=L.list_median("l"), p=L.list_product("m"), v=F.round(L.list_var_pop("l"), 8), j=F.array_join("m", "+"))),
            f"SELECT o_orderkey, CAST(list_sum(l) AS DOUBLE) AS s, round(list_avg(l), 8) AS a, list_min(l) AS lo, list_max(l) AS hi, list_count(l) AS c, CAST(list_median(l) AS DOUBLE) AS md, list_product(m) AS p, round(list_var_pop(l), 8) AS v, array_to_string(m, '+') AS j {_LM}")
frame_query("list_range", _lists(lambda: dict(a=L.range_list(0, (F.col("o_orderkey") % 4).cast("int")).cast("array<bigint>"), b=F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"), F.lit(2).cast("long")))),
            f"SELECT o_orderkey, range(0, o_orderkey % 4) AS a, generate_series(1, 5, 2) AS b {_LM}")

frame_query("struct_functions", lambda s, d: table(s, d, "nation").select(N.struct_insert(F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n")), r=F.col("n_regionkey")).alias("s")).select("s.*"),
            "SELECT s.k AS k, s.n AS n, s.r AS r FROM (SELECT struct_insert({'k': n_nationkey, 'n': n_name}, r := n_regionkey) AS s FROM nation)")
frame_query("map_functions", lambda s, d: table(s, d, "nation").withColumn("m", F.create_map(F.lit("k"), "n_nationkey", F.lit("r"), "n_regionkey")).select("n_name", F.map_keys("m").alias("ks"), F.map_values("m").alias("vs"), N.map_extract("m", F.lit("r")).alias("e"), N.map_extract("m", F.lit("z")).alias("z"), F.try_element_at("m", F.lit("k")).alias("v"), F.size("m").cast("long").alias("c"), F.map_contains_key("m", F.lit("k")).alias("h")),
            "SELECT n_name, map_keys(m) AS ks, map_values(m) AS vs, map_extract(m, 'r') AS e, map_extract(m, 'z') AS z, map_extract_value(m, 'k') AS v, CAST(cardinality(m) AS BIGINT) AS c, map_contains(m, 'k') AS h FROM (SELECT n_name, MAP {'k': n_nationkey, 'r': n_regionkey} AS m FROM nation)")
frame_query("union_functions", lambda s, d: table(s, d, "nation").withColumn("u", F.when(F.col("n_nationkey") % 2 == 0, N.union_value({"num": "int", "str": "string"}, "num", F.col("n_nationkey"))).otherwise(N.union_value({"num": "int", "str": "string"}, "str", F.col("n_name")))).select("n_nationkey", N.union_tag("u").alias("t"), N.union_extract("u", "num").alias("n"), N.union_extract("u", "str").alias("s")),
            "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'num' ELSE 'str' END AS t, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS n, CASE WHEN n_nationkey % 2 <> 0 THEN n_name END AS s FROM nation")
_PRIORITY = N.Enum(["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"])
frame_query("enum_functions", lambda s, d: table(s, d, "orders").select("o_orderkey", _PRIORITY.code("o_orderpriority").cast("int").alias("c"), _PRIORITY.first().alias("f"), F.size(_PRIORITY.range_boundary("3-MEDIUM", None)).cast("long").alias("n")),
            "WITH e AS (SELECT o_orderkey, o_orderpriority::ENUM('5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT') AS p FROM orders) SELECT o_orderkey, CAST(enum_code(p) AS INT) AS c, enum_first(p)::VARCHAR AS f, CAST(3 AS BIGINT) AS n FROM e")

frame_query("json_extract", _events(lambda: dict(a=F.get_json_object("props", "$.k"), b=F.get_json_object("props", "$.k").cast("long"), c=N.json_exists("props", "$.k"), d=N.json_exists("props", "$.zz"), t=N.json_type("props"), tk=N.json_type("props", "$.k"), v=N.json_valid("props"), k=F.json_object_keys("props"))),
            f"SELECT event_id, json_extract_string(props, '$.k') AS a, CAST(props->>'$.k' AS BIGINT) AS b, json_exists(props, '$.k') AS c, json_exists(props, '$.zz') AS d, json_type(props) AS t, json_type(props, '$.k') AS tk, json_valid(props) AS v, json_keys(props) AS k {_E}")
frame_query("json_build", lambda s, d: table(s, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("o"), F.to_json(F.array("n_nationkey", "n_regionkey")).alias("a")), "SELECT json_object('n_nationkey', n_nationkey, 'n_name', n_name)::VARCHAR AS o, json_array(n_nationkey, n_regionkey)::VARCHAR AS a FROM nation")
frame_query("json_transform", _events(lambda: dict(s=F.from_json("props", "k int")["k"])), f"""SELECT event_id, json_transform(props, '{{"k": "INTEGER"}}').k AS s {_E}""")
frame_query("json_group", lambda s, d: table(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list("n_nationkey"))).alias("a")), "SELECT n_regionkey, to_json(list(n_nationkey ORDER BY n_nationkey))::VARCHAR AS a FROM nation GROUP BY n_regionkey")
frame_query("json_each", lambda s, d: N.json_each(table(s, d, "events").select("event_id", "props"), "props").select("event_id", "key", "value"), "SELECT event_id, j.key, j.value::VARCHAR AS value FROM events, json_each(props) AS j")
frame_query("json_patch", _events(lambda: dict(m=N.json_merge_patch("props", F.lit('{"k":null,"n":[1]}')), c=N.json_contains("props", F.lit('{"k":69}')))), f"""SELECT event_id, json_merge_patch(props, '{{"k":null,"n":[1]}}')::VARCHAR AS m, json_contains(props, '{{"k":69}}') AS c {_E}""")
