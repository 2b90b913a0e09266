"""Queries through bitmap indexes; each has the plain query as its oracle."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from quern.operators import bitmap as B
from quern.operators.shared import written
from quern.plans import registry
from quern.plans.registry import frame_query
from quern.session import table


def _lineitem(s, d):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate", "l_returnflag", "l_linestatus"]
    base = table(s, d, "lineitem").select(*columns)
    return B.with_row_ids(base, [F.col(c) for c in columns])


def _days(c):
    return F.unix_date(F.col(c).cast("date"))


def _month(c):
    return (F.year(c) * 12 + F.month(c)).cast("long")


def _revenue(rows):
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


def q6(s, d):
    """Year of shipping, three discounts, quantities under 24: three indexes ANDed."""
    base = _lineitem(s, d)
    ship, disc, qty = B.build(base, "shipdate", F.year("l_shipdate")), B.build(base, "discount", F.round(F.col("l_discount") * 100)), B.build(base, "quantity", F.col("l_quantity") - 1)
    chosen = B.conjunction(B.range_or(ship, 1997, 1), B.range_or(disc, 5, 3), B.range_or(qty, 0, 23))
    return _revenue(B.fetch(base, chosen, ["l_extendedprice", "l_discount"]))


def q8_orders(s, d):
    """Orders of two years, by day codes."""
    base = B.with_row_ids(table(s, d, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderkey")])
    index = B.build(base, "orderdate", _days("o_orderdate") - 1)
    return B.fetch(base, B.range_or(index, 9130, 731), ["o_orderkey"])


def q14(s, d):
    """One month by its group vector."""
    base = _lineitem(s, d)
    chosen = B.range_or(B.build(base, "shipdate_GE", _month("l_shipdate")), 1997 * 12 + 9, 1)
    rows = B.fetch(base, chosen, ["l_partkey", "l_extendedprice", "l_discount"]).join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.agg(F.round(100 * F.sum(F.when(F.col("p_type").like("PROMO%"), value).otherwise(0.0)) / F.sum(value), 8).alias("promo_revenue"))


def q15(s, d):
    """Three months by their group vectors."""
    base = _lineitem(s, d)
    chosen = B.range_or(B.build(base, "shipdate_GE", _month("l_shipdate")), 1996 * 12 + 1, 3)
    rows = B.fetch(base, chosen, ["l_suppkey", "l_extendedprice", "l_discount"])
    return rows.groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def q19(s, d):
    """Two equality vectors."""
    base = _lineitem(s, d)
    flag = B.build(base, "returnflag", F.ascii("l_returnflag"))
    status = B.build(base, "linestatus", F.ascii("l_linestatus"))
    return B.count(B.conjunction(B.range_or(flag, ord("A"), 1), B.range_or(status, ord("F"), 1)))


def q5_foreign_keys(s, d):
    """A dimension filter as a set of keys, ORed over the key index."""
    base = _lineitem(s, d)
    index = B.build(base, "suppkey", F.col("l_suppkey"))
    nations = table(s, d, "nation").join(table(s, d, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    keys = table(s, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("s_suppkey").alias("value"))
    return B.count(B.value_or(index, keys))


def groupby_baseline(s, d):
    rows = table(s, d, "lineitem").filter("l_shipdate >= TIMESTAMP '1993-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"))


def updates(s, d):
    """Status 'F' turned to 'O' for one supplier's rows, then counted."""
    base = _lineitem(s, d)
    index = B.build(base, "linestatus", F.ascii("l_linestatus"))
    changed = base.filter("l_suppkey = 7 AND l_linestatus = 'F'")
    after = B.apply_changes(index, B.build(changed, "linestatus", F.ascii("l_linestatus")), B.build(changed, "linestatus", F.lit(ord("O"))))
    return after.groupBy("value").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def disjunction(s, d):
    base = _lineitem(s, d)
    flag, ship = B.build(base, "returnflag", F.ascii("l_returnflag")), B.build(base, "shipdate_GE", _month("l_shipdate"))
    return B.count(B.disjunction(B.range_or(flag, ord("R"), 1), B.range_or(ship, 1999 * 12 + 1, 6)))


@dataclass(frozen=True)
class IndexConfig:
    """A named index: the table's column as a code; grouped codes give group encoding."""

    name: str
    column: str
    code: Callable[[str], Column]


#: Named indexes over lineitem.
INDEXES = {
    c.name: c
    for c in (
        IndexConfig("shipdate", "l_shipdate", lambda c: _days(c) - 1), IndexConfig("shipdate_GE", "l_shipdate", _month), IndexConfig("discount", "l_discount", lambda c: F.round(F.col(c) * 100)),
        IndexConfig("quantity", "l_quantity", lambda c: F.col(c) - 1), IndexConfig("returnflag", "l_returnflag", F.ascii), IndexConfig("linestatus", "l_linestatus", F.ascii),
        IndexConfig("suppkey", "l_suppkey", F.col), IndexConfig("partkey", "l_partkey", F.col), IndexConfig("orderkey", "l_orderkey", F.col),
    )
}


def load_bitmap(spark, sf_dir, *names):
    """Named indexes as stored tables, clustered by value so that a predicate reads few row groups; unknown names are reported and skipped."""
    base = _lineitem(spark, sf_dir)
    out = {}
    for name in names:
        if name not in INDEXES:
            print(f"no bitmap index named {name}")
            continue
        config = INDEXES[name]
        index = B.build(base, name, config.code(config.column))
        out[name], _ = written(index.repartitionByRange("value").sortWithinPartitions("value", "bucket"), f"bitmap-{name}")
    return out


#: The queries that have a bitmap form.
BY_NUMBER = {5: q5_foreign_keys, 6: q6, 8: q8_orders, 14: q14, 15: q15, 19: q19}


def bm_tpch(spark, sf_dir, number):
    """Query `number` through bitmap indexes; numbers outside 1 to 22 raise, others without a bitmap form run plainly."""
    if not 1 <= number <= 22:
        raise ValueError(f"no query {number}")
    if number in BY_NUMBER:
        return BY_NUMBER[number](spark, sf_dir)
    found = registry.queries()
    if f"tpch_q{number}" not in found:
        raise NotImplementedError(f"query {number} needs a table that is not there")
    return found[f"tpch_q{number}"](spark, sf_dir)


_REV = "round(sum(l_extendedprice * (1 - l_discount)), 2)"
for _name, _run, _sql in (
    ("q6", q6, "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE year(l_shipdate) = 1997 AND round(l_discount * 100) BETWEEN 5 AND 7 AND l_quantity < 24"),
    ("q8_orders", q8_orders, "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'"),
    ("q14", q14, "SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 8) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE date_trunc('month', l_shipdate) = DATE '1997-09-01'"),
    ("q15", q15, f"SELECT l_suppkey, {_REV} AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey"),
    ("q19", q19, "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'"),
    ("q5_foreign_keys", q5_foreign_keys, "SELECT count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    ("groupby", groupby_baseline, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty FROM lineitem WHERE l_shipdate >= TIMESTAMP '1993-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY ALL"),
    ("updates", updates, "SELECT ascii(CASE WHEN l_suppkey = 7 AND l_linestatus = 'F' THEN 'O' ELSE l_linestatus END)::BIGINT AS value, count(*) AS n FROM lineitem GROUP BY 1"),
    ("disjunction", disjunction, "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' OR (l_shipdate >= TIMESTAMP '1999-01-01' AND l_shipdate < TIMESTAMP '1999-07-01')"),
):
    frame_query(f"bitmap_{_name}", _run, _sql)
