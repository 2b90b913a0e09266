"""Decision-support queries on the star schema, with the columns it has."""

from quern.plans.registry import sql_query

_REV = "CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE)"

sql_query(
    "tpch_q1",
    "lineitem",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(round(sum(l_extendedprice), 2) AS DOUBLE) AS sum_base_price,
       CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS sum_disc_price,
       CAST(round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS DOUBLE) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
sql_query(
    "tpch_q3",
    "customer orders lineitem",
    f"""SELECT l_orderkey, {_REV} AS revenue, o_orderdate FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
  AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
)
sql_query(
    "tpch_q4",
    "orders lineitem",
    """SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
GROUP BY o_orderpriority""",
)
sql_query(
    "tpch_q5",
    "customer orders lineitem supplier nation region",
    f"""SELECT n_name, {_REV} AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
  AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY n_name""",
)
sql_query(
    "tpch_q6",
    "lineitem",
    """SELECT CAST(round(sum(l_extendedprice * l_discount), 2) AS DOUBLE) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'
  AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
)
sql_query(
    "tpch_q7",
    "supplier lineitem orders customer nation",
    """SELECT supp_nation, cust_nation, l_year, CAST(round(sum(volume), 2) AS DOUBLE) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))) AS shipping
GROUP BY supp_nation, cust_nation, l_year""",
)
sql_query(
    "tpch_q8",
    "part supplier lineitem orders customer nation region",
    """SELECT o_year, round(sum(CASE WHEN nation = 'NATION_1' THEN volume ELSE 0 END) / sum(volume), 8) AS mkt_share FROM (
  SELECT CAST(year(o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
    AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND p_type = 'ECONOMY') AS all_nations
GROUP BY o_year""",
)
sql_query(
    "tpch_q9",
    "part supplier lineitem orders nation",
    """SELECT nation, o_year, CAST(round(sum(amount), 2) AS DOUBLE) AS sum_profit FROM (
  SELECT n_name AS nation, CAST(year(o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity AS amount
  FROM part, supplier, lineitem, orders, nation
  WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%ring%') AS profit
GROUP BY nation, o_year""",
)
sql_query(
    "tpch_q10",
    "customer orders lineitem nation",
    f"""SELECT c_custkey, c_name, {_REV} AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1997-10-01 00:00:00'
  AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
)
sql_query(
    "tpch_q12",
    "orders lineitem",
    """SELECT l_linestatus, sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high_line_count,
       sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS low_line_count
FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'
GROUP BY l_linestatus""",
    """SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
       CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'
GROUP BY l_linestatus""",
)
sql_query(
    "tpch_q13",
    "customer orders",
    """SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '5-LOW' GROUP BY c_custkey) AS c_orders
GROUP BY c_count""",
)
sql_query(
    "tpch_q14",
    "lineitem part",
    """SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 8) AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-10-01 00:00:00'""",
)
sql_query(
    "tpch_q15",
    "lineitem supplier",
    """WITH revenue AS (SELECT l_suppkey AS supplier_no, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS total_revenue FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-04-01 00:00:00' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)""",
)
sql_query(
    "tpch_q17",
    "lineitem part",
    """SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
)
sql_query(
    "tpch_q18",
    "customer orders lineitem",
    """SELECT c_name, c_custkey, o_orderkey, o_totalprice, sum(l_quantity) AS sum_qty FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
)
sql_query(
    "tpch_q19",
    "lineitem part",
    f"""SELECT {_REV} AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND (
  (p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
  OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15))""",
)
sql_query(
    "tpch_q20",
    "supplier nation lineitem part",
    """SELECT s_name, s_acctbal FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey = 1 AND s_suppkey IN (
  SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%') GROUP BY l_suppkey HAVING sum(l_quantity) > 100)""",
)
sql_query(
    "tpch_q21",
    "supplier lineitem orders nation",
    """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND s_nationkey = n_nationkey AND n_regionkey = 2
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
)
sql_query(
    "tpch_q22",
    "customer orders",
    """SELECT c_nationkey, count(*) AS numcust, CAST(round(sum(c_acctbal), 2) AS DOUBLE) AS totacctbal FROM customer
WHERE c_nationkey IN (1, 3, 5, 7, 9) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00 AND c_nationkey IN (1, 3, 5, 7, 9))
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_nationkey""",
)

# The part-supplier table is missing: its pairs are those that were sold, with the least price paid as the cost and all that was sold as the stock.
_PS = "ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice) AS ps_supplycost, sum(l_quantity) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey)"
sql_query(
    "tpch_q2",
    "lineitem part supplier nation region",
    f"""WITH {_PS}, near AS (SELECT ps_partkey, ps_supplycost, s_acctbal, s_name, s_suppkey, n_name FROM ps, supplier, nation, region
  WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part, near
WHERE p_partkey = ps_partkey AND p_size < 25 AND ps_supplycost = (SELECT min(n2.ps_supplycost) FROM near n2 WHERE n2.ps_partkey = p_partkey)
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
)
_VALUE = "CAST(round(sum(ps_supplycost * ps_availqty), 2) AS DOUBLE)"
sql_query(
    "tpch_q11",
    "lineitem supplier",
    f"""WITH {_PS}, here AS (SELECT ps_partkey, ps_supplycost, ps_availqty FROM ps, supplier WHERE ps_suppkey = s_suppkey AND s_nationkey = 7)
SELECT ps_partkey, {_VALUE} AS value FROM here GROUP BY ps_partkey
HAVING sum(ps_supplycost * ps_availqty) > (SELECT sum(ps_supplycost * ps_availqty) * 0.001 FROM here)""",
)
sql_query(
    "tpch_q16",
    "lineitem part supplier",
    f"""WITH {_PS} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps, part
WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#1' AND p_type NOT LIKE 'ECON%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
)
