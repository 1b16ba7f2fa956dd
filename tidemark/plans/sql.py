"""Queries that are one SQL text for Spark and for the oracle. {name} stands for a table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """Only the tables that the text names are read; Catalyst sees them as sub-plans, so that nothing is registered."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return lambda spark, sf_dir: spark.sql(text, **{n: load(spark, sf_dir, n) for n in names})


def oracle(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


#: available quantity and cost by part and supplier, as there is no such table
PARTSUPP = "ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(sum(l_quantity) AS DOUBLE) AS ps_availqty, min(l_extendedprice / l_quantity) AS ps_supplycost FROM {lineitem} GROUP BY l_partkey, l_suppkey)"
REVENUE = "l_extendedprice * (1 - l_discount)"

TPCH = {
    "tpch_q1": f"""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum({REVENUE}), 2) AS sum_disc_price, round(sum({REVENUE} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
        FROM {{lineitem}} WHERE l_shipdate <= DATE '2001-08-06' GROUP BY l_returnflag, l_linestatus""",
    "tpch_q2": f"""WITH {PARTSUPP}, cheapest AS (SELECT ps_partkey AS k, min(ps_supplycost) AS c FROM ps JOIN {{supplier}} ON s_suppkey = ps_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' GROUP BY ps_partkey)
        SELECT round(s_acctbal, 2) AS s_acctbal, s_name, n_name, p_partkey, p_brand FROM {{part}} JOIN ps ON p_partkey = ps_partkey JOIN {{supplier}} ON s_suppkey = ps_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey JOIN cheapest ON k = p_partkey AND c = ps_supplycost
        WHERE p_size <= 15 AND p_type LIKE '%O%' AND r_name = 'EUROPE' ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q3": f"""SELECT l_orderkey, round(sum({REVENUE}), 2) AS revenue, o_orderdate FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q4": """SELECT o_orderpriority, count(*) AS order_count FROM {orders} WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY) GROUP BY o_orderpriority""",
    "tpch_q5": f"""SELECT n_name, round(sum({REVENUE}), 2) AS revenue FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{supplier}} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-01-01' GROUP BY n_name""",
    "tpch_q6": """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""",
    "tpch_q7": f"""SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, {REVENUE} AS volume
        FROM {{supplier}} JOIN {{lineitem}} ON s_suppkey = l_suppkey JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{customer}} ON c_custkey = o_custkey JOIN {{nation}} n1 ON s_nationkey = n1.n_nationkey JOIN {{nation}} n2 ON c_nationkey = n2.n_nationkey
        WHERE (n1.n_name = 'NATION_3' AND n2.n_name = 'NATION_7' OR n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_3') AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '2000-12-31') s GROUP BY supp_nation, cust_nation, l_year""",
    "tpch_q8": f"""SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, {REVENUE} AS volume, n2.n_name AS nation
        FROM {{part}} JOIN {{lineitem}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} n1 ON c_nationkey = n1.n_nationkey JOIN {{region}} ON n1.n_regionkey = r_regionkey JOIN {{nation}} n2 ON s_nationkey = n2.n_nationkey
        WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY') s GROUP BY o_year""",
    "tpch_q9": f"""WITH {PARTSUPP} SELECT n_name AS nation, CAST(year(o_orderdate) AS BIGINT) AS o_year, round(sum({REVENUE} - ps_supplycost * l_quantity), 2) AS sum_profit
        FROM {{part}} JOIN {{lineitem}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN ps ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{nation}} ON s_nationkey = n_nationkey WHERE p_type LIKE '%RO%' GROUP BY n_name, year(o_orderdate)""",
    "tpch_q10": f"""SELECT c_custkey, c_name, round(sum({REVENUE}), 2) AS revenue, c_acctbal, n_name FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{nation}} ON c_nationkey = n_nationkey
        WHERE o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""WITH {PARTSUPP}, v AS (SELECT ps_partkey, CAST(sum(CAST(ps_supplycost * ps_availqty AS DECIMAL(18, 4))) AS DOUBLE) AS value FROM ps JOIN {{supplier}} ON ps_suppkey = s_suppkey JOIN {{nation}} ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_3', 'NATION_7') GROUP BY ps_partkey)
        SELECT ps_partkey, round(value, 2) AS value FROM v WHERE value > (SELECT sum(value) * 0.001 FROM v)""",
    "tpch_q12": """SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate + INTERVAL '60' DAY AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY l_returnflag""",
    "tpch_q13": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) c GROUP BY c_count""",
    "tpch_q14": f"""SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 6) AS promo_revenue FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'""",
    "tpch_q15": f"""WITH r AS (SELECT l_suppkey AS supplier_no, round(sum({REVENUE}), 2) AS total_revenue FROM {{lineitem}} WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-04-01' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM {{supplier}} JOIN r ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM r)""",
    "tpch_q16": f"""WITH {PARTSUPP} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps JOIN {{part}} ON p_partkey = ps_partkey
        WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (1, 4, 7, 15, 23, 36, 45, 49) AND ps_suppkey NOT IN (SELECT s_suppkey FROM {{supplier}} WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
    "tpch_q17": """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE p_brand = 'Brand#3' AND p_size < 20 AND l_quantity < (SELECT 0.4 * avg(l2.l_quantity) FROM {lineitem} l2 WHERE l2.l_partkey = p_partkey)""",
    "tpch_q18": """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 300) GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": f"""SELECT round(sum({REVENUE}), 2) AS revenue FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey WHERE (p_brand = 'Brand#1' AND p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 21) OR (p_brand = 'Brand#2' AND p_size BETWEEN 1 AND 30 AND l_quantity BETWEEN 10 AND 30) OR (p_brand = 'Brand#3' AND p_size BETWEEN 1 AND 45 AND l_quantity BETWEEN 20 AND 40)""",
    "tpch_q20": f"""WITH {PARTSUPP} SELECT s_name, s_suppkey FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND s_suppkey IN (SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM {{part}} WHERE p_type LIKE 'S%')
        AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM {{lineitem}} WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01'))""",
    "tpch_q21": """SELECT s_name, count(*) AS numwait FROM {supplier} JOIN {lineitem} l1 ON s_suppkey = l1.l_suppkey JOIN {orders} ON o_orderkey = l1.l_orderkey JOIN {nation} ON s_nationkey = n_nationkey
        WHERE o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate + INTERVAL '60' DAY AND EXISTS (SELECT 1 FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
        AND NOT EXISTS (SELECT 1 FROM {lineitem} l3 JOIN {orders} o3 ON o3.o_orderkey = l3.l_orderkey WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_shipdate > o3.o_orderdate + INTERVAL '60' DAY)
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": """SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (SELECT substring(CAST(100 + c_nationkey AS VARCHAR(8)), 2, 2) AS cntrycode, c_acctbal, c_custkey FROM {customer}) c
        WHERE cntrycode IN ('03', '07', '11', '15', '19', '21', '23') AND c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2000-06-01') GROUP BY cntrycode""",
}

RELATIONAL = {
    "scan_full": "SELECT * FROM {nation}",
    "scan_projection": "SELECT l_orderkey, l_quantity FROM {lineitem}",
    "filter_cmp": "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem} WHERE l_quantity >= 45 AND l_orderkey <> 7 AND l_linenumber < 5 AND l_shipdate > DATE '1998-01-01'",
    "filter_null": "SELECT event_id, value IS NULL AS no_value FROM {events} WHERE props IS NOT NULL AND NOT (nullif(event_type, 'view') IS NULL)",
    "filter_and_or": "SELECT o_orderkey FROM {orders} WHERE (o_orderstatus = 'F' AND o_totalprice > 300000) OR (NOT o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')",
    "filter_between": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_discount BETWEEN 0.02 AND 0.03 AND l_quantity BETWEEN 10 AND 12",
    "filter_in": "SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)",
    "filter_like": "SELECT p_partkey, p_type, p_brand FROM {part} WHERE p_type LIKE 'S%' AND p_brand NOT LIKE '%1'",
    "proj_arith": "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS a, -l_linenumber AS b, l_orderkey % 7 AS c, round(l_extendedprice / l_quantity, 6) AS d, round(l_extendedprice - l_tax, 2) AS e FROM {lineitem}",
    "proj_cast": "SELECT p_partkey, CAST(p_size AS BIGINT) AS size_long, CAST(p_size AS DOUBLE) AS size_double, CAST(p_partkey AS VARCHAR(20)) AS key_text, CAST('2024-01-31' AS DATE) AS day FROM {part}",
    "proj_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM {orders}",
    "proj_coalesce": "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS t, nullif(user_id, 1) AS u FROM {events}",
    "join_inner": "SELECT o_orderkey, c_name, n_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey WHERE o_totalprice > 200000",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey",
    "join_right": "SELECT c_custkey, o_orderkey FROM {orders} RIGHT JOIN {customer} ON c_custkey = o_custkey AND o_totalprice > 350000",
    "join_full": "SELECT c.c_custkey, s.s_suppkey FROM {customer} c FULL OUTER JOIN {supplier} s ON c.c_custkey = s.s_suppkey + 1000",
    "join_cross": "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}",
    "join_semi": "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)",
    "join_anti": "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "join_not_in": "SELECT s_suppkey FROM {supplier} WHERE s_suppkey NOT IN (SELECT nullif(l_suppkey, 5) FROM {lineitem} WHERE l_suppkey > 20 AND l_suppkey <> 5)",
    "join_theta": "SELECT l1.l_orderkey, l1.l_linenumber FROM {lineitem} l1 WHERE EXISTS (SELECT 1 FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey AND l2.l_quantity > l1.l_quantity)",
    "subq_correlated": "SELECT l_orderkey, l_linenumber FROM {lineitem} l WHERE l_quantity > (SELECT 1.5 * avg(l2.l_quantity) FROM {lineitem} l2 WHERE l2.l_partkey = l.l_partkey)",
    "subq_scalar": "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM {orders})",
    "agg_count": "SELECT count(*) AS n, count(nullif(event_type, 'click')) AS n_other FROM {events}",
    "agg_sum": "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s_int, CAST(sum(l_orderkey) AS BIGINT) AS s_long, round(sum(l_extendedprice), 2) AS s_double, sum(CASE WHEN l_quantity < 0 THEN 1.0 END) AS s_none FROM {lineitem}",
    "agg_minmax": "SELECT min(l_orderkey) AS a, max(l_orderkey) AS b, min(l_extendedprice) AS c, max(l_shipdate) AS d, min(l_returnflag) AS e FROM {lineitem}",
    "agg_avg": "SELECT l_returnflag, round(avg(l_quantity), 6) AS a, avg(CASE WHEN l_quantity < 0 THEN 1.0E0 END) AS b FROM {lineitem} GROUP BY l_returnflag",
    "agg_filter": "SELECT event_type, count(*) FILTER (WHERE value > 100) AS n, round(sum(value) FILTER (WHERE user_id < 50), 2) AS s FROM {events} GROUP BY event_type",
    "agg_conditional": "SELECT o_orderstatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent FROM {orders} GROUP BY o_orderstatus",
    "agg_groupby": "SELECT c_nationkey, c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS a FROM {customer} GROUP BY c_nationkey, c_mktsegment",
    "agg_having": "SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS q FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 250",
    "agg_count_distinct": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM {lineitem} GROUP BY l_returnflag",
    "agg_percentile_cont": "SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95 FROM {events} GROUP BY event_type",
    "agg_two_phase": "SELECT k, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 6) AS a, min(lo) AS lo, max(hi) AS hi FROM (SELECT l_returnflag AS k, l_orderkey % 8 AS shard, count(*) AS n, sum(l_quantity) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM {lineitem} GROUP BY l_returnflag, l_orderkey % 8) p GROUP BY k",
    "agg_rollup": "SELECT c_mktsegment, c_nationkey, count(*) AS n, CAST(grouping(c_mktsegment) AS BIGINT) AS g FROM {customer} GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "agg_group_expr": "SELECT CASE WHEN value > 100 THEN 'big' ELSE 'small' END AS band, CAST(hour(ts) AS BIGINT) AS h, count(*) AS n FROM {events} GROUP BY 1, 2",
    "agg_nested": "SELECT n, count(*) AS users FROM (SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id) c GROUP BY n",
    "distinct": "SELECT DISTINCT c_nationkey, c_mktsegment FROM {customer}",
    "win_running_sum": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS s FROM {events}",
    "win_moving_avg": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS a FROM {events}",
    "win_row_number": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS BIGINT) AS rn FROM {orders}",
    "win_rank": "SELECT event_id, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c FROM {events} WINDOW w AS (PARTITION BY event_type ORDER BY user_id)",
    "win_lag_lead": "SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_first_last": "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS n FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_ntile": "SELECT event_id, CAST(ntile(4) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS q FROM {events}",
    "win_range_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM {events}",
    "sort_multi": "SELECT n_nationkey, n_name, n_regionkey FROM {nation} ORDER BY n_regionkey DESC NULLS LAST, n_name ASC NULLS LAST",
    "limit_offset": "SELECT o_orderkey, o_orderdate FROM {orders} ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 35",
    "topk": "SELECT o_custkey, round(sum(o_totalprice), 2) AS spent FROM {orders} GROUP BY o_custkey ORDER BY spent DESC, o_custkey LIMIT 10",
    "topk_per_group": "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM {customer}) c WHERE rn <= 3",
    "union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "union_distinct": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "intersect": "SELECT l_suppkey AS k FROM {lineitem} WHERE l_quantity > 49 INTERSECT SELECT l_suppkey FROM {lineitem} WHERE l_discount > 0.09",
    "intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}",
    "except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000",
    "except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}",
    "fn_extract": "SELECT event_id, CAST(extract(YEAR FROM ts) AS BIGINT) AS y, CAST(extract(MONTH FROM ts) AS BIGINT) AS m, CAST(extract(MINUTE FROM ts) AS BIGINT) AS mi FROM {events}",
    "fn_date_trunc": "SELECT CAST(date_trunc('day', ts) AS DATE) AS d, count(*) AS n FROM {events} GROUP BY 1",
    "fn_date_arith": "SELECT event_id, ts - INTERVAL '1' DAY AS before, ts + INTERVAL '90' MINUTE AS after FROM {events} WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '7' DAY",
    "fn_substring": "SELECT p_partkey, substring(p_brand, 7, 2) AS b, substring(p_type, 1, 3) AS t FROM {part}",
    "fn_string": "SELECT n_nationkey, length(n_name) AS l, upper(lower(n_name)) AS u, n_name || '-' || n_regionkey AS c, md5(n_name) AS h, trim('  x ') AS t, replace(n_name, 'NATION', 'N') AS r FROM {nation}",
    "fn_math": "SELECT p_partkey, abs(-p_size) AS a, round(sqrt(p_size), 6) AS s, round(ln(p_retailprice), 6) AS l, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(power(p_size, 2), 2) AS p FROM {part}",
    "row_count": "SELECT count(*) AS n FROM {lineitem}",
    "cdf": "SELECT event_type, round(avg(CASE WHEN value <= 50 THEN 1.0E0 ELSE 0.0E0 END), 8) AS cdf50 FROM {events} GROUP BY event_type",
}

TIME_RANGE = {
    "ts_last_hour": "SELECT user_id, count(*) AS n, round(avg(value), 4) AS a FROM {events} WHERE ts >= TIMESTAMP '2024-01-30 23:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY user_id",
    "ts_last_day": "SELECT date_trunc('hour', ts) AS h, round(avg(value), 4) AS a, round(max(value), 4) AS m FROM {events} WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' GROUP BY 1",
    "ts_last_week": "SELECT CAST(date_trunc('day', ts) AS DATE) AS d, event_type, count(*) AS n, round(sum(value), 2) AS s FROM {events} WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1, 2",
    "ts_device_recent": "SELECT event_id, ts, value FROM {events} WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 100",
    "ts_anomaly": "SELECT event_id, user_id, value FROM {events} WHERE value > 300 OR value < 0.5",
    "ts_last_point": "SELECT event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) e WHERE rn = 1",
}

_E, _B = "{events}", "FROM {events}"
WEB = {
    1: f"SELECT count(*) AS n {_B}",
    2: f"SELECT count(*) AS n {_B} WHERE event_type <> 'view'",
    3: f"SELECT round(sum(value), 2) AS s, count(*) AS n, round(avg(value), 4) AS a {_B}",
    4: f"SELECT round(avg(user_id), 4) AS a {_B}",
    5: f"SELECT count(DISTINCT user_id) AS n {_B}",
    6: f"SELECT count(DISTINCT event_type) AS n {_B}",
    7: f"SELECT min(ts) AS a, max(ts) AS b {_B}",
    8: f"SELECT event_type, count(*) AS n {_B} WHERE event_type <> 'view' GROUP BY event_type ORDER BY n DESC, event_type",
    9: f"SELECT event_type, count(DISTINCT user_id) AS u {_B} GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    10: f"SELECT event_type, round(sum(value), 2) AS s, count(*) AS c, round(avg(value), 4) AS a, count(DISTINCT user_id) AS u {_B} GROUP BY event_type ORDER BY c DESC, event_type LIMIT 10",
    11: f"SELECT event_type, count(DISTINCT user_id) AS u {_B} WHERE value > 10 GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    12: f"SELECT event_type, CAST(hour(ts) AS BIGINT) AS h, count(DISTINCT user_id) AS u {_B} WHERE value > 10 GROUP BY 1, 2 ORDER BY u DESC, event_type, h LIMIT 10",
    13: f"SELECT event_type, count(*) AS c {_B} WHERE event_type <> '' GROUP BY event_type ORDER BY c DESC, event_type LIMIT 10",
    14: f"SELECT event_type, count(DISTINCT user_id) AS u {_B} WHERE event_type <> '' GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    15: f"SELECT user_id % 10 AS g, event_type, count(*) AS c {_B} WHERE event_type <> '' GROUP BY 1, 2 ORDER BY c DESC, g, event_type LIMIT 10",
    16: f"SELECT user_id, count(*) AS c {_B} GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10",
    17: f"SELECT user_id, event_type, count(*) AS c {_B} GROUP BY user_id, event_type ORDER BY c DESC, user_id, event_type LIMIT 10",
    18: f"SELECT user_id, event_type, count(*) AS c {_B} GROUP BY user_id, event_type",
    19: f"SELECT user_id, CAST(extract(MINUTE FROM ts) AS BIGINT) AS m, event_type, count(*) AS c {_B} GROUP BY 1, 2, 3 ORDER BY c DESC, user_id, m, event_type LIMIT 10",
    20: f"SELECT user_id {_B} WHERE user_id = 35",
    21: "SELECT count(*) AS n FROM {pages} WHERE url LIKE '%example.org%'",
    22: "SELECT substring(url, 1, 8) AS k, min(url) AS u, count(*) AS c FROM {pages} WHERE html LIKE '%track%' GROUP BY 1 ORDER BY c DESC, k LIMIT 10",
    23: "SELECT substring(url, 1, 8) AS k, min(url) AS u, count(*) AS c, count(DISTINCT url) AS d FROM {pages} WHERE html LIKE '%title%' AND url NOT LIKE '%ref=%' GROUP BY 1 ORDER BY c DESC, k LIMIT 10",
    24: "SELECT page_id, url FROM {pages} WHERE url LIKE '%example%' ORDER BY url, page_id LIMIT 10",
    25: f"SELECT event_type, event_id {_B} WHERE event_type <> 'view' ORDER BY ts, event_id LIMIT 10",
    26: f"SELECT event_type, event_id {_B} WHERE event_type <> 'view' ORDER BY event_type, event_id LIMIT 10",
    27: f"SELECT event_type, event_id {_B} WHERE event_type <> 'view' ORDER BY ts, event_type, event_id LIMIT 10",
    28: f"SELECT user_id, round(avg(length(event_type)), 4) AS l, count(*) AS c {_B} WHERE event_type <> '' GROUP BY user_id HAVING count(*) > 60 ORDER BY l DESC, user_id LIMIT 25",
    30: "SELECT " + ", ".join(f"round(sum(value + {i}), 2) AS s{i}" for i in range(20)) + f" {_B}",
    31: f"SELECT date_trunc('minute', ts) AS m, count(*) AS c {_B} GROUP BY 1 ORDER BY c DESC, m LIMIT 10",
    32: f"SELECT event_type, user_id % 3 AS g, CASE WHEN value > 50 THEN event_type ELSE '' END AS src, count(*) AS c {_B} GROUP BY 1, 2, 3 ORDER BY c DESC, event_type, g, src LIMIT 10",
    33: f"SELECT date_trunc('hour', ts) AS m, count(DISTINCT user_id) AS u {_B} GROUP BY 1 ORDER BY u DESC, m LIMIT 10",
    34: f"SELECT date_trunc('hour', ts) AS m, count(*) AS c, count(DISTINCT user_id) AS u {_B} WHERE event_type = 'click' GROUP BY 1 ORDER BY c DESC, m LIMIT 10",
    35: f"SELECT date_trunc('hour', ts) AS m, count(*) AS c, count(DISTINCT user_id) AS u {_B} WHERE event_type = 'purchase' AND value > 20 GROUP BY 1 ORDER BY c DESC, m LIMIT 10",
    36: f"SELECT user_id, count(*) AS c {_B} WHERE value > 20 GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10",
    37: f"SELECT user_id, event_type, count(*) AS c {_B} WHERE value > 20 GROUP BY 1, 2 ORDER BY c DESC, user_id, event_type LIMIT 10",
    38: f"SELECT user_id, event_type, count(*) AS c {_B} WHERE value > 40 GROUP BY 1, 2 ORDER BY c DESC, user_id, event_type LIMIT 10",
    39: f"SELECT CAST(ts AS DATE) AS d, count(*) AS c {_B} GROUP BY 1 ORDER BY c DESC, d LIMIT 10",
    40: f"SELECT CAST(ts AS DATE) AS d, count(DISTINCT user_id) AS u {_B} GROUP BY 1 ORDER BY u DESC, d LIMIT 10",
    41: f"SELECT date_trunc('hour', ts) AS h, count(*) AS c {_B} GROUP BY 1 ORDER BY c DESC, h LIMIT 24",
    42: f"SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS d, count(*) AS c {_B} GROUP BY 1, 2 ORDER BY c DESC, event_type, d LIMIT 10",
    43: f"SELECT event_type, count(*) AS c, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END), 2) AS s, round(avg(value), 4) AS a, count(DISTINCT user_id) AS u {_B} GROUP BY event_type ORDER BY c DESC, event_type LIMIT 10",
}

TEXTS = TPCH | RELATIONAL | TIME_RANGE | {f"web_q{n}": t for n, t in WEB.items()}
#: NOT IN becomes a broadcast of the whole subquery. Where its column can have no null, NOT EXISTS says the same and is an anti join.
PLANNED = {"tpch_q16": TPCH["tpch_q16"].replace("ps_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal < 0)", "ps_suppkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {supplier} WHERE s_suppkey = ps_suppkey AND s_acctbal < 0)")}
QUERIES = {n: spark_query(t) for n, t in (TEXTS | PLANNED).items()}
ORACLE = {n: oracle(t) for n, t in TEXTS.items()}
