"""Queries over the driver's tables, one or more for each operator and function family, with DuckDB SQL beside them.

A query is text of the dialect, run by the engine, or a function of the session and the tables' folder. Its oracle is
SQL for the same rows; where the dialect's text is good SQL as it is, the oracle is that text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import compare
from granary.operators import changes, log, relational
from granary.plans.engine import Engine
from granary.plans.staging import numbered, shared_folder
from granary.sources import files, log_source, packs
from granary.streaming import refresh

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}

DIALECT: dict[str, tuple[str, str | None]] = {}
FUNCTIONS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, script: str) -> Engine:
    """An engine with the tables that a script names."""
    out = Engine(spark)
    words = set(re.findall(r"\w+", script.lower()))
    for name in TABLES:
        if name in words:
            out.attach(name, out.spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS.get(name))
    return out


def q(name: str, dialect: str, oracle: str | None = None) -> None:
    DIALECT[name] = (dialect, oracle or dialect)


def f(name: str, oracle: str | None):
    def keep(build):
        FUNCTIONS[name] = (build, oracle)
        return build

    return keep


FLAGSHIP = """
SELECT n_name, l_returnflag, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_shipdate >= '1995-01-01' GROUP BY n_name, l_returnflag ORDER BY revenue DESC, n_name, l_returnflag LIMIT 10"""
q("flagship", FLAGSHIP, FLAGSHIP.replace("'1995-01-01'", "TIMESTAMP '1995-01-01'"))

# scans, projections, predicates
q("scan_region", "SELECT * FROM region")
q("table_statement", "TABLE region", "SELECT * FROM region")
q("scan_dual", "SELECT 1 + 1 AS two FROM DUAL", "SELECT 2 AS two")
q("values_rows", "VALUES ROW(1, 'a'), ROW(2, 'b')", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS v(column_0, column_1)")
q("derived_table", "SELECT t.k, t.n FROM (SELECT n_regionkey AS k, COUNT(*) AS n FROM nation GROUP BY n_regionkey) AS t WHERE t.n > 1")
q("view_scan_whole", "CREATE VIEW rich AS SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000; SELECT * FROM rich WHERE c_acctbal < 9000", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_acctbal < 9000")
q("proj_exprs", "SELECT c_custkey, c_acctbal * 2 AS twice, n.* FROM customer JOIN nation n ON c_nationkey = n.n_nationkey")
q("proj_labels", "SELECT COUNT(*), MAX(o_orderkey) FROM orders", 'SELECT COUNT(*) AS "COUNT(*)", MAX(o_orderkey) AS "MAX(o_orderkey)" FROM orders')
q("filter_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
q("filter_truthy", "SELECT COUNT(*) AS n FROM part WHERE p_size % 2", "SELECT COUNT(*) AS n FROM part WHERE p_size % 2 <> 0")
q("cmp_rowctor", "SELECT n_name FROM nation WHERE (n_regionkey, n_nationkey) > (2, 10)")
q("row_in", "SELECT n_name FROM nation WHERE (n_regionkey, n_nationkey) IN ((1, 1), (2, 7), (3, 3))")
q("nullsafe_eq", "SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') <=> NULL AS missing FROM customer", "SELECT c_custkey, CAST(NULLIF(c_mktsegment, 'BUILDING') IS NULL AS INT) AS missing FROM customer")
q("logic_xor", "SELECT COUNT(*) AS n FROM part WHERE p_size > 25 XOR p_retailprice > 1000", "SELECT COUNT(*) AS n FROM part WHERE xor(CAST(p_size > 25 AS INT), CAST(p_retailprice > 1000 AS INT)) = 1")
q("logic_symbols", "SELECT COUNT(*) AS n FROM part WHERE p_size > 40 || (p_size < 5 && !(p_type = 'PROMO'))", "SELECT COUNT(*) AS n FROM part WHERE p_size > 40 OR (p_size < 5 AND NOT (p_type = 'PROMO'))")
q("three_valued", "SELECT COUNT(*) AS n FROM customer WHERE NOT (NULLIF(c_nationkey, 3) > 10)", "SELECT COUNT(*) AS n FROM customer WHERE NOT (NULLIF(c_nationkey, 3) > 10)")
q("like_ci", "SELECT p_partkey FROM part WHERE p_name LIKE '%EE%'", "SELECT p_partkey FROM part WHERE p_name ILIKE '%EE%'")
q("like_escape", "SELECT n_name FROM nation WHERE n_name LIKE 'nation|_1%' ESCAPE '|'", "SELECT n_name FROM nation WHERE n_name ILIKE 'nation|_1%' ESCAPE '|'")
q("like_backslash", r"SELECT n_name FROM nation WHERE n_name NOT LIKE 'NATION\\_2%'", "SELECT n_name FROM nation WHERE NOT n_name ILIKE 'NATION|_2%' ESCAPE '|'")
q("regexp_ci", "SELECT p_partkey FROM part WHERE p_name REGEXP '^[a-m].*e$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^[a-m].*e$', 'i')")
q("regexp_class", "SELECT COUNT(*) AS n FROM part WHERE p_brand RLIKE '[[:digit:]]{2}$'", "SELECT COUNT(*) AS n FROM part WHERE regexp_matches(p_brand, '[[:digit:]]{2}$')")
q("in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('building', 'Machinery')", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
q("not_in_list", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3)")
q("between", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN '1995-01-01' AND '1995-03-31'", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31'")
q("not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 40")
q("between_null", "SELECT COUNT(*) AS n FROM part WHERE NOT (p_size BETWEEN 10 AND NULLIF(p_size, p_size))", "SELECT 0 AS n")
q("is_null_bool", "SELECT COUNT(*) AS n FROM customer WHERE (c_acctbal > 0) IS NOT TRUE OR NULLIF(c_nationkey, 5) IS NULL")
q("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, CASE p_type WHEN 'promo' THEN 1 ELSE 0 END AS promo FROM part", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, CASE lower(p_type) WHEN 'promo' THEN 1 ELSE 0 END AS promo FROM part")
q("sounds_like", "SELECT COUNT(*) AS n FROM nation WHERE n_name SOUNDS LIKE 'nation'", "SELECT COUNT(*) AS n FROM nation WHERE n_name ILIKE 'nation%'")
q("arith_div_mod", "SELECT p_partkey, p_size DIV 7 AS d, p_size % 7 AS m, p_size / 0 AS z, p_size % 0 AS y, ROUND(p_size / 7, 4) AS x, -p_size AS neg FROM part", "SELECT p_partkey, p_size // 7 AS d, p_size % 7 AS m, CAST(NULL AS DOUBLE) AS z, CAST(NULL AS INT) AS y, ROUND(p_size / 7, 4) AS x, -p_size AS neg FROM part")
q("bitwise", "SELECT p_partkey, p_size & 6 AS a, p_size | 8 AS o, p_size ^ 5 AS x, p_size << 2 AS l, p_size >> 1 AS r FROM part", "SELECT p_partkey, p_size & 6 AS a, p_size | 8 AS o, xor(p_size, 5) AS x, CAST(p_size AS BIGINT) << 2 AS l, CAST(p_size AS BIGINT) >> 1 AS r FROM part")
q("power_binds_tighter", "SELECT p_partkey, 2 * p_size ^ 3 AS x FROM part", "SELECT p_partkey, 2 * xor(p_size, 3) AS x FROM part")
q("date_interval", "SELECT o_orderkey, DATE(o_orderdate) + INTERVAL 1 MONTH AS later, o_orderdate - INTERVAL 90 MINUTE AS earlier FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS later, o_orderdate - INTERVAL 90 MINUTE AS earlier FROM orders")
q("json_arrow", "SELECT event_id, props->'$.k' AS k, props->>'$.k' AS text FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, json_extract_string(props, '$.k') AS text FROM events")
q("casts", "SELECT c_custkey, CAST(c_acctbal AS SIGNED) AS s, CAST(c_acctbal AS CHAR(3)) AS c, CAST('12.7abc' AS SIGNED) AS lenient, CONVERT(c_nationkey, DOUBLE) AS d FROM customer WHERE c_acctbal > 100", "SELECT c_custkey, CAST(round(c_acctbal) AS BIGINT) AS s, left(CAST(c_acctbal AS VARCHAR), 3) AS c, CAST(13 AS BIGINT) AS lenient, CAST(c_nationkey AS DOUBLE) AS d FROM customer WHERE c_acctbal > 100")
q("lenient_numbers", "SELECT p_partkey, p_brand + 1 AS b, CONCAT(p_size, 'x') * 2 AS x FROM part", "SELECT p_partkey, CAST(1 AS DOUBLE) AS b, CAST(p_size * 2 AS DOUBLE) AS x FROM part")
q("variables", "SET @low = 40; SELECT p_partkey, p_size - @low AS over FROM part WHERE p_size > @low", "SELECT p_partkey, p_size - 40 AS over FROM part WHERE p_size > 40")
q("compare_folded", "SELECT COUNT(*) AS n FROM region WHERE r_name = 'asia  '", "SELECT COUNT(*) AS n FROM region WHERE r_name = 'ASIA'")

# subqueries and common table expressions
q("scalar_sub", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer)")
q("corr_scalar_sub", "SELECT n_name, (SELECT COUNT(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation")
q("in_sub", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
q("not_in_sub", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
q("in_sub_multi", "SELECT COUNT(*) AS n FROM customer WHERE (c_nationkey, c_mktsegment) IN (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9900)")
q("exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20)")
q("not_exists", "SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > 9000)")
q("any_sub_whole", "SELECT p_partkey FROM part WHERE p_size > ANY (SELECT p_size FROM part WHERE p_type = 'PROMO')")
q("all_sub", "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING')")
q("all_sub_null", "SELECT p_size > ALL (SELECT NULLIF(r_regionkey, 2) FROM region) AS x, COUNT(*) AS n FROM part GROUP BY x", "SELECT CASE WHEN p_size <= 4 THEN 0 END AS x, COUNT(*) AS n FROM part GROUP BY 1")
q("any_projected", "SELECT r_regionkey, r_regionkey = ANY (SELECT n_regionkey FROM nation WHERE n_nationkey < 3) AS x FROM region", "SELECT r_regionkey, CAST(r_regionkey = ANY (SELECT n_regionkey FROM nation WHERE n_nationkey < 3) AS INT) AS x FROM region")
q("cte_multi", "WITH a AS (SELECT n_regionkey AS k FROM nation), b (k, n) AS (SELECT k, COUNT(*) FROM a GROUP BY k) SELECT r_name, n FROM b JOIN region ON r_regionkey = k")
q("cte_rec_all", "WITH RECURSIVE t (n, s) AS (SELECT 1, 1 UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 50) SELECT n, s FROM t", "WITH RECURSIVE t (n, s) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, s + n + 1 FROM t WHERE n < 50) SELECT n, s FROM t")
q("cte_rec_union", "WITH RECURSIVE t (n) AS (SELECT 1 UNION SELECT (n * 3) % 31 FROM t) SELECT n FROM t")
q("cte_rec_join", "WITH RECURSIVE near (k, steps) AS (SELECT r_regionkey, 0 FROM region WHERE r_regionkey = 0 UNION ALL SELECT k + 1, steps + 1 FROM near JOIN region ON r_regionkey = k + 1) SELECT k, steps FROM near", "SELECT CAST(r_regionkey AS BIGINT) AS k, CAST(r_regionkey AS BIGINT) AS steps FROM region")

# joins
q("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
q("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
q("join_right", "SELECT c_custkey, n_name FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9500")
q("join_cross", "SELECT r.r_name, t.x FROM region r CROSS JOIN (SELECT 1 AS x UNION ALL SELECT 2) t")
q("join_comma", "SELECT COUNT(*) AS n FROM orders, customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
q("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey + b.n_regionkey > 6")
q("join_using_whole", "SELECT event_id, n FROM events JOIN (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id) c USING (user_id)")
q("join_using_star", "SELECT * FROM nation JOIN (SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey) c USING (n_regionkey)")
q("join_natural", "SELECT * FROM nation NATURAL JOIN (SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey = 2) z")
q("join_natural_right", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey < 5) x NATURAL RIGHT JOIN (SELECT n_nationkey AS k, n_regionkey AS b FROM nation WHERE n_nationkey < 9) y")
q("join_straight", "SELECT COUNT(*) AS n FROM nation STRAIGHT_JOIN region ON n_regionkey = r_regionkey", "SELECT COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey")
q("join_hints", "SELECT COUNT(*) AS n FROM orders USE INDEX (by_date) JOIN customer FORCE INDEX FOR JOIN (pk) ON o_custkey = c_custkey", "SELECT COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey")
q("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
q("join_multiway", "SELECT r_name, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
q("join_ci_text", "SELECT COUNT(*) AS n FROM customer JOIN (SELECT DISTINCT LOWER(c_mktsegment) AS seg FROM customer) s ON c_mktsegment = s.seg", "SELECT COUNT(*) AS n FROM customer")

# grouping
q("agg_global", "SELECT COUNT(*) AS n, SUM(p_size) AS s FROM part WHERE p_size > 1000", "SELECT COUNT(*) AS n, CAST(SUM(p_size) AS BIGINT) AS s FROM part WHERE p_size > 1000")
q("group_by", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_discount), 6) AS disc FROM lineitem GROUP BY l_returnflag, l_linestatus")
q("group_alias_ordinal", "SELECT YEAR(o_orderdate) AS y, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY y, 2", "SELECT YEAR(o_orderdate) AS y, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2")
q("group_folded", "SELECT UPPER(seg) AS seg, n FROM (SELECT seg, COUNT(*) AS n FROM (SELECT c_mktsegment AS seg FROM customer UNION ALL SELECT LOWER(c_mktsegment) FROM customer) t GROUP BY seg) u", "SELECT c_mktsegment AS seg, 2 * COUNT(*) AS n FROM customer GROUP BY 1")
q("group_firstrow", "SELECT n_regionkey, n_name FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, arg_min(n_name, n_nationkey) AS n_name FROM nation GROUP BY n_regionkey")
q("having", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING n > 55 AND MAX(c_acctbal) > 0", "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 55 AND MAX(c_acctbal) > 0")
q("having_nogroup", "SELECT p_partkey, p_size * 2 AS twice FROM part HAVING twice > 90", "SELECT p_partkey, p_size * 2 AS twice FROM part WHERE p_size * 2 > 90")
q("rollup1", "SELECT p_type, SUM(p_size) AS s FROM part GROUP BY p_type WITH ROLLUP", "SELECT p_type, CAST(SUM(p_size) AS BIGINT) AS s FROM part GROUP BY ROLLUP (p_type)")
q("rollup2", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority WITH ROLLUP", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
q("count_distinct_multi", "SELECT COUNT(DISTINCT c_nationkey, c_mktsegment) AS n, COUNT(DISTINCT c_mktsegment) AS m FROM customer", "SELECT COUNT(DISTINCT (c_nationkey, c_mktsegment)) AS n, COUNT(DISTINCT c_mktsegment) AS m FROM customer")
q("sum_distinct", "SELECT p_type, SUM(DISTINCT p_size) AS s, ROUND(AVG(DISTINCT p_size), 6) AS a FROM part GROUP BY p_type", "SELECT p_type, CAST(SUM(DISTINCT p_size) AS BIGINT) AS s, ROUND(AVG(DISTINCT p_size), 6) AS a FROM part GROUP BY p_type")
q("sum_avg_min_max", "SELECT c_mktsegment, ROUND(SUM(c_acctbal), 2) AS s, ROUND(AVG(c_acctbal), 4) AS a, MIN(c_name) AS lo, MAX(c_name) AS hi FROM customer GROUP BY c_mktsegment")
q("any_value", "SELECT n_regionkey, ANY_VALUE(n_regionkey) AS v FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, n_regionkey AS v FROM nation GROUP BY n_regionkey")
q("group_concat", "SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_nationkey DESC SEPARATOR '/') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '/' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey")
q("group_concat_distinct", "SELECT c_nationkey, GROUP_CONCAT(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS segs FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segs FROM customer GROUP BY c_nationkey")
q("group_concat_other", "SELECT p_type, GROUP_CONCAT(DISTINCT p_size ORDER BY p_size SEPARATOR ' ') AS sizes FROM part GROUP BY p_type", "SELECT p_type, array_to_string(list_sort(list_distinct(list(p_size))), ' ') AS sizes FROM part GROUP BY p_type")
q("std_var_pop", "SELECT p_type, ROUND(STD(p_size), 6) AS s, ROUND(STDDEV(p_size), 6) AS t, ROUND(VARIANCE(p_size), 6) AS v FROM part GROUP BY p_type", "SELECT p_type, ROUND(stddev_pop(p_size), 6) AS s, ROUND(stddev_pop(p_size), 6) AS t, ROUND(var_pop(p_size), 6) AS v FROM part GROUP BY p_type")
q("std_var_samp", "SELECT p_type, ROUND(STDDEV_SAMP(p_size), 6) AS s, ROUND(VAR_SAMP(p_size), 6) AS v FROM part GROUP BY p_type")
q("samp_of_one", "SELECT n_nationkey, STDDEV_SAMP(n_regionkey) AS s FROM nation GROUP BY n_nationkey", "SELECT n_nationkey, CAST(NULL AS DOUBLE) AS s FROM nation")
q("json_arrayagg", "SELECT n_regionkey, JSON_LENGTH(JSON_ARRAYAGG(n_name)) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(COUNT(*) AS INT) AS n FROM nation GROUP BY n_regionkey")
q("json_objectagg", "SELECT r_regionkey, JSON_OBJECTAGG(r_name, r_regionkey) AS o FROM region GROUP BY r_regionkey", "SELECT r_regionkey, '{\"' || r_name || '\":' || r_regionkey || '}' AS o FROM region")
q("bit_aggs", "SELECT p_type, BIT_OR(p_size) AS o, BIT_XOR(p_size) AS x FROM part GROUP BY p_type", "SELECT p_type, CAST(bit_or(p_size) AS BIGINT) AS o, CAST(bit_xor(p_size) AS BIGINT) AS x FROM part GROUP BY p_type")
q("bit_aggs_empty", "SELECT BIT_OR(p_size) AS o, BIT_XOR(p_size) AS x, CAST(BIT_AND(p_size) AS CHAR) AS a FROM part WHERE p_size < 0", "SELECT CAST(0 AS BIGINT) AS o, CAST(0 AS BIGINT) AS x, '18446744073709551615' AS a")
q("distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
q("distinct_order_other", "SELECT DISTINCT n_regionkey FROM nation ORDER BY n_nationkey LIMIT 3", "SELECT n_regionkey FROM nation GROUP BY n_regionkey ORDER BY min(n_nationkey) LIMIT 3")
q("sum_predicate", "SELECT c_nationkey, SUM(c_acctbal < 0) AS debtors, SUM(c_mktsegment = 'building') AS b FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, CAST(SUM(CAST(c_acctbal < 0 AS INT)) AS BIGINT) AS debtors, CAST(SUM(CAST(c_mktsegment = 'BUILDING' AS INT)) AS BIGINT) AS b FROM customer GROUP BY c_nationkey")
q("order_by_aggregate", "SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING COUNT(*) > 10 ORDER BY SUM(c_acctbal) DESC LIMIT 5")

# windows
q("w_row_number", "SELECT c_custkey, ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer")
q("w_rank", "SELECT p_partkey, RANK() OVER (PARTITION BY p_type ORDER BY p_size) AS r, DENSE_RANK() OVER (PARTITION BY p_type ORDER BY p_size) AS d FROM part")
q("w_percent", "SELECT p_partkey, ROUND(PERCENT_RANK() OVER (ORDER BY p_size), 10) AS p, ROUND(CUME_DIST() OVER (ORDER BY p_size), 10) AS c FROM part")
q("w_ntile", "SELECT c_custkey, NTILE(7) OVER (ORDER BY c_custkey) AS t FROM customer")
q("w_lag_lead", "SELECT event_id, LAG(value) OVER (PARTITION BY user_id ORDER BY event_id) AS a, LEAD(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events")
q("w_values", "SELECT event_id, FIRST_VALUE(event_type) OVER w1 AS x FROM events".replace("OVER w1", "OVER (PARTITION BY user_id ORDER BY event_id)"))
q("w_last_nth", "SELECT event_id, LAST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, NTH_VALUE(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events")
q("w_running_sum_peers", "SELECT p_partkey, SUM(p_retailprice > 0) OVER (PARTITION BY p_type ORDER BY p_size) AS s FROM part", "SELECT p_partkey, COUNT(*) OVER (PARTITION BY p_type ORDER BY p_size) AS s FROM part")
q("w_rows_frame", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM events")
q("w_whole_partition", "SELECT c_custkey, MAX(c_acctbal) OVER (PARTITION BY c_nationkey) AS m, COUNT(*) OVER () AS n FROM customer")
q("w_count_distinct", "SELECT c_custkey, COUNT(DISTINCT c_mktsegment) OVER (PARTITION BY c_nationkey) AS n FROM customer")
q("w_over_grouped", "SELECT c_nationkey, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS r, SUM(COUNT(*)) OVER () AS total FROM customer GROUP BY c_nationkey", "SELECT c_nationkey, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS r, CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total FROM customer GROUP BY c_nationkey")

# order, limits, set operations
q("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10, 15", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 10")
q("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
q("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
q("union_folded", "SELECT COUNT(*) AS n FROM (SELECT r_name FROM region UNION SELECT LOWER(r_name) FROM region) t", "SELECT COUNT(*) AS n FROM region")
q("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
q("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
q("minus_folded", "SELECT r_name FROM region MINUS SELECT 'europe'", "SELECT r_name FROM region WHERE r_name <> 'EUROPE'")
q("setop_precedence", "SELECT 1 AS x UNION SELECT 2 INTERSECT SELECT 3", "SELECT 1 AS x")
q("setop_parens", "(SELECT p_partkey AS k FROM part ORDER BY p_partkey LIMIT 3) UNION ALL (SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 2) ORDER BY k")

# functions
q("fn_text_1", "SELECT c_custkey, CONCAT(c_name, '/', c_mktsegment) AS a, CONCAT_WS('-', c_name, NULL, c_nationkey) AS b, LENGTH(c_name) AS c, CHAR_LENGTH(c_name) AS d, UPPER(c_mktsegment) AS e, LCASE(c_name) AS g FROM customer", "SELECT c_custkey, c_name || '/' || c_mktsegment AS a, concat_ws('-', c_name, NULL, c_nationkey) AS b, CAST(strlen(c_name) AS INT) AS c, CAST(length(c_name) AS INT) AS d, upper(c_mktsegment) AS e, lower(c_name) AS g FROM customer")
q("fn_text_2", "SELECT c_custkey, SUBSTRING(c_name, 2, 4) AS a, SUBSTRING(c_name, -3) AS b, SUBSTRING(c_name, 0, 2) AS z, LEFT(c_name, 3) AS c, RIGHT(c_name, 4) AS d, LPAD(c_custkey, 8, '0') AS e, RPAD(c_mktsegment, 12, '*') AS g, REVERSE(c_name) AS h FROM customer", "SELECT c_custkey, substring(c_name, 2, 4) AS a, right(c_name, 3) AS b, '' AS z, left(c_name, 3) AS c, right(c_name, 4) AS d, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS e, rpad(c_mktsegment, 12, '*') AS g, reverse(c_name) AS h FROM customer")
q("fn_text_3", "SELECT c_custkey, REPLACE(c_name, 'u', 'oo') AS a, INSTR(c_name, 'T') AS b, LOCATE('e', c_name, 4) AS c, REPEAT('ab', 3) AS d, SPACE(2) AS e, TRIM(BOTH 'C' FROM c_name) AS g, SUBSTRING_INDEX(c_name, '#', 1) AS h, INSERT(c_name, 2, 3, '_') AS i FROM customer", "SELECT c_custkey, replace(c_name, 'u', 'oo') AS a, CAST(instr(lower(c_name), 't') AS INT) AS b, CAST(CASE WHEN instr(substring(lower(c_name), 4), 'e') > 0 THEN instr(substring(lower(c_name), 4), 'e') + 3 ELSE 0 END AS INT) AS c, 'ababab' AS d, '  ' AS e, trim(c_name, 'C') AS g, split_part(c_name, '#', 1) AS h, substring(c_name, 1, 1) || '_' || substring(c_name, 5) AS i FROM customer")
q("fn_text_4", "SELECT c_custkey, FIELD(c_mktsegment, 'building', 'machinery') AS a, FIND_IN_SET('b', 'a,B,c') AS b, ELT(2, 'x', 'y') AS c, STRCMP(c_mktsegment, 'FURNITURE') AS d, ASCII(c_name) AS e, HEX(c_custkey) AS g, SHA2(c_name, 256) AS h, TO_BASE64(c_name) AS i, FROM_BASE64(TO_BASE64(c_name)) AS j, QUOTE(c_mktsegment) AS k FROM customer", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS a, 2 AS b, 'y' AS c, CASE WHEN c_mktsegment < 'FURNITURE' THEN -1 WHEN c_mktsegment = 'FURNITURE' THEN 0 ELSE 1 END AS d, CAST(ascii(c_name) AS INT) AS e, to_hex(c_custkey) AS g, sha256(c_name) AS h, base64(encode(c_name)) AS i, c_name AS j, '''' || c_mktsegment || '''' AS k FROM customer")
q("fn_regexp", "SELECT c_custkey, REGEXP_LIKE(c_name, 'CUST') AS a, REGEXP_REPLACE(c_name, '[0-9]+', '#') AS b, REGEXP_SUBSTR(c_name, '[0-9]') AS c, REGEXP_SUBSTR('a1b22c333', '[0-9]+', 1, 3) AS d, REGEXP_INSTR('a1b22', '[0-9]+', 1, 2) AS e, REGEXP_REPLACE('a1b2c3', '[0-9]', 'x', 1, 2) AS g FROM customer", "SELECT c_custkey, CAST(regexp_matches(c_name, 'CUST', 'i') AS INT) AS a, regexp_replace(c_name, '[0-9]+', '#', 'g') AS b, regexp_extract(c_name, '[0-9]') AS c, '333' AS d, 4 AS e, 'a1bxc3' AS g FROM customer")
q("fn_numeric_1", "SELECT p_partkey, ABS(p_size - 25) AS a, CEIL(p_retailprice) AS b, FLOOR(p_retailprice) AS c, SIGN(p_size - 25) AS d, ROUND(p_retailprice) AS e, TRUNCATE(p_retailprice, 1) AS g, MOD(p_size, 8) AS h, GREATEST(p_size, 20, 30) AS i, LEAST(p_size, 20) AS j, GREATEST(p_size, NULL) AS k FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS b, CAST(floor(p_retailprice) AS BIGINT) AS c, CAST(sign(p_size - 25) AS INT) AS d, round(p_retailprice) AS e, trunc(CAST(p_retailprice AS DECIMAL(18, 6)) * 10) / 10 AS g, p_size % 8 AS h, greatest(p_size, 30) AS i, least(p_size, 20) AS j, CAST(NULL AS INT) AS k FROM part")
q("fn_numeric_2", "SELECT p_partkey, ROUND(POW(p_size, 2), 6) AS a, ROUND(SQRT(p_size), 8) AS b, SQRT(-1) AS c, ROUND(LN(p_size), 8) AS d, LN(0) AS e, ROUND(LOG(2, p_size), 8) AS g, ROUND(EXP(1), 8) AS h, PI() AS i, ROUND(SIN(p_size), 8) AS j, ROUND(DEGREES(1), 8) AS k, ROUND(ATAN(1, 2), 8) AS l, ASIN(2) AS m, CONV('ff', 16, 10) AS n FROM part", "SELECT p_partkey, round(pow(p_size, 2), 6) AS a, round(sqrt(p_size), 8) AS b, CAST(NULL AS DOUBLE) AS c, round(ln(p_size), 8) AS d, CAST(NULL AS DOUBLE) AS e, round(log2(p_size), 8) AS g, round(exp(1), 8) AS h, CAST(3.141593 AS DOUBLE) AS i, round(sin(p_size), 8) AS j, round(degrees(1), 8) AS k, round(atan2(1, 2), 8) AS l, CAST(NULL AS DOUBLE) AS m, '255' AS n FROM part")
q("fn_format", "SELECT p_partkey, FORMAT(p_size * 1234.5, 2) AS a FROM part", "SELECT p_partkey, format('{:,.2f}', p_size * 1234.5) AS a FROM part")
q("fn_date_parts", "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, QUARTER(o_orderdate) AS k, DAYOFWEEK(o_orderdate) AS w, WEEKDAY(o_orderdate) AS wd, DAYOFYEAR(o_orderdate) AS dy, LAST_DAY(o_orderdate) AS l, WEEKOFYEAR(o_orderdate) AS wy, WEEK(o_orderdate) AS w0, HOUR(o_orderdate) AS h, EXTRACT(MONTH FROM o_orderdate) AS em, TO_DAYS(o_orderdate) AS td FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS k, CAST(dayofweek(o_orderdate) + 1 AS INT) AS w, CAST(isodow(o_orderdate) - 1 AS INT) AS wd, CAST(dayofyear(o_orderdate) AS INT) AS dy, last_day(o_orderdate) AS l, CAST(weekofyear(o_orderdate) AS INT) AS wy, CAST(strftime(o_orderdate, '%U') AS INT) AS w0, CAST(hour(o_orderdate) AS INT) AS h, CAST(month(o_orderdate) AS INT) AS em, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INT) + 719528 AS td FROM orders")
q("fn_date_arith", "SELECT o_orderkey, DATEDIFF(o_orderdate, '1992-01-01') AS a, DATE_ADD(DATE(o_orderdate), INTERVAL 3 WEEK) AS b, DATE_SUB(DATE(o_orderdate), INTERVAL 1 YEAR) AS c, TIMESTAMPDIFF(MONTH, '1992-01-15', o_orderdate) AS d, TIMESTAMPADD(HOUR, 5, o_orderdate) AS e, MAKEDATE(2024, 60) AS g, UNIX_TIMESTAMP(o_orderdate) AS h, FROM_DAYS(730000) AS i FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS INT) AS a, CAST(CAST(o_orderdate AS DATE) + INTERVAL 21 DAY AS DATE) AS b, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS c, datesub('month', TIMESTAMP '1992-01-15', o_orderdate) AS d, o_orderdate + INTERVAL 5 HOUR AS e, DATE '2024-02-29' AS g, CAST(epoch(o_orderdate) AS BIGINT) AS h, CAST(DATE '1970-01-01' + INTERVAL (730000 - 719528) DAY AS DATE) AS i FROM orders")
q("fn_date_format", "SELECT o_orderkey, DATE_FORMAT(o_orderdate, '%Y/%m/%d %H:%i') AS a, DATE_FORMAT(o_orderdate, '%W, %M') AS b, DAYNAME(o_orderdate) AS c, MONTHNAME(o_orderdate) AS d, STR_TO_DATE('28/09/2026', '%d/%m/%Y') AS e FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS a, strftime(o_orderdate, '%A, %B') AS b, dayname(o_orderdate) AS c, monthname(o_orderdate) AS d, DATE '2026-09-28' AS e FROM orders")
q("fn_time_whole", "SELECT event_id, SEC_TO_TIME(event_id) AS a, TIME_TO_SEC('01:02:03') AS b, CAST(TIMEDIFF('10:00:00', '08:30:00') AS CHAR) AS c, CAST(MAKETIME(30, 5, 1) AS CHAR) AS d FROM events", "SELECT event_id, event_id * 1000000 AS a, CAST(3723 AS BIGINT) AS b, '01:30:00' AS c, '30:05:01' AS d FROM events")
q("fn_flow", "SELECT p_partkey, IF(p_size > 25, 'big', 'small') AS a, IFNULL(NULLIF(p_size, 10), -1) AS b, COALESCE(NULL, NULLIF(p_type, 'promo'), 'none') AS c, ISNULL(NULLIF(p_size, 3)) AS d FROM part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS a, coalesce(nullif(p_size, 10), -1) AS b, coalesce(nullif(p_type, 'PROMO'), 'none') AS c, CAST(nullif(p_size, 3) IS NULL AS INT) AS d FROM part")
q("fn_json", """SELECT event_id, JSON_EXTRACT(props, '$.k') AS a, JSON_VALID(props) AS b, JSON_LENGTH(props) AS c, JSON_TYPE(props) AS d, JSON_KEYS(props) AS e, JSON_UNQUOTE('"x"') AS g, JSON_OBJECT('a', 1, 'b', 'two') AS h, JSON_ARRAY(1, 'x', NULL) AS i, JSON_CONTAINS('[1, 2]', '2') AS j, JSON_QUOTE('q') AS k FROM events""", """SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS a, 1 AS b, 1 AS c, 'OBJECT' AS d, '["k"]' AS e, 'x' AS g, '{"a":1,"b":"two"}' AS h, '[1,"x",null]' AS i, 1 AS j, '"q"' AS k FROM events""")
q("fn_info", "SELECT DATABASE() AS a, CONNECTION_ID() AS b, LAST_INSERT_ID() AS c, SLEEP(0) AS d", "SELECT 'main' AS a, 1 AS b, 0 AS c, 0 AS d")

q("fn_rest", """SELECT c_custkey, OCTET_LENGTH(c_name) AS a, BIT_LENGTH(c_name) AS b, LTRIM('  x ') AS c, RTRIM(' x  ') AS d, MID(c_name, 2, 3) AS e, POSITION('e' IN c_name) AS g, ORD(c_name) AS h, UNHEX('4142') AS i, NVL(NULLIF(c_nationkey, 3), -1) AS j,
  ROUND(LOG10(c_custkey + 1), 9) AS k, ROUND(COS(c_acctbal), 9) AS l, ROUND(TAN(c_nationkey), 9) AS m, ROUND(ACOS(0.25), 9) AS n, ROUND(COT(c_nationkey + 1), 9) AS o, ROUND(RADIANS(c_nationkey), 9) AS p FROM customer""",
  """SELECT c_custkey, CAST(strlen(c_name) AS INT) AS a, CAST(strlen(c_name) * 8 AS INT) AS b, 'x ' AS c, ' x' AS d, substr(c_name, 2, 3) AS e, CAST(instr(lower(c_name), 'e') AS INT) AS g, CAST(ascii(c_name) AS INT) AS h, 'AB' AS i, coalesce(nullif(c_nationkey, 3), -1) AS j,
  round(log10(c_custkey + 1), 9) AS k, round(cos(c_acctbal), 9) AS l, round(tan(c_nationkey), 9) AS m, round(acos(0.25), 9) AS n, round(cot(c_nationkey + 1), 9) AS o, round(radians(c_nationkey), 9) AS p FROM customer""")
q("fn_clock", """SELECT event_id, SECOND(ts) AS a, MICROSECOND(ts) AS b, YEARWEEK(ts) AS c, TIME_FORMAT(ts, '%H.%i.%s') AS d, ADDTIME(ts, '01:00:00') AS e, SUBTIME(ts, '00:00:05') AS g, CAST(ADDTIME('10:00:00', '00:30:00') AS CHAR) AS h, FROM_UNIXTIME(event_id) AS i, CONVERT_TZ(ts, 'UTC', 'CET') AS j,
  CAST(TIME(ts) AS CHAR) AS k, MICROSECOND('10:00:00.25') AS l, CAST(MAKETIME(-1, 30, 0) AS CHAR) AS m, MAKETIME(1, 60, 0) AS n, ADDTIME(DATE(ts), '01:00:00') AS o, TIME_FORMAT('05:06:07', '%H.%i.%s') AS p, TIMEDIFF(ts, '2024-01-01 00:00:00') AS r, TIME('nothing') AS s, TIMESTAMP(ts, '00:00:01') AS t FROM events""",
  """SELECT event_id, CAST(second(ts) AS INT) AS a, CAST(microsecond(ts) % 1000000 AS INT) AS b, CAST(year(ts) * 100 + CAST(strftime(ts, '%U') AS INT) AS INT) AS c, strftime(ts, '%H.%M.%S') AS d, ts + INTERVAL 1 HOUR AS e, ts - INTERVAL 5 SECOND AS g, '10:30:00' AS h, make_timestamp(event_id * 1000000) AS i, ts AS j,
  strftime(ts, '%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS k, 250000 AS l, '-01:30:00' AS m, CAST(NULL AS BIGINT) AS n, date_trunc('day', ts) + INTERVAL 1 HOUR AS o, '05.06.07' AS p, (epoch_us(date_trunc('second', ts)) - epoch_us(TIMESTAMP '2024-01-01')) AS r, CAST(NULL AS BIGINT) AS s, ts + INTERVAL 1 SECOND AS t FROM events""")
q("fn_now", "SELECT c_custkey, CHAR_LENGTH(UUID()) AS a, RAND() >= 0 AND RAND() < 1 AS b, NOW() > '2020-01-01' AS c, TIMESTAMPDIFF(DAY, CURDATE(), NOW()) < 2 AS d, CURTIME() IS NULL AS e FROM customer", "SELECT c_custkey, 36 AS a, 1 AS b, 1 AS c, 1 AS d, 0 AS e FROM customer")
q("collate_binary", "SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE utf8_general_ci = 'building' OR BINARY c_mktsegment = 'machinery'", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
q("sum_past_bigint", "SELECT SUM(CAST(o_orderkey AS DECIMAL(38, 0)) + 9223372036854775807) AS s, 9223372036854775807 + 1 AS t FROM orders", "SELECT CAST(sum(CAST(o_orderkey AS DECIMAL(38, 0)) + 9223372036854775807) AS DECIMAL(38, 0)) AS s, CAST(9223372036854775808 AS DECIMAL(20, 0)) AS t FROM orders")

# tables and rules
SHOP = """
CREATE TABLE seg (name VARCHAR(20) PRIMARY KEY, rank INT NOT NULL DEFAULT 9 CHECK (rank >= 0));
INSERT INTO seg (name, rank) VALUES ('BUILDING', 1), ('MACHINERY', 2), ('FURNITURE', 3);
CREATE TABLE cust AS SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg, c_nationkey AS nation FROM customer;
"""
CUST = "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg, c_nationkey AS nation FROM customer"
q("dml_insert_ignore", SHOP + "INSERT IGNORE INTO seg (name, rank) VALUES ('building', 7), ('NEW', 4), ('BAD', -1); SELECT name, rank FROM seg", "SELECT * FROM (VALUES ('BUILDING', 1), ('MACHINERY', 2), ('FURNITURE', 3), ('NEW', 4)) t(name, rank)")
q("dml_on_duplicate", SHOP + "INSERT INTO seg (name, rank) VALUES ('building', 7), ('NEW', 4), ('NEW', 5) ON DUPLICATE KEY UPDATE rank = rank + VALUES(rank); SELECT name, rank FROM seg", "SELECT * FROM (VALUES ('BUILDING', 8), ('MACHINERY', 2), ('FURNITURE', 3), ('NEW', 9)) t(name, rank)")
q("dml_replace", SHOP + "REPLACE INTO seg (name) VALUES ('BUILDING'), ('X'); SELECT name, rank FROM seg", "SELECT * FROM (VALUES ('BUILDING', 9), ('MACHINERY', 2), ('FURNITURE', 3), ('X', 9)) t(name, rank)")
q("dml_insert_select", SHOP + "INSERT INTO cust (id, name, seg, nation) SELECT id + 1000000, CONCAT(name, ' II'), seg, nation FROM cust WHERE nation = 3; SELECT id, name FROM cust", f"SELECT id, name FROM ({CUST}) UNION ALL SELECT id + 1000000, name || ' II' FROM ({CUST}) WHERE nation = 3")
q("dml_update_seq", SHOP + "UPDATE cust SET nation = nation + 100, name = CONCAT(nation, ':', name) WHERE seg = 'building'; SELECT id, name, nation FROM cust", f"SELECT id, CASE WHEN seg = 'BUILDING' THEN (nation + 100) || ':' || name ELSE name END AS name, CASE WHEN seg = 'BUILDING' THEN nation + 100 ELSE nation END AS nation FROM ({CUST})")
q("dml_update_join", SHOP + "UPDATE cust c JOIN seg s ON s.name = c.seg SET c.nation = s.rank WHERE s.rank < 3; SELECT id, nation FROM cust", f"SELECT id, CASE seg WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE nation END AS nation FROM ({CUST})")
q("dml_update_two_matches", SHOP + "CREATE TABLE rate (id INT PRIMARY KEY, seg VARCHAR(20), v INT); INSERT INTO rate VALUES (3, 'BUILDING', 30), (1, 'building', 10), (2, 'BUILDING', 20), (4, 'MACHINERY', 40); UPDATE cust c JOIN rate r ON r.seg = c.seg SET c.nation = r.v; SELECT id, nation FROM cust", f"SELECT id, CASE seg WHEN 'BUILDING' THEN 10 WHEN 'MACHINERY' THEN 40 ELSE nation END AS nation FROM ({CUST})")
q("dml_ignore_repeats", SHOP + "CREATE TABLE seen (seg VARCHAR(20) PRIMARY KEY, nation INT); INSERT IGNORE INTO seen SELECT seg, nation FROM cust ORDER BY id; SELECT COUNT(*) AS n FROM seen", "SELECT count(DISTINCT c_mktsegment) AS n FROM customer")
q("dml_replace_repeats", SHOP + "CREATE TABLE seen (seg VARCHAR(20) PRIMARY KEY, n INT, best INT UNIQUE); REPLACE INTO seen VALUES ('a', 1, 1), ('b', 2, 2), ('A', 3, 3), ('c', 4, 2), ('d', 5, 3), ('e', 6, NULL), ('f', 7, NULL); SELECT seg, n FROM seen", "SELECT * FROM (VALUES ('c', 4), ('d', 5), ('e', 6), ('f', 7)) t(seg, n)")
q("dml_upsert_repeats", SHOP + "CREATE TABLE seen (seg VARCHAR(20) PRIMARY KEY, n INT, m INT); INSERT INTO seen VALUES ('a', 1, 1), ('z', 0, 0); INSERT INTO seen VALUES ('b', 2, 2), ('A', 3, 3), ('b', 4, 4), ('a', 5, 5), ('c', 6, 6) ON DUPLICATE KEY UPDATE n = VALUES(n) * 10; SELECT seg, n, m FROM seen", "SELECT * FROM (VALUES ('a', 50, 1), ('z', 0, 0), ('b', 40, 2), ('c', 6, 6)) t(seg, n, m)")
q("dml_commit_twice", SHOP + "COMMIT; UPDATE seg SET rank = 7 WHERE name = 'building'; COMMIT; DELETE FROM seg WHERE rank = 2; COMMIT; UPDATE seg SET rank = 8; ROLLBACK; OPTIMIZE TABLE seg; SELECT name, rank FROM seg", "SELECT * FROM (VALUES ('BUILDING', 7), ('FURNITURE', 3)) t(name, rank)")
q("dml_update_order_limit", SHOP + "UPDATE cust SET nation = -1 ORDER BY id DESC LIMIT 5; SELECT id, nation FROM cust", f"SELECT id, CASE WHEN id > (SELECT max(id) - 5 FROM ({CUST})) THEN -1 ELSE nation END AS nation FROM ({CUST})")
q("dml_update_key", SHOP + "UPDATE seg SET name = 'HOUSE' WHERE name = 'BUILDING'; SELECT name, rank FROM seg", "SELECT * FROM (VALUES ('HOUSE', 1), ('MACHINERY', 2), ('FURNITURE', 3)) t(name, rank)")
q("dml_delete", SHOP + "DELETE FROM cust WHERE seg IN (SELECT name FROM seg WHERE rank > 1); SELECT id FROM cust", f"SELECT id FROM ({CUST}) WHERE seg NOT IN ('MACHINERY', 'FURNITURE')")
q("dml_delete_multi", SHOP + "DELETE c FROM cust c JOIN seg s ON s.name = c.seg WHERE s.rank = 3; SELECT id FROM cust", f"SELECT id FROM ({CUST}) WHERE seg <> 'FURNITURE'")
q("dml_rollback", SHOP + "COMMIT; DELETE FROM cust WHERE nation < 10; ROLLBACK; SELECT COUNT(*) AS n FROM cust", "SELECT COUNT(*) AS n FROM customer")
q("show_changes", SHOP + "COMMIT; UPDATE seg SET rank = 5 WHERE name = 'building'; DELETE FROM seg WHERE rank = 2; INSERT INTO seg (name) VALUES ('Q'); SHOW CHANGES", "SELECT 'seg' AS \"Table\", '1' AS \"New\", '1' AS \"Changed\", '1' AS \"Deleted\"")
LINKED = SHOP + "CREATE TABLE note (id INT AUTO_INCREMENT PRIMARY KEY, seg VARCHAR(20) REFERENCES seg (name) ON DELETE {0} ON UPDATE CASCADE, body TEXT); INSERT INTO note (seg, body) VALUES ('BUILDING', 'a'), ('building', 'b'), ('MACHINERY', 'c');"
q("fk_cascade", LINKED.format("CASCADE") + "DELETE FROM seg WHERE name = 'BUILDING'; SELECT id, body FROM note", "SELECT 3 AS id, 'c' AS body")
q("fk_set_null", LINKED.format("SET NULL") + "DELETE FROM seg WHERE name = 'BUILDING'; SELECT id, seg FROM note", "SELECT * FROM (VALUES (1, NULL), (2, NULL), (3, 'MACHINERY')) t(id, seg)")
q("fk_update_cascade", LINKED.format("CASCADE") + "UPDATE seg SET name = 'HOUSE' WHERE name = 'BUILDING'; SELECT id, seg FROM note", "SELECT * FROM (VALUES (1, 'HOUSE'), (2, 'HOUSE'), (3, 'MACHINERY')) t(id, seg)")
q("alter_fill", SHOP + "ALTER TABLE cust ADD COLUMN tier VARCHAR(5) NOT NULL DEFAULT 'A1' AFTER name, CHANGE nation country INT; SELECT * FROM cust", f"SELECT id, name, 'A1' AS tier, seg, nation AS country FROM ({CUST})")
q("alter_modify", SHOP + "ALTER TABLE cust MODIFY nation VARCHAR(10); SELECT id, CONCAT(nation, '!') AS n FROM cust", f"SELECT id, nation || '!' AS n FROM ({CUST})")
q("alter_primary", SHOP + "CREATE TABLE tag (t VARCHAR(5), label VARCHAR(9)); INSERT INTO tag (t, label) VALUES ('a', 'Alpha'), ('b', 'Beta'); ALTER TABLE tag ADD PRIMARY KEY (t); SELECT * FROM tag", "SELECT * FROM (VALUES ('a', 'Alpha'), ('b', 'Beta')) t(t, label)")
q("auto_increment", SHOP + "CREATE TABLE a (id INT AUTO_INCREMENT PRIMARY KEY, v VARCHAR(9)); ALTER TABLE a AUTO_INCREMENT = 100; INSERT INTO a (v) VALUES ('x'), ('y'); INSERT INTO a (id, v) VALUES (500, 'z'), (NULL, 'w'); SELECT id, v FROM a", "SELECT * FROM (VALUES (100, 'x'), (101, 'y'), (500, 'z'), (501, 'w')) t(id, v)")
q("show_columns", SHOP + "SHOW COLUMNS FROM seg", "SELECT * FROM (VALUES ('name', 'VARCHAR(20)', 'NO', 'PRI', NULL, ''), ('rank', 'INT', 'NO', '', '9', '')) t(\"Field\", \"Type\", \"Null\", \"Key\", \"Default\", \"Extra\")")
q("show_tables", SHOP + "CREATE VIEW v AS SELECT 1 AS x; SHOW FULL TABLES LIKE 'c%'", "SELECT * FROM (VALUES ('cust', 'BASE TABLE'), ('customer', 'BASE TABLE')) t(\"Tables_in_main\", \"Table_type\")")
SEG = SHOP[: SHOP.index("CREATE TABLE cust")]
q("create_index", SEG + "CREATE INDEX by_rank ON seg (rank); SHOW INDEX FROM seg", "SELECT * FROM (VALUES ('seg', '0', 'PRIMARY', '1', 'name'), ('seg', '1', 'by_rank', '1', 'rank')) t(\"Table\", \"Non_unique\", \"Key_name\", \"Seq_in_index\", \"Column_name\")")
q("drop_index", SEG + "CREATE INDEX by_rank ON seg (rank); DROP INDEX by_rank ON seg; SHOW INDEX FROM seg", "SELECT 'seg' AS \"Table\", '0' AS \"Non_unique\", 'PRIMARY' AS \"Key_name\", '1' AS \"Seq_in_index\", 'name' AS \"Column_name\"")
q("describe", SEG + "DESCRIBE seg", "SELECT * FROM (VALUES ('name', 'VARCHAR(20)', 'NO', 'PRI', NULL, ''), ('rank', 'INT', 'NO', '', '9', '')) t(\"Field\", \"Type\", \"Null\", \"Key\", \"Default\", \"Extra\")")
q("show_status", SEG + "SHOW TABLE STATUS", "SELECT 'seg' AS \"Name\", '3' AS \"Rows\", '1' AS \"Auto_increment\", '' AS \"Comment\"")
q("show_grants", SEG + "GRANT INSERT ON seg TO PUBLIC; SHOW GRANTS FOR seg", "SELECT 'seg' AS \"Table\", 'PUBLIC' AS \"Writer\"")
q("revoke", SEG + "GRANT INSERT ON seg TO PUBLIC; REVOKE INSERT ON seg FROM PUBLIC; SHOW GRANTS FOR seg", "SELECT 'seg' AS \"Table\", 'owner' AS \"Writer\"")
q("show_variables", "SET @@depth = 5; SHOW VARIABLES LIKE 'dep%'", "SELECT 'DEPTH' AS \"Variable_name\", '5' AS \"Value\"")
q("use_database", "CREATE DATABASE stock; USE stock; LOCK TABLES x WRITE; SELECT DATABASE() AS d", "SELECT 'stock' AS d")
q("drop_table", SHOP + "DROP TABLE seg; DROP TABLE IF EXISTS nowhere; SHOW TABLES LIKE 'seg%'", "SELECT 'x' AS \"Tables_in_main\" WHERE false")
q("add_unique", SEG + "ALTER TABLE seg ADD UNIQUE (rank); INSERT IGNORE INTO seg (name, rank) VALUES ('TWICE', 1), ('ONCE', 8); SELECT name, rank FROM seg", "SELECT * FROM (VALUES ('BUILDING', 1), ('FURNITURE', 3), ('MACHINERY', 2), ('ONCE', 8)) t(name, rank)")
q("check_follows_rename", SEG + "ALTER TABLE seg ADD CONSTRAINT low CHECK (rank < 50); ALTER TABLE seg CHANGE rank place INT NOT NULL DEFAULT 9; INSERT IGNORE INTO seg (name, place) VALUES ('HIGH', 60), ('LOW', 40), ('NONE', NULL); SELECT name, place FROM seg WHERE name <> 'none'", "SELECT * FROM (VALUES ('BUILDING', 1), ('FURNITURE', 3), ('MACHINERY', 2), ('LOW', 40)) t(name, place)")
q("touch_on_update", "CREATE TABLE note (id INT PRIMARY KEY, v INT, at DATETIME DEFAULT '2020-01-01 00:00:00' ON UPDATE CURRENT_TIMESTAMP); INSERT INTO note (id, v) VALUES (1, 1), (2, 2); UPDATE note SET v = 5 WHERE id = 2; SELECT id, v, at > '2021-01-01' AS touched FROM note", "SELECT * FROM (VALUES (1, 1, 0), (2, 5, 1)) t(id, v, touched)")
q("create_like", SHOP + "CREATE TABLE seg2 LIKE seg; INSERT INTO seg2 (name) VALUES ('only'); SELECT * FROM seg2", "SELECT 'only' AS name, 9 AS rank")
q("truncate", SHOP + "TRUNCATE TABLE cust; SELECT COUNT(*) AS n FROM cust", "SELECT 0 AS n")
q("rename_table", SHOP + "RENAME TABLE cust TO clients; SELECT COUNT(*) AS n FROM clients", "SELECT COUNT(*) AS n FROM customer")
q("explain", "EXPLAIN SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT * FROM (VALUES ('1', 'nation', '25', 'scan; Spark plans filters, joins and order'), ('2', 'region', '5', 'scan; Spark plans filters, joins and order')) t(id, \"table\", \"rows\", \"access\")")


def place(spark: SparkSession, sf_dir: str, script: str) -> DataFrame:
    """The rows of an ordered query, numbered in its order."""
    return numbered(engine(spark, sf_dir, script).sql(script), "place")


# operators on DataFrames
@f("order_nulls_whole", "SELECT c_custkey, row_number() OVER (ORDER BY NULLIF(c_nationkey, 3) NULLS FIRST, c_custkey) AS place FROM customer")
def _(spark, d):
    return place(spark, d, "SELECT c_custkey FROM customer ORDER BY NULLIF(c_nationkey, 3), c_custkey")


@f("order_ordinal_alias_whole", "SELECT c_custkey AS k, c_acctbal AS b, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS place FROM customer")
def _(spark, d):
    return place(spark, d, "SELECT c_custkey AS k, c_acctbal AS b FROM customer ORDER BY 2 DESC, k")


@f("join_semi", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def _(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@f("join_anti", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def _(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@f("cmp_key", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE lower(p_type) END AS k FROM part")
def _(spark, d):
    mixed = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("0"), F.col("p_size").cast("string"), F.lit(".0"))).otherwise(F.concat(F.col("p_type"), F.lit("  ")))
    return table(spark, d, "part").select("p_partkey", compare.cmp_key(mixed).alias("k"))


@f("explorer_search", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(concat_ws(' ', c_custkey, c_name, c_mktsegment)) LIKE '%77%'")
def _(spark, d):
    return relational.search_rows(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "77", order="c_custkey")


SEARCHED = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_mktsegment c_nationkey", "supplier": "s_suppkey s_name s_nationkey", "part": "p_partkey p_name p_brand p_type p_size",
    "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_returnflag l_linestatus", "events": "event_id user_id event_type props", "documents": "doc_id text lang source",
    "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}


@f(
    "db_search_whole",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS \"table\", count(*) AS n FROM {name} WHERE contains(lower(concat_ws(' ', {', '.join(columns.split())})), '17')" for name, columns in SEARCHED.items()) + ") WHERE n > 0",
)
def _(spark, d):
    return relational.search_tables({name: table(spark, d, name).select(*columns.split()) for name, columns in SEARCHED.items()}, "17")


@f("find_replace", "SELECT p_partkey, regexp_replace(p_name, 'e', '3', 'gi') AS p_name FROM part WHERE p_name ILIKE '%e%'")
def _(spark, d):
    return relational.find_replace(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", "e", "3")


@f("qbe_search", "SELECT p_partkey FROM part WHERE p_size > 30 AND p_type ILIKE 'pro%' AND p_brand IS NOT NULL")
def _(spark, d):
    return relational.by_example(table(spark, d, "part"), {"p_size": "> 30", "p_type": "pro*", "p_brand": "not empty"}).select("p_partkey")


@f("csv_guard_whole", "SELECT doc_id, CASE WHEN regexp_matches(x, '^[=@\\t\\r]') OR (regexp_matches(x, '^[+-]') AND NOT regexp_matches(x, '^[+-]\\s*([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$') AND trim(substr(x, 2), ' ') <> '') THEN '''' || x ELSE x END AS cell FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || text AS x FROM documents)")
def _(spark, d):
    mark = F.element_at(F.array(F.lit("="), F.lit("-"), F.lit("@"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", files.guarded(F.concat(mark, F.col("text"))).alias("cell"))


@f("json_rows_sink", "SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def _(spark, d):
    return files.json_rows(table(spark, d, "region"))


@f("unique_violations", "SELECT CAST(n_regionkey AS VARCHAR) AS \"key\", count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
def _(spark, d):
    return changes.repeated(table(spark, d, "nation"), ["n_regionkey"])


@f("fk_violations", "SELECT o_orderkey AS \"key\", CAST(o_custkey AS VARCHAR) AS missing FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def _(spark, d):
    return changes.orphans(table(spark, d, "orders"), "o_orderkey", "o_custkey", table(spark, d, "customer").filter("c_nationkey < 20"), "c_custkey")


@f("check_violations", "SELECT p_partkey AS \"key\", 'small' AS rule FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey, 'cheap' FROM part WHERE p_retailprice > 1500")
def _(spark, d):
    return changes.broken(table(spark, d, "part"), "p_partkey", {"small": F.col("p_size") <= 45, "cheap": F.col("p_retailprice") <= 1500})


@f("problems_report", "SELECT 'check' AS kind, 'small' AS rule, count(*) AS n FROM part WHERE p_size > 45 UNION ALL SELECT 'unique', 'p_size', count(*) FROM (SELECT p_size FROM part GROUP BY 1 HAVING count(*) > 1)")
def _(spark, d):
    part = table(spark, d, "part")
    return changes.report({"small": F.col("p_size") <= 45}, part, "p_partkey", [["p_size"]])


# the log
EVENTS_LAST = """SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'"""


def event_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("gone"))


@f("log_latest", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    return log.latest(event_log(spark, d), "user_id", "event_id").select("user_id", "event_id")


@f(
    "log_merge_latest",
    f"""WITH last AS ({EVENTS_LAST}), dead AS (SELECT user_id, max(event_id) AS x FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT l.user_id, l.event_id, l.event_type, (SELECT count(*) FROM events e WHERE e.user_id = l.user_id AND e.event_type <> 'error' AND e.event_id > coalesce(d.x, -1)) AS versions,
  (SELECT min(event_id) FROM events e WHERE e.user_id = l.user_id AND e.event_type <> 'error') AS first_seq FROM last l LEFT JOIN dead d USING (user_id)""",
)
def _(spark, d):
    held = event_log(spark, d).withColumn("seq", F.col("event_id"))
    return log.merge(held, "user_id", "seq", "gone").select("user_id", "event_id", "event_type", "versions", "first_seq")


@f("log_clear", "SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_type = 'error' AND user_id = 7)")
def _(spark, d):
    held = event_log(spark, d)
    return log.after_clear(held, "event_id", clears=held.filter("event_type = 'error' AND user_id = 7").select("event_id")).select("event_id")


@f(
    "log_rekey",
    """WITH a AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_id < 400 GROUP BY user_id),
b AS (SELECT e.event_type, e.event_id FROM events e JOIN a USING (event_id) UNION ALL SELECT event_type, event_id FROM events WHERE event_id >= 400)
SELECT event_type, max(event_id) AS event_id FROM b GROUP BY event_type""",
)
def _(spark, d):
    held = event_log(spark, d).withColumn("gone", F.lit(False))
    return log.replay(held, [(0, "user_id"), (400, "event_type")], "event_id", "gone").select("event_type", "event_id")


@f("log_checkpoint", "SELECT event_id FROM events WHERE event_id >= 300")
def _(spark, d):
    held = event_log(spark, d).withColumn("pack", F.col("event_id").cast("string"))
    marks = spark.createDataFrame([(350, ["300", "301"], "owner"), (360, ["305", "nowhere"], "owner"), (380, ["310"], "other")], "event_id long, packs array<string>, signer string")
    return log.from_checkpoint(held, marks, "pack", "event_id", F.col("signer") == "owner").select("event_id")


@f("log_official", "SELECT event_id, user_id IN (1, 2) AS official FROM events WHERE user_id IN (1, 2)")
def _(spark, d):
    held = event_log(spark, d).withColumn("signer", F.col("user_id").cast("string"))
    return log.by_writer(held, "signer", "1", ["2"]).select("event_id", "official")


@f("log_unofficial", "SELECT count(*) AS n FROM events WHERE user_id NOT IN (1, 2)")
def _(spark, d):
    held = event_log(spark, d).withColumn("signer", F.col("user_id").cast("string"))
    return log.by_writer(held, "signer", "1", ["2"], "unofficial").agg(F.count(F.lit(1)).alias("n"))


@f("log_align_fill", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'none' AS extra FROM events")
def _(spark, d):
    held = table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("values"))
    return log.aligned(held, [("k", "k", "int", None), ("extra", "zz", "string", "none")])


@f(
    "log_budget",
    """WITH o AS (SELECT event_id, sum(event_id % 100) OVER (ORDER BY event_id DESC) AS run FROM events WHERE user_id <> 1 AND event_id % 100 <= 90)
SELECT event_id FROM o WHERE run <= 5000 UNION ALL SELECT event_id FROM events WHERE user_id = 1""",
)
def _(spark, d):
    held = event_log(spark, d).withColumn("size", F.col("event_id") % 100)
    return log.within_budget(held, "size", "event_id", F.col("user_id") == 1, pack_bytes=90, total_bytes=5000).select("event_id")


@f("chunk_reassembly", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(DISTINCT turn) AS n_parts FROM conversations GROUP BY conv_id HAVING count(DISTINCT turn) = 4")
def _(spark, d):
    return log.reassemble(table(spark, d, "conversations").withColumn("total", F.lit(4)), ["conv_id"], "turn", "text", "total")


@f("sheet_overlay", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN n_nationkey % 5 = 1 THEN 'X' ELSE n_name END AS n_name, CASE n_nationkey % 5 WHEN 1 THEN 'Changed' WHEN 2 THEN 'Deleted' ELSE 'Saved' END AS state FROM nation UNION ALL SELECT 100, 'N', 'New'")
def _(spark, d):
    base = table(spark, d, "nation").select(F.col("n_nationkey").cast("long"), "n_name")
    key = F.col("n_nationkey") % 5
    pending = base.filter(key.isin(1, 2, 3)).select("n_nationkey", F.when(key == 1, "X").otherwise(F.col("n_name")).alias("n_name"), (key == 2).alias("gone"))
    new = spark.createDataFrame([(100, "N", False), (101, "dropped", True)], pending.schema)
    return log.overlay(base, pending.unionAll(new), "n_nationkey", "gone")


@f("commit_log", "SELECT user_id, event_id, value, CASE WHEN lag(event_id) OVER w IS NULL THEN 'Added' WHEN value = lag(value) OVER w AND event_type = lag(event_type) OVER w THEN 'Repeated' ELSE 'Changed' END AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _(spark, d):
    held = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return log.commits(held, "user_id", "event_id").select("user_id", "event_id", "value", "change")


@f("log_own_writes", "SELECT event_id, user_id FROM events")
def _(spark, d):
    held = table(spark, d, "events").select("event_id", "user_id")
    return log.with_own_writes(held.filter("event_id % 10 <> 3 OR user_id <> 5"), held.filter("user_id = 5"), "user_id", "event_id")


@f("log_newest_pages", "SELECT DISTINCT event_id // 100 AS page FROM events WHERE event_id // 100 >= (SELECT max(event_id // 100) FROM events WHERE event_type = 'error' AND user_id = 7)")
def _(spark, d):
    held = table(spark, d, "events").withColumn("page", F.floor(F.col("event_id") / 100))
    return log.newest_pages(held, "page", (F.col("event_type") == "error") & (F.col("user_id") == 7)).select("page").distinct()


@f("reassembly_resent", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*) AS n_parts FROM conversations GROUP BY conv_id HAVING count(*) = 4 AND min(turn) = 0 AND max(turn) = 3 AND conv_id % 3 <> 1")
def _(spark, d):
    held = table(spark, d, "conversations").withColumn("total", F.lit(4))
    first_lost = held.filter("NOT (conv_id % 3 = 1 AND turn = 0)")
    return log.reassemble(first_lost.unionAll(first_lost.filter("turn % 2 = 1")), ["conv_id"], "turn", "text", "total")


@f("pack_counts", "SELECT CAST(count(*) AS BIGINT) AS n FROM conversations")
def _(spark, d):
    held = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("k"), F.concat(F.lit("x],[y"), "text").alias("v"))
    return packs.write_packs(held, "k").agg(F.sum("n_records").alias("n"))


@f("pack_round_trip", "SELECT CAST(n_nationkey AS VARCHAR) AS \"key\", n_name FROM nation")
def _(spark, d):
    held = packs.decode(packs.write_packs(table(spark, d, "nation"), "n_nationkey", 400))
    return held.select("key", F.col("values")["n_name"].alias("n_name"))


@f("import_upsert", "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 77, 'NEW'")
def _(spark, d):
    e = Engine(spark)
    nation = e.spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name")
    e.write("n", nation)
    new = e.spark.createDataFrame([(77, "NEW", 1)], "n_nationkey int, n_name string, ignored int")
    e.write("n", nation.filter("n_nationkey < 3").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!"))).withColumn("ignored", F.lit(0)).unionAll(new))
    return e.sql("SELECT n_nationkey, n_name FROM n")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@f("csv_round_trip", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(spark, d):
    path = new_folder(spark, "csv")
    files.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return files.typed(files.read_csv(spark, path, delimiter=","))


@f("tsv_source", "SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_custkey AS VARCHAR) AS c, o_orderpriority AS p FROM orders")
def _(spark, d):
    path = new_folder(spark, "tsv")
    table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p")).write.csv(path, header=True, sep="\t")
    return files.read_csv(spark, path)


@f("json_round_trip", "SELECT doc_id, text, lang FROM documents")
def _(spark, d):
    path = new_folder(spark, "json")
    files.write_json(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return spark.read.schema("doc_id long, text string, lang string").json(path)


@f("cols_rows_source", "SELECT * FROM (VALUES (1, 'a', 0.5), (2, '7', 2.0), (3, NULL, NULL)) t(k, v, x)")
def _(spark, d):
    return files.from_table(spark, ["k", "v", "x"], [[1, "a", 0.5], [2, 7, 2], [3]])


@f("dump_round_trip", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    e, copy = Engine(spark), Engine(spark)
    for name in ("region", "nation"):
        e.write(name, e.spark.read.parquet(f"{d}/{name}.parquet"))
    copy.run("\n".join(e.dump()), import_mode=True)
    return copy.sql("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")


@f("log_source", "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS p, CAST(user_id AS VARCHAR) AS signer, event_id AS time FROM events")
def _(spark, d):
    folder = new_folder(spark, "log")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("p"), F.col("user_id").cast("string").alias("signer"), F.col("event_id").alias("time"))
    rows.select(F.to_json(F.struct("*"))).write.text(folder)
    log_source.register(spark)
    return spark.read.format("granary_log").option("path", folder).option("suffix", ".txt").load()


@f("log_follow", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, d):
    source, target, marks = (new_folder(spark, x) for x in ("arrivals", "followed", "marks"))
    held = table(spark, d, "events").select("user_id", "event_id", "event_type")
    for part in (held.filter("event_type = 'error'"), held.filter("event_type <> 'error'")):
        part.write.mode("append").json(source)
        refresh.follow(spark, source, target, "user_id long, event_id long, event_type string", "user_id", "event_id", marks).awaitTermination()
    return refresh.current(spark, target).select("user_id", "event_id")


@f("windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return refresh.windowed_counts(table(spark, d, "events"), "ts", "1 hour", "10 minutes", "event_type")


def run_dialect(script: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, script).sql(script)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run_dialect(script) for name, (script, _) in DIALECT.items()} | {name: build for name, (build, _) in FUNCTIONS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for held in (DIALECT, FUNCTIONS) for name, (_, sql) in held.items() if sql}
