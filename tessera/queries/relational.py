"""The relational surface of the dialect on the star-schema tables: each query as dialect text and as SQL for the check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.dialect import Dialect
from tessera.plans.cluster import table

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: name -> (dialect text, SQL of the check; None: the same text)
PAIRS: dict[str, tuple[str, str | None]] = {
    # projection and filters
    "select_exprs": ("SELECT c_custkey AS k, c_acctbal * 2 AS twice, c_name AS `full name` FROM customer", None),
    "quoted_identifier": ('SELECT "n_name" AS n, [n_regionkey] AS r FROM "nation" WHERE `n_nationkey` < 10', 'SELECT "n_name" AS n, n_regionkey AS r FROM nation WHERE n_nationkey < 10'),
    "filter_and_or": ("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice > 100000", None),
    "filter_inequality": ("SELECT count(*) AS n FROM part WHERE p_size <> 10 AND p_brand != 'Brand#11'", None),
    "between": ("SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 10", None),
    "in_list": ("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)", None),
    "in_subq": ("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", None),
    "not_in_subq": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 50000)", None),
    "exists_corr": ("SELECT c_custkey FROM customer AS c WHERE EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')", None),
    "not_exists_corr": ("SELECT c_custkey FROM customer AS c WHERE NOT EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey)", None),
    "filter_like_ci": ("SELECT n_nationkey FROM nation WHERE n_name LIKE '%AN%'", "SELECT n_nationkey FROM nation WHERE n_name ILIKE '%an%'"),
    "filter_not_like": ("SELECT n_nationkey FROM nation WHERE n_name NOT LIKE 'a%'", "SELECT n_nationkey FROM nation WHERE n_name NOT ILIKE 'a%'"),
    "is_null": ("SELECT count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL", None),
    "is_not_null": ("SELECT count(*) AS n FROM events WHERE props IS NOT NULL", None),
    "case_when": ("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders", None),
    "case_simple": ("SELECT r_name, CASE r_regionkey WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS tag FROM region", None),
    "iif": ("SELECT p_partkey, IIF(p_size > 25, 'big', 'small') AS s FROM part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS s FROM part"),
    "coalesce_nullif": ("SELECT p_partkey, IFNULL(NULLIF(p_size, 1), -1) AS s, p_size % 7 AS m FROM part WHERE p_size == 1 OR p_size > 45", "SELECT p_partkey, coalesce(nullif(p_size, 1), -1) AS s, p_size % 7 AS m FROM part WHERE p_size = 1 OR p_size > 45"),
    "number_text_compare": ("SELECT count(*) AS n FROM part WHERE p_size > '25'", "SELECT count(*) AS n FROM part WHERE p_size > 25"),
    "text_number_compare": ("SELECT count(*) AS n FROM nation WHERE n_name > 5", "SELECT count(*) AS n FROM nation WHERE n_name > '5'"),
    "rank_text_number": ("SELECT count(*) AS n FROM orders WHERE STRFTIME('%Y', o_orderdate) > 1990", "SELECT count(*) AS n FROM orders"),
    "truth_of_number": ("SELECT count(*) AS n FROM nation WHERE n_regionkey", "SELECT count(*) AS n FROM nation WHERE n_regionkey <> 0"),
    # joins
    "inner_join": ("SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 150000", None),
    "left_join": ("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", None),
    "multi_cond_join": ("SELECT count(*) AS n FROM supplier AS s INNER JOIN customer AS c ON s.s_nationkey = c.c_nationkey AND s.s_suppkey = c.c_custkey", None),
    "self_join": ("SELECT a.n_name AS x, b.n_name AS y FROM nation AS a INNER JOIN nation AS b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", None),
    "multiway_join": (
        "SELECT r_name, count(*) AS n FROM lineitem INNER JOIN orders ON l_orderkey = o_orderkey INNER JOIN customer ON o_custkey = c_custkey INNER JOIN nation ON c_nationkey = n_nationkey INNER JOIN region ON n_regionkey = r_regionkey INNER JOIN part ON p_partkey = l_partkey WHERE p_size < 10 GROUP BY r_name",
        None,
    ),
    "derived_join": ("SELECT c.c_custkey, t.n FROM customer AS c INNER JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS t ON t.o_custkey = c.c_custkey WHERE t.n > 12", None),
    "cross_join": ("SELECT count(*) AS n FROM region, nation WHERE n_regionkey = r_regionkey", None),
    "join_using": ("SELECT count(*) AS n FROM (SELECT n_nationkey AS k FROM nation) AS a JOIN (SELECT s_nationkey AS k FROM supplier) AS b USING (k)", None),
    "right_full_join": ("SELECT count(*) AS n, count(s_suppkey) AS m FROM supplier FULL OUTER JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 5", None),
    # aggregation
    "count_distinct": ("SELECT count(*) AS n, count(DISTINCT o_custkey) AS d FROM orders", None),
    "sum_avg_min_max": (
        "SELECT ROUND(SUM(o_totalprice), 2) AS s, ROUND(AVG(o_totalprice), 4) AS a, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders",
        None,
    ),
    "sum_case": ("SELECT SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f FROM orders", "SELECT CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f FROM orders"),
    "count_case": ("SELECT COUNT(CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE NULL END) AS f FROM orders", None),
    "sum_iif": ("SELECT SUM(IIF(o_orderpriority = '1-URGENT', 1, 0)) AS u FROM orders", "SELECT CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS u FROM orders"),
    "sum_bool": ("SELECT SUM(o_orderstatus = 'O') AS o, AVG(o_totalprice > 100000) AS a FROM orders", "SELECT CAST(SUM(CAST(o_orderstatus = 'O' AS INT)) AS BIGINT) AS o, AVG(CAST(o_totalprice > 100000 AS INT)) AS a FROM orders"),
    "ratio_real": ("SELECT CAST(SUM(IIF(o_orderpriority = '1-URGENT', 1, 0)) AS REAL) * 100 / COUNT(*) AS pct FROM orders", "SELECT CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS DOUBLE) * 100 / COUNT(*) AS pct FROM orders"),
    "divide_by_zero": ("SELECT COUNT(*) / (COUNT(*) - COUNT(*)) AS z FROM region", "SELECT CAST(NULL AS BIGINT) AS z"),
    "group_by_multi": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "group_by_alias": ("SELECT STRFTIME('%Y', o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY y", "SELECT strftime(o_orderdate, '%Y') AS y, COUNT(*) AS n FROM orders GROUP BY 1"),
    "having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15", None),
    "order_by_agg": ("SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 10", None),
    "nested_agg": ("SELECT AVG(n) AS a, MAX(n) AS m FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey)", None),
    "select_distinct": ("SELECT DISTINCT p_brand, p_size FROM part", None),
    "distinct_order_hidden": (
        "SELECT DISTINCT c_mktsegment FROM customer ORDER BY c_acctbal DESC LIMIT 3",
        "SELECT c_mktsegment FROM customer GROUP BY c_mktsegment ORDER BY max(c_acctbal) DESC LIMIT 3",
    ),
    "bare_column_max": (
        "SELECT c_mktsegment, c_custkey, MAX(c_acctbal) AS top FROM customer GROUP BY c_mktsegment",
        "SELECT c_mktsegment, arg_max(c_custkey, c_acctbal) AS c_custkey, MAX(c_acctbal) AS top FROM customer GROUP BY c_mktsegment",
    ),
    "bare_column_no_group": ("SELECT p_name, MIN(p_retailprice + p_partkey * 0.000001) AS least FROM part", "SELECT arg_min(p_name, p_retailprice + p_partkey * 0.000001) AS p_name, MIN(p_retailprice + p_partkey * 0.000001) AS least FROM part"),
    "bare_column_dependent": ("SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey", "SELECT any_value(n_name) AS n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey"),
    "group_concat": ("SELECT r_regionkey, COUNT(*) AS n, TOTAL(n_nationkey) AS t FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey", "SELECT r_regionkey, COUNT(*) AS n, CAST(SUM(n_nationkey) AS DOUBLE) AS t FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey"),
    # windows
    "rank": ("SELECT s_suppkey, RANK() OVER (ORDER BY s_acctbal DESC) AS r FROM supplier", None),
    "rank_partition_topn": ("SELECT c_custkey, rnk FROM (SELECT c_custkey, RANK() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rnk FROM customer) WHERE rnk <= 5", None),
    "dense_rank": ("SELECT p_partkey FROM (SELECT p_partkey, DENSE_RANK() OVER (ORDER BY p_size DESC) AS d FROM part) AS t WHERE d = 1", None),
    "rank_over_agg": ("SELECT c_nationkey, RANK() OVER (ORDER BY COUNT(c_custkey) DESC) AS r FROM customer GROUP BY c_nationkey", None),
    "window_running": ("SELECT n_nationkey, SUM(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation", "SELECT n_nationkey, CAST(SUM(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation"),
    # sort and limit
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5, 7", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 5"),
    "order_nulls": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey, c_custkey LIMIT 20", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey NULLS FIRST, c_custkey LIMIT 20"),
    "order_multi_ordinal": ("SELECT n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2 ASC LIMIT 8", None),
    # set operations and subqueries
    "union": ("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region", None),
    "union_all": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "except": ("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 20", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "cte": ("WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT o_custkey FROM big WHERE t > (SELECT AVG(t) * 2 FROM big)", None),
    "scalar_subq_cmp": ("SELECT p_partkey FROM part WHERE p_retailprice = (SELECT MAX(p_retailprice) FROM part)", None),
    "scalar_subq_select": ("SELECT n_name, (SELECT COUNT(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation", None),
    "scalar_subq_first": ("SELECT COUNT(*) AS n FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region ORDER BY r_name)", "SELECT COUNT(*) AS n FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region ORDER BY r_name LIMIT 1)"),
    "nested_subqueries": ("SELECT c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = (SELECT MIN(r_name) FROM region)))", None),
    "ties_all_rows": ("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) = (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM orders GROUP BY o_custkey)))", None),
    # scalar functions
    "cast_real_prefix": ("SELECT p_partkey, CAST(p_brand AS REAL) AS z, CAST(SUBSTR(p_brand, 7) || 'x' AS REAL) AS b FROM part", "SELECT p_partkey, 0.0::DOUBLE AS z, CAST(substr(p_brand, 7) AS DOUBLE) AS b FROM part"),
    "cast_int_prefix": ("SELECT p_partkey, CAST(p_retailprice AS INTEGER) AS i, CAST('3.9x' AS INTEGER) AS t FROM part", "SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS i, 3::BIGINT AS t FROM part"),
    "strftime_parts": ("SELECT o_orderkey, STRFTIME('%Y', o_orderdate) AS y, STRFTIME('%m', o_orderdate) AS m, STRFTIME('%d', o_orderdate) AS d FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%d') AS d FROM orders"),
    "date_functions": ("SELECT o_orderkey, DATE(o_orderdate) AS d, DATETIME(o_orderdate, '+1 day') AS t FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS t FROM orders"),
    "julian_diff": ("SELECT o_orderkey, ROUND(JULIANDAY('2000-01-01') - JULIANDAY(o_orderdate), 4) AS days FROM orders", "SELECT o_orderkey, round(julian(TIMESTAMP '2000-01-01') - julian(o_orderdate), 4) AS days FROM orders"),
    "year_difference": ("SELECT o_orderkey, STRFTIME('%Y', '2000-06-01') - STRFTIME('%Y', o_orderdate) AS years FROM orders", "SELECT o_orderkey, 2000 - year(o_orderdate) AS years FROM orders"),
    "pinned_now": ("SELECT COUNT(*) AS n, DATE('now') AS today FROM orders WHERE o_orderdate < CURRENT_TIMESTAMP", "SELECT COUNT(*) AS n, '2024-01-01' AS today FROM orders WHERE o_orderdate < TIMESTAMP '2024-01-01'"),
    "text_date_minus": ("SELECT DATETIME('2020-05-05') - DATETIME('1990-01-01') AS y FROM region", "SELECT 30.0::DOUBLE AS y FROM region"),
    "substr": ("SELECT p_partkey, SUBSTR(p_name, 2, 3) AS a, SUBSTR(p_name, 0, 2) AS b, SUBSTR(p_name, -3) AS c FROM part", "SELECT p_partkey, substr(p_name, 2, 3) AS a, substr(p_name, 0, 2) AS b, substr(p_name, -3) AS c FROM part"),
    "instr": ("SELECT p_partkey, INSTR(p_name, 'e') AS i FROM part", None),
    "concat": ("SELECT c_custkey, c_name || '/' || c_mktsegment AS x FROM customer", None),
    "round_abs_len": ("SELECT c_custkey, ROUND(c_acctbal, 1) AS r, ABS(c_acctbal) AS a, LENGTH(c_name) AS l FROM customer", None),
    "case_functions": ("SELECT n_nationkey, UPPER(n_name) AS u, LOWER(n_name) AS l, TRIM(' ' || n_name) AS t, REPLACE(n_name, 'A', '_') AS r FROM nation", None),
    "int_division": ("SELECT o_orderkey, o_orderkey / 7 AS q, 7 / 2 AS three, o_totalprice / 2 AS half FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, 3 AS three, o_totalprice / 2 AS half FROM orders"),
    "min_max_scalar": ("SELECT p_partkey, MAX(p_size, 20) AS hi, MIN(p_size, 20) AS lo FROM part", "SELECT p_partkey, greatest(p_size, 20) AS hi, least(p_size, 20) AS lo FROM part"),
    "bool_arithmetic": ("SELECT p_partkey, 2 * (p_size = 10) AS b FROM part", "SELECT p_partkey, 2 * CAST(p_size = 10 AS INT) AS b FROM part"),
    "glob": ("SELECT n_nationkey FROM nation WHERE n_name GLOB 'I*'", "SELECT n_nationkey FROM nation WHERE n_name LIKE 'I%'"),
    # forms that the queries above meet with constants or without rows
    "not_in_some": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", None),
    "not_exists_some": ("SELECT c_custkey FROM customer AS c WHERE NOT EXISTS (SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)", None),
    "like_folds_case": ("SELECT n_nationkey FROM nation WHERE n_name LIKE '%tion_1%'", "SELECT n_nationkey FROM nation WHERE n_name ILIKE '%tion_1%'"),
    "glob_class": ("SELECT p_partkey FROM part WHERE p_type GLOB '[A-M]*' AND p_name GLOB '*red?*'", None),
    "union_mixed": ("SELECT k || '' AS k FROM (SELECT n_nationkey AS k FROM nation UNION SELECT r_name FROM region) AS t", "SELECT CAST(n_nationkey AS VARCHAR) AS k FROM nation UNION SELECT r_name FROM region"),
    "month_overflow": (
        "SELECT o_orderkey, DATE(o_orderdate, '+1 month') AS d FROM orders",
        "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INT)), '%Y-%m-%d') AS d FROM orders",
    ),
    "row_values": ("SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT c_custkey, 'F' FROM customer WHERE c_nationkey = 3)", None),
    "row_compare": ("SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (700, 5000)", None),
    "json_member": (
        "SELECT event_id, JSON_EXTRACT(props, '$.k') || '' AS k FROM events WHERE JSON_EXTRACT(props, '$.k') > 50",
        "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50",
    ),
    "hex_unicode": ("SELECT n_nationkey, HEX(n_name) AS h, UNICODE(n_name) AS u FROM nation", None),
    "order_by_agg_ungrouped": ("SELECT COUNT(*) AS n, MIN(o_orderkey) AS k FROM orders ORDER BY MAX(o_totalprice)", None),
    "limit_unordered": ("SELECT COUNT(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 7)", None),
    "recursive_cte": ("WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 10) SELECT n FROM c", None),
}


def database(spark: SparkSession, d: str) -> Dialect:
    return Dialect(spark, {t: table(spark, d, t) for t in STAR})


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: database(spark, d).sql(text)


QUERIES = {n: _query(text) for n, (text, _) in PAIRS.items()}
SQL = {n: check or text.replace("`", '"') for n, (text, check) in PAIRS.items()}
