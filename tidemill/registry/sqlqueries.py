"""SQL box: read-only statements over registered tables, covering the dialect users rely on."""

from tidemill.operators.sql import run_sql_query
from tidemill.registry import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# name -> (Spark SQL, the other dialect's form where it differs)
STATEMENTS = {
    "projection_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "group_order": ("SELECT p_type, COUNT(*) AS cnt FROM part GROUP BY p_type ORDER BY cnt DESC", None),
    "left_join": (
        "SELECT c.c_custkey, c.c_name, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey",
        None,
    ),
    "count_distinct": ("SELECT COUNT(*) AS total_rows, COUNT(DISTINCT user_id) AS unique_vals FROM events", None),
    "inner_join_chain": (
        """SELECT r_name, n_name, COUNT(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
           JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""",
        None,
    ),
    "cross_join": (
        "SELECT o_orderkey, o_totalprice / a.top AS share FROM orders CROSS JOIN (SELECT MAX(o_totalprice) AS top FROM orders) a",
        None,
    ),
    "self_join": (
        """SELECT a.o_orderkey, b.o_totalprice - a.o_totalprice AS rise FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""",
        None,
    ),
    "theta_join": (
        "SELECT r_name, COUNT(*) AS n FROM orders JOIN region ON o_totalprice >= r_regionkey * 100000 GROUP BY r_name",
        None,
    ),
    "exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')", None),
    "not_exists": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "not_exists_filtered": ("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P')", None),
    "except_filtered": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'", None),
    "in_subquery": ("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", None),
    "not_in": ("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity > 48)", None),
    "scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)", None),
    "correlated_subquery": (
        """SELECT o_orderkey, o_totalprice FROM orders o
           WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""",
        None,
    ),
    "cte": (
        """WITH spend AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey)
           SELECT c_mktsegment, ROUND(AVG(total), 2) AS mean_total FROM spend JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
        None,
    ),
    "recursive_cte": (
        """WITH RECURSIVE steps(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM steps WHERE n < 7)
           SELECT n, COALESCE(c, 0) AS line_count FROM steps
           LEFT JOIN (SELECT l_linenumber, COUNT(l_orderkey) AS c FROM lineitem GROUP BY l_linenumber) k ON l_linenumber = n""",
        None,
    ),
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect": ("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders", None),
    "except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None),
    "case_like_having": (
        """SELECT CASE WHEN p_type LIKE 'S%' THEN 'S' WHEN p_type LIKE '%Y' THEN 'Y' ELSE 'other' END AS kind, COUNT(*) AS n
           FROM part GROUP BY 1 HAVING COUNT(*) > 1""",
        None,
    ),
    "string_functions": (
        """SELECT p_partkey, UPPER(p_name) AS u, SUBSTR(p_name, 2, 3) AS s, LENGTH(p_name) AS n, REPLACE(p_brand, '#', '-') AS r,
           TRIM(p_type) || '!' AS c, COALESCE(NULLIF(p_type, 'PROMO'), 'none') AS f FROM part""",
        """SELECT p_partkey, UPPER(p_name) AS u, SUBSTR(p_name, 2, 3) AS s, CAST(LENGTH(p_name) AS INTEGER) AS n, REPLACE(p_brand, '#', '-') AS r,
           TRIM(p_type) || '!' AS c, COALESCE(NULLIF(p_type, 'PROMO'), 'none') AS f FROM part""",
    ),
    "date_functions": (
        """SELECT YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, COUNT(*) AS n, MIN(date_trunc('month', o_orderdate)) AS first_day
           FROM orders GROUP BY 1, 2""",
        """SELECT CAST(YEAR(o_orderdate) AS INTEGER) AS y, CAST(MONTH(o_orderdate) AS INTEGER) AS m, COUNT(*) AS n,
           CAST(MIN(date_trunc('month', o_orderdate)) AS TIMESTAMP) AS first_day FROM orders GROUP BY 1, 2""",
    ),
    "math_functions": (
        "SELECT s_suppkey, ABS(s_acctbal - 5000) AS a, CEIL(s_acctbal) AS c, ROUND(SQRT(ABS(s_acctbal)), 4) AS q, SIGN(s_acctbal) AS g FROM supplier",
        """SELECT s_suppkey, ABS(s_acctbal - 5000) AS a, CAST(CEIL(s_acctbal) AS BIGINT) AS c, ROUND(SQRT(ABS(s_acctbal)), 4) AS q,
           CAST(SIGN(s_acctbal) AS DOUBLE) AS g FROM supplier""",
    ),
    "ranking_windows": (
        """SELECT o_orderkey, ROW_NUMBER() OVER w AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk,
           DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, NTILE(3) OVER w AS nt
           FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
        """SELECT o_orderkey, CAST(ROW_NUMBER() OVER w AS INTEGER) AS rn, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS rk,
           CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS dr, CAST(NTILE(3) OVER w AS INTEGER) AS nt
           FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    ),
    "analytic_windows": (
        """SELECT event_id, LAG(value) OVER w AS previous, LEAD(value, 2) OVER w AS later, FIRST_VALUE(value) OVER w AS opening
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
        None,
    ),
    "framed_windows": (
        """SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS recent,
           MAX(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak FROM events""",
        None,
    ),
}


def _run(t, spark, statement):
    result, _, error = run_sql_query(spark, statement, {name: t(name) for name in TABLES if name in statement})
    if error:
        raise ValueError(error)
    return result


for _name, (_spark_sql, _other) in STATEMENTS.items():

    @query(f"sql_{_name}", _other or _spark_sql)
    def _statement(t, spark, statement=_spark_sql):
        return _run(t, spark, statement)


@query(
    "sql_executed",
    "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderstatus <> 'insert into x' GROUP BY 1",
)
def _executed(t, spark):
    statement = "SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderstatus <> 'insert into x' GROUP BY 1 -- done"
    result, _, error = run_sql_query(spark, statement, {"orders": t("orders")}, execute=True)
    if error:
        raise ValueError(error)
    return result


