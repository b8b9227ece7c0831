"""Joins, stacking and the flagship report."""

from pyspark.sql import functions as F

from tidemill.operators.aggregate import group_aggregate
from tidemill.operators.combine import concat_datasets, join_datasets
from tidemill.registry import query


def holed(df, column, hole):
    """The table with one value of a column turned into NULL."""
    return df.withColumn(column, F.nullif(F.col(column), F.lit(hole)))


@query(
    "segment_order_value",
    """SELECT c_mktsegment, round(avg(o_totalprice), 2) AS mean_o_totalprice
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def _segments(t, spark):
    orders = t("orders").select("o_custkey", "o_totalprice")
    customers = t("customer").select("c_custkey", "c_mktsegment")
    joined = join_datasets(orders, customers, "o_custkey", "c_custkey", "inner")
    return group_aggregate(joined, "c_mktsegment", "o_totalprice", "mean")


def _null_key_frames(t):
    left = holed(t("customer"), "c_nationkey", 3)
    # shifted keys leave rows without a partner on both sides
    shifted = t("nation").withColumn("n_nationkey", F.col("n_nationkey") + 5)
    return left, holed(shifted, "n_nationkey", 9)


_NULL_KEYS = """
WITH l AS (SELECT c_custkey, c_name, nullif(c_nationkey, 3) AS c_nationkey, c_acctbal, c_mktsegment FROM customer),
     r AS (SELECT nullif(n_nationkey + 5, 9) AS n_nationkey, n_name, n_regionkey FROM nation)
"""

for _kind, _sql in {
    "inner": "JOIN",
    "left": "LEFT JOIN",
    "right": "RIGHT JOIN",
    "outer": "FULL JOIN",
}.items():

    @query(
        f"join_{_kind}_null_keys",
        f"{_NULL_KEYS} SELECT * FROM l {_sql} r ON l.c_nationkey IS NOT DISTINCT FROM r.n_nationkey",
    )
    def _joined(t, spark, kind=_kind):
        left, right = _null_key_frames(t)
        return join_datasets(left, right, "c_nationkey", "n_nationkey", kind)


for _kind, _sql in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}.items():

    @query(f"join_{_kind}", f"SELECT * FROM customer {_sql} orders ON c_custkey = o_custkey")
    def _plain(t, spark, kind=_kind):
        return join_datasets(t("customer"), t("orders"), "c_custkey", "o_custkey", kind)


@query(
    "join_outer_same_key",
    """WITH l AS (SELECT c_custkey AS id, c_name AS name, nullif(c_nationkey, 3) AS nationkey FROM customer),
            r AS (SELECT nullif(n_nationkey, 5) AS nationkey, n_name AS name, n_regionkey FROM nation)
       SELECT coalesce(l.nationkey, r.nationkey) AS nationkey, id, l.name AS name_left, r.name AS name_right, n_regionkey
       FROM l FULL JOIN r ON l.nationkey IS NOT DISTINCT FROM r.nationkey""",
)
def _same_key(t, spark):
    left = t("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.nullif("c_nationkey", F.lit(3)).alias("nationkey")
    )
    right = t("nation").select(
        F.nullif("n_nationkey", F.lit(5)).alias("nationkey"), F.col("n_name").alias("name"), "n_regionkey"
    )
    return join_datasets(left, right, "nationkey", "nationkey", "outer")


@query(
    "join_hot_keys",
    """SELECT o_orderkey, o_orderstatus, l_linenumber, l_quantity
       FROM orders FULL JOIN lineitem ON o_orderkey = l_orderkey""",
)
def _hot(t, spark):
    orders = t("orders").select("o_orderkey", "o_orderstatus")
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    # a low threshold, so that the split of heavy keys is exercised
    joined = join_datasets(orders, lines, "o_orderkey", "l_orderkey", "outer", hot_rows=8)
    return joined.select("o_orderkey", "o_orderstatus", "l_linenumber", "l_quantity")


@query(
    "concat_vertical",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_acctbal AS DOUBLE) AS balance,
              c_mktsegment AS segment, NULL AS city FROM customer
       UNION ALL
       SELECT 'S' || s_suppkey, s_name, CAST(s_nationkey AS DOUBLE), NULL, 'none' FROM supplier""",
)
def _vertical(t, spark):
    customers = t("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
    )
    suppliers = t("supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("balance"), F.lit("none").alias("city"),
    )
    return concat_datasets([customers, suppliers])


_BY_POSITION = """
WITH a AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS i FROM customer),
     b AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS i FROM part)
"""


@query("concat_horizontal", f"{_BY_POSITION} SELECT c_custkey, c_name, p_partkey, p_name FROM a FULL JOIN b USING (i)")
def _horizontal(t, spark):
    frames = [t("customer").select("c_custkey", "c_name"), t("part").select("p_retailprice", "p_partkey", "p_name")]
    wide = concat_datasets(frames, 1, ["c_custkey", ["p_retailprice", "p_partkey"]])
    return wide.drop("p_retailprice")


@query(
    "concat_horizontal_reset",
    """WITH a AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier),
            b AS (SELECT -c_custkey AS c, row_number() OVER (ORDER BY -c_custkey) AS i FROM customer)
       SELECT s_suppkey AS "0", s_name AS "1", c AS "2" FROM a FULL JOIN b USING (i)""",
)
def _reset(t, spark):
    frames = [t("supplier").select("s_suppkey", "s_name"), t("customer").select((-F.col("c_custkey")).alias("c_custkey"))]
    return concat_datasets(frames, 1, ["s_suppkey", "c_custkey"], reset_names=True)
