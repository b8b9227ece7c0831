"""Grouping, pivots, summaries, chart data and key figures."""

from itertools import combinations

from functools import reduce

from pyspark.sql import functions as F

from tidemill.operators import aggregate, charts, kpi
from tidemill.registry import query

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _line_facts(t):
    return t("lineitem").select("l_returnflag", "l_linestatus", *LINE_NUMBERS, "l_shipdate")


# a missing status is not a group
_STATUS = "CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END"
_GROUP_SQL = {
    "mean": "round(avg(o_totalprice), 2)",
    "sum": "round(sum(o_totalprice), 2)",
    "count": "count(o_totalprice)",
    "min": "min(o_totalprice)",
    "max": "max(o_totalprice)",
    "std": "round(stddev_samp(o_totalprice), 2)",
}
for _agg, _sql in _GROUP_SQL.items():

    @query(
        f"group_{_agg}",
        f"""SELECT p AS priority, {_sql} AS {_agg}_o_totalprice FROM (SELECT {_STATUS} AS p, o_totalprice FROM orders)
            WHERE p IS NOT NULL GROUP BY 1""",
    )
    def _group(t, spark, agg=_agg):
        df = t("orders").select(
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"), "o_totalprice"
        )
        return aggregate.group_aggregate(df, "priority", "o_totalprice", agg)


@query(
    "group_median",
    f"""SELECT p AS priority, round(quantile_cont(o_custkey, 0.5), 2) AS median_o_custkey
        FROM (SELECT {_STATUS} AS p, o_custkey FROM orders) WHERE p IS NOT NULL GROUP BY 1""",
)
def _median(t, spark):
    priority = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority")
    return aggregate.group_aggregate(t("orders").select(priority, "o_custkey"), "priority", "o_custkey", "median")


@query(
    "group_median_many",
    "SELECT l_partkey, round(quantile_cont(l_quantity, 0.5), 2) AS median_l_quantity FROM lineitem GROUP BY 1",
)
def _median_many(t, spark):
    return aggregate.group_aggregate(t("lineitem"), "l_partkey", "l_quantity", "median")


@query(
    "group_median_buckets",
    """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS mid, quantile_cont(l_extendedprice, 0.9) AS high
       FROM lineitem GROUP BY 1""",
)
def _median_buckets(t, spark):
    from tidemill.plans.quantiles import grouped_quantiles

    # a low limit exercises the route for columns with too many distinct values for one task
    return grouped_quantiles(t("lineitem"), ["l_returnflag"], "l_extendedprice", {"mid": 0.5, "high": 0.9}, 1_000)


@query(
    "group_sum_all_null",
    """SELECT o_orderpriority, round(coalesce(sum(CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END), 0), 2) AS sum_x
       FROM orders GROUP BY 1""",
)
def _all_null(t, spark):
    known = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")).alias("x")
    return aggregate.group_aggregate(t("orders").select("o_orderpriority", known), "o_orderpriority", "x", "sum")


for _agg, _sql in {
    "mean": "round(avg(l_extendedprice) FILTER (WHERE l_linestatus = '{h}'), 2)",
    "sum": "round(sum(l_extendedprice) FILTER (WHERE l_linestatus = '{h}'), 2)",
    "count": "CAST(count(*) FILTER (WHERE l_linestatus = '{h}') AS BIGINT)",
    "min": "min(l_extendedprice) FILTER (WHERE l_linestatus = '{h}')",
    "max": "max(l_extendedprice) FILTER (WHERE l_linestatus = '{h}')",
}.items():
    _cells = ", ".join(f'{_sql.format(h=h)} AS "{h}"' for h in "FO")

    @query(f"pivot_{_agg}", f"SELECT l_returnflag, {_cells} FROM lineitem GROUP BY 1")
    def _pivot(t, spark, agg=_agg):
        return aggregate.pivot_table(t("lineitem"), "l_returnflag", "l_extendedprice", agg, "l_linestatus")


@query("pivot_flat", "SELECT p_brand, round(avg(p_retailprice), 2) AS p_retailprice FROM part GROUP BY 1")
def _pivot_flat(t, spark):
    return aggregate.pivot_table(t("part"), "p_brand", "p_retailprice", "mean")


@query(
    "grouped_mean_color",
    """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS l_quantity FROM lineitem GROUP BY 1, 2""",
)
def _color(t, spark):
    out = aggregate.grouped_mean(t("lineitem"), "l_returnflag", "l_quantity", "l_linestatus")
    return out.withColumn("l_quantity", F.round("l_quantity", 4))


for _k, _column, _table in ((10, "p_brand", "part"), (15, "event_type", "events"), (8, "o_orderpriority", "orders"), (20, "l_partkey", "lineitem")):

    @query(
        f"value_counts_{_column}",
        f'SELECT {_column}, count(*) AS "Count" FROM {_table} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {_k}',
    )
    def _counts(t, spark, k=_k, column=_column, table=_table):
        return aggregate.value_counts(t(table), column, k)


_CONTINGENCY = ", ".join(
    f"count(*) FILTER (WHERE o_orderstatus = '{h}') AS \"{h}\"" for h in "FOP"
)


@query("crosstab", f"SELECT o_orderpriority, {_CONTINGENCY} FROM orders GROUP BY 1")
def _crosstab(t, spark):
    return aggregate.contingency_table(t("orders"), "o_orderpriority", "o_orderstatus")


def _union(columns, body):
    return " UNION ALL ".join(body.format(c=c, i=i) for i, c in enumerate(columns))


@query(
    "describe",
    _union(
        LINE_NUMBERS,
        """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std,
           round(min({c}), 2) AS min, round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.5), 2) AS p50,
           round(quantile_cont({c}, 0.75), 2) AS p75, round(max({c}), 2) AS max FROM lineitem""",
    ),
)
def _describe(t, spark):
    return aggregate.describe(t("lineitem"), LINE_NUMBERS)


@query(
    "describe_percentiles",
    _union(
        ["o_totalprice", "o_custkey"],
        """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std,
           round(min({c}), 3)::DOUBLE AS min, round(quantile_cont({c}, 0.1), 3) AS p10, round(quantile_cont({c}, 0.25), 3) AS p25,
           round(quantile_cont({c}, 0.5), 3) AS p50, round(quantile_cont({c}, 0.75), 3) AS p75,
           round(quantile_cont({c}, 0.9), 3) AS p90, round(max({c}), 3)::DOUBLE AS max FROM orders""",
    ),
)
def _percentiles(t, spark):
    return aggregate.describe(t("orders"), ["o_totalprice", "o_custkey"], (0.1, 0.25, 0.5, 0.75, 0.9), 3)


@query(
    "shape_stats",
    _union(
        LINE_NUMBERS,
        """SELECT '{c}' AS "column", round(skewness({c}), 3) AS skewness, round(kurtosis({c}), 3) AS kurtosis,
           round(stddev_samp({c}) / avg({c}), 3) AS cv, round(max({c}) - min({c}), 3) AS range,
           round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 3) AS iqr FROM lineitem""",
    ),
)
def _shape(t, spark):
    return aggregate.shape_statistics(t("lineitem"), LINE_NUMBERS)


_CATEGORIES = ["p_name", "p_brand", "p_type"]


@query(
    "cat_summary",
    "WITH "
    + ", ".join(f"v{i} AS (SELECT {c} AS v, count(*) AS n FROM part GROUP BY 1)" for i, c in enumerate(_CATEGORIES))
    + _union(
        _CATEGORIES,
        """ SELECT '{c}' AS "column", (SELECT count(*) FROM v{i}) AS unique_values,
            (SELECT v FROM v{i} ORDER BY n DESC, v LIMIT 1) AS most_common, (SELECT max(n) FROM v{i}) AS most_common_freq,
            (SELECT v FROM v{i} ORDER BY n, v DESC LIMIT 1) AS least_common, (SELECT min(n) FROM v{i}) AS least_common_freq""",
    ),
)
def _categories(t, spark):
    return aggregate.categorical_summary(t("part"))


@query(
    "column_overview",
    _union(
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
        """SELECT '{c}' AS "column", count(*) AS rows, count({c}) AS non_null, count(*) - count({c}) AS nulls,
           count(DISTINCT {c}) AS "distinct" FROM orders""",
    ),
)
def _overview(t, spark):
    return aggregate.column_overview(t("orders")).drop("type")


# -- charts -------------------------------------------------------------------------------


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS \"column\", "
        + ", ".join("1.0::DOUBLE AS " + b if a == b else f"round(corr({a}, {b}), 4) AS {b}" for b in LINE_NUMBERS)
        + " FROM lineitem"
        for a in LINE_NUMBERS
    ),
)
def _matrix(t, spark):
    return charts.correlation_matrix(t("lineitem"), LINE_NUMBERS)


_PAIRS = " UNION ALL ".join(
    f"SELECT {n} AS n, '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM lineitem"
    for n, (a, b) in enumerate(combinations(LINE_NUMBERS, 2))
)


@query("top_pair", f"SELECT column_a, column_b, round(r, 4) AS r FROM ({_PAIRS}) ORDER BY abs(r) DESC, n LIMIT 1")
def _top_pair(t, spark):
    return charts.strongest_pair(t("lineitem"), LINE_NUMBERS)


# the pairs among the first three numeric columns, with their points
@query(
    "scatter_pair_points",
    " UNION ALL ".join(
        f"SELECT '{a}' AS x_name, '{b}' AS y_name, {a}::DOUBLE AS x, {b}::DOUBLE AS y FROM part"
        for a, b in (("p_partkey", "p_size"), ("p_partkey", "p_retailprice"), ("p_size", "p_retailprice"))
    ),
)
def _scatter_pairs(t, spark):
    part = t("part")
    points = [
        charts.scatter_data(part, a, b).select(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for a, b in charts.scatter_pairs(part, 3)
    ]
    return reduce(lambda a, b: a.unionByName(b), points)


@query(
    "correlated_pairs",
    f"""SELECT column_a, column_b, round(r, 4) AS r, CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength,
        CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM ({_PAIRS}) WHERE abs(r) > 0.5""",
)
def _correlated(t, spark):
    return charts.correlated_pairs(t("lineitem"), LINE_NUMBERS)


_NET = ("l_extendedprice", "net", "taxed", "left_over", "l_quantity")


# prices before and after discount and tax go together, what is left over goes against them
@query(
    "correlated_prices",
    "WITH l AS (SELECT l_extendedprice, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 + l_tax) AS taxed, "
    "100000 - l_extendedprice AS left_over, l_quantity FROM lineitem), p AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM l" for a, b in combinations(_NET, 2))
    + """) SELECT column_a, column_b, round(r, 4) AS r, CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'moderate' END AS strength,
        CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM p WHERE abs(r) > 0.5""",
)
def _correlated_prices(t, spark):
    price = F.col("l_extendedprice")
    lines = t("lineitem").select(
        price, (price * (1 - F.col("l_discount"))).alias("net"), (price * (1 + F.col("l_tax"))).alias("taxed"), (100000 - price).alias("left_over"), "l_quantity"
    )
    return charts.correlated_pairs(lines)


@query(
    "histogram",
    """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
       c AS (SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 30)) AS INTEGER), 29) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
       SELECT CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 30), 4) AS lower, round(lo + (i + 1) * ((hi - lo) / 30), 4) AS upper,
              coalesce(n, 0) AS count FROM range(30) r(i) CROSS JOIN b LEFT JOIN c ON c.bin = i""",
)
def _histogram(t, spark):
    out = charts.histogram(t("lineitem"), "l_extendedprice")
    return out.select("bin", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "count")


_BOX = """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                          quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)"""


@query(
    "box_stats",
    _BOX
    + """ SELECT event_type, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
        min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS lower_whisker,
        max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
        min(value) AS min, max(value) AS max, count(value) AS count,
        count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM events JOIN q USING (event_type) GROUP BY event_type, q1, median, q3""",
)
def _box(t, spark):
    out = charts.box_statistics(t("events"), "event_type", "value")
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query(
    "violin_data",
    _BOX
    + """, b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
        c AS (SELECT event_type, least(CAST(floor((value - lo) / ((hi - lo) / 30)) AS INTEGER), 29) AS bin, count(*) AS n FROM events, b GROUP BY 1, 2)
        SELECT q.event_type, CAST(i AS INTEGER) AS bin, coalesce(n, 0) AS count, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3
        FROM q CROSS JOIN range(30) r(i) LEFT JOIN c ON c.event_type = q.event_type AND c.bin = i""",
)
def _violin(t, spark):
    out = charts.violin_data(t("events"), "event_type", "value").drop("lower", "upper")
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("scatter_data", "SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def _scatter(t, spark):
    return charts.scatter_data(t("lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


# -- key figures --------------------------------------------------------------------------


@query(
    "kpi_detect",
    """SELECT 'l_linenumber' AS "column", sum(l_linenumber)::DOUBLE AS value, 'Total l_linenumber' AS label, 'integer' AS format FROM lineitem
       UNION ALL SELECT 'l_quantity', round(avg(l_quantity), 2), 'Avg l_quantity', 'decimal' FROM lineitem
       UNION ALL SELECT 'holed', round(avg(CASE WHEN l_returnflag <> 'N' THEN l_linenumber END), 2), 'Avg holed', 'decimal' FROM lineitem
       UNION ALL SELECT 'l_discount', round(avg(l_discount) * 100, 1), 'Avg l_discount (%)', 'percent' FROM lineitem""",
)
def _kpis(t, spark):
    holed = F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")).alias("holed")
    return kpi.detect_kpi_columns(t("lineitem").select("l_linenumber", "l_quantity", holed, "l_discount", "l_tax"), shown=4)


@query(
    "kpi_all_columns",
    """SELECT 'l_orderkey' AS "column", sum(l_orderkey)::DOUBLE AS value, 'Total l_orderkey' AS label, 'integer' AS format FROM lineitem
       UNION ALL SELECT 'l_partkey', sum(l_partkey)::DOUBLE, 'Total l_partkey', 'integer' FROM lineitem
       UNION ALL SELECT 'l_suppkey', sum(l_suppkey)::DOUBLE, 'Total l_suppkey', 'integer' FROM lineitem
       UNION ALL SELECT 'l_linenumber', sum(l_linenumber)::DOUBLE, 'Total l_linenumber', 'integer' FROM lineitem
       UNION ALL SELECT 'l_quantity', round(avg(l_quantity), 2), 'Avg l_quantity', 'decimal' FROM lineitem
       UNION ALL SELECT 'l_extendedprice', round(avg(l_extendedprice), 2), 'Avg l_extendedprice', 'decimal' FROM lineitem
       UNION ALL SELECT 'l_discount', round(avg(l_discount) * 100, 1), 'Avg l_discount (%)', 'percent' FROM lineitem
       UNION ALL SELECT 'l_tax', round(avg(l_tax) * 100, 1), 'Avg l_tax (%)', 'percent' FROM lineitem""",
)
def _all_kpis(t, spark):
    return kpi.detect_kpi_columns(t("lineitem"))


for _agg, _sql in {"mean": "avg", "sum": "sum", "count": "count", "max": "max", "min": "min"}.items():

    @query(
        f"kpi_card_{_agg}",
        f"""WITH x AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () // 2 AS mid
              FROM events WHERE event_type <> 'error'),
            h AS (SELECT avg(value) FILTER (WHERE i < mid) AS a, avg(value) FILTER (WHERE i >= mid) AS b, {_sql}(value) AS v FROM x)
            SELECT round(v, 2)::DOUBLE AS value, '{_agg.capitalize()} of value' AS label, round((b - a) / abs(a) * 100, 1) AS delta FROM h""",
    )
    def _card(t, spark, agg=_agg):
        df = t("events").select("ts", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
        return kpi.kpi_card(df, "value", agg, ["ts", "event_id"])


@query(
    "explain_value",
    """SELECT round(100.0 * count(*) FILTER (WHERE o_totalprice < 400000) / count(*), 4)::DOUBLE AS percentile, round(avg(o_totalprice), 4) AS mean,
       quantile_cont(o_totalprice, 0.5) AS median, round(stddev_samp(o_totalprice), 4) AS std,
       round(abs(400000 - avg(o_totalprice)) / stddev_samp(o_totalprice), 4) AS std_distance,
       CASE WHEN 100.0 * count(*) FILTER (WHERE o_totalprice < 400000) / count(*) >= 95 THEN 'top 5%'
            WHEN 100.0 * count(*) FILTER (WHERE o_totalprice < 400000) / count(*) <= 5 THEN 'bottom 5%' ELSE 'middle' END AS band FROM orders""",
)
def _explain(t, spark):
    return kpi.value_position(t("orders"), "o_totalprice", 400000)


@query(
    "explain_text",
    "SELECT count(*) FILTER (WHERE lang = 'en') AS frequency, round(100.0 * count(*) FILTER (WHERE lang = 'en') / count(lang), 4)::DOUBLE AS share_pct FROM documents",
)
def _explain_text(t, spark):
    return kpi.value_position(t("documents"), "lang", "en")
