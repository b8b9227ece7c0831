"""Profiles, quality, rules, personal data, insights and dashboards."""

from pyspark.sql import functions as F

from tidemill.operators import insights, quality, validate
from tidemill.operators.privacy import CONTENT_PATTERNS, content_match_rates, detect_sensitive_columns
from tidemill.registry import query
from tidemill.registry.cleaning import _EVENTS, RULES, holed_events

# customers of one segment have no known nation
_CUSTOMERS = """(SELECT c_custkey, c_name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment FROM customer)"""
_CUSTOMER_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_CUSTOMER_NUMBERS = ["c_custkey", "c_nationkey", "c_acctbal"]


def holed_customers(t):
    known = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_nationkey")).alias("c_nationkey")
    return t("customer").select("c_custkey", "c_name", known, "c_acctbal", "c_mktsegment")


def _union(columns, body, joiner=" UNION ALL "):
    return joiner.join(body(i, c) for i, c in enumerate(columns))


def _profile_row(i, c):
    numeric = c in _CUSTOMER_NUMBERS
    moments = (
        f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, NULL AS mode"
        if numeric
        else f"NULL AS mean, NULL AS std, NULL AS min, NULL AS max, (SELECT {c} FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode"
    )
    return f"""SELECT '{c}' AS "column", count({c}) AS non_null, round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS null_pct,
       count(DISTINCT {c}) AS "unique", {moments} FROM c"""


@query("profile", f"WITH c AS {_CUSTOMERS} " + _union(_CUSTOMER_COLUMNS, _profile_row))
def _profile(t, spark):
    return quality.column_profiles(holed_customers(t), samples=0).drop("dtype")


@query(
    "profile_samples",
    f"WITH c AS {_CUSTOMERS} "
    + _union(
        _CUSTOMER_COLUMNS,
        lambda i, c: f"""SELECT '{c}' AS "column", (SELECT string_agg(CAST({c} AS VARCHAR), '|' ORDER BY c_custkey)
        FROM (SELECT {c}, c_custkey FROM c WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 5)) AS samples""",
    ),
)
def _samples(t, spark):
    out = quality.column_samples(holed_customers(t), 5, "c_custkey")
    return out.select("column", F.array_join("sample_values", "|").alias("samples"))


@query(
    "quality_score",
    f"""WITH c AS (SELECT o_orderpriority, o_orderstatus, left(o_orderpriority, 1) AS digit,
                   CASE WHEN o_orderstatus = 'F' THEN '12' WHEN o_orderstatus = 'O' THEN 'x' END AS mixed FROM orders),
        q AS (SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM c)) AS duplicates,
                     count(*) - count(mixed) AS missing FROM c)
        SELECT rows, duplicates, missing, round((rows * 4 - missing) / (rows * 4) * 50, 4) AS completeness_points,
               round(greatest(0, 25 * (1 - duplicates / rows * 5)), 4)::DOUBLE AS duplicate_points, 25 - 25 / 4.0::DOUBLE AS type_points,
               CAST(round_even((rows * 4 - missing) / (rows * 4) * 50 + greatest(0, 25 * (1 - duplicates / rows * 5)) + 25 - 25 / 4.0, 0) AS INTEGER) AS score FROM q""",
)
def _score(t, spark):
    mixed = F.when(F.col("o_orderstatus") == "F", "12").when(F.col("o_orderstatus") == "O", "x").alias("mixed")
    df = t("orders").select("o_orderpriority", "o_orderstatus", F.left("o_orderpriority", F.lit(1)).alias("digit"), mixed)
    return quality.quality_score(df)


@query(
    "quality_report",
    f"WITH c AS {_CUSTOMERS} "
    + _union(
        _CUSTOMER_COLUMNS,
        lambda i, c: f"""SELECT '{c}' AS "column", count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
        round(100.0 * (count(*) - count({c})) / count(*), 2)::DOUBLE AS null_percentage, count(DISTINCT {c}) AS unique_count,
        round(100.0 * count(DISTINCT {c}) / count(*), 2)::DOUBLE AS unique_percentage, """
        + (
            f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 2) AS mean FROM c"
            if c in _CUSTOMER_NUMBERS
            else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean FROM c"
        ),
    ),
)
def _report(t, spark):
    return quality.quality_report(holed_customers(t)).drop("dtype")


_TOTALS = f"""WITH c AS (SELECT c_nationkey, c_mktsegment FROM {_CUSTOMERS}),
 q AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM c)) AS d, count(*) - count(c_nationkey) AS m FROM c)"""


@query(
    "quality_totals",
    f"""{_TOTALS} SELECT n AS total_rows, 2 AS total_columns, n * 2 AS total_cells, m AS missing_values, d AS duplicate_rows,
        round((n * 2 - m) / (n * 2) * 100, 2) AS completeness_score, round(d / n * 100, 2) AS duplicate_percentage FROM q""",
)
def _totals(t, spark):
    return quality.quality_totals(holed_customers(t).select("c_nationkey", "c_mktsegment"))


@query(
    "guided_score",
    f"{_TOTALS} SELECT round(greatest(0, round((n * 2 - m) / (n * 2) * 100, 2) - 0.5 * round(d / n * 100, 2)), 4)::DOUBLE AS guided_score FROM q",
)
def _guided(t, spark):
    return quality.guided_score(holed_customers(t).select("c_nationkey", "c_mktsegment"))


@query(
    "missing_table",
    f"""WITH c AS {_CUSTOMERS} SELECT 'c_nationkey' AS "column", count(*) - count(c_nationkey) AS missing,
        round(100.0 * (count(*) - count(c_nationkey)) / count(*), 2)::DOUBLE AS missing_pct FROM c""",
)
def _missing(t, spark):
    return quality.missing_table(holed_customers(t))


@query(
    "validate_table",
    """SELECT count(*) BETWEEN 1 AND 1000000 AND false AS is_valid, 'The following columns are entirely empty: nothing' AS issues FROM events""",
)
def _valid(t, spark):
    df = t("events").withColumn("nothing", F.nullif("event_type", "event_type"))
    return quality.validate_table(df).select("is_valid", F.array_join("issues", "; ").alias("issues"))


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "spread"]
_SPREAD = "(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_quantity * l_quantity * l_extendedprice AS spread, l_returnflag FROM lineitem)"


def _spread_lines(t):
    return t("lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_quantity") * F.col("l_quantity") * F.col("l_extendedprice")).alias("spread"), "l_returnflag",
    )


def _anomaly_row(i, c):
    return f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS count, round(any_value(lo), 2) AS lower_bound, round(any_value(hi), 2) AS upper_bound
    FROM l, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM l))"""


@query("anomalies", f"WITH l AS {_SPREAD} SELECT * FROM ({_union(_LINE, _anomaly_row)}) WHERE count > 0")
def _anomalies(t, spark):
    return quality.detect_anomalies(_spread_lines(t))


@query(
    "anomalous_rows",
    """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
       SELECT event_id, value FROM events, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) ORDER BY event_id LIMIT 10""",
)
def _anomalous(t, spark):
    return quality.anomalous_rows(t("events").select("event_id", "value"), "value", 10, "event_id")


@query(
    "data_dictionary",
    f"WITH c AS {_CUSTOMERS} "
    + _union(
        _CUSTOMER_COLUMNS,
        lambda i, c: f"""SELECT '{c}' AS "column", format('{{:,}}', count({c})) || ' / ' || format('{{:,}}', count(*)) AS non_null_count,
        count(DISTINCT {c}) AS unique_values, '{'The key' if c == 'c_custkey' else ''}' AS description,
        (SELECT string_agg(CAST({c} AS VARCHAR), ', ' ORDER BY c_custkey) FROM (SELECT {c}, c_custkey FROM c WHERE {c} IS NOT NULL ORDER BY c_custkey LIMIT 3)) AS sample_values
        FROM c""",
    ),
)
def _dictionary(t, spark):
    return quality.data_dictionary(holed_customers(t), {"c_custkey": "The key"}, "c_custkey").drop("data_type")


@query(
    "report_columns",
    f"WITH c AS {_CUSTOMERS} "
    + _union(
        _CUSTOMER_COLUMNS,
        lambda i, c: f"""SELECT '{c}' AS "column", count({c}) AS non_null_count,
        round(round(100.0 * (count(*) - count({c})) / count(*), 2), 1)::DOUBLE AS null_pct FROM c""",
    ),
)
def _report_columns(t, spark):
    return quality.report_tables(holed_customers(t))["columns"].drop("dtype")


# -- single rules -------------------------------------------------------------------------

_RULES = {
    "not_null": (RULES[0], "count(*) FILTER (WHERE value IS NULL)"),
    "unique": (
        RULES[1],
        "(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM e WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1))",
    ),
    "range": (RULES[3], "count(*) FILTER (WHERE value < 5 OR value > 50)"),
    "allowed": (RULES[5], "count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'error'))"),
    "regex": (RULES[6], "count(*) FILTER (WHERE NOT regexp_matches(event_type, '^(?:[a-m])'))"),
}
for _name, (_rule, _sql) in _RULES.items():

    @query(
        f"rule_{_name}",
        f"WITH e AS {_EVENTS}, v AS (SELECT {_sql} AS violations, count(*) AS n FROM e) "
        "SELECT violations, round(100.0 * violations / n, 2)::DOUBLE AS violation_pct FROM v",
    )
    def _one_rule(t, spark, rule=_rule):
        return validate.rule_violations(holed_events(t), rule)


@query(
    "violations_range",
    f"SELECT * FROM {_EVENTS} WHERE value < 5 OR value > 50 ORDER BY event_id LIMIT 50",
)
def _violating(t, spark):
    return validate.violating_rows(holed_events(t), RULES[3], 50, "event_id")


@query(
    "violations_unique",
    "SELECT doc_id, source FROM documents WHERE text IN (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)",
)
def _violating_unique(t, spark):
    rule = {"column": "text", "rule_type": "unique"}
    return validate.violating_rows(t("documents"), rule, limit=None).select("doc_id", "source")


@query(
    "violations_tagged",
    f"""SELECT event_id, concat_ws('|', CASE WHEN value IS NULL THEN '`value` has no missing values' END,
        CASE WHEN value < 5 OR value > 50 THEN '`value` between 5 and 50' END,
        CASE WHEN NOT regexp_matches(event_type, '^(?:[a-m])') THEN '`event_type` matches /[a-m]/' END) AS violated FROM {_EVENTS}""",
)
def _tagged(t, spark):
    tagged = validate.tag_violations(holed_events(t), [RULES[0], RULES[3], RULES[6]])
    return tagged.select("event_id", F.array_join("violated_rules", "|").alias("violated"))


@query(
    "validation_summary",
    f"""WITH e AS {_EVENTS} SELECT CAST(3 AS BIGINT) AS total_rules, CAST((count(*) FILTER (WHERE value IS NULL) = 0)::INTEGER + 1 AS BIGINT) AS passed,
        3 - CAST((count(*) FILTER (WHERE value IS NULL) = 0)::INTEGER + 1 AS BIGINT) AS failed FROM e""",
)
def _summary(t, spark):
    rules = [RULES[0], RULES[7], RULES[8]]
    return validate.validation_summary(validate.run_validation(holed_events(t), rules))


# -- personal data ------------------------------------------------------------------------


def _rate_row(i, kind):
    pattern = CONTENT_PATTERNS[kind].replace("'", "''")
    return f"""SELECT 'text' AS "column", '{kind}' AS kind, round(avg(CASE WHEN regexp_matches(text, '{pattern}') THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS match_rate FROM documents"""


@query("pii_rates", _union(list(CONTENT_PATTERNS), _rate_row))
def _rates(t, spark):
    out = content_match_rates(t("documents"), ["text"])
    return out.select("column", "kind", F.round("match_rate", 6).alias("match_rate"))


@query(
    "pii_detect",
    """SELECT 'c_name' AS "column", 'ssn' AS sensitivity_type, 'high' AS confidence,
         'Column name contains ''name'' and content matches ssn pattern' AS reason, min(c_name) AS sample_match FROM customer
       UNION ALL SELECT 'shipment', 'ip', 'medium', 'Column name contains ''ip''', NULL
       UNION ALL SELECT 'contact', 'email', 'high', 'Content matches email pattern', min('user' || c_custkey || '@example.com') FROM customer WHERE c_nationkey < 20
       UNION ALL SELECT 'phone', 'phone', 'high', 'Column name contains ''phone'' and content matches phone pattern', min('555-010-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')[-4:]) FROM customer""",
)
def _pii(t, spark):
    key = F.col("c_custkey").cast("string")
    df = t("customer").select(
        "c_custkey", "c_name", F.col("c_nationkey").alias("shipment"),
        F.when(F.col("c_nationkey") < 20, F.concat(F.lit("user"), key, F.lit("@example.com"))).otherwise("none").alias("contact"),
        F.concat(F.lit("555-010-"), F.right(F.lpad(key, 9, "0"), F.lit(4))).alias("phone"),
    )
    return detect_sensitive_columns(df)


# -- insights -----------------------------------------------------------------------------


@query("insight_rows")
def _insights(t, spark):
    return insights.insight_rows(_spread_lines(t))


@query(
    "insight_patterns",
    f"""WITH l AS {_SPREAD}, m AS (
        {_union(_LINE, lambda i, c: f"SELECT '{c}' AS column, avg({c}) AS m, stddev_samp({c}) AS s FROM l")}),
        r AS ({" UNION ALL ".join(f"SELECT '{a},{b}' AS column, corr({a}, {b}) AS r FROM l" for i, a in enumerate(_LINE) for b in _LINE[i + 1:])})
        SELECT 'patterns' AS category, "column", round(s / m, 4) AS metric FROM m WHERE s > abs(m) * 0.5
        UNION ALL SELECT 'patterns', "column", round(r, 4) FROM r WHERE abs(r) > 0.5""",
)
def _patterns(t, spark):
    rows = insights.insight_rows(_spread_lines(t)).where("category = 'patterns'")
    return rows.select("category", "column", F.round("metric", 4).alias("metric"))


@query(
    "insight_cards",
    f"""WITH l AS {_SPREAD}, q AS (SELECT quantile_cont(spread, 0.25) AS q1, quantile_cont(spread, 0.75) AS q3 FROM l),
        o AS (SELECT count(*) FILTER (WHERE spread < q1 - 1.5 * (q3 - q1) OR spread > q3 + 1.5 * (q3 - q1)) AS n, count(*) AS total FROM l, q)
        SELECT 'finding' AS type, 'Excellent Data Quality' AS title, 'Dataset is 100.0% complete - ready for reliable analysis.' AS content
        UNION ALL SELECT 'risk', 'Outliers in spread', 'Found ' || n || ' outliers (' || printf('%.1f', 100.0 * n / total) || '%) in ''spread''. This may skew statistical analyses.'
        FROM o WHERE n > total * 0.05
        UNION ALL SELECT 'finding', 'Strong Correlation Detected', '''l_extendedprice'' and ''spread'' have a correlation of ' || printf('%.2f', abs(corr(l_extendedprice, spread))) || '. Consider if one is redundant.'
        FROM l HAVING abs(corr(l_extendedprice, spread)) > 0.85
        UNION ALL SELECT 'recommendation', 'Large Dataset', 'With ' || format('{{:,}}', count(*)) || ' rows, consider sampling for exploratory analysis then validating on the full set.'
        FROM l HAVING count(*) > 10000""",
)
def _cards(t, spark):
    return insights.insight_cards(_spread_lines(t)).drop("position")


@query(
    "issue_queue",
    f"""WITH c AS (SELECT c_nationkey, c_mktsegment, c_acctbal * c_acctbal * c_acctbal AS cube FROM {_CUSTOMERS} UNION ALL
               SELECT c_nationkey, c_mktsegment, c_acctbal * c_acctbal * c_acctbal AS cube FROM {_CUSTOMERS}),
        d AS (SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM c)) AS n FROM c),
        q AS (SELECT quantile_cont(cube, 0.25) AS q1, quantile_cont(cube, 0.75) AS q3 FROM c),
        o AS (SELECT count(*) FILTER (WHERE cube < q1 - 1.5 * (q3 - q1) OR cube > q3 + 1.5 * (q3 - q1)) AS n FROM c, q)
        SELECT 'duplicates' AS type, NULL AS "column", n AS count FROM d WHERE n > 0
        UNION ALL SELECT 'nulls', 'c_nationkey', count(*) - count(c_nationkey) FROM c HAVING count(*) > count(c_nationkey)
        UNION ALL SELECT 'outliers', 'cube', n FROM o WHERE n > 0""",
)
def _issues(t, spark):
    customers = holed_customers(t)
    cube = (F.col("c_acctbal") * F.col("c_acctbal") * F.col("c_acctbal")).alias("cube")
    once = customers.select("c_nationkey", "c_mktsegment", cube)
    return insights.issue_queue(once.unionByName(once)).select("type", "column", "count")


@query(
    "auto_clean",
    f"""WITH e AS (SELECT event_id, event_type, value FROM {_EVENTS}),
        f AS (SELECT event_id, event_type, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e)) AS value FROM e),
        q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f),
        o AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM e)
        SELECT event_id, event_type, value FROM f, q WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
        OR NOT EXISTS (SELECT 1 FROM e, o WHERE value < o.q1 - 1.5 * (o.q3 - o.q1) OR value > o.q3 + 1.5 * (o.q3 - o.q1))""",
)
def _auto_clean(t, spark):
    return insights.auto_clean(holed_events(t).select("event_id", "event_type", "value"))


@query(
    "confidence",
    f"""WITH c AS {_CUSTOMERS}, s AS (SELECT count(*) AS n, 100.0 * (5 * count(*) - (count(*) - count(c_nationkey))) / (5 * count(*)) AS f FROM c),
        p AS (SELECT 0.5 + CASE WHEN n >= 500 THEN 0.2 WHEN n >= 100 THEN 0.1 WHEN n < 30 THEN -0.2 ELSE 0 END
              + CASE WHEN f >= 99 THEN 0.15 WHEN f >= 95 THEN 0.1 WHEN f < 80 THEN -0.15 ELSE 0 END + 0.1 AS score FROM s)
        SELECT CASE WHEN score >= 0.75 THEN 'High' WHEN score >= 0.5 THEN 'Medium' ELSE 'Low' END AS level,
               CAST(round(greatest(0.05, least(0.95, score)) * 100) AS INTEGER) AS score_pct FROM p""",
)
def _confidence(t, spark):
    return insights.confidence(holed_customers(t), "rule_based").drop("reasons")


@query(
    "recommendations",
    """SELECT 'Excellent data quality - no missing values detected.' AS text
       UNION ALL SELECT '''o_orderpriority'' has very high cardinality (' || count(DISTINCT o_orderpriority) || ' unique values). Consider grouping or encoding for analysis.'
         FROM orders HAVING count(DISTINCT o_orderpriority) > count(*) * 0.5
       UNION ALL SELECT 'Small sample size. Statistical results may not be reliable. Consider collecting more data.' FROM orders HAVING count(*) < 30
       UNION ALL SELECT 'Multiple numeric columns available. Consider correlation analysis and feature importance evaluation.'
       UNION ALL SELECT 'Sufficient numeric features for clustering or dimensionality reduction.'
       UNION ALL SELECT 'Consider comparing o_orderkey across different o_orderstatus categories for segmentation insights.'""",
)
def _recommendations(t, spark):
    return insights.recommendation_rows(t("orders")).select("text")


@query(
    "dashboard_charts",
    """SELECT 'histogram' AS type, 'o_orderkey' AS x, NULL AS y, 'Distribution of o_orderkey' AS title
       UNION ALL SELECT 'bar', 'o_orderstatus', 'count', 'Count by o_orderstatus' FROM orders HAVING count(DISTINCT o_orderstatus) <= 15
       UNION ALL SELECT 'heatmap', 'o_orderkey,o_custkey,o_totalprice', NULL, 'Correlation Heatmap'
       UNION ALL (SELECT 'scatter', a, b, a || ' vs ' || b FROM (
          SELECT 1 AS n, 'o_orderkey' AS a, 'o_custkey' AS b, corr(o_orderkey, o_custkey) AS r FROM orders
          UNION ALL SELECT 2, 'o_orderkey', 'o_totalprice', corr(o_orderkey, o_totalprice) FROM orders
          UNION ALL SELECT 3, 'o_custkey', 'o_totalprice', corr(o_custkey, o_totalprice) FROM orders) ORDER BY abs(r) DESC, n LIMIT 1)
       UNION ALL SELECT 'line', 'o_orderdate', 'o_orderkey', 'o_orderkey over o_orderdate'
       UNION ALL SELECT 'box', 'o_orderstatus', 'o_orderkey', 'o_orderkey by o_orderstatus' FROM orders HAVING count(DISTINCT o_orderstatus) <= 10""",
)
def _dashboard(t, spark):
    return insights.dashboard_charts(t("orders")).drop("position")


# the same sentences built from SQL figures
_HOLED = "(SELECT c_custkey, c_name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment FROM customer)"
_FIGURES = f"""h AS {_HOLED}, f AS (
  SELECT count(*) AS n, count(*) - count(c_nationkey) AS missing, 100.0 * (5 * count(*) - (count(*) - count(c_nationkey))) / (5 * count(*)) AS pct,
         avg(c_custkey) AS mean, count(DISTINCT c_name) AS names, count(DISTINCT c_mktsegment) AS segments FROM h)"""


@query(
    "executive_brief",
    f"""WITH {_FIGURES}
       SELECT concat('- Dataset contains ', format('{{:,}}', n), ' records across 5 variables (3 numeric, 2 categorical).', chr(10),
         '- Data completeness is ', format('{{:.1f}}', pct), '% with ', format('{{:,}}', missing), ' missing values total.', chr(10),
         '- Key metric ''c_custkey'' averages ', format('{{:,}}', floor(mean)::BIGINT), substr(format('{{:.2f}}', mean - floor(mean)), 2), ' across the dataset.', chr(10),
         '- Primary category ''c_name'' has ', names, ' distinct values.', chr(10),
         '- Recommended next steps: clean missing data, explore correlations, and segment by key categories.') AS text FROM f""",
)
def _brief(t, spark):
    return spark.createDataFrame([(insights.executive_brief(holed_customers(t)),)], "text string")


@query(
    "quality_commentary",
    f"""WITH {_FIGURES}
       SELECT concat('Dataset has ', format('{{:,}}', n), ' rows and 5 columns with a quality score of 85/100. ',
         CASE WHEN pct >= 99 THEN 'Data completeness is excellent with virtually no missing values.'
              WHEN pct >= 90 THEN concat('Data completeness is good at ', format('{{:.1f}}', pct), '%, though some cleaning may help.')
              ELSE concat('Data completeness is ', format('{{:.1f}}', pct), '% - significant cleaning is recommended before analysis.') END,
         ' Overall, this dataset is well-suited for analysis.') AS text FROM f""",
)
def _commentary(t, spark):
    return spark.createDataFrame([(insights.quality_commentary(holed_customers(t), 85),)], "text string")


@query(
    "summary_statistics",
    f"""WITH h AS {_HOLED}, n AS ({_union(("c_custkey", "c_nationkey", "c_acctbal"), lambda i, c: f"""
          SELECT '{c}' AS column, unnest(['count', 'mean', 'min', '50%', 'max']) AS metric,
                 unnest([count({c})::DOUBLE, avg({c}), min({c})::DOUBLE, quantile_cont({c}, 0.5), max({c})::DOUBLE]) AS value FROM h""")}),
       k AS ({_union(("c_name", "c_mktsegment"), lambda i, c: f"""
          SELECT '{c}' AS column, count(DISTINCT {c}) AS levels, (SELECT count(*) FROM h GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS top FROM h""")})
       SELECT "column", metric, round(value, 2) AS value FROM n
       UNION ALL SELECT "column", 'unique', levels::DOUBLE FROM k UNION ALL SELECT "column", 'top_frequency', top::DOUBLE FROM k
       UNION ALL SELECT 'c_nationkey', 'missing', (count(*) - count(c_nationkey))::DOUBLE FROM h""",
)
def _summary_statistics(t, spark):
    stats = insights.summary_stats(holed_customers(t))
    rows = [(c, m, float(v)) for c, values in stats["numeric_summary"].items() for m, v in values.items() if m in ("count", "mean", "min", "50%", "max")]
    for c, entry in stats["categorical_summary"].items():
        rows += [(c, "unique", float(entry["unique_count"])), (c, "top_frequency", float(entry["top_frequency"]))]
    rows += [(c, "missing", float(entry["count"])) for c, entry in stats["missing_values"].items()]
    return spark.createDataFrame(rows, "column string, metric string, value double").withColumn("value", F.round("value", 2))


@query(
    "dataset_context",
    f"""WITH h AS {_HOLED}, s AS (SELECT count(*) AS n, count(*) - count(c_nationkey) AS missing FROM h)
       SELECT concat('Dataset shape: ', n, ' rows x 5 columns') AS line FROM s UNION ALL SELECT 'Columns:' FROM s
       UNION ALL SELECT concat('  - ', c, ' (', k, ', ', CASE WHEN c = 'c_nationkey' THEN missing ELSE 0 END, ' nulls)') FROM s,
         (VALUES ('c_custkey', 'bigint'), ('c_name', 'string'), ('c_nationkey', 'int'), ('c_acctbal', 'double'), ('c_mktsegment', 'string')) v(c, k)""",
)
def _context(t, spark):
    lines = insights.dataset_context(holed_customers(t), 10, "c_custkey").split("\n\n")[0].split("\n")
    return spark.createDataFrame([(line,) for line in lines], "line string")


@query("narratives")
def _narratives(t, spark):
    df = holed_customers(t)
    facts = insights.TableFacts(df)
    score = quality.quality_score(df).first()["score"]
    stats = insights.summary_stats(df, facts)
    rows = [
        ("commentary", insights.quality_commentary(df, score, facts)),
        ("report", insights.report_narrative(df, facts)),
        ("brief", insights.executive_brief(df, facts)),
        ("summary", insights.summary_markdown(df, stats)),
        ("dictionary", quality.dictionary_markdown(df, "customers")),
        ("context", insights.dataset_context(df, 10, "c_custkey")),
    ]
    return spark.createDataFrame(rows, "kind string, text string")
