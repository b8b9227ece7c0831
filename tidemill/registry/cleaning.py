"""Cleaning, text, type and encoding operators."""

from pyspark.sql import functions as F

from tidemill.operators import clean, privacy
from tidemill.operators.validate import run_validation
from tidemill.plans.steps import run_steps
from tidemill.registry import query

# -- projection and filters ---------------------------------------------------------------


@query(
    "calc_column",
    """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) + l_tax AS net,
              l_quantity > 25 AND l_tax < 0.04 AS small_tax FROM lineitem""",
)
def _calc(t, spark):
    df = t("lineitem")
    df = clean.add_calculated_column(df, "net", "`l_extendedprice` * (1 - l_discount) + l_tax")
    df = clean.add_calculated_column(df, "small_tax", "l_quantity > 25 & l_tax < 0.04")
    return df.select("l_orderkey", "l_linenumber", "net", "small_tax")


@query(
    "calc_mod_floor",
    """SELECT l_orderkey, l_linenumber,
              (l_quantity - 25) - 7 * floor((l_quantity - 25) / 7) AS modulo,
              floor((l_quantity - 25) / -4) AS floored,
              power(l_quantity, 2) AS squared,
              l_extendedprice / nullif(l_quantity - 25, 0) AS ratio FROM lineitem""",
)
def _modulo(t, spark):
    df = t("lineitem")
    for name, text in {
        "modulo": "(l_quantity - 25) % 7",
        "floored": "(l_quantity - 25) // -4",
        "squared": "l_quantity ** 2",
        "ratio": "l_extendedprice / (l_quantity - 25)",
    }.items():
        df = clean.add_calculated_column(df, name, text)
    return df.select("l_orderkey", "l_linenumber", "modulo", "floored", "squared", "ratio")


@query(
    "calc_builder",
    "SELECT l_orderkey, l_linenumber, l_quantity * l_tax AS a, l_quantity / 4 AS b FROM lineitem",
)
def _builder(t, spark):
    df = clean.add_arithmetic_column(t("lineitem"), "a", "l_quantity", "*", "l_tax")
    df = clean.add_arithmetic_column(df, "b", "l_quantity", "/", 4, right_is_column=False)
    return df.select("l_orderkey", "l_linenumber", "a", "b")


@query(
    "filter_isin",
    "SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus IN ('F')",
)
def _isin(t, spark):
    choices = {"l_returnflag": ["A", "R"], "l_linestatus": ["F"], "l_shipdate": []}
    return clean.filter_values(t("lineitem"), choices)


@query("drop_rename", "SELECT o_orderkey AS id, o_custkey, o_orderstatus AS status, o_orderdate FROM orders")
def _drop(t, spark):
    df = clean.drop_columns(t("orders"), ["o_totalprice", "o_orderpriority"])
    return clean.rename_columns(df, {"o_orderkey": "id", "o_orderstatus": "status", "unknown": "x"})


@query("preview_rows", "SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def _preview(t, spark):
    return clean.preview(t("orders"), 100, ["o_totalprice", "o_orderkey"])


# -- missing values: the value of every 'error' event is unknown ----------------------------

_EVENTS = "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"


def holed_events(t):
    return t("events").select(
        "event_id", "ts", "user_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )


_FILLS = {
    "mean": "(SELECT avg(value) FROM e)",
    "median": "(SELECT quantile_cont(value, 0.5) FROM e)",
    "mode": "(SELECT value FROM e WHERE value IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, value LIMIT 1)",
    "zero": "0",
}
for _strategy, _value in _FILLS.items():

    @query(
        f"fill_{_strategy}",
        f"WITH e AS {_EVENTS} SELECT event_id, round(coalesce(value, {_value}), 6) AS value FROM e",
    )
    def _fill(t, spark, strategy=_strategy):
        filled = clean.fill_missing(holed_events(t), "value", strategy)
        return filled.select("event_id", F.round("value", 6).alias("value"))


@query(
    "fill_mode_text",
    """WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS p FROM orders)
       SELECT o_orderkey, coalesce(p, (SELECT p FROM x WHERE p IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, p LIMIT 1)) AS p FROM x""",
)
def _mode_text(t, spark):
    df = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("p"))
    return clean.fill_missing(df, "p", "mode")


for _strategy, _frame, _pick in (
    ("forward", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "last_value"),
    ("backward", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "first_value"),
):
    for _label, _keys, _by in (("", (), ""), ("_by_user", ("user_id",), "PARTITION BY user_id")):

        @query(
            f"fill_{_strategy}{_label}",
            f"""WITH e AS {_EVENTS} SELECT event_id, {_pick}(value IGNORE NULLS)
                OVER ({_by} ORDER BY ts, event_id {_frame}) AS value FROM e""",
        )
        def _carry(t, spark, strategy=_strategy, keys=_keys):
            filled = clean.fill_missing(holed_events(t), "value", strategy, ["ts", "event_id"], keys)
            return filled.select("event_id", "value")


@query("drop_missing", f"SELECT * FROM {_EVENTS} WHERE value IS NOT NULL AND user_id IS NOT NULL")
def _drop_missing(t, spark):
    return clean.drop_missing_rows(holed_events(t), ["value", "user_id"])


@query("flag_missing", f"SELECT *, value IS NULL AS value_is_missing FROM {_EVENTS}")
def _flag(t, spark):
    return clean.flag_missing(holed_events(t))


# -- outliers -----------------------------------------------------------------------------

_FENCE = """WITH b AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}),
f AS (SELECT q1 - {m} * (q3 - q1) AS lo, q3 + {m} * (q3 - q1) AS hi FROM b)
"""


@query(
    "outliers_remove",
    _FENCE.format(c="l_extendedprice", t="lineitem", m=0.5)
    + "SELECT lineitem.* FROM lineitem, f WHERE l_extendedprice BETWEEN lo AND hi",
)
def _remove(t, spark):
    return clean.remove_outliers_iqr(t("lineitem"), "l_extendedprice", 0.5)


@query(
    "outliers_preview",
    _FENCE.format(c="value", t="events", m=1.5)
    + "SELECT events.* FROM events, f WHERE value < lo OR value > hi ORDER BY event_id LIMIT 20",
)
def _outlier_preview(t, spark):
    return clean.outlier_rows(t("events"), "value", 1.5, 20, "event_id")


@query(
    "outliers_cap",
    _FENCE.format(c="l_extendedprice", t="lineitem", m=0.5)
    + "SELECT l_orderkey, l_linenumber, round(greatest(lo, least(hi, l_extendedprice)), 6) AS l_extendedprice FROM lineitem, f",
)
def _cap(t, spark):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    capped = clean.cap_outliers(df, "l_extendedprice", "iqr", 0.5)
    return capped.withColumn("l_extendedprice", F.round("l_extendedprice", 6))


@query(
    "outliers_cap_percentile",
    f"""WITH e AS {_EVENTS}, f AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM e)
       SELECT event_id, CASE WHEN value IS NOT NULL THEN round(greatest(lo, least(hi, value)), 6) END AS value FROM e, f""",
)
def _cap_percentile(t, spark):
    capped = clean.cap_outliers(holed_events(t).select("event_id", "value"), "value", "percentile")
    return capped.withColumn("value", F.round("value", 6))


# -- duplicates ---------------------------------------------------------------------------

_KINDS = ["p_brand", "p_type", "p_size"]


@query("dedupe", "SELECT DISTINCT p_brand, p_type, p_size FROM part")
def _dedupe(t, spark):
    return clean.remove_duplicates(t("part").select(*_KINDS))


@query("dedupe_none", "SELECT p_brand, p_type, p_size FROM part GROUP BY ALL HAVING count(*) = 1")
def _dedupe_none(t, spark):
    return clean.remove_duplicates(t("part").select(*_KINDS), keep=False)


@query(
    "duplicate_count",
    """SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, text FROM documents)) AS BIGINT)
       AS duplicate_rows FROM documents""",
)
def _duplicates(t, spark):
    return clean.duplicate_count(t("documents").select("lang", "source", "text"))


@query(
    "duplicate_preview",
    """SELECT p_brand, p_type, p_size FROM part
       JOIN (SELECT p_brand AS b, p_type AS y, p_size AS s FROM part GROUP BY ALL HAVING count(*) > 1)
       ON p_brand = b AND p_type = y AND p_size = s ORDER BY 1, 2, 3 LIMIT 20""",
)
def _duplicate_preview(t, spark):
    return clean.duplicate_rows(t("part").select(*_KINDS), 20)


# -- text ---------------------------------------------------------------------------------


@query(
    "split_column",
    """SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS p_name_part1, string_split(p_name, ' ')[2] AS p_name_part2
       FROM part""",
)
def _split(t, spark):
    return clean.split_column(t("part").select("p_partkey", "p_name"), "p_name", " ")


@query(
    "split_column_regex",
    """SELECT o_orderkey, trim(regexp_split_to_array(o_orderpriority, '-|NOT')[1]) AS a,
              trim(regexp_split_to_array(o_orderpriority, '-|NOT')[2]) AS b,
              trim(regexp_split_to_array(o_orderpriority, '-|NOT')[3]) AS c FROM orders""",
)
def _split_regex(t, spark):
    df = clean.split_column(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-|NOT", ["a", "b", "c"])
    return df.drop("o_orderpriority")


@query("merge_columns", "SELECT p_partkey, concat_ws(' / ', p_brand, nullif(p_type, 'ECONOMY'), p_size) AS merged FROM part")
def _merge(t, spark):
    df = t("part").withColumn("p_type", F.nullif("p_type", F.lit("ECONOMY")))
    return clean.merge_columns(df, ["p_brand", "p_type", "p_size"], "merged", " / ").select("p_partkey", "merged")


_TITLE = """array_to_string(list_transform(regexp_extract_all({c}, '([A-Za-z]+|[^A-Za-z]+)'),
 lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '')"""

for _method, _sql in {
    "lowercase": "lower({c})",
    "uppercase": "upper({c})",
    "titlecase": _TITLE,
    "strip": "trim({c})",
    "strip_all": "trim(regexp_replace({c}, '\\s+', ' ', 'g'))",
}.items():
    _padded = "('  ' || p_name || '   ' || p_brand || ' ')"

    @query(f"text_{_method}", f"SELECT p_partkey, {_sql.format(c=_padded)} AS label FROM part")
    def _text(t, spark, method=_method):
        label = F.concat(F.lit("  "), "p_name", F.lit("   "), "p_brand", F.lit(" "))
        return clean.standardize_text(t("part").select("p_partkey", label.alias("label")), "label", method)


@query(
    "document_blanks",
    "SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS chars, md5(lower(text)) AS lower_md5 FROM documents",
)
def _document_blanks(t, spark):
    df = t("documents").select("doc_id", "text", F.md5(F.lower("text")).alias("lower_md5"))
    collapsed = clean.standardize_text(df, "text", "strip_all")
    return collapsed.select("doc_id", F.length("text").cast("long").alias("chars"), "lower_md5")


@query(
    "regex_extract",
    """SELECT page_id, url, CASE WHEN regexp_matches(url, 'page=\\d+') THEN regexp_extract(url, 'page=\\d+') END AS url_extracted
       FROM pages""",
)
def _extract(t, spark):
    return clean.string_operations(t("pages").select("page_id", "url"), "url", "extract_regex", r"page=\d+")


@query("string_trim", "SELECT p_partkey, p_name FROM part")
def _trim(t, spark):
    padded = t("part").select("p_partkey", F.concat(F.lit(" \t"), "p_name", F.lit(" \n")).alias("p_name"))
    return clean.string_operations(padded, "p_name", "trim")


# -- types and dates ------------------------------------------------------------------------


@query(
    "type_numeric",
    """SELECT event_id, CAST(TRY_CAST(regexp_extract(props, '-?\\d+') AS DOUBLE) AS DOUBLE) AS k,
              NULL::DOUBLE AS kind FROM events""",
)
def _numeric(t, spark):
    df = t("events").select("event_id", F.concat(F.lit(" "), F.regexp_extract("props", r"-?\d+", 0)).alias("k"), F.col("event_type").alias("kind"))
    return clean.convert_column_type(clean.convert_column_type(df, "k", "numeric"), "kind", "numeric")


@query("type_integer", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem")
def _integer(t, spark):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return clean.convert_column_type(df, "l_quantity", "integer")


@query(
    "type_datetime",
    """SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS day, NULL::TIMESTAMP AS bad,
              CAST(o_orderkey AS VARCHAR) AS label FROM orders""",
)
def _datetime(t, spark):
    df = t("orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_orderpriority").alias("bad"),
        F.col("o_orderkey").alias("label"),
    )
    for column, target in (("day", "datetime"), ("bad", "datetime"), ("label", "text")):
        df = clean.convert_column_type(df, column, target)
    return df


@query(
    "date_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
              CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, dayname(o_orderdate) AS o_orderdate_weekday FROM orders""",
)
def _parts(t, spark):
    return clean.extract_date_parts(t("orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@query(
    "year_numbers_as_dates",
    "SELECT o_orderkey, make_timestamp(year(o_orderdate), 1, 1, 0, 0, 0) AS y FROM orders",
)
def _years(t, spark):
    df = t("orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    return clean.convert_column_type(df, "y", "datetime")


@query(
    "detect_dates",
    """SELECT 1 AS position, 'o_orderdate' AS "column", 'datetime type' AS reason
       UNION ALL SELECT 2, 'month_label', 'name'
       UNION ALL SELECT 3, 'code', '4-digit values' FROM orders HAVING min(o_custkey + 1000) >= 1000 AND max(o_custkey + 1000) <= 9999""",
)
def _detect_dates(t, spark):
    df = t("orders").select(
        "o_totalprice", "o_orderdate", F.date_format("o_orderdate", "MMM").alias("month_label"), (F.col("o_custkey") + 1000).alias("code")
    )
    return clean.detect_date_columns(df)


@query(
    "text_dates",
    """SELECT 'a' AS "column", 1.0::DOUBLE AS parsed_share, true AS is_date
       UNION ALL SELECT 'b', round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE,
                        avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) > 0.5 FROM orders
       UNION ALL SELECT 'o_orderstatus', 0.0, false""",
)
def _text_dates(t, spark):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    df = t("orders").select(
        text.alias("a"), F.when(F.col("o_orderstatus") == "F", text).otherwise("unknown").alias("b"), "o_orderstatus"
    )
    return clean.text_date_columns(df).withColumn("parsed_share", F.round("parsed_share", 6))


# -- encoding -------------------------------------------------------------------------------


@query(
    "bin_numeric",
    """WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
       SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= lo + 1 * ((hi - lo) / 5) THEN 'very low'
         WHEN l_quantity <= lo + 2 * ((hi - lo) / 5) THEN 'low' WHEN l_quantity <= lo + 3 * ((hi - lo) / 5) THEN 'mid'
         WHEN l_quantity <= lo + 4 * ((hi - lo) / 5) THEN 'high' ELSE 'very high' END AS l_quantity_binned FROM lineitem, b""",
)
def _bins(t, spark):
    labels = ["very low", "low", "mid", "high", "very high"]
    return clean.bin_numeric(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", 5, labels).drop("l_quantity")


@query(
    "one_hot",
    """SELECT o_orderkey, """
    + ", ".join(
        f"CAST(o_orderstatus IS NOT NULL AND o_orderstatus = '{v}' AS INTEGER) AS o_orderstatus_{v}" for v in "FOP"
    )
    + " FROM orders",
)
def _one_hot(t, spark):
    return clean.one_hot_encode(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", drop_original=True)


@query("distinct_levels", "SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 20")
def _levels(t, spark):
    return clean.distinct_levels(t("part"), "p_brand", 20)


for _kind, _sql in {
    "full": "'***REDACTED***'",
    "hash": "left(sha256(c_name), 12)",
    "partial": "left(c_name, 2) || repeat('*', CAST(length(c_name) - 4 AS BIGINT)) || right(c_name, 2)",
}.items():

    @query(
        f"mask_{_kind}",
        f"""SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE {_sql} END AS c_name,
                   CASE WHEN '{_kind}' = 'partial' THEN '****' ELSE right(c_name, 4) END AS tail FROM customer""",
    )
    def _mask(t, spark, kind=_kind):
        df = t("customer").select(
            "c_custkey",
            F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_name")).alias("c_name"),
            F.right("c_name", F.lit(4)).alias("tail"),
        )
        masked = privacy.mask_column(df, "c_name", kind)
        return privacy.mask_column(masked, "tail", "partial") if kind == "partial" else masked


@query(
    "melt_long",
    """SELECT o_orderkey, 'o_totalprice' AS "Series", o_totalprice AS "Value" FROM orders
       UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders""",
)
def _melt(t, spark):
    return clean.melt(t("orders"), ["o_orderkey"], ["o_totalprice", "o_custkey"])


# -- step sequences -----------------------------------------------------------------------

_STEPS = [
    ("Remove duplicates", "remove_duplicates", {}),
    ("Flag missing", "flag_missing", {}),
    ("Fill missing", "fill_missing", {"column": "value", "strategy": "zero"}),
    ("Cap outliers", "cap_outliers", {"column": "value"}),
    ("Mask type", "mask_column", {"column": "event_type", "mask_type": "partial"}),
    ("Drop", "drop_columns", {"columns": ["ts"]}),
]
_STEP_SQL = f"""
WITH e AS {_EVENTS}, filled AS (SELECT event_id, user_id, event_type, value IS NULL AS value_is_missing, coalesce(value, 0) AS value FROM e),
b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM filled),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b)
"""


def _doubled(t):
    events = holed_events(t)
    return events.unionByName(events)


@query(
    "cleaning_steps",
    _STEP_SQL
    + """SELECT event_id, user_id, round(greatest(lo, least(hi, value)), 6) AS value, value_is_missing,
         CASE WHEN length(event_type) <= 4 THEN '****' ELSE left(event_type, 2) ||
         repeat('*', CAST(length(event_type) - 4 AS BIGINT)) || right(event_type, 2) END AS event_type FROM filled, f""",
)
def _steps(t, spark):
    cleaned, _ = run_steps(_doubled(t), _STEPS)
    return cleaned.withColumn("value", F.round("value", 6))


@query(
    "cleaning_log",
    _STEP_SQL
    + """SELECT 1 AS step, 'Remove duplicates' AS action, count(*) AS rows_affected FROM e
         UNION ALL SELECT 2, 'Flag missing', count(*) FILTER (WHERE value_is_missing) FROM filled
         UNION ALL SELECT 3, 'Fill missing', count(*) FILTER (WHERE value_is_missing) FROM filled
         UNION ALL SELECT 4, 'Cap outliers', count(*) FILTER (WHERE value < lo OR value > hi) FROM filled, f
         UNION ALL SELECT 5, 'Mask type', count(event_type) FROM filled
         UNION ALL SELECT 6, 'Drop', 0""",
)
def _log(t, spark):
    _, log = run_steps(_doubled(t), _STEPS)
    return log.drop("timestamp")


# -- validation ---------------------------------------------------------------------------

RULES = [
    {"column": "value", "rule_type": "not_null"},
    {"column": "user_id", "rule_type": "unique"},
    {"column": "event_id", "rule_type": "unique"},
    {"column": "value", "rule_type": "range", "params": {"min": 5, "max": 50}},
    {"column": "event_type", "rule_type": "range"},
    {"column": "event_type", "rule_type": "allowed_values", "params": {"allowed": ["click", " view ", "error"]}},
    {"column": "event_type", "rule_type": "regex", "params": {"pattern": "[a-m]"}},
    {"column": "event_type", "rule_type": "regex", "params": {"pattern": "["}},
    {"column": "absent", "rule_type": "not_null"},
]
_RULE_COUNTS = [
    "count(*) FILTER (WHERE value IS NULL)",
    "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM e WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1))",
    "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM e GROUP BY event_id HAVING count(*) > 1))",
    "count(*) FILTER (WHERE value < 5 OR value > 50)",
    "count(event_type)",
    "count(*) FILTER (WHERE event_type NOT IN ('click', 'view', 'error'))",
    "count(*) FILTER (WHERE NOT regexp_matches(event_type, '^(?:[a-m])'))",
    "0",
    "0",
]


@query(
    "run_validation",
    f"WITH e AS {_EVENTS}, v AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS i, '{r['column']}' AS \"column\", '{r['rule_type']}' AS type, CAST({c} AS BIGINT) AS violations, count(*) AS n FROM e"
        for i, (r, c) in enumerate(zip(RULES, _RULE_COUNTS))
    )
    + """) SELECT "column", type, violations, round(100.0 * violations / n, 2)::DOUBLE AS violation_pct,
         CASE WHEN i = 7 THEN 'Error' WHEN violations = 0 THEN 'Pass' ELSE 'Fail' END AS status FROM v""",
)
def _validation(t, spark):
    return run_validation(holed_events(t), RULES).select("column", "type", "violations", "violation_pct", "status")
