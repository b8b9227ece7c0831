"""Time series, trends, regular grids and forecasts."""

from pyspark.sql import functions as F

from tidemill.operators import timeseries as ts
from tidemill.operators.forecast import run_time_series_forecast
from tidemill.registry import query

_PERIOD = {
    "D": ("date_trunc('day', {c})", "INTERVAL 1 DAY", "DoD", 365),
    "W": ("date_trunc('week', {c}) + INTERVAL 6 DAY", "INTERVAL 7 DAY", "WoW", 52),
    "MS": ("date_trunc('month', {c})", "INTERVAL 1 MONTH", "MoM", 12),
    "QS": ("date_trunc('quarter', {c})", "INTERVAL 3 MONTH", "QoQ", 4),
    "YS": ("date_trunc('year', {c})", "INTERVAL 1 YEAR", "YoY", 1),
}


def _series_sql(freq, agg, table, date, value):
    period, step, _, _ = _PERIOD[freq]
    empty = "0" if agg in ("sum", "count") else "NULL"
    function = "avg" if agg == "mean" else agg
    return f"""
    g AS (SELECT CAST({period.format(c=date)} AS TIMESTAMP) AS p, {function}({value}) AS v FROM {table}
          WHERE {date} IS NOT NULL AND {value} IS NOT NULL GROUP BY 1),
    s AS (SELECT unnest(generate_series(min(p), max(p), {step})) AS p FROM g),
    series AS (SELECT s.p AS "Period", coalesce(g.v, {empty}) AS v FROM s LEFT JOIN g USING (p))"""


for _name, _freq, _agg in (
    ("time_day", "D", "count"),
    ("time_week", "W", "sum"),
    ("time_month", "MS", "mean"),
    ("time_quarter", "QS", "max"),
    ("time_year", "YS", "min"),
):

    @query(
        _name,
        f"""WITH {_series_sql(_freq, _agg, 'orders', 'o_orderdate', 'o_totalprice')}
            SELECT "Period", {'CAST(v AS BIGINT)' if _agg == 'count' else 'round(v, 2)'} AS o_totalprice FROM series""",
    )
    def _series(t, spark, freq=_freq, agg=_agg):
        out = ts.build_time_series(t("orders"), "o_orderdate", "o_totalprice", freq, agg)
        return out if agg == "count" else out.withColumn("o_totalprice", F.round("o_totalprice", 2))


for _freq in _PERIOD:
    _, _, _label, _year = _PERIOD[_freq]
    _yoy = "" if _freq == "YS" else f', round((v / nullif(lag(v, {_year}) OVER w, 0) - 1) * 100, 2) AS "YoY %"'

    @query(
        f"time_intelligence_{_freq.lower()}",
        f"""WITH {_series_sql(_freq, 'sum', 'orders', 'o_orderdate', 'o_totalprice')}
            SELECT "Period", round(v, 2) AS o_totalprice, round((v / nullif(lag(v) OVER w, 0) - 1) * 100, 2) AS "{_label} %"{_yoy},
                   round(avg(v) OVER (ORDER BY "Period" ROWS 2 PRECEDING), 2) AS "3-Period Rolling Avg"
            FROM series WINDOW w AS (ORDER BY "Period")""",
    )
    def _intelligence(t, spark, freq=_freq):
        out = ts.compute_time_intelligence(t("orders"), "o_orderdate", "o_totalprice", freq, "sum", 3)
        if freq == "YS":  # yearly changes are the year-over-year changes
            out = out.select("Period", "o_totalprice", F.col("`YoY %`"), F.col("`3-Period Rolling Avg`"))
        return out.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(
    "time_by_event_type",
    """WITH g AS (SELECT event_type, date_trunc('day', ts) AS p, count(value) AS v FROM events GROUP BY 1, 2),
       s AS (SELECT event_type, unnest(generate_series(min(p), max(p), INTERVAL 1 DAY)) AS p FROM g GROUP BY 1),
       series AS (SELECT event_type, p AS "Period", coalesce(v, 0) AS v FROM s LEFT JOIN g USING (event_type, p))
       SELECT event_type, "Period", v AS value,
              round((v / nullif(lag(v) OVER w, 0) - 1) * 100, 2) AS "DoD %",
              round((v / nullif(lag(v, 365) OVER w, 0) - 1) * 100, 2) AS "YoY %",
              round(avg(v) OVER (PARTITION BY event_type ORDER BY "Period" ROWS 6 PRECEDING), 2) AS "7-Period Rolling Avg"
       FROM series WINDOW w AS (PARTITION BY event_type ORDER BY "Period")""",
)
def _by_type(t, spark):
    return ts.compute_time_intelligence(t("events"), "ts", "value", "D", "count", 7, "event_type")


_YEARLY = "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, avg(o_totalprice) AS m FROM orders GROUP BY 1"


@query(
    "trend_points",
    f"""SELECT year, round(m, 2) AS average, round(m / nullif(lag(m) OVER (ORDER BY year), 0) - 1, 4) AS change FROM ({_YEARLY})""",
)
def _points(t, spark):
    df = t("orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    return ts.trend_points(df, "year", "o_totalprice")


@query(
    "trend_points_many_keys",
    """SELECT o_orderdate, round(m, 2) AS average, round(m / nullif(lag(m) OVER (ORDER BY o_orderdate), 0) - 1, 4) AS change
       FROM (SELECT o_orderdate, avg(sqrt(o_totalprice)) AS m FROM orders GROUP BY 1)""",
)
def _many_points(t, spark):
    # a low limit exercises the route for keys too many for one window
    df = t("orders").select("o_orderdate", F.sqrt("o_totalprice").alias("root"))
    return ts.trend_points(df, "o_orderdate", "root", window_keys=100)


_TREND = """SELECT 'year' AS key, '{m}' AS measure, count(*) AS points, round(first(m), 2) AS first_average, round(last(m), 2) AS last_average,
  CASE WHEN last(m) > first(m) THEN 'increasing' ELSE 'decreasing' END AS trend,
  round((last(m) - first(m)) / first(m) * 100, 2) AS total_change_pct
  FROM (SELECT year(o_orderdate) AS y, avg({e}) AS m FROM orders GROUP BY 1 ORDER BY 1) HAVING count(*) >= 2"""


@query("trends", _TREND.format(m="o_totalprice", e="o_totalprice"))
def _trend(t, spark):
    df = t("orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    return ts.detect_trends(df, "year", "o_totalprice")


@query(
    "trends_auto",
    " UNION ALL ".join(
        f"SELECT * FROM ({_TREND.format(m=m, e=e)})"
        for m, e in (("o_custkey", "o_custkey"), ("o_totalprice", "o_totalprice"), ("half", "o_totalprice / 2"))
    ),
)
def _auto(t, spark):
    df = t("orders").select("o_custkey", "o_totalprice", (F.col("o_totalprice") / 2).alias("half"), F.year("o_orderdate").cast("string").alias("year"))
    return ts.detect_trends(df)


_MONTHS = "SELECT o_orderpriority AS k, date_trunc('month', o_orderdate) AS p, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2"


def _monthly(t):
    return t("orders").select(
        "o_orderpriority", F.date_trunc("month", "o_orderdate").alias("month"), "o_totalprice"
    )


@query(
    "regularise_monthly",
    f"""WITH g AS ({_MONTHS}), s AS (SELECT k, unnest(generate_series(min(p), max(p), INTERVAL 1 MONTH)) AS p FROM g GROUP BY 1),
        j AS (SELECT s.k, s.p, g.v, row_number() OVER (PARTITION BY s.k ORDER BY s.p) AS i FROM s LEFT JOIN g ON s.k = g.k AND s.p = g.p),
        n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY k ORDER BY p) AS bi,
                     last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY p) AS bv,
                     first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ai,
                     first_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS av FROM j)
        SELECT k AS o_orderpriority, CAST(p AS TIMESTAMP) AS date, round(CASE WHEN v IS NOT NULL THEN v ELSE bv + (av - bv) * (i - bi) / (ai - bi) END, 2) AS value,
               v IS NULL AS is_filled FROM n""",
)
def _regular(t, spark):
    out = ts.regularise(_monthly(t), "month", "o_totalprice", "o_orderpriority")
    return out.select("o_orderpriority", "date", F.round("value", 2).alias("value"), "is_filled")


@query("forecast_monthly")
def _forecast(t, spark):
    out = run_time_series_forecast(_monthly(t), "month", "o_totalprice", 12, partition_by="o_orderpriority")
    return out.withColumns({"value": F.round("value", 2), "aic": F.round("aic", 2)})


@query("forecast_daily_events")
def _forecast_daily(t, spark):
    daily = t("events").select("event_type", F.date_trunc("day", "ts").alias("day"), "value")
    out = run_time_series_forecast(daily, "day", "value", 7, partition_by="event_type")
    return out.withColumns({"value": F.round("value", 3), "aic": F.round("aic", 2)})


# an exact trend with an exact season goes on as it was
@query(
    "forecast_known_series",
    """WITH e AS (SELECT min(date_trunc('month', o_orderdate)) AS lo, max(date_trunc('month', o_orderdate)) AS hi FROM orders),
       m AS (SELECT unnest(range(lo::TIMESTAMP, (hi + INTERVAL 13 MONTH)::TIMESTAMP, INTERVAL 1 MONTH)) AS d, hi FROM e)
       SELECT d::TIMESTAMP AS date, round((year(d) * 12 + month(d) - 23900) * 2.5 + (month(d) * 7) % 12, 3)::DOUBLE AS value,
              CASE WHEN d <= hi THEN 'historical' ELSE 'forecast' END AS type FROM m""",
)
def _forecast_known(t, spark):
    month = F.date_trunc("month", "o_orderdate")
    value = (F.year("month") * 12 + F.month("month") - 23900) * 2.5 + F.month("month") * 7 % 12
    known = t("orders").select(month.alias("month")).distinct().withColumn("v", value.cast("double"))
    out = run_time_series_forecast(known, "month", "v", 12)
    return out.select("date", (F.round("value", 3) + 0.0).alias("value"), "type")
