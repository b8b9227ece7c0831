"""Regular time series: period aggregation, changes, rolling averages, trends, gap filling.

Windows run over aggregated periods, one row per calendar period and series, never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemill.functions.scalars import change_pct, full_sum, to_number
from tidemill.functions.types import dtype_of, numeric_columns, ref, require_columns
from tidemill.operators.clean import coerce_datetime
from tidemill.plans.hotkeys import small_side
from tidemill.plans.roworder import with_row_index
from tidemill.plans.session import materialize

# Frequency -> (change label, period label, periods per year).
FREQUENCIES = {
    "D": ("DoD", "Day", 365),
    "W": ("WoW", "Week", 52),
    "M": ("MoM", "Month", 12),
    "Q": ("QoQ", "Quarter", 4),
    "Y": ("YoY", "Year", 1),
}
# The names of the frequencies.
FREQUENCY_CHOICES = {"Daily": "D", "Weekly": "W", "Monthly": "MS", "Quarterly": "QS", "Yearly": "YS"}

_STEPS = {
    "D": "INTERVAL 1 DAY",
    "W": "INTERVAL 7 DAYS",
    "M": "INTERVAL 1 MONTH",
    "Q": "INTERVAL 3 MONTHS",
    "Y": "INTERVAL 1 YEAR",
}
_TRUNC = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
SERIES_AGGREGATES = ("sum", "mean", "min", "max", "count")
WINDOW_KEYS = 1_000_000


def frequency_root(freq: str) -> str:
    root = FREQUENCY_CHOICES.get(freq, freq)[0].upper()
    if root not in _STEPS:
        raise ValueError(f"unknown frequency: {freq}")
    return root


def period_of(moment, root: str):
    """Start of the period; a week is named by the Sunday that closes it."""
    start = F.date_trunc(_TRUNC[root], moment)
    return start + F.expr("INTERVAL 6 DAYS") if root == "W" else start


def _series_window(keys: list[str]):
    return Window.partitionBy(*[ref(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))


def _keys(partition_by) -> list[str]:
    return [partition_by] if isinstance(partition_by, str) else list(partition_by)


def build_time_series(
    df: DataFrame, date_col: str, value_col: str, freq: str = "MS", agg: str = "sum", partition_by=()
) -> DataFrame:
    """``Period`` and value at even spacing; empty periods are 0 for sum and count, else NULL."""
    keys, root = _keys(partition_by), frequency_root(freq)
    require_columns(df, [date_col, value_col, *keys])
    if agg not in SERIES_AGGREGATES:
        raise ValueError(f"agg must be one of {SERIES_AGGREGATES}, got '{agg}'")
    x = F.col("_x")
    measure = {"sum": full_sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}[agg](x)
    periods = (
        df.select(
            *[ref(k) for k in keys],
            coerce_datetime(df, date_col).alias("_t"),
            to_number(ref(value_col), dtype_of(df, value_col)).alias("_x"),
        )
        .where("_t is not null and _x is not null")
        .groupBy(*[ref(k) for k in keys], period_of(F.col("_t"), root).alias("_p"))
        .agg(measure.alias("_m"))
    )
    return _fill_gaps(periods, keys, root, value_col, agg)


def _fill_gaps(periods, keys, root, value_col, agg):
    """Each period emits itself and the empty periods up to the next one."""
    step = F.expr(_STEPS[root])
    following = F.lead("_p").over(_series_window(keys).orderBy("_p"))
    last_empty = F.coalesce(F.col("_next") - step, F.col("_p"))
    spread = periods.withColumn("_next", following).select(
        *[ref(k) for k in keys], "_p", "_m", F.explode(F.sequence(F.col("_p"), last_empty, step)).alias("Period")
    )
    value = F.when(F.col("Period") == F.col("_p"), F.col("_m"))
    if agg in ("sum", "count"):
        value = F.coalesce(value, F.lit(0))
    return spread.select(*[ref(k) for k in keys], "Period", value.alias(value_col))


def change_label(freq: str) -> str:
    return f"{FREQUENCIES[frequency_root(freq)][0]} %"


def compute_time_intelligence(
    df: DataFrame,
    date_col: str,
    value_col: str,
    freq: str = "MS",
    agg: str = "sum",
    rolling_window: int = 3,
    partition_by=(),
) -> DataFrame:
    """The series with period-over-period %, year-over-year % and a trailing average."""
    keys, root = _keys(partition_by), frequency_root(freq)
    label, _, per_year = FREQUENCIES[root]
    series = build_time_series(df, date_col, value_col, freq, agg, keys)
    over = _series_window(keys).orderBy("Period")
    value = ref(value_col)
    pop = change_pct(value, F.lag(value, 1).over(over))
    yoy = change_pct(value, F.lag(value, per_year).over(over))
    rolling = F.round(F.avg(value).over(over.rowsBetween(-(rolling_window - 1), 0)), 2)
    out = {f"{label} %": pop, "YoY %": yoy, f"{rolling_window}-Period Rolling Avg": rolling}
    return series.select(*[ref(k) for k in keys], "Period", value, *[e.alias(n) for n, e in out.items()])


def series_labels(freq: str = "MS", rolling_window: int = 3) -> dict:
    """Names that go with ``compute_time_intelligence``."""
    label, period, per_year = FREQUENCIES[frequency_root(freq)]
    return {
        "pop_label": label,
        "period_label": period,
        "rolling_label": f"{rolling_window}-Period Rolling Avg",
        "periods_per_year": per_year,
    }


# -- trends -------------------------------------------------------------------------------


def _with_previous(points: DataFrame, key: str, value: str, few_keys: bool) -> DataFrame:
    """Add the value of the preceding key; many keys go through row positions, not one window."""
    if few_keys:
        return points.withColumn("_prev", F.lag(value).over(Window.partitionBy(F.lit(0)).orderBy(ref(key))))
    indexed = with_row_index(points, key, "_i")
    before = indexed.select((F.col("_i") + 1).alias("_i"), ref(value).alias("_prev"))
    return indexed.join(before, "_i", "left").drop("_i")


def trend_points(df: DataFrame, date_col: str, value_col: str, window_keys: int = WINDOW_KEYS) -> DataFrame:
    """Mean per key in key order and its relative change from the key before."""
    points = (
        df.where(ref(date_col).isNotNull())
        .groupBy(ref(date_col))
        .agg(F.avg(ref(value_col)).alias("_mean"))
    )
    keys = df.agg(F.approx_count_distinct(ref(date_col)).alias("n")).first()["n"]
    moved = _with_previous(points, date_col, "_mean", keys <= window_keys)
    change = F.try_divide(F.col("_mean"), F.col("_prev")) - 1
    return moved.select(ref(date_col), F.round("_mean", 2).alias("average"), F.round(change, 4).alias("change"))


def detect_trends(
    df: DataFrame, date_col: str | None = None, value_col: str | None = None, measures_shown: int | None = None
) -> DataFrame:
    """First against last average; without columns, the first year/date column by every measure.

    All measures share one pass: the means per key, then one row of ends.  ``measures_shown``
    restricts the automatic choice to the first numeric columns.
    """
    if date_col and value_col and date_col in df.columns and value_col in df.columns:
        key, measures = date_col, [value_col]
    else:
        times = [c for c in df.columns if "year" in c.lower() or "date" in c.lower()]
        key, measures = (times[0], numeric_columns(df)[:measures_shown]) if times else (None, [])
    if not measures:
        return df.sparkSession.createDataFrame(
            [],
            "key string, measure string, points long, first_average double, last_average double, "
            "trend string, total_change_pct double",
        )
    points = df.where(ref(key).isNotNull()).groupBy(ref(key).alias("_k")).agg(
        *[F.avg(ref(m)).alias(f"m{i}") for i, m in enumerate(measures)]
    )
    cells = [
        F.struct(
            F.lit(m).alias("measure"),
            F.count("*").alias("points"),
            F.min_by(f"m{i}", "_k").alias("first"),
            F.max_by(f"m{i}", "_k").alias("last"),
        )
        for i, m in enumerate(measures)
    ]
    rows = points.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).where("points >= 2")
    return rows.select(
        F.lit(key).alias("key"),
        "measure",
        "points",
        F.round("first", 2).alias("first_average"),
        F.round("last", 2).alias("last_average"),
        F.when(F.col("last") > F.col("first"), "increasing").otherwise("decreasing").alias("trend"),
        F.round(F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100, 2).alias("total_change_pct"),
    )


# -- regular spacing ----------------------------------------------------------------------

MIN_POINTS = 6


def infer_spacing(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: the constant spacing of its distinct moments ``_t``, if it has one.

    n distinct moments lie on an even grid exactly when each is a whole number of steps of
    (last - first) / (n - 1) from the first, so no ordering of the moments is needed.
    """
    groups = [ref(k) for k in keys]
    month = F.year("_t") * 12 + F.month("_t")
    at_midnight = F.col("_t") == F.date_trunc("day", F.col("_t"))
    first_day = at_midnight & (F.dayofmonth("_t") == 1)
    last_day = at_midnight & (F.to_date("_t") == F.last_day(F.col("_t")))
    ends = points.groupBy(*groups).agg(
        F.count("*").alias("_n"),
        F.sum("_raw").alias("_rows"),
        F.min("_t").alias("_lo"),
        F.max("_t").alias("_hi"),
        F.every(first_day).alias("_starts"),
        F.every(last_day).alias("_ends"),
        F.min(month).alias("_mlo"),
        F.max(month).alias("_mhi"),
        F.every(at_midnight & (F.weekday("_t") < 5)).alias("_weekdays"),
    )
    seconds = F.unix_micros("_hi") - F.unix_micros("_lo")
    gaps = F.col("_n") - 1
    span_m = F.col("_mhi") - F.col("_mlo")
    ends = ends.where("_n >= 3").withColumns(
        {
            "_step_us": F.when(seconds % gaps == 0, F.floor(seconds / gaps)),
            "_step_m": F.when(span_m % gaps == 0, F.floor(span_m / gaps)),
        }
    )
    side = small_side(ends)
    tagged = points.join(side, keys)
    offset = F.unix_micros("_t") - F.unix_micros("_lo")
    even = F.every((F.col("_step_us") > 0) & (offset % F.col("_step_us") == 0))
    even_months = F.every((F.col("_step_m") > 0) & ((month - F.col("_mlo")) % F.col("_step_m") == 0))
    carried = ["_n", "_rows", "_lo", "_hi", "_mlo", "_starts", "_ends", "_weekdays", "_step_us", "_step_m"]
    checked = tagged.groupBy(*groups, *carried).agg(even.alias("_even"), even_months.alias("_even_m"))
    on_months = F.col("_even_m") & (F.col("_starts") | F.col("_ends"))
    business = weekday_number(F.col("_hi")) - weekday_number(F.col("_lo")) + 1
    return checked.withColumn(
        "_kind",
        F.when(on_months & F.col("_starts"), "month_start")
        .when(on_months, "month_end")
        .when(F.col("_even"), "fixed")
        .when(F.col("_weekdays") & (business == F.col("_n")), "business")
        .otherwise("unknown"),
    )


def season_length(kind, step_us, step_m):
    """Periods in a season: monthly 12, quarterly 4, weekly 52, daily 7, yearly and others none."""
    day = 86_400_000_000
    by_months = F.when(step_m % 12 == 0, 0).when(step_m % 3 == 0, 4).otherwise(12)
    fixed = F.when(step_us % (7 * day) == 0, 52).when(step_us % day == 0, 7).otherwise(0)
    return (
        F.when(kind.isin("month_start", "month_end"), by_months)
        .when(kind == "fixed", fixed)
        .when(kind == "business", 7)
        .otherwise(12)
        .cast("int")
    )


def weekday_number(moment):
    """Weekdays before the day of ``moment``, counted from a Monday."""
    days = F.unix_date(F.to_date(moment)) + 3
    return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(5))


def grid_date(end, step):
    """The moment ``step`` positions after ``end`` on a series' grid (columns _kind, _step_us, _step_m)."""
    months = F.add_months(F.to_date(end), (F.coalesce("_step_m", F.lit(1)) * step).cast("int"))
    time_of_day = F.unix_micros(end) - F.unix_micros(F.date_trunc("day", end))
    at_time = F.timestamp_micros(F.unix_micros(months.cast("timestamp")) + time_of_day)
    weekday = weekday_number(end) + step
    business = F.date_from_unix_date((F.floor(weekday / 5) * 7 + weekday % 5 - 3).cast("int")).cast("timestamp")
    single = F.timestamp_micros(F.unix_micros(F.add_months(F.to_date(end), step.cast("int")).cast("timestamp")) + time_of_day)
    return (
        F.when(F.col("_kind") == "month_start", at_time)
        .when(F.col("_kind") == "month_end", F.last_day(months).cast("timestamp"))
        .when(F.col("_kind") == "fixed", F.timestamp_micros(F.unix_micros(end) + F.col("_step_us") * step))
        .when(F.col("_kind") == "business", business)
        .otherwise(single)
    )


def even_series(df: DataFrame, date_col: str, value_col: str, partition_by=()) -> DataFrame:
    """Keys, _t, _v, _filled, _i (position on the grid), season, _kind, _step_us, _step_m of series of six rows and more.

    A series with a spacing holds every moment of its grid already, since the spacing is the mean
    one, so its points are passed on with a position computed from the moment.  Only a series without
    one is read anew, at month starts, and has gaps: as many positions as the calendar has months.
    """
    asked = _keys(partition_by)
    keys = asked or ["_all"]
    groups = [ref(k) for k in keys]
    work = df.select(
        *([ref(k) for k in asked] or [F.lit(0).alias("_all")]),
        coerce_datetime(df, date_col).alias("_t"),
        to_number(ref(value_col), dtype_of(df, value_col)).alias("_x"),
    ).where("_t is not null and _x is not null")
    points = materialize(work.groupBy(*groups, "_t").agg(F.avg("_x").alias("_v"), F.count("*").alias("_raw")))
    kinds = infer_spacing(points, keys).where(F.col("_rows") >= MIN_POINTS)
    season = season_length(F.col("_kind"), F.col("_step_us"), F.col("_step_m")).alias("season")
    kinds = small_side(kinds.select(*groups, "_lo", "_hi", "_mlo", "_kind", "_step_us", "_step_m", season))
    shown = ["season", "_kind", "_step_us", "_step_m"]
    month = F.year("_t") * 12 + F.month("_t")
    position = (
        F.when(F.col("_kind").isin("month_start", "month_end"), F.floor((month - F.col("_mlo")) / F.col("_step_m")))
        .when(F.col("_kind") == "fixed", F.floor((F.unix_micros("_t") - F.unix_micros("_lo")) / F.col("_step_us")))
        .otherwise(weekday_number(F.col("_t")) - weekday_number(F.col("_lo")))
    )
    even = points.join(kinds.where("_kind <> 'unknown'"), keys).select(
        *groups, "_t", "_v", F.col("_v").alias("_filled"), position.cast("long").alias("_i"), *shown
    )
    # month starts at or after the first moment, keeping its time of day
    time_of_day = F.unix_micros("_lo") - F.unix_micros(F.date_trunc("day", F.col("_lo")))
    first_month = F.when(F.dayofmonth("_lo") == 1, F.date_trunc("month", F.col("_lo"))).otherwise(
        F.date_trunc("month", F.col("_lo")) + F.expr("INTERVAL 1 MONTH")
    )
    monthly = F.when(
        first_month <= F.col("_hi"), F.sequence(first_month, F.col("_hi"), F.expr("INTERVAL 1 MONTH"))
    ).otherwise(F.array().cast("array<timestamp>"))
    at_time = F.transform(monthly, lambda d: F.timestamp_micros(F.unix_micros(d) + time_of_day))
    uneven = kinds.where("_kind = 'unknown'").select(*groups, F.explode(at_time).alias("_t"), *shown)
    read = _interpolate(uneven.join(points.drop("_raw"), [*keys, "_t"], "left"), keys)
    read = read.select(*groups, "_t", "_v", "_filled", F.col("_i").cast("long").alias("_i"), *shown)
    return even.unionByName(read).drop(*([] if asked else ["_all"]))


def regularise(df: DataFrame, date_col: str, value_col: str, partition_by=()) -> DataFrame:
    """Evenly spaced series: equal moments averaged, gaps filled linearly.

    The spacing is inferred per series; a series without one is read at month starts.  Series
    with fewer than six rows are left out.  Adds ``season`` for forecasting.
    """
    return even_series(df, date_col, value_col, partition_by).select(
        *[ref(k) for k in _keys(partition_by)], F.col("_t").alias("date"), F.col("_filled").alias("value"), F.col("_v").isNull().alias("is_filled"), "season"
    )


def _interpolate(series: DataFrame, keys: list[str]) -> DataFrame:
    """Linear by position between known values; after the last known value it is repeated."""
    order = _series_window(keys).orderBy("_t")
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    ahead = order.rowsBetween(0, Window.unboundedFollowing)
    placed = series.withColumn("_i", F.row_number().over(order))
    known = F.when(F.col("_v").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("_v").alias("v")))
    placed = placed.withColumn("_b", F.last(known, True).over(back)).withColumn("_a", F.first(known, True).over(ahead))
    before, after = F.col("_b"), F.col("_a")
    slope = F.try_divide(after["v"] - before["v"], (after["i"] - before["i"]).cast("double"))
    between = before["v"] + slope * (F.col("_i") - before["i"])
    filled = F.when(F.col("_v").isNotNull(), F.col("_v")).when(after.isNull(), before["v"]).otherwise(between)
    return placed.withColumn("_filled", filled)
