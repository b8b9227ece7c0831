"""Cleaning: projection, missing values, outliers, duplicates, text and types."""

from __future__ import annotations

import math
import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemill.functions.expressions import arithmetic_text, column_expression
from tidemill.functions.scalars import collapse_blanks, strip, title_case, to_datetime, to_number
from tidemill.functions.types import dtype_of, grouping_key, is_numeric, is_text, ref, require_columns, require_operand
from tidemill.plans.quantiles import column_quantiles, fences
from tidemill.plans.roworder import carry_fill

MAX_NEW_COLUMNS = 1_000
MAX_PATTERN_LENGTH = 200


def _replace(df: DataFrame, column: str, value) -> DataFrame:
    return df.select(*[value.alias(c) if c == column else ref(c) for c in df.columns])


# -- projection and filters ---------------------------------------------------------------


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    require_columns(df, columns)
    return df.select(*[ref(c) for c in df.columns if c not in set(columns)])


def rename_columns(df: DataFrame, rename_map: dict[str, str]) -> DataFrame:
    """Names that are not in the frame are ignored."""
    return df.withColumnsRenamed(rename_map)


def add_calculated_column(df: DataFrame, name: str, expression: str) -> DataFrame:
    return df.withColumn(name, column_expression(expression, df.columns))


def add_arithmetic_column(df, name, left, operator, right, right_is_column=True) -> DataFrame:
    """The guided form: one operator between a column and a column or constant."""
    if operator not in ("+", "-", "*", "/"):
        raise ValueError(f"operator must be one of + - * /, got '{operator}'")
    return add_calculated_column(df, name, arithmetic_text(left, operator, right, right_is_column))


def filter_values(df: DataFrame, choices: dict[str, list]) -> DataFrame:
    """Keep rows whose value is among the chosen ones in every column; no choice, no filter."""
    tests = [ref(c).isin(values) for c, values in choices.items() if values]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def preview(df: DataFrame, n: int = 10, order_by=None) -> DataFrame:
    """First ``n`` rows in the given order; any ``n`` rows without one."""
    if order_by is None:
        return df.limit(n)
    columns = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*[ref(c) for c in columns]).limit(n)


# -- missing values -----------------------------------------------------------------------


def drop_missing_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    require_columns(df, columns)
    return df.dropna("any", subset=list(columns))


def most_frequent(df: DataFrame, column: str):
    """The most frequent non-null value, the smallest among ties; None without values."""
    row = (
        df.where(ref(column).isNotNull())
        .groupBy(ref(column).alias("v"))
        .count()
        .orderBy(F.desc("count"), "v")
        .limit(1)
        .first()
    )
    return None if row is None else row["v"]


def fill_missing(
    df: DataFrame, column: str, strategy: str = "mean", order_by=None, partition_by=()
) -> DataFrame:
    """Fill NULLs with mean, median, mode or zero, or carry values forward / backward."""
    require_operand(df, column)
    if strategy in ("forward", "backward"):
        if order_by is None:
            raise ValueError("carrying values needs order_by")
        return carry_fill(df, column, order_by, partition_by, backward=strategy == "backward")
    if strategy == "mean":
        value = df.agg(F.avg(ref(column)).alias("v")).first()["v"]
    elif strategy == "median":
        value = column_quantiles(df, {column: [0.5]})[column][0]
    elif strategy == "mode":
        value = most_frequent(df, column)
        value = 0 if value is None else value
    elif strategy == "zero":
        value = 0
    else:
        raise ValueError(f"unknown fill strategy: {strategy}")
    if value is None:
        return df
    filler = F.lit(value)
    if not (isinstance(value, float) and is_numeric(dtype_of(df, column))):
        filler = filler.cast(dtype_of(df, column))
    return _replace(df, column, F.coalesce(ref(column), filler))


def columns_with_missing(df: DataFrame) -> list[str]:
    counts = df.agg(*[F.count_if(ref(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if counts[f"n{i}"] > 0]


def flag_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add ``{column}_is_missing``; without a list, for every column that has a NULL."""
    columns = columns_with_missing(df) if columns is None else columns
    require_columns(df, columns)
    return df.withColumns({f"{c}_is_missing": ref(c).isNull() for c in columns})


# -- outliers -----------------------------------------------------------------------------


def remove_outliers_iqr(df: DataFrame, column: str, multiplier: float = 1.5) -> DataFrame:
    """Keep values inside the fences; rows without a value do not qualify."""
    require_operand(df, column)
    _, _, lower, upper = fences(df, [column], multiplier)[column]
    if lower is None:
        return df.limit(0)
    return df.where(ref(column).between(lower, upper))


def outlier_rows(df: DataFrame, column: str, multiplier: float = 1.5, limit: int = 20, order_by=None) -> DataFrame:
    """A look at the rows ``remove_outliers_iqr`` would call outliers."""
    _, _, lower, upper = fences(df, [column], multiplier)[column]
    if lower is None:
        return df.limit(0)
    return preview(df.where((ref(column) < lower) | (ref(column) > upper)), limit, order_by)


def cap_bounds(df: DataFrame, column: str, method: str = "iqr", multiplier: float = 1.5):
    if method == "iqr":
        return fences(df, [column], multiplier)[column][2:]
    return tuple(column_quantiles(df, {column: [0.01, 0.99]})[column])


def cap_outliers(
    df: DataFrame, column: str, method: str = "iqr", multiplier: float = 1.5, bounds: tuple | None = None
) -> DataFrame:
    """Clip to the IQR fences, or to the 1st / 99th percentile for any other method.

    ``bounds`` from ``cap_bounds`` spare computing them again.
    """
    require_operand(df, column)
    lower, upper = bounds or cap_bounds(df, column, method, multiplier)
    if lower is None:
        return df
    x = ref(column)
    return _replace(df, column, F.when(x < lower, F.lit(lower)).when(x > upper, F.lit(upper)).otherwise(x))


# -- duplicates ---------------------------------------------------------------------------


def remove_duplicates(df: DataFrame, keep="first") -> DataFrame:
    """Whole-row duplicates: keep one of each, or with ``keep=False`` none of them."""
    if keep in ("first", "last"):
        return df.dropDuplicates()
    if keep is not False:
        raise ValueError("keep must be 'first', 'last' or False")
    return duplicate_groups(df).where(F.col("copies") == 1).drop("copies")


def duplicate_groups(df: DataFrame) -> DataFrame:
    """One row per distinct row with its number of ``copies`` (combined before the shuffle)."""
    return df.groupBy(*[ref(c) for c in df.columns]).agg(F.count("*").alias("copies"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """``duplicate_rows``: rows beyond the first of each group of equal rows."""
    keys = df.select(*[grouping_key(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)])
    return duplicate_groups(keys).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))


def duplicate_rows(df: DataFrame, limit: int = 20) -> DataFrame:
    """Preview of rows having copies, every copy shown."""
    repeated = duplicate_groups(df).where(F.col("copies") > 1)
    ordered = repeated.orderBy(*[ref(c) for c in df.columns]).limit(limit)
    shown = F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(limit)).cast("int"))
    return ordered.withColumn("_copy", F.explode(shown)).drop("copies", "_copy").limit(limit)


# -- text and types -----------------------------------------------------------------------


def split_column(
    df: DataFrame, column: str, delimiter: str = ",", names: list[str] | None = None, max_columns: int | None = MAX_NEW_COLUMNS
) -> DataFrame:
    """Split text into as many columns as the longest row needs; an error beyond ``max_columns`` unless None."""
    require_operand(df, column)
    pattern = re.escape(delimiter) if len(delimiter) == 1 else delimiter
    parts = F.split(ref(column).cast("string"), pattern)
    width = df.agg(F.max(F.size(parts)).alias("n")).first()["n"]
    width = max(width or 0, 0)
    if max_columns is not None and width > max_columns:
        raise ValueError(f"splitting '{column}' would add {width} columns (limit {max_columns})")
    if not names or len(names) < width:
        names = [f"{column}_part{i + 1}" for i in range(width)]
    return df.withColumns({names[i]: strip(F.get(parts, F.lit(i))) for i in range(width)})


def merge_columns(df: DataFrame, columns: list[str], name: str, separator: str = " ") -> DataFrame:
    """Join the text of several columns; missing values are left out."""
    require_columns(df, columns)
    return df.withColumn(name, F.concat_ws(separator, *[ref(c).cast("string") for c in columns]))


_TEXT_METHODS = {
    "lowercase": F.lower,
    "uppercase": F.upper,
    "titlecase": title_case,
    "strip": strip,
    "strip_all": collapse_blanks,
}


def standardize_text(df: DataFrame, column: str, method: str = "lowercase") -> DataFrame:
    require_operand(df, column)
    if method not in _TEXT_METHODS:
        return df
    return _replace(df, column, _TEXT_METHODS[method](ref(column).cast("string")))


def usable_pattern(pattern: str | None) -> bool:
    if not pattern or len(pattern) > MAX_PATTERN_LENGTH:
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine that runs patterns accepts this one; its syntax is not Python's."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Py4JJavaError:
        return False
    return True


def string_operations(df: DataFrame, column: str, operation: str, pattern: str | None = None) -> DataFrame:
    """lowercase / uppercase / trim in place, or ``extract_regex`` into ``{column}_extracted``."""
    require_operand(df, column)
    text = ref(column).cast("string")
    simple = {"lowercase": "lowercase", "uppercase": "uppercase", "trim": "strip"}
    if operation in simple:
        return standardize_text(df, column, simple[operation])
    if operation != "extract_regex" or not usable_pattern(pattern) or not compiles(df.sparkSession, pattern):
        return df
    found = F.regexp_extract(text, pattern, 0)
    return df.withColumn(f"{column}_extracted", F.when(text.rlike(pattern), found))


def convert_column_type(df: DataFrame, column: str, target: str) -> DataFrame:
    """numeric / float / integer / text / datetime; values that cannot convert become NULL."""
    require_operand(df, column)
    dtype = dtype_of(df, column)
    if target == "text":
        return _replace(df, column, ref(column).cast("string"))
    if target == "datetime":
        return _replace(df, column, coerce_datetime(df, column))
    if target not in ("numeric", "float", "integer"):
        return df
    integral = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if target in ("numeric", "integer") and integral:
        return _replace(df, column, ref(column).cast("long")) if target == "integer" else df
    number = to_number(ref(column), dtype)
    if target == "integer":
        fractions = df.agg(F.count_if(number != F.floor(number)).alias("n")).first()["n"]
        if fractions:
            raise ValueError(f"'{column}' has {fractions} values with a fraction")
        number = number.cast("long")
    return _replace(df, column, number)


# -- dates --------------------------------------------------------------------------------


def looks_like_years(df: DataFrame, columns: list[str]) -> dict[str, bool]:
    """Which numeric columns hold only 4-digit values (one aggregation for all of them)."""
    numeric = [c for c in columns if is_numeric(dtype_of(df, c))]
    if not numeric:
        return {}
    row = df.agg(
        *[F.min(ref(c)).alias(f"lo{i}") for i, c in enumerate(numeric)],
        *[F.max(ref(c)).alias(f"hi{i}") for i, c in enumerate(numeric)],
    ).first()
    return {
        c: row[f"lo{i}"] is not None and row[f"lo{i}"] >= 1000 and row[f"hi{i}"] <= 9999
        for i, c in enumerate(numeric)
    }


def coerce_datetime(df: DataFrame, column: str):
    """The column as a timestamp; numbers that all look like years mean 1 January."""
    dtype = dtype_of(df, column)
    years = looks_like_years(df, [column]).get(column) if is_numeric(dtype) else None
    return to_datetime(ref(column), dtype, years)


# Name parts that mark a column as date-like.
DATE_WORDS = ("date", "year", "month", "time", "period", "day")


def detect_date_columns(df: DataFrame) -> DataFrame:
    """Columns that are datetimes, date-like by name, or hold only 4-digit numbers."""
    reasons, unnamed = {}, []
    for field in df.schema:
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            reasons[field.name] = "datetime type"
        elif any(word in field.name.lower() for word in DATE_WORDS):
            reasons[field.name] = "name"
        elif is_numeric(field.dataType):
            unnamed.append(field.name)
    for c, is_year in looks_like_years(df, unnamed).items():
        if is_year:
            reasons[c] = "4-digit values"
    rows = [(i, c, reasons[c]) for i, c in enumerate(df.columns) if c in reasons]
    return df.sparkSession.createDataFrame(rows, "position int, column string, reason string")


def text_date_columns(df: DataFrame) -> DataFrame:
    """Share of non-null text that parses as a date; above one half the column qualifies."""
    texts = [f.name for f in df.schema if is_text(f.dataType)]
    schema = "column string, parsed_share double, is_date boolean"
    if not texts:
        return df.sparkSession.createDataFrame([], schema)
    share = {
        c: F.avg(F.when(ref(c).isNotNull(), F.try_to_timestamp(ref(c)).isNotNull().cast("double")))
        for c in texts
    }
    wide = df.agg(*[F.coalesce(share[c], F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(texts)])
    items = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("parsed_share")) for i, c in enumerate(texts)]
    return wide.select(F.inline(F.array(*items))).withColumn("is_date", F.col("parsed_share") > 0.5)


def extract_date_parts(df: DataFrame, column: str) -> DataFrame:
    moment = coerce_datetime(df, column)
    return df.withColumns(
        {
            f"{column}_year": F.year(moment),
            f"{column}_month": F.month(moment),
            f"{column}_day": F.dayofmonth(moment),
            f"{column}_weekday": F.date_format(moment, "EEEE"),
        }
    )


# -- encoding -----------------------------------------------------------------------------


def bin_edges(low: float, high: float, n_bins: int) -> list[float]:
    """Equal-width edges; the lowest is moved down by 0.1 % of the range so it is included."""
    if low == high:
        margin = 0.001 * abs(low) if low != 0 else 0.001
        low, high = low - margin, high + margin
        return [low + i * ((high - low) / n_bins) for i in range(n_bins)] + [high]
    width = (high - low) / n_bins
    edges = [low + i * width for i in range(n_bins)] + [high]
    edges[0] = low - 0.001 * (high - low)
    return edges


def _rounded_edge(x: float, precision: int) -> float:
    """Round to ``precision`` decimals, or significant decimals for values below one."""
    if x == 0 or not math.isfinite(x):
        return x
    digits = precision if math.trunc(x) else precision - 1 - math.floor(math.log10(abs(x)))
    return round(x, digits)


def _interval_labels(edges: list[float]) -> list[str]:
    for precision in range(3, 20):
        rounded = [_rounded_edge(e, precision) for e in edges]
        if len(set(rounded)) == len(rounded):
            break
    return [f"({a}, {b}]" for a, b in zip(rounded, rounded[1:])]


def bin_numeric(df: DataFrame, column: str, n_bins: int = 5, labels: list[str] | None = None) -> DataFrame:
    """Right-closed equal-width bins in ``{column}_binned``; wrong-length labels are ignored."""
    require_operand(df, column)
    row = df.agg(F.min(ref(column)).cast("double").alias("lo"), F.max(ref(column)).cast("double").alias("hi")).first()
    name = f"{column}_binned"
    if row["lo"] is None:
        return df.withColumn(name, F.lit(None).cast("string"))
    edges = bin_edges(row["lo"], row["hi"], n_bins)
    if not labels or len(labels) != n_bins:
        labels = _interval_labels(edges)
    x = ref(column)
    label = F.lit(labels[-1])
    for i in range(n_bins - 2, -1, -1):
        label = F.when(x <= edges[i + 1], labels[i]).otherwise(label)
    return df.withColumn(name, F.when(x.isNotNull(), label))


def distinct_levels(df: DataFrame, column: str, limit: int | None = 20) -> DataFrame:
    """The first non-null distinct values in value order; None for all."""
    levels = df.where(ref(column).isNotNull()).select(ref(column)).distinct().orderBy(ref(column))
    return levels if limit is None else levels.limit(limit)


def one_hot_encode(
    df: DataFrame, column: str, drop_original: bool = False, max_columns: int | None = MAX_NEW_COLUMNS
) -> DataFrame:
    """A 0/1 column ``{column}_{value}`` per distinct value, in value order.

    More than ``max_columns`` values are an error; None lifts the limit.
    """
    require_operand(df, column)
    levels = [r[0] for r in distinct_levels(df, column, None if max_columns is None else max_columns + 1).collect()]
    if max_columns is not None and len(levels) > max_columns:
        raise ValueError(f"'{column}' has more than {max_columns} distinct values")
    encoded = df.withColumns({f"{column}_{v}": F.when(ref(column) == v, 1).otherwise(0) for v in levels})
    return drop_columns(encoded, [column]) if drop_original else encoded


def melt(df: DataFrame, ids: list[str], values: list[str], variable: str = "Series", value: str = "Value") -> DataFrame:
    """Wide to long: one row per id and value column."""
    require_columns(df, [*ids, *values])
    return df.unpivot([ref(c) for c in ids], [ref(c).cast("double").alias(c) for c in values], variable, value)

