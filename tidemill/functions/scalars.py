"""Scalar expressions whose defaults in Spark differ from the table semantics we follow."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tidemill.functions.types import is_datetime, is_numeric, is_text

NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
BLANK_EDGES = r"(?U)^\s+|\s+$"
BLANK_RUN = r"(?U)\s+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, BLANK_EDGES, "")


def collapse_blanks(text: Column) -> Column:
    # after this every blank is a plain space, so the cheap trim is enough
    return F.trim(F.regexp_replace(text, BLANK_RUN, " "))


def title_case(text: Column) -> Column:
    """Capitalise every run of letters, not only those after a blank."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def finite(number: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def to_number(column: Column, dtype: T.DataType) -> Column:
    """Coerce to double; text that is not a plain number becomes NULL."""
    if is_text(dtype):
        trimmed = strip(column)
        return finite(F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double")))
    if is_numeric(dtype):
        return finite(column.cast("double"))
    if isinstance(dtype, T.BooleanType):
        return column.cast("double")
    return F.lit(None).cast("double")


def to_datetime(column: Column, dtype: T.DataType, years: bool | None = None) -> Column:
    """Coerce to timestamp; ``years`` says that numbers are calendar years."""
    if is_datetime(dtype):
        return column.cast("timestamp")
    if is_numeric(dtype):
        if years:
            return F.make_date(column.cast("int"), F.lit(1), F.lit(1)).cast("timestamp")
        return F.timestamp_micros(F.floor(column.cast("double") / 1000))
    return F.try_to_timestamp(column.cast("string"))


def floor_div(left: Column, right: Column) -> Column:
    return F.floor(F.try_divide(left.cast("double"), right.cast("double"))).cast("double")


def floor_mod(left: Column, right: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return left - right * floor_div(left, right)


def share_pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole`` in percent, 0 for an empty whole."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.coalesce(F.round(ratio * 100, digits), F.lit(0.0))


def change_pct(current: Column, previous: Column, digits: int = 2) -> Column:
    """Relative change in percent, NULL without a usable previous value."""
    return F.round((F.try_divide(current.cast("double"), previous.cast("double")) - 1) * 100, digits)


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pairwise-complete Pearson r; NULL when either side does not vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.try_divide(F.covar_pop(a, b), F.nullif(spread, F.lit(0.0)))


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness: NULL below 3 values, 0 for a constant."""
    n = F.count(x).cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n < 3, None).when(F.stddev_pop(x) == 0, 0.0).otherwise(F.skewness(x) * factor)


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis: NULL below 4 values, 0 for a constant."""
    n = F.count(x).cast("double")
    value = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when(n < 4, None).when(F.stddev_pop(x) == 0, 0.0).otherwise(value)


def full_sum(x: Column) -> Column:
    """Sum that is 0, not NULL, over nothing."""
    return F.coalesce(F.sum(x), F.lit(0))


def number_like(column: Column) -> Column:
    """True for text that reads as a number."""
    return F.coalesce(strip(column).rlike(NUMBER_PATTERN), F.lit(False))
