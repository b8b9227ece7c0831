"""Column classes: which columns count as numeric, text or date-like."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F, types as T

DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING_TYPES = (T.FloatType, T.DoubleType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def dtype_of(df: DataFrame, column: str) -> T.DataType:
    require_columns(df, [column])
    return df.schema[column].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATETIME_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def flat_columns(df: DataFrame) -> list[str]:
    """Columns whose values can be compared and grouped (no arrays, maps or structs)."""
    return [f.name for f in df.schema if not isinstance(f.dataType, NESTED_TYPES)]


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no such column: {', '.join(missing)}")


def require_operand(df: DataFrame, column: str) -> None:
    """Nested columns pass through tables untouched but are not operands."""
    if isinstance(dtype_of(df, column), NESTED_TYPES):
        raise TypeError(f"column '{column}' is nested and cannot be used here")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ref(name: str):
    """Reference a column by exact name, dots and spaces included."""
    return F.col(quoted(name))


def double_sql(value: float) -> str:
    """A double as SQL text, exactly."""
    value = float(value)
    return f"({value!r}D)" if math.isfinite(value) else f"double('{value}')"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values are one concept: float NaN becomes NULL."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, FLOATING_TYPES)}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(ref(c)), ref(c)).alias(c) if c in floats else ref(c)
            for c in df.columns
        ]
    )


DIGEST_LENGTH = 64


def grouping_key(df: DataFrame, column: str):
    """A stand-in with the same equality as the column, for grouping and matching only.

    Long texts are replaced by their SHA-256 digest, so whole documents are not shuffled just
    to be compared; shorter texts stay below the digest's length and cannot be mistaken for one.
    -0.0 and 0.0 are one value.
    """
    value, dtype = ref(column), df.schema[column].dataType
    if is_text(dtype):
        return F.when(F.length(value) >= DIGEST_LENGTH, F.sha2(value, 256)).otherwise(value)
    if isinstance(dtype, FLOATING_TYPES):
        return value + F.lit(0.0).cast(dtype)
    return value
