"""The cleaning steps that look at one row at a time, applied to a streaming table unchanged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from tidemill.functions.types import is_numeric
from tidemill.operators.validate import tag_violations
from tidemill.plans.steps import OPERATORS

ROWWISE = (
    "drop_columns", "rename_columns", "add_calculated_column", "filter_values", "drop_missing_rows",
    "merge_columns", "standardize_text", "string_operations", "mask_column",
)


def _is_rowwise(df: DataFrame, name: str, options: dict) -> bool:
    if name == "flag_missing":  # without columns it looks for those with a missing value
        return options.get("columns") is not None
    if name == "extract_date_parts":  # numbers are years only if the whole column is
        return not is_numeric(df.schema[options["column"]].dataType)
    return name in ROWWISE


def apply_rowwise(stream: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Steps that need bounds, groups or row order are refused: a stream has no whole table.

    ``flag_missing`` needs its columns, ``extract_date_parts`` a column that is not a number.
    """

    def applied(df: DataFrame, step: tuple[str, dict]) -> DataFrame:
        name, options = step
        if not _is_rowwise(df, name, options):
            raise ValueError(f"not row-wise: {name}")
        return OPERATORS[name](df, **options)

    return reduce(applied, steps, stream)


def tag_stream(stream: DataFrame, rules: list[dict]) -> DataFrame:
    """Tag each arriving row with the row-wise validation rules it violates."""
    return tag_violations(stream, rules)
