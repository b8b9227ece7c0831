"""Cleaning as a list of steps with a log of affected rows.

A step is ``(action, operator name, arguments)``.  Undo is dropping the last step, reset is the
input frame: both are free because frames are immutable.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tidemill.functions.types import ref
from tidemill.operators import clean, privacy
from tidemill.operators.clean import cap_bounds
from tidemill.plans.session import materialize

LOG_SCHEMA = "step int, action string, rows_affected long, timestamp timestamp"

OPERATORS = {
    name: getattr(clean, name)
    for name in (
        "drop_columns", "rename_columns", "add_calculated_column", "filter_values", "drop_missing_rows",
        "fill_missing", "flag_missing", "remove_outliers_iqr", "cap_outliers", "remove_duplicates",
        "split_column", "merge_columns", "standardize_text", "string_operations", "convert_column_type",
        "extract_date_parts", "bin_numeric", "one_hot_encode",
    )
} | {"mask_column": privacy.mask_column}

# steps whose effect is the number of rows they remove
_REMOVING = {"drop_missing_rows", "remove_outliers_iqr", "remove_duplicates", "filter_values"}
# steps that move the whole table; their result is kept so that later bounds passes do not repeat them
_SHUFFLING = {"remove_duplicates"}
# steps that touch every row
_ALL_ROWS = {"add_calculated_column", "merge_columns", "one_hot_encode"}
# steps that touch no row
_NO_ROWS = {"drop_columns", "rename_columns"}


def _resolved(df: DataFrame, name: str, arguments: dict) -> dict:
    """Arguments with what both the step and its count need, computed once."""
    if name == "flag_missing" and arguments.get("columns") is None:
        return {"columns": clean.columns_with_missing(df)}
    if name == "cap_outliers":
        return {"column": arguments["column"], "bounds": cap_bounds(df, **arguments)}
    return arguments


def _affected(df: DataFrame, name: str, arguments: dict) -> Column | None:
    """Count over the step's input of the rows (or cells) it affects; None for removing steps."""
    nothing = F.count_if(F.lit(False))
    if name in _REMOVING:
        return None
    if name in _NO_ROWS:
        return nothing
    if name in _ALL_ROWS:
        return F.count(F.lit(1))
    if name == "flag_missing":
        return sum((F.count_if(ref(c).isNull()) for c in arguments["columns"]), nothing)
    x = ref(arguments["column"])
    if name == "fill_missing":
        return F.count_if(x.isNull())
    if name == "cap_outliers":
        low, high = arguments["bounds"]
        return nothing if low is None else F.count_if((x < low) | (x > high))
    if name == "extract_date_parts":
        return F.count(clean.coerce_datetime(df, arguments["column"]))
    if name == "string_operations" and arguments.get("operation") == "extract_regex":
        pattern = arguments.get("pattern")
        return F.count_if(x.cast("string").rlike(pattern)) if clean.usable_pattern(pattern) else nothing
    return F.count(x)


def run_steps(df: DataFrame, steps: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """Apply the steps in order and return the cleaned table with its log.

    The counts ride along with the runs that produce the table; nothing is scanned for them.
    """
    observed = []
    for i, (action, name, arguments) in enumerate(steps):
        if name not in OPERATORS:
            raise ValueError(f"unknown step: {name}")
        arguments = _resolved(df, name, arguments)
        affected = _affected(df, name, arguments)
        before, later = Observation(f"before_{i}"), None
        measure = F.count(F.lit(1)) if affected is None else affected
        result = OPERATORS[name](df.observe(before, measure.alias("n")), **arguments)
        if affected is None:
            later = Observation(f"after_{i}")
            result = result.observe(later, F.count(F.lit(1)).alias("n"))
        observed.append((action, before, later))
        df = materialize(result) if name in _SHUFFLING else result
    df = materialize(df)
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    rows = []
    for i, (action, before, later) in enumerate(observed):
        n = before.get["n"]
        rows.append((i + 1, action, n if later is None else n - later.get["n"], now))
    return df, df.sparkSession.createDataFrame(rows, LOG_SCHEMA)


def undo(steps: list[tuple]) -> list[tuple]:
    return steps[:-1]
