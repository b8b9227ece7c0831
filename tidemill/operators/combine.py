"""Joining and stacking tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from tidemill.functions.types import (
    FLOATING_TYPES,
    INTEGER_TYPES,
    dtype_of,
    is_numeric,
    ref,
    require_operand,
)
from tidemill.plans.hotkeys import HOT_ROWS, uneven_join
from tidemill.plans.roworder import with_row_index

JOIN_TYPES = ("inner", "left", "right", "outer")


def join_datasets(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, join_type: str = "inner", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Equi-join on one key where missing keys match missing keys.

    A key of the same name appears once; other shared names get ``_left`` / ``_right``.
    """
    if join_type not in JOIN_TYPES:
        raise ValueError(f"join_type must be one of {JOIN_TYPES}, got '{join_type}'")
    require_operand(left, left_key)
    require_operand(right, right_key)
    if is_numeric(dtype_of(left, left_key)) != is_numeric(dtype_of(right, right_key)):
        raise ValueError(f"cannot join '{left_key}' with '{right_key}': one is numeric, the other is not")
    same = left_key == right_key
    shared = set(left.columns) & set(right.columns) - ({left_key} if same else set())
    # positions keep the two sides apart whatever their column names are
    l_names = [f"_l{i}" for i in range(len(left.columns))]
    r_names = [f"_r{i}" for i in range(len(right.columns))]
    lk = l_names[left.columns.index(left_key)]
    rk = r_names[right.columns.index(right_key)]
    how = "full" if join_type == "outer" else join_type
    joined = uneven_join(left.toDF(*l_names), right.toDF(*r_names), lk, rk, how, hot_rows)
    out = []
    for name, c in zip(l_names, left.columns):
        if same and c == left_key:
            key = {"inner": F.col(lk), "left": F.col(lk), "right": F.col(rk), "full": F.coalesce(lk, rk)}[how]
            out.append(key.alias(c))
        else:
            out.append(F.col(name).alias(f"{c}_left" if c in shared else c))
    for name, c in zip(r_names, right.columns):
        if not (same and c == right_key):
            out.append(F.col(name).alias(f"{c}_right" if c in shared else c))
    return joined.select(*out)


def _common_type(kinds: list[T.DataType]) -> T.DataType:
    """The type that holds every kind: equal, wider number, timestamp, or text."""
    if len({k.simpleString() for k in kinds}) == 1:
        return kinds[0]
    if all(isinstance(k, INTEGER_TYPES) for k in kinds):
        return T.LongType()
    if all(isinstance(k, INTEGER_TYPES + FLOATING_TYPES + (T.DecimalType,)) for k in kinds):
        return T.DoubleType()
    if all(isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)) for k in kinds):
        return T.TimestampType()
    return T.StringType()


def concat_vertical(frames: list[DataFrame]) -> DataFrame | None:
    """Stack rows by column name; absent columns are NULL, clashing types widen."""
    if not frames:
        return None
    kinds: dict[str, list] = {}
    for frame in frames:
        for field in frame.schema:
            kinds.setdefault(field.name, []).append(field.dataType)
    target = {c: _common_type(k) for c, k in kinds.items()}
    aligned = [
        frame.select(*[ref(f.name) if f.dataType == target[f.name] else ref(f.name).cast(target[f.name]).alias(f.name) for f in frame.schema])
        for frame in frames
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def concat_horizontal(frames: list[DataFrame], order_by: list, reset_names: bool = False) -> DataFrame | None:
    """Put tables side by side by row position; ``order_by[i]`` defines the rows of frame i."""
    if not frames:
        return None
    if len(order_by) != len(frames):
        raise ValueError("order_by needs one ordering per frame")
    used: dict[str, int] = {}
    indexed = []
    for n, (frame, order) in enumerate(zip(frames, order_by)):
        positioned = with_row_index(frame, order, "_position")
        names = []
        for c in frame.columns:
            used[c] = used.get(c, 0) + 1
            names.append(c if used[c] == 1 else f"{c}_{used[c]}")
        indexed.append(positioned.toDF(*names, "_position"))
    # positions are unique on both sides, so no key of this join can be heavy
    wide = reduce(lambda a, b: a.join(b, "_position", "full"), indexed).drop("_position")
    return wide.toDF(*[str(i) for i in range(len(wide.columns))]) if reset_names else wide


def concat_datasets(frames: list[DataFrame], axis: int = 0, order_by: list | None = None, reset_names: bool = False):
    if axis == 0:
        return concat_vertical(frames)
    return concat_horizontal(frames, order_by or [], reset_names)
