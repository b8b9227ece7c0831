"""Run a registered query next to its SQL form and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd


def connect(folder: str):
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if value is None or value is pd.NA:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and math.isnan(value):
        return None
    if value is pd.NaT:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return 0.0 if value == 0 else float(value)
    return str(value)


def bag(frame):
    frame = frame[sorted(frame.columns)]
    columns = [[canonical(v) for v in frame[c].astype(object)] for c in frame.columns]
    return Counter(zip(*columns)) if columns else Counter()


def compare(spark_frame, sql_frame) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} vs {len(sql_frame)}"
    a, b = bag(spark_frame), bag(sql_frame)
    if a != b:
        return f"only spark {list((a - b).items())[:2]} only sql {list((b - a).items())[:2]} ({sum((a - b).values())} rows)"
    kinds = {
        c: (spark_frame[c].dtype.kind, sql_frame[c].dtype.kind)
        for c in spark_frame.columns
        if spark_frame[c].dtype.kind != sql_frame[c].dtype.kind and not spark_frame[c].isna().any()
    }
    return f"kinds {kinds}" if kinds and len(spark_frame) else None
