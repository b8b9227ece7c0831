"""Moments of all column pairs from one scan, for tables with many columns.

One aggregate per pair makes a plan that grows with the square of the number of columns.  Here every
task multiplies its batches of rows as matrices and emits one row of arrays per column; those are
merged in two rounds, the tasks of a stretch first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.plans.session import ship_package

#: Up to this many columns one built-in aggregate per pair is used, beyond it the matrices; results are equal.
BUILT_IN_COLUMNS = 24
#: Tasks merged at once in the first round.
STRETCH = 256

_FIELDS = ("n", "mean_i", "mean_j", "m2_i", "m2_j", "c", "odd")
_SCHEMA = "i int, part int, " + ", ".join(f"{f} array<double>" for f in _FIELDS)


def _settled(m2: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Variation within rounding of the shifted squares is none."""
    return np.where(m2 <= 1e-13 * squares, 0.0, m2)


def _task(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    shift, known = np.zeros(width), np.zeros(width, bool)
    n, sums, squares, products, odd = (np.zeros((width, width)) for _ in range(5))
    for batch in batches:
        if not batch.num_rows:
            continue
        valid = np.stack([pc.is_valid(c).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        x = np.stack([pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        finite = np.isfinite(x)
        for i in np.flatnonzero(~known):
            seen = x[valid[:, i] & finite[:, i], i]
            if len(seen):
                # a value of the column, so that a constant column is shifted to zeros exactly
                shift[i], known[i] = np.partition(seen, len(seen) // 2)[len(seen) // 2], True
        x = np.where(valid & finite, x - shift, 0.0)
        mask = valid.astype(np.float64)
        n += mask.T @ mask
        sums += x.T @ mask
        squares += (x * x).T @ mask
        products += x.T @ x
        if not finite.all():
            odd += (valid & ~finite).astype(np.float64).T @ mask
    count = np.maximum(n, 1.0)
    mean = shift[:, None] + sums / count
    m2 = _settled(squares - sums * sums / count, squares)
    table = {"n": n, "mean_i": mean, "mean_j": mean.T, "m2_i": m2, "m2_j": m2.T, "c": products - sums * sums.T / count, "odd": odd + odd.T}
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, part, np.int32)),
         *[pa.array([row[i:] for i, row in enumerate(table[f])], pa.list_(pa.float64())) for f in _FIELDS]],
        names=["i", "part", *_FIELDS],
    )


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Moments of the union of the rows' parts."""
    rows = rows.sort_values("part")
    each = {f: np.stack(rows[f].to_list()) for f in _FIELDS}
    n = each["n"].sum(axis=0)
    out = {"n": n, "odd": each["odd"].sum(axis=0)}
    away = {}
    filled = each["n"] > 0
    for side in ("i", "j"):
        mean = each[f"mean_{side}"]
        base = mean[filled.argmax(axis=0), np.arange(mean.shape[1])]
        off = np.where(filled, mean - base, 0.0)
        middle = (each["n"] * off).sum(axis=0) / np.maximum(n, 1.0)
        out[f"mean_{side}"] = base + middle
        away[side] = np.where(filled, off - middle, 0.0)
        out[f"m2_{side}"] = each[f"m2_{side}"].sum(axis=0) + (each["n"] * away[side] ** 2).sum(axis=0)
    out["c"] = each["c"].sum(axis=0) + (each["n"] * away["i"] * away["j"]).sum(axis=0)
    return pd.DataFrame({"i": [rows["i"].iloc[0]], "part": [rows["part"].iloc[0]], **{f: [out[f]] for f in _FIELDS}})


def pair_moments(df: DataFrame, values: list[Column]) -> DataFrame:
    """(i, j, n, mean_i, mean_j, m2_i, m2_j, c, odd) for i <= j over the rows where both values are filled.

    ``m2`` and ``c`` are sums of squares and of products about the means; ``odd`` is positive where
    NaN or an infinite value was met, and the other figures leave such values out.  A task's row for
    a column holds as many numbers as there are columns, whatever its rows.
    """
    width = len(values)
    ship_package(df.sparkSession)
    rows = df.select(*[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    each = rows.mapInArrow(lambda it: _task(it, width), _SCHEMA)
    near = each.groupBy("i", F.floor(F.col("part") / STRETCH)).applyInPandas(_merge, _SCHEMA)
    whole = near.groupBy("i").applyInPandas(_merge, _SCHEMA)
    return whole.select("i", F.posexplode(F.arrays_zip(*_FIELDS)).alias("at", "m")).select(
        "i", (F.col("i") + F.col("at")).alias("j"), "m.*"
    )


def pair_correlation() -> Column:
    """Pearson r of a row of ``pair_moments``; NULL when either side does not vary."""
    spread = F.sqrt("m2_i") * F.sqrt("m2_j")
    return F.when((F.col("n") > 0) & (F.col("odd") > 0), F.lit(float("nan"))).otherwise(
        F.try_divide("c", F.nullif(spread, F.lit(0.0)))
    )
