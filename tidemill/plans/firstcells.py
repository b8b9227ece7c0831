"""The first filled cells of every column from one scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemill.functions.types import ref
from tidemill.plans.session import ship_package

_PLAIN = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.BinaryType)


def _plain(kind: T.DataType) -> bool:
    """Whether Arrow orders the type as Spark does."""
    return isinstance(kind, _PLAIN) or kind == T.StringType()


def _key(column: Column, kind: T.DataType) -> list[Column]:
    """Null first, NaN last, as Spark sorts: a rank of the kind of value, then the value."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        rank = F.when(column.isNull(), 0).when(F.isnan(column), 2).otherwise(1)
        return [rank, F.when(rank == 1, column)]
    return [F.when(column.isNull(), 0).otherwise(1), column.cast("int") if isinstance(kind, T.BooleanType) else column]


def _pick(table: pa.Table, n: int, width: int, keys: list[str]) -> pa.Table:
    """The rows that hold one of the first ``n`` filled cells of a column."""
    order = (
        pc.sort_indices(table, sort_keys=[(k, "ascending") for k in keys]).to_numpy() if keys else np.arange(table.num_rows)
    )
    wanted = [np.empty(0, np.int64)]
    for i in range(width):
        filled = pc.is_valid(table.column(i)).to_numpy(zero_copy_only=False)[order]
        wanted.append(order[np.flatnonzero(filled)[:n]])
    return table.take(pa.array(np.unique(np.concatenate(wanted)).astype(np.int64)))


def _first_rows(batches: Iterator[pa.RecordBatch], n: int, width: int, keys: list[str]) -> Iterator[pa.RecordBatch]:
    held, enough = None, False
    for batch in batches:
        if enough or not batch.num_rows:
            continue
        found = _pick(pa.Table.from_batches([batch]), n, width, keys)
        held = found if held is None else _pick(pa.concat_tables([held, found]), n, width, keys)
        enough = not keys and all(held.num_rows - held.column(i).null_count >= n for i in range(width))
    if held is not None:
        yield from held.combine_chunks().to_batches()


def first_cells(df: DataFrame, n: int, orders: list[str]) -> DataFrame:
    """(column, rank, value as text) of the first ``n`` filled cells of every column.

    Every task keeps the rows that hold one of its first cells, at most ``n`` per column; these few
    are ranked by a window per column.  Without ``orders`` any filled cells are taken.  Order columns
    of nested types or other collations skip the choice inside tasks.
    """
    width = len(df.columns)
    kinds = {f.name: f.dataType for f in df.schema}
    cells = [
        (ref(c) if _plain(kinds[c]) else ref(c).cast("string")).alias(f"c{i}") for i, c in enumerate(df.columns)
    ]
    simple = all(_plain(kinds[o]) for o in orders if o in kinds) and set(orders) <= set(kinds)
    keys = [k for o in orders for k in (_key(ref(o), kinds[o]) if simple else [ref(o)])]
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*cells, *[k.alias(x) for k, x in zip(keys, names)])
    if simple:
        ship_package(df.sparkSession)
        rows = rows.mapInArrow(lambda it: _first_rows(it, n, width, names), rows.schema)
    texts = [F.struct(F.lit(i).alias("at"), F.col(f"c{i}").cast("string").alias("value")) for i in range(width)]
    flat = rows.select(*names, F.inline(F.array(*texts))).where(F.col("value").isNotNull())
    order = Window.partitionBy("at").orderBy(*names, "value")
    column = F.element_at(F.array(*[F.lit(c) for c in df.columns]), F.col("at") + 1)
    return flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(
        column.alias("column"), "rank", "value"
    )
