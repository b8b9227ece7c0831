"""Row order as data: contiguous indexes and carried values without a global window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tidemill.functions.types import quoted, ref, require_columns
from tidemill.plans.session import materialize, ship_package

_LOCAL_BITS = 33
#: So many rows are sorted to find one among them.
SELECTED_ROWS = 10_000


def _sort_columns(order_by, reverse=False):
    columns = [order_by] if isinstance(order_by, str) else list(order_by)
    return columns, [ref(c).desc() if reverse else ref(c).asc() for c in columns]


def _placed(df: DataFrame, ordering) -> DataFrame:
    """Range-partition and sort by ``ordering``; ``_slot`` numbers rows within partitions."""
    ranged = df.repartitionByRange(*ordering).sortWithinPartitions(*ordering)
    # The slots must not move between the counting and the numbering pass.
    return materialize(ranged.withColumn("_slot", F.monotonically_increasing_id()))


def _part():
    return F.shiftright("_slot", _LOCAL_BITS)


def with_row_index(df: DataFrame, order_by, name: str = "row_index") -> DataFrame:
    """Add 0-based positions in ``order_by`` order (which must end in a unique column).

    The driver holds one count per partition, never rows.
    """
    columns, ordering = _sort_columns(order_by)
    require_columns(df, columns)
    placed = _placed(df, ordering)
    sizes = sorted(
        (r["part"], r["count"]) for r in placed.groupBy(_part().alias("part")).count().collect()
    )
    offsets, seen = [], 0
    for part, size in sizes:
        offsets.append((part, seen))
        seen += size
    spark = df.sparkSession
    table = spark.createDataFrame(offsets, "_part long, _offset long")
    local = F.col("_slot").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    # one row per partition, so the broadcast is bounded by the partition count
    return (
        placed.withColumn("_part", _part())
        .join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_part", "_offset", "_slot")
    )


def precedes(df: DataFrame, order_by, position: int, rows: int):
    """A condition: the row stands before 0-based ``position`` in ``order_by`` order (which ends in a unique column).

    The boundary row is selected, not sorted for: approximate quantiles bracket its first order
    column until few rows are left inside, or only rows equal in it, where the next column decides.
    ``rows`` is the number of rows of ``df``.  Only the boundary's order values reach the driver.
    """
    columns, ordering = _sort_columns(order_by)
    if position <= 0 or position >= rows:
        return F.lit(position >= rows)
    left, offset, inside = df.select(*[ref(c) for c in columns]), position, rows
    for name in columns:
        kind = df.schema[name].dataType
        if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            break  # no sketch for this type
        column = ref(name)
        while inside > SELECTED_ROWS:
            nulls = left.agg(F.count_if(column.isNull()).alias("n")).first()["n"]
            if offset < nulls:  # nulls come first
                left, inside = left.where(column.isNull()), nulls
                break
            share = (offset - nulls) / (inside - nulls)
            around = [min(1.0, max(0.0, share + side)) for side in (-0.001, 0.001)]
            lo, hi = left.agg(F.percentile_approx(column, around, 20_000).alias("q")).first()["q"]
            lo, hi = (F.lit(v).cast(kind) for v in (lo, hi))
            row = left.agg(F.count_if(column.isNull() | (column < lo)).alias("below"), F.count_if(column.between(lo, hi)).alias("inside")).first()
            if not row["below"] <= offset < row["below"] + row["inside"]:
                break
            shrunk = row["inside"] < inside
            left, offset, inside = left.where(column.between(lo, hi)), offset - row["below"], row["inside"]
            if not shrunk:
                break
        if inside <= SELECTED_ROWS:
            break
        ends = left.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count_if(column.isNull()).alias("nulls")).first()
        if not (ends["nulls"] == inside or ends["nulls"] == 0 and ends["lo"] == ends["hi"]):
            break
    if inside <= SELECTED_ROWS:
        boundary = left.orderBy(*ordering).offset(offset).limit(1).first()
    else:  # an order column that sketches do not take, such as text
        boundary = with_row_index(left, columns, "_at").where(F.col("_at") == offset).first()
    values = F.struct(*[F.lit(boundary[c]).cast(df.schema[c].dataType).alias(f"o{i}") for i, c in enumerate(columns)])
    return F.struct(*[ref(c).alias(f"o{i}") for i, c in enumerate(columns)]) < values


def _fill_task(batches: Iterator[pa.RecordBatch], keys: list[str], column: str) -> Iterator[pa.RecordBatch]:
    """A task's rows with the last value of their key so far; ``_open`` marks rows of its first key before any value."""
    from pyspark import TaskContext

    part, slot = TaskContext.get().partitionId(), 0
    last_keys, carry, first_run = None, None, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        changed = np.zeros(n, bool)
        for k in keys:
            names = batch.column(k)
            differs = pc.fill_null(pc.not_equal(names[1:], names[:-1]), False).to_numpy(zero_copy_only=False)
            missing = names.is_null().to_numpy(zero_copy_only=False)
            changed[1:] |= differs | (missing[1:] != missing[:-1])
        head = [batch.column(k)[0].as_py() for k in keys]
        changed[0] = last_keys is not None and head != last_keys
        values = batch.column(column)
        if carry is None or changed[0]:
            carry = pa.nulls(1, values.type)
        # position 0 is what the batch before handed on
        source = pa.concat_arrays([carry, values])
        at = np.arange(1, n + 1)
        start = np.maximum.accumulate(np.where(changed, at, 0))
        seen = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), at, 0))
        pick = np.where(seen >= start, seen, 0)
        pick[(pick == 0) & (start > 0)] = -1
        filled = source.take(pa.array(np.maximum(pick, 0), pa.int64(), mask=pick < 0))
        in_first = (start == 0) & first_run & ~changed[0]
        open_ = in_first & filled.is_null().to_numpy(zero_copy_only=False)
        first_run = first_run and not changed.any()
        last_keys = [batch.column(k)[n - 1].as_py() for k in keys]
        carry = filled.slice(n - 1, 1)
        columns = [filled if name == column else batch.column(name) for name in batch.schema.names]
        added = [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(slot, slot + n)), pa.array(open_)]
        slot += n
        yield pa.RecordBatch.from_arrays([*columns, *added], names=[*batch.schema.names, "_part", "_slot", "_open"])


def carry_fill(
    df: DataFrame, column: str, order_by, partition_by=(), backward: bool = False
) -> DataFrame:
    """Fill NULLs with the last (or, backward, the next) non-null value in row order.

    Rows are range-partitioned once and every task streams over its own.  A key holding many rows is
    spread over several tasks; values that cross their edges travel as one small row per task.
    """
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    columns, ordering = _sort_columns(order_by, reverse=backward)
    require_columns(df, [column, *keys, *columns])
    spark = df.sparkSession
    ship_package(spark)
    # nested keys are compared as text; numbered names keep clear of the frame's own
    names = [f"_key{i}" for i in range(len(keys))]
    flat = [F.to_json(F.struct(ref(k))) if isinstance(df.schema[k].dataType, (T.StructType, T.ArrayType, T.MapType)) else ref(k) for k in keys]
    ranged = df.withColumns(dict(zip(names, flat))).repartitionByRange(*[ref(k) for k in keys], *ordering).sortWithinPartitions(*[ref(k) for k in keys], *ordering)
    added = [T.StructField("_part", T.LongType()), T.StructField("_slot", T.LongType()), T.StructField("_open", T.BooleanType())]
    placed = materialize(ranged.mapInArrow(lambda it: _fill_task(it, names, column), T.StructType([*ranged.schema.fields, *added])))
    key = F.struct(*[F.col(k) for k in names]) if keys else F.struct(F.lit(0).alias("all"))
    tail = F.struct(key.alias("key"), ref(column).alias("value"), F.col("_open").alias("open"))
    edges = placed.groupBy("_part").agg(F.min_by(key, "_slot").alias("first"), F.max_by(tail, "_slot").alias("tail")).orderBy("_part").collect()
    carries, held_key, held = [], None, None
    for edge in edges:
        if held is not None and held_key == edge["first"]:
            carries.append((edge["_part"], held))
        if edge["tail"]["open"] and held_key == edge["tail"]["key"]:
            continue  # a task without values of its only key passes on what it got
        held_key, held = edge["tail"]["key"], edge["tail"]["value"]
    schema = T.StructType([T.StructField("_from", T.LongType()), T.StructField("_carry", df.schema[column].dataType)])
    table = spark.createDataFrame(carries, schema)  # at most one row per task
    joined = placed.join(F.broadcast(table), F.col("_part") == F.col("_from"), "left")
    carried = F.when(F.col("_open"), F.col("_carry"))
    return joined.select(*[F.coalesce(ref(c), carried).alias(c) if c == column else F.col(quoted(c)) for c in df.columns])
