"""Ranks and running values within groups that may each hold any share of the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemill.llm.common import ordered, prepare, stored

#: A key with more than this share of the rows is heavy; so at most as many keys are.
HEAVY_SHARE = 4096


def _scan(batches: Iterator[pa.RecordBatch], group: str, lanes: Sequence[str]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held, count, carried = None, 0, dict.fromkeys(lanes, np.int64(0))
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        names = batch.column(group)
        opens = np.append(names[0].as_py() != held, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False))
        run = np.cumsum(opens) - (1 if opens[0] else 0)
        start = np.append([] if opens[0] else [0], np.flatnonzero(opens)).astype(np.int64)
        place = np.arange(n) - start[run]
        goes_on = np.flatnonzero(run == 0) if not opens[0] else slice(0, 0)
        place[goes_on] += count
        columns = dict(zip(batch.schema.names, batch.columns))
        for lane in lanes:
            upto = np.bitwise_xor.accumulate(columns[lane].to_numpy(zero_copy_only=False))
            value = upto ^ np.where(start > 0, upto[start - 1], 0)[run]
            value[goes_on] ^= carried[lane]
            carried[lane] = value[-1]
            columns[lane] = pa.array(value)
        held, count = names[n - 1].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*columns.values(), pa.array(place), pa.array(np.full(n, part, np.int32))], names=[*columns, "place", "part"]
        )


def scan(df: DataFrame, group: str, order: Sequence[Column], lanes: Sequence[str] = (), label: str = "scan") -> DataFrame:
    """Adds ``place``, the 0-based rank of a row in its ``group``; ``lanes`` become the XOR of all values up to the row.

    Rows are range-partitioned, so a group may span partitions and each task streams over its rows.
    What a partition hands on to the next is one row, and the driver sees only those.  ``group`` and
    ``lanes`` (longs) hold no nulls; rows equal in ``order`` are taken in any order.
    """
    spark = df.sparkSession
    prepare(spark)
    schema = T.StructType([*df.schema.fields, T.StructField("place", T.LongType()), T.StructField("part", T.IntegerType())])
    spread = df.withColumn("_row", F.monotonically_increasing_id())  # equal rows need not meet in one partition
    kept = stored(ordered(spread, F.col(group), *order, F.col("_row")).drop("_row").mapInArrow(lambda it: _scan(it, group, lanes), schema), label)
    edges = kept.groupBy("part").agg(F.min(group).alias("first"), F.max(F.struct(group, "place", *lanes)).alias("last")).orderBy("part").collect()
    carries, held = [], None
    for edge in edges:
        last = (edge["last"][group], edge["last"]["place"] + 1, *(edge["last"][lane] for lane in lanes))
        if held and held[0] == edge["first"]:
            carries.append((edge["part"], *held))
            if last[0] == held[0]:
                last = (last[0], last[1] + held[1], *(a ^ b for a, b in zip(last[2:], held[2:])))
        held = last
    names = [f"carried_{c}" for c in ("part", "group", "place", *lanes)]
    kinds = [T.IntegerType(), df.schema[group].dataType, *[T.LongType()] * (1 + len(lanes))]
    table = spark.createDataFrame(carries, T.StructType([T.StructField(*f) for f in zip(names, kinds)]))
    # at most one row per partition
    joined = kept.join(F.broadcast(table), (F.col("part") == F.col("carried_part")) & (F.col(group) == F.col("carried_group")), "left")
    moved = {"place": F.col("place") + F.coalesce("carried_place", F.lit(0))}
    moved |= {lane: F.col(lane).bitwiseXOR(F.coalesce(f"carried_{lane}", F.lit(0))) for lane in lanes}
    return joined.withColumns(moved).drop("part", *names)


def join_heavy(left: DataFrame, right: DataFrame, match: dict[str, str], weight: str, rows: int) -> DataFrame:
    """Left join with a table of unique keys, where ``weight`` counts the left rows of a key and ``rows`` all of them.

    Keys above the heavy share, at most HEAVY_SHARE of them, are broadcast; the others are few rows each and shuffled.
    """
    on = [F.col(a) == F.col(b) for a, b in match.items()]
    is_heavy = F.col(weight) * HEAVY_SHARE > rows
    heavy = F.broadcast(right.where(is_heavy))
    rest = left.join(F.broadcast(right.where(is_heavy).select(*match.values())), on, "left_anti")
    return left.join(heavy, on).unionByName(rest.join(right.where(~is_heavy), on, "left"))
