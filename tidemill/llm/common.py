"""What the operators of this package share: stored tables, row numbers, batch slices, running totals."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidemill.plans.session import scratch_path, ship_package

#: Separators of the word contracts, as a character class that Java, RE2 and Python read alike.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"
#: Python workers handle at most about this many bytes of text at once (or a single longer text).
SLICE_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Code for the executors, and Arrow batches small enough for long texts (unless set by the user)."""
    ship_package(spark)
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "1000")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and continue from the files.

    Lost executors cost nothing that was written, and both the plan and its numbers (row ids,
    running totals) stay as they were in the committed attempt of each task.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that only finished steps used, instead of at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Tables of a few numbers per row are broadcast up to this many rows, about 10 MB.
SMALL_ROWS = 200_000


def if_small(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored, counted, and broadcast in joins only if it has at most SMALL_ROWS rows."""
    kept = stored(df, label)
    return F.broadcast(kept) if kept.count() <= SMALL_ROWS else kept


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """Whole rows packed in ``row`` with a row number ``uid`` that no later scan can change.

    Packing keeps extra columns of any name away from the columns that operators add.
    """
    return stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("uid")), label)


def bucket_of(name: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive pieces whose texts sum to about ``limit`` bytes."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for k, n in enumerate(size):
        if k > start and total + n > limit:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def _add_running(batches: Iterator[pa.RecordBatch], group: str | None, value: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    seen: dict = {}
    for batch in batches:
        n = batch.num_rows
        amount = pc.fill_null(batch.column(value), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if group is None:
            keys, codes = [None], np.zeros(n, np.int64)
        else:
            coded = batch.column(group).dictionary_encode(null_encoding="encode")
            keys, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        sums = np.cumsum(amount[order])
        first = np.searchsorted(codes[order], np.arange(len(keys)))
        start = np.where(first > 0, sums[first - 1], 0) if n else np.zeros(len(keys), np.int64)
        ends = np.append(first[1:], n)
        base = np.array([seen.get(k, 0) for k in keys], np.int64) - start
        before = np.empty(n, np.int64)
        before[order] = sums - amount[order] + base[codes[order]]
        for k, lo, hi in zip(keys, first, ends):
            if hi > lo:
                seen[k] = seen.get(k, 0) + int(sums[hi - 1] - (sums[lo - 1] if lo else 0))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(before)],
            names=[*batch.schema.names, "part", "within"],
        )


def running_totals(df: DataFrame, value: str, group: str | None = None, label: str = "running") -> DataFrame:
    """Adds ``before``: the sum of ``value`` over all earlier rows (of the same ``group``).

    Earlier means in a lower partition, or higher up in the same one, so a range-partitioned and
    sorted input gives totals in that order.  Each task streams over its rows and keeps one sum
    per group; the table is stored, one small row per partition and group is summed across
    partitions, and the sums are joined back.  No task sees another's rows.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("within", T.LongType())])
    prepare(df.sparkSession)
    kept = stored(df.mapInArrow(lambda it: _add_running(it, group, value), schema), label)
    keys = ["part"] + ([group] if group else [])
    sums = kept.groupBy(*keys).agg(F.sum(value).alias("amount"))
    order = Window.partitionBy(*([group] if group else [])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = if_small(sums.select(
        F.col("part").alias("base_part"),
        *([F.col(group).alias("base_group")] if group else []),
        F.coalesce(F.sum("amount").over(order), F.lit(0)).alias("base"),
    ), f"{label}-base")
    match = F.col("part") == F.col("base_part")
    if group:
        match = match & F.col(group).eqNullSafe(F.col("base_group"))
    return kept.join(base, match).withColumn("before", F.col("base") + F.col("within")).drop(
        "part", "within", "base", "base_part", "base_group"
    )


def ordered(df: DataFrame, *order: Column) -> DataFrame:
    """Range-partitioned and sorted; the number of partitions follows the session's setting."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)
