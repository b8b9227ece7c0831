"""Sharding by longest-processing-time scheduling (operator 9).

Equal texts form a group that stays together.  Groups above 1/LARGE of all bytes are scheduled one
by one (there are fewer than LARGE of them); the others are first gathered by hash in BUNDLES
bundles.  Both bounds are fixed, so the list that is sorted by size and dealt out through a heap
of shard loads fits the driver at any input size, and so do the two broadcast maps.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

from tidemill.llm.common import running_totals, stored

SHARDS = 24
LARGE = 1 << 16
BUNDLES = 1 << 14


def longest_first(sizes: list[tuple], shards: int) -> dict:
    """Item -> shard: items (item, size) from the largest down, each to the least loaded shard."""
    loads = [(0, shard) for shard in range(shards)]
    placed = {}
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(loads)
        placed[item] = shard
        heapq.heappush(loads, (load + size, shard))
    return placed


def shard(
    docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
    large: int = LARGE, bundles: int = BUNDLES,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: sizes (UTF-8 bytes of the text plus 8) are near equal between shards as
    far as groups of equal texts, which stay together, allow.  Null texts form a group of their
    own, apart from empty ones; ids play no part, so null and repeated ids and repeated rows are
    fine.  Slots count from 0 in each shard.  An empty table gives an empty result; other columns
    are ignored.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("")).alias("digest"),
        ).withColumn("bundle", F.pmod(F.xxhash64("digest"), F.lit(bundles))),
        "shard-rows",
    )
    groups = stored(rows.groupBy("digest", "bundle").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    alone = groups.where(F.col("bytes") * large > total)
    gathered = groups.where(F.col("bytes") * large <= total).groupBy("bundle").agg(F.sum("bytes").alias("bytes"))
    items = [((0, r["digest"]), r["bytes"]) for r in alone.select("digest", "bytes").collect()]
    items += [((1, r["bundle"]), r["bytes"]) for r in gathered.collect()]
    placed = longest_first(items, shards)
    single = spark.createDataFrame([(k, s) for (kind, k), s in placed.items() if kind == 0], "digest string, own_shard int")
    many = spark.createDataFrame([(k, s) for (kind, k), s in placed.items() if kind == 1], "bundle long, bundle_shard int")
    dealt = (
        rows.join(F.broadcast(single), "digest", "left").join(F.broadcast(many), "bundle", "left")
        .select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "bundle_shard").alias("shard"), F.lit(1).cast("long").alias("one"))
    )
    return running_totals(dealt, "one", "shard", "slots").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("before").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
