"""Mixing sources to target weights by weighted fair queueing (operator 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemill.llm.common import WORD_PATTERN, numbered, ordered, running_totals, stored, text_or_empty

#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: A source gives at most this many times its size.
MAX_EPOCHS = 3
#: Seed of the shuffle.
SEED = "mix-0"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: its weight and target.  ``sizes`` has one row per source (source, source_size).

    The weights share the total of all sizes.  A target stops at ``max_epochs`` times its source's
    size and the excess is shared again by weight until none is above.  With sources sorted by the
    level at which they fill up, the final level is that of the first source which stays below.
    The windows see one row per source, never documents.
    """
    position = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (position % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", position.alias("rank"), weight.alias("weight")).withColumn(
        "cap", F.col("source_size") * max_epochs
    )
    fills_at = F.col("cap").cast("double") / F.col("weight").cast("double")
    rows = Window.orderBy("fills_at", "rank")
    everything = Window.partitionBy(F.lit(0))
    shared = ranked.withColumn("fills_at", fills_at).select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("weight").over(rows.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
    )
    share = (F.col("total") - F.col("capped")).cast("double") / F.col("open_weight").cast("double")
    first_open = F.min(F.when(F.col("fills_at") > F.col("share"), F.struct("fills_at", "rank", "share"))).over(everything)
    level = F.col("first_open.share")
    cap = F.col("cap").cast("double")
    return shared.withColumn("share", share).withColumn("first_open", first_open).select(
        "source", "source_size", "rank", "total",
        F.when(level.isNull() | (F.col("fills_at") <= level), cap).otherwise(level * F.col("weight")).alias("target"),
    )


def mix_copies(rows: DataFrame, weights=WEIGHTS, max_epochs=MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Rows (uid, doc_id, source, size, text_key) with source_size, target and ``copies`` taken."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, max_epochs), "targets").withColumnRenamed("source", "target_source")
    known = rows.join(targets, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    shuffled = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    queue = ordered(
        known.where("size > 0").withColumn("shuffled", shuffled),
        F.col("rank"), F.col("shuffled"), F.asc_nulls_last("doc_id"), F.col("text_key"), F.col("uid"),
    )
    # each epoch of a source follows the one before; only copies that start below the target can be taken
    start = F.col("epoch") * F.col("source_size") + F.col("before")
    copies = (
        running_totals(queue, "size", "rank", "queue")
        .withColumn("epoch", F.explode(F.array(*[F.lit(k) for k in range(max_epochs)])))
        .where(start.cast("double") < F.col("target"))
        .select(
            ((start + F.col("size")).cast("double") / F.col("target")).alias("finish"),
            "rank", "shuffled", "doc_id", "text_key", "uid", "size", "total",
        )
    )
    by_finish = ordered(
        copies, F.col("finish"), F.col("rank"), F.col("shuffled"), F.asc_nulls_last("doc_id"), F.col("text_key"), F.col("uid")
    ).select("uid", "size", "total")
    taken = (
        running_totals(by_finish, "size", None, "finish")
        .where(F.col("before") + F.col("size") <= F.col("total"))
        .groupBy("uid")
        .agg(F.count("*").alias("copies"))
    )
    return known.join(taken, "uid", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, row_number) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(
        row_number.alias("uid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"), F.xxhash64(text).alias("text_key"),
    )


def mix_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    Every document of a source gets a virtual finish time, the source's cumulative words in
    shuffled order divided by its target; all are range-sorted by it and taken while the running
    total stays within the budget (the sum of all sizes).  Documents are taken whole, so a source
    may end one document away from its target.  The order depends on ids and texts alone, so
    reruns agree.  Null texts have size 0; documents without words take no part (taken 0); null is
    a source of its own, the last.  Rows with equal ids and texts are interchangeable.
    """
    rows = stored(_sizes(docs, id_col, text_col, source_col, F.monotonically_increasing_id()), "sizes")
    return mix_copies(rows, weights, max_epochs, seed).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED,
) -> DataFrame:
    """The mix itself: every document with all its columns, as often as it is taken."""
    table = numbered(docs, "mix-rows")
    rows = stored(_sizes(table, f"row.{id_col}", f"row.{text_col}", f"row.{source_col}", F.col("uid")), "sizes")
    copies = mix_copies(rows, weights, max_epochs, seed).where("copies > 0").select("uid", "copies")
    return (
        table.join(copies.hint("shuffle_hash"), "uid")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("row.*")
    )
