"""Exact deduplication by a heavy-hitter split (operator 1, DataFrame functions only).

A frequent-items summary of the Misra-Gries family (the mergeable counters behind
``approx_top_k_accumulate``) finds digests that may hold more than 1/``share`` of all rows.  An
exact count keeps the true ones; at most ``share`` digests can be that frequent, which bounds
the table of their winners, so it is broadcast and decides their rows where they are read.  All
other digests are small by construction and go through one ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemill.llm.common import SPACE_CLASS, numbered, stored, text_or_empty

#: A digest with more than 1/SHARE of all rows is decided map-side.
SHARE = 4096
#: Counters of a summary: its error is below 3.5/TRACKED of the rows, well under 1/SHARE.
TRACKED = 65536
#: Summaries are merged in this many groups before the last merge.
MERGE_GROUPS = 64


def _digests(docs: DataFrame, id_col: str, text_col: str, row_number) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(F.regexp_replace(text, SPACE_CLASS + "+", "").cast("binary"), 256).alias("text_sha256"),
        F.char_length(text).alias("chars"),
        row_number.alias("uid"),
    )


def _rank():
    """Smallest wins: most code points, then smallest id (null last), then row number."""
    return F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")


def heavy_winners(rows: DataFrame, share: int = SHARE, tracked: int = TRACKED) -> DataFrame:
    """Digests with more than 1/``share`` of the rows, their exact sizes and their best rows (at most ``share`` rows)."""
    merged = (
        rows.groupBy((F.spark_partition_id() % MERGE_GROUPS).alias("g"))
        .agg(F.expr(f"approx_top_k_accumulate(xxhash64(text_sha256), {tracked})").alias("s"))
        # a grouping of one group: an empty table gives no row at all
        .groupBy(F.pmod("g", F.lit(1)).alias("all"))
        .agg(F.expr("approx_top_k_combine(s)").alias("s"))
    )
    maybe = merged.select(F.explode(F.expr(f"approx_top_k_estimate(s, {2 * share})")).alias("top")).select("top.item")
    total = rows.count()
    counted = (
        rows.join(F.broadcast(maybe), F.xxhash64("text_sha256") == F.col("item"), "left_semi")
        .groupBy("text_sha256")
        .agg(F.count("*").alias("heavy_size"), F.min(_rank()).alias("best"))
    )
    # never more than ``share`` digests pass
    return counted.where(F.col("heavy_size") * share > total).select(
        "text_sha256", "heavy_size", F.col("best.doc_id").alias("heavy_id"), F.col("best.uid").alias("heavy_uid")
    )


def _mark(rows: DataFrame, share: int, tracked: int) -> DataFrame:
    winners = stored(heavy_winners(rows, share, tracked), "heavy")
    tagged = rows.join(F.broadcast(winners), "text_sha256", "left")
    heavy = tagged.where("heavy_uid is not null").select(
        "doc_id", F.col("heavy_id").alias("keep_id"), F.col("heavy_size").alias("group_size"),
        (F.col("uid") == F.col("heavy_uid")).alias("kept"), "text_sha256", "uid",
    )
    group = Window.partitionBy("text_sha256").orderBy(F.desc("chars"), F.asc_nulls_last("doc_id"), "uid")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = tagged.where("heavy_uid is null").select(
        "doc_id", F.first("doc_id").over(whole).alias("keep_id"), F.count("*").over(whole).alias("group_size"),
        (F.row_number().over(group) == 1).alias("kept"), "text_sha256", "uid",
    )
    return heavy.unionByName(rest)


def mark_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, tracked: int = TRACKED
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting space, tab, line feed, vertical tab, form feed
    and carriage return; null counts as empty, so null, empty and blank texts are copies of each
    other.  Of equal texts the longest original (in code points) stays, then the smallest doc_id
    (null last).  Of rows repeated as a whole exactly one is kept; keep_id is null if that row has
    no id.  An empty table gives an empty result; other columns are ignored.
    """
    rows = stored(_digests(docs, id_col, text_col, F.monotonically_increasing_id()), "digests")
    return _mark(rows, share, tracked).drop("uid")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE) -> DataFrame:
    """The kept rows with all their columns."""
    table = numbered(docs, "dedup-rows")
    rows = stored(_digests(table, f"row.{id_col}", f"row.{text_col}", F.col("uid")), "digests")
    kept = _mark(rows, share, TRACKED).where("kept").select("uid")
    return table.join(kept.hint("shuffle_hash"), "uid", "left_semi").select("row.*")
