"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemill.llm.common import stored


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """Link every node's larger (or smaller) neighbours to its smallest one."""
    if large:
        sides = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        sides = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
            least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        )
    return out.where("a < b").distinct()


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node of its component.

    Every round is written to the shared folder.  The driver sees a count and a checksum per round;
    rounds grow with the logarithm of the longest path.
    """
    pairs = stored(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "pairs"
    )
    before = _state(pairs)
    while before[0]:
        pairs = stored(_stars(_stars(pairs, True), False), "stars")
        after = _state(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        pairs.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
