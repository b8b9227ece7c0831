"""Joins whose keys may be extremely uneven.

Adaptive execution splits a skewed partition only on a side whose rows are all kept by the
join type, so an outer join cannot split its optional side.  A key known to occur on the
optional side always finds a partner there: for such keys the outer join equals an inner
join (both sides splittable), and only the other keys need the outer form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tidemill.plans.session import materialize

HOT_ROWS = 5_000_000
#: A materialised side of at most so many rows is broadcast.
SMALL_ROWS = 200_000


def hot_keys(df: DataFrame, key: str, at_least: int = HOT_ROWS) -> DataFrame:
    """All key values (``k``, NULL included) that hold ``at_least`` rows, counted exactly."""
    return df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where(F.col("n") >= at_least).select("k")


def _comparable(left: DataFrame, right: DataFrame, lk: str, rk: str) -> bool:
    a, b = left.schema[lk].dataType, right.schema[rk].dataType
    return a == b or isinstance(a, T.NumericType) and isinstance(b, T.NumericType)


def uneven_join(
    left: DataFrame, right: DataFrame, lk: str, rk: str, how: str, at_least: int = HOT_ROWS
) -> DataFrame:
    """Null-safe equi-join of two frames with disjoint column names.

    However many keys are heavy, all are routed: their table, at most rows / ``at_least`` long,
    tags the rows of both sides and is broadcast only if it is small.
    """
    match = F.col(lk).eqNullSafe(F.col(rk))
    if how == "inner" or not _comparable(left, right, lk, rk):
        return left.join(right, match, how)
    none = F.lit(False)
    sides = []
    if how in ("right", "full"):
        sides.append(hot_keys(left, lk, at_least).withColumns({"on_left": F.lit(True), "on_right": none}))
    if how in ("left", "full"):
        sides.append(hot_keys(right, rk, at_least).withColumns({"on_left": none, "on_right": F.lit(True)}))
    heavy = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    # partners on both sides, or on the optional side of a one-sided join: an inner join, where either
    # side can be split; heavy on one side of a full join only: all those rows are kept by an outer
    # join to that side, which can split them
    form = F.when(F.lit(how != "full") | (F.bool_or("on_left") & F.bool_or("on_right")), "inner").when(F.bool_or("on_left"), "left")
    table = materialize(heavy.groupBy(F.col("k").alias("_hot")).agg(form.otherwise("right").alias("_form")))
    forms = {r["_form"]: r["count"] for r in table.groupBy("_form").count().collect()}
    if not forms:
        return left.join(right, match, how)
    if sum(forms.values()) <= SMALL_ROWS:
        table = F.broadcast(table)

    def routed(side: DataFrame, key: str, wanted: str | None) -> DataFrame:
        tagged = side.join(table, F.col(key).eqNullSafe(F.col("_hot")), "left")
        return tagged.where(F.col("_form").isNull() if wanted is None else F.col("_form") == wanted).select(*side.columns)

    out = routed(left, lk, None).join(routed(right, rk, None), match, how)
    for name in sorted(forms):
        out = out.unionByName(routed(left, lk, name).join(routed(right, rk, name), match, name))
    return out


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Materialise a join side and broadcast it only when its counted rows allow it."""
    kept = materialize(df)
    return F.broadcast(kept) if kept.count() <= rows else kept
