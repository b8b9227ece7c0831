"""Exact linear-interpolation quantiles that never gather a large column in one task.

The built-in ``percentile`` keeps one counter per distinct value: fine for few distinct values,
slow for many and impossible for billions.  The first scan estimates the number of distinct
values and takes approximate quantiles a little below and above each wanted rank.  Their rank
error is bounded, so they bracket the exact value; brackets are narrowed further while they
hold too many values, and the exact aggregate sees only what is left.  Every scan serves all
columns and is combined on the map side; no row is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.types import quoted, ref
from tidemill.plans.hotkeys import small_side

DISTINCT_LIMIT = 10_000
GROUP_DISTINCT_LIMIT = 500_000
SKETCH_ACCURACY = 20_000
#: Steps of the grid that narrows the brackets of groups.
GRID = 256
# a bracket reaches this share of its rows beyond the wanted rank, well over the sketch's error
MARGIN = 4.0 / SKETCH_ACCURACY


def _as_double(column: str):
    value = ref(column).cast("double")
    return F.when(~F.isnan(value), value)


@dataclass
class _Target:
    """One wanted rank of one column and the value range known to hold it."""

    column: int
    slot: int
    rank: float
    inside: int
    below: int = 0
    lo: float = -math.inf
    hi: float = math.inf

    def covers(self, below: int, inside: int) -> bool:
        return below <= math.floor(self.rank) and math.ceil(self.rank) < below + inside

    def fraction(self, rank: float) -> float:
        return (rank - self.below) / self.inside


def column_quantiles(
    df: DataFrame, wanted: dict[str, list[float]], distinct_limit: int = DISTINCT_LIMIT, approx: bool = False
) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns as driver scalars; with ``approx``, one scan and a
    rank error below ``1 / SKETCH_ACCURACY``."""
    columns = list(wanted)
    if not columns:
        return {}
    values = df.select(*[_as_double(c).alias(f"v{i}") for i, c in enumerate(columns)])
    if approx:
        sketches = [F.percentile_approx(f"v{i}", wanted[c], SKETCH_ACCURACY).alias(f"q{i}") for i, c in enumerate(columns)]
        row = values.agg(*sketches).first()
        return {c: list(row[f"q{i}"] or [None] * len(wanted[c])) for i, c in enumerate(columns)}
    first = []
    for i, c in enumerate(columns):
        around = [min(1.0, max(0.0, p + side)) for p in wanted[c] for side in (-MARGIN, MARGIN)]
        first += [
            F.count(f"v{i}").alias(f"n{i}"),
            F.approx_count_distinct(f"v{i}").alias(f"d{i}"),
            F.percentile_approx(f"v{i}", around, SKETCH_ACCURACY).alias(f"e{i}"),
        ]
    sizes = values.agg(*first).first()
    targets, direct, edges = [], [], []
    for i, c in enumerate(columns):
        n = sizes[f"n{i}"]
        if sizes[f"d{i}"] <= distinct_limit or n < 2 / MARGIN:
            direct.append(i)
            continue
        for slot, p in enumerate(wanted[c]):
            targets.append(_Target(i, slot, p * (n - 1), n))
            edges.append(tuple(sizes[f"e{i}"][2 * slot : 2 * slot + 2]))
    _narrow(values, targets, edges, distinct_limit)
    return _read(values, columns, wanted, direct, targets)


def _narrow(values, targets, edges, distinct_limit):
    """Tighten brackets until each holds few distinct values."""
    pending = list(zip(targets, edges))
    while pending:
        checks = []
        for k, (t, (lo, hi)) in enumerate(pending):
            v = F.col(f"v{t.column}")
            within = v.between(lo, hi)
            checks += [
                F.count_if(v < lo).alias(f"b{k}"),
                F.count_if(within).alias(f"i{k}"),
                F.approx_count_distinct(F.when(within, v)).alias(f"d{k}"),
            ]
        row = values.agg(*checks).first()
        crowded = []
        for k, (t, (lo, hi)) in enumerate(pending):
            below, inside = row[f"b{k}"], row[f"i{k}"]
            if t.covers(below, inside) and inside < t.inside:
                t.lo, t.hi, t.below, t.inside = lo, hi, below, inside
                if row[f"d{k}"] > distinct_limit:
                    crowded.append(t)
        if not crowded:
            return
        sketches = []
        for k, t in enumerate(crowded):
            v = F.col(f"v{t.column}")
            low = max(0.0, t.fraction(math.floor(t.rank)) - MARGIN)
            high = min(1.0, t.fraction(math.ceil(t.rank) + 1) + MARGIN)
            inside = F.when(v.between(t.lo, t.hi), v)
            sketches.append(F.percentile_approx(inside, [low, high], SKETCH_ACCURACY).alias(f"e{k}"))
        found = values.agg(*sketches).first()
        pending = [(t, tuple(found[f"e{k}"])) for k, t in enumerate(crowded)]


def _read(values, columns, wanted, direct, targets):
    """The exact values, all columns in one scan."""
    exprs = []
    for i in direct:
        points = F.array(*[F.lit(float(p)) for p in wanted[columns[i]]])
        exprs.append(F.percentile(f"v{i}", points).alias(f"q{i}"))
    for k, t in enumerate(targets):
        v = F.col(f"v{t.column}")
        position = (t.rank - t.below) / (t.inside - 1) if t.inside > 1 else 0.0
        inside = F.when(v.between(t.lo, t.hi), v)
        exprs.append(F.percentile(inside, F.lit(min(1.0, max(0.0, position)))).alias(f"t{k}"))
    row = values.agg(*exprs).first()
    found = {c: [None] * len(wanted[c]) for c in columns}
    for i in direct:
        if row[f"q{i}"] is not None:
            found[columns[i]] = list(row[f"q{i}"])
    for k, t in enumerate(targets):
        found[columns[t.column]][t.slot] = row[f"t{k}"]
    return found


def fences(df: DataFrame, columns: list[str], multiplier: float = 1.5) -> dict[str, tuple]:
    """Per column ``(q1, q3, lower, upper)``; all None for a column without values."""
    out = {}
    for c, (q1, q3) in column_quantiles(df, {c: [0.25, 0.75] for c in columns}).items():
        if q1 is None:
            out[c] = (None, None, None, None)
        else:
            reach = multiplier * (q3 - q1)
            out[c] = (q1, q3, q1 - reach, q3 + reach)
    return out


def grouped_quantiles(
    df: DataFrame,
    keys: list[str],
    column: str,
    points: dict[str, float],
    distinct_limit: int = GROUP_DISTINCT_LIMIT,
) -> DataFrame:
    """Exact quantiles per group: ``keys`` plus one column per entry of ``points``."""
    rows = df.select(*[ref(k) for k in keys], _as_double(column).alias("_v"))
    for k in keys:
        rows = rows.where(ref(k).isNotNull())
    distinct = rows.agg(F.approx_count_distinct("_v").alias("d")).first()["d"]
    if distinct <= distinct_limit:
        return (
            rows.groupBy(*[ref(k) for k in keys])
            .agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in points.values()])).alias("_q"))
            .select(*[ref(k) for k in keys], *[F.col("_q")[i].alias(n) for i, n in enumerate(points)])
        )
    return _grouped_by_bracket(rows, keys, points)


def _grouped_by_bracket(rows, keys, points, limit: int = DISTINCT_LIMIT):
    """Exact quantiles of groups of any size: brackets per group and rank, narrowed until few values are left.

    A round takes, per bracket, approximate quantiles on a grid and keeps the stretch of the grid
    around the wanted rank; all counts and sketches are combined on the map side.
    """
    key_cols = [ref(k) for k in keys]
    groups = rows.select(*key_cols).distinct()
    present = rows.where("_v is not null")
    wanted = F.array(*[F.struct(F.lit(i).alias("_slot"), F.lit(float(p)).alias("_p")) for i, p in enumerate(points.values())])
    none = F.lit(None).cast("double")
    # one row per group and wanted quantile
    brackets = small_side(
        present.groupBy(*key_cols).agg(F.count("*").alias("_inside"), F.approx_count_distinct("_v").alias("_distinct"))
        .withColumn("_want", F.explode(wanted))
        .select(
            *key_cols, "_want._slot", (F.col("_want._p") * (F.col("_inside") - 1)).alias("_rank"), none.alias("_lo"), none.alias("_hi"),
            F.lit(0).cast("long").alias("_below"), "_inside", "_distinct",
        )
    )
    inside = (F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))
    grid = [k / GRID for k in range(GRID + 1)]
    known = [*keys, "_slot", "_rank", "_lo", "_hi"]
    while brackets.where(F.col("_distinct") > limit).limit(1).count():
        crowded = brackets.where(F.col("_distinct") > limit)
        cuts = present.join(crowded, keys).where(inside).groupBy(*map(quoted, [*known, "_below", "_inside"])).agg(
            F.percentile_approx("_v", grid, GRID * 40).alias("_cuts")
        )
        # a grid step is forty times the sketch's error, so one more step on each side is safe
        first = F.floor((F.floor("_rank") - F.col("_below")) / F.col("_inside") * GRID) - 1
        last = F.ceil((F.ceil("_rank") + 1 - F.col("_below")) / F.col("_inside") * GRID) + 1
        edges = small_side(cuts.select(
            *key_cols, "_slot", "_rank", F.col("_inside").alias("_before"),
            F.coalesce(F.when(first >= 0, F.get("_cuts", first.cast("int"))), "_lo").alias("_lo"),
            F.coalesce(F.when(last <= GRID, F.get("_cuts", last.cast("int"))), "_hi").alias("_hi"),
        ))
        counted = present.join(edges, keys).groupBy(*map(quoted, [*known, "_before"])).agg(
            F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.count_if(inside).alias("_inside"),
            F.approx_count_distinct(F.when(inside, F.col("_v"))).alias("_distinct"),
        )
        # what no longer shrinks is read as it is
        left = F.when(F.col("_inside") < F.col("_before"), F.col("_distinct")).otherwise(0)
        done = brackets.where(F.col("_distinct") <= limit)
        brackets = small_side(done.unionByName(counted.withColumn("_distinct", left).drop("_before")))
    values = (
        present.join(brackets.drop("_inside", "_distinct"), keys).where(inside)
        .groupBy(*map(quoted, [*keys, "_slot", "_rank", "_below", "_v"])).agg(F.count("*").alias("_c"))
        .groupBy(*map(quoted, [*keys, "_slot", "_rank", "_below"])).agg(F.array_sort(F.collect_list(F.struct("_v", "_c"))).alias("_values"))
    )

    def at(rank):
        """The value that holds ``rank`` among the sorted values and their counts."""
        start = F.struct(F.col("_below").alias("seen"), F.lit(None).cast("double").alias("found"))

        def step(state, x):
            upto = state["seen"] + x["_c"]
            found = F.when(state["found"].isNull() & (upto > rank), x["_v"]).otherwise(state["found"])
            return F.struct(upto.alias("seen"), found.alias("found"))

        return F.aggregate("_values", start, step, lambda state: state["found"])

    low, high = at(F.floor("_rank")), at(F.ceil("_rank"))
    found = values.select(*key_cols, "_slot", (low + (high - low) * (F.col("_rank") - F.floor("_rank"))).alias("_q"))
    cells = [F.max(F.when(F.col("_slot") == i, F.col("_q"))).alias(name) for i, name in enumerate(points)]
    return groups.join(found.groupBy(*key_cols).agg(*cells), keys, "left").select(*key_cols, *[quoted(n) for n in points])
