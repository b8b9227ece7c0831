"""Additive Holt-Winters forecasts, one model per series.

The filter maps a state to the next one by an affine function of the state, so whole stretches of a
series are affine maps as well and compose.  A stretch is summed up, for every candidate setting, by
its map and by the normal equations of its one-step errors in the unknown start state; neither grows
with the number of points.  Series of up to CHUNK points are fitted in one task; longer ones are
summed up chunk by chunk in parallel and the summaries are composed in a tree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tidemill.functions.types import quoted, ref
from tidemill.operators.timeseries import even_series, grid_date
from tidemill.plans.hotkeys import small_side
from tidemill.plans.session import materialize

#: Points of a series that one task reads, and summaries that it composes.
CHUNK, FAN_IN = 4096, 32
#: Rounds of grid refinement; each has five values per smoothing weight.
ROUNDS = 7
#: Errors that are summed up at once.
_BLOCK = 64


def _summary(y: np.ndarray, start: int, season: int, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For many smoothing settings, the stretch ``y`` from position ``start`` on: state map and normal matrix.

    Both act on (1, start state) and have shape (C, 1 + k, 1 + k): the map gives (1, end state), the
    matrix the sum of squared one-step errors as a quadratic form.
    """
    alpha, beta, gamma = params.T[:, :, None]
    count, k = len(params), 2 + season
    begin = np.broadcast_to(np.eye(1 + k)[1:], (count, k, 1 + k))
    level, trend = begin[:, 0].copy(), begin[:, 1].copy()
    seasonal = [begin[:, 2 + i].copy() for i in range(season)]
    observed, normal = np.zeros(1 + k), np.zeros((count, 1 + k, 1 + k))
    errors = np.empty((count, _BLOCK, 1 + k))
    for t, value in enumerate(y):
        observed[0] = value
        s = seasonal[(start + t) % season] if season else 0.0
        e = observed - level - trend - s
        errors[:, t % _BLOCK] = e
        level, trend = level + trend + alpha * e, trend + alpha * beta * e
        if season:
            seasonal[(start + t) % season] = s + gamma * (1 - alpha) * e
        if t % _BLOCK == _BLOCK - 1 or t == len(y) - 1:
            held = errors[:, : t % _BLOCK + 1]
            normal += held.transpose(0, 2, 1) @ held
    top = np.broadcast_to(np.eye(1 + k)[:1], (count, 1, 1 + k))
    return np.concatenate([top, np.stack([level, trend, *seasonal], axis=1)], axis=1), normal


def _composed(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The summary of two stretches that follow each other."""
    (map1, normal1), (map2, normal2) = first, second
    return map2 @ map1, normal1 + map1.transpose(0, 2, 1) @ normal2 @ map1


def _grid(centre: np.ndarray, reach: float) -> np.ndarray:
    axes = [np.clip(np.linspace(c - reach, c + reach, 5), 1e-4, 0.9999) for c in centre]
    return np.stack(np.meshgrid(*axes), -1).reshape(-1, len(centre))


def _settings(centre: np.ndarray, reach: float) -> np.ndarray:
    grid = _grid(centre, reach)
    return np.column_stack([grid, np.zeros(len(grid))]) if len(centre) == 2 else grid


def _least(summary: tuple[np.ndarray, np.ndarray]) -> tuple[int, float, np.ndarray]:
    """The setting with the least squared error at its best start state, that error, and the end state."""
    maps, normal = summary
    q, b = normal[:, 1:, 1:], normal[:, 1:, 0]
    # level and season offsets can trade places: the pseudo-inverse takes the smallest start
    starts = -np.einsum("cij,cj->ci", np.linalg.pinv(q, rcond=1e-11, hermitian=True), b)
    losses = np.maximum(normal[:, 0, 0] + np.einsum("ci,ci->c", b, starts), 0)
    i = int(losses.argmin())
    return i, float(losses[i]), maps[i, 1:, 0] + maps[i, 1:, 1:] @ starts[i]


class _Search:
    """Shrinking grid around the best smoothing weights so far."""

    def __init__(self, season: int):
        self.centre, self.reach, self.loss, self.state = np.full(3 if season else 2, 0.5), 0.5, math.inf, None

    def settings(self) -> np.ndarray:
        return _settings(self.centre, self.reach)

    def take(self, summary: tuple[np.ndarray, np.ndarray]) -> None:
        i, loss, state = _least(summary)
        if loss < self.loss:
            self.loss, self.state, self.centre = loss, state, _grid(self.centre, self.reach)[i]
        self.reach /= 2


def _aic(loss: float, n: int, season: int) -> float:
    return n * math.log(max(loss, 1e-300) / n) + 2 * ((3 if season else 2) + 2 + season)


def _used(season: int, n: int) -> int:
    return season if season > 1 and n >= 2 * season else 0


def _fit(y: np.ndarray, season: int) -> tuple[np.ndarray, float]:
    """End state (level, trend, season by position) and AIC of the best setting."""
    shift = float(y[0])  # keeps the sums of squares near the size of the errors
    search = _Search(season)
    for _ in range(ROUNDS):
        search.take(_summary(y - shift, 0, season, search.settings()))
    state = search.state.copy()
    state[0] += shift
    return state, _aic(search.loss, len(y), season)


def _ahead(state: np.ndarray, n: int, season: int, periods: int) -> np.ndarray:
    steps = np.arange(1, periods + 1)
    values = state[0] + steps * state[1]
    return values + state[2 + (n + steps - 1) % season] if season else values


def holt_winters(y, periods: int, season: int = 0) -> tuple[np.ndarray, float, bool]:
    """Forecast values, AIC and whether the season was used (it needs two full seasons)."""
    y = np.asarray(y, dtype=float)
    used = _used(season, len(y))
    state, aic = _fit(y, used)
    return _ahead(state, len(y), used, periods), round(aic, 2), bool(used)


def _packed(summary: tuple[np.ndarray, np.ndarray]) -> bytes:
    return np.stack(summary).tobytes()


def _unpacked(data: bytes, season: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data).reshape(2, -1, 3 + season, 3 + season)
    return both[0], both[1]


def _fields(keys: list[T.StructField], **kinds: T.DataType) -> T.StructType:
    return T.StructType([*keys, *(T.StructField(n, k) for n, k in kinds.items())])


_MODEL = {"state": T.ArrayType(T.DoubleType()), "used": T.IntegerType(), "aic": T.DoubleType()}


def _short_models(points: DataFrame, keys: list[T.StructField]) -> DataFrame:
    """One task per series of at most CHUNK points."""
    names = [k.name for k in keys]

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        y = group.sort_values("_at")["_y"].to_numpy()
        used = _used(int(group["_season"].iloc[0]), len(y))
        state, aic = _fit(y, used)
        return pd.DataFrame([{**{k: group[k].iloc[0] for k in names}, "state": state, "used": used, "aic": aic}])

    return points.groupBy(*[ref(k) for k in names]).applyInPandas(fitted, _fields(keys, **_MODEL))


def _long_models(points: DataFrame, sizes: DataFrame, keys: list[T.StructField], chunk: int, fan_in: int) -> DataFrame:
    """Series of any length: chunks summed up in parallel, summaries composed ``fan_in`` at a time."""
    names = [k.name for k in keys]
    by = [ref(k) for k in names]
    searched = {"_centre": T.ArrayType(T.DoubleType()), "_loss": T.DoubleType(), "state": T.ArrayType(T.DoubleType()), "used": T.IntegerType()}
    most = sizes.agg(F.max("_n")).first()[0] or 0
    levels = max(1, math.ceil(math.log(max(2, math.ceil(most / chunk)), fan_in)))
    used = F.when((F.col("_season") > 1) & (F.col("_n") >= 2 * F.col("_season")), F.col("_season")).otherwise(0)
    search = sizes.select(
        *by, F.array_repeat(F.lit(0.5), F.when(used > 0, 3).otherwise(2)).alias("_centre"), F.lit(math.inf).alias("_loss"),
        F.lit(None).cast("array<double>").alias("state"), used.cast("int").alias("used"),
    )
    points = points.withColumn("_chunk", F.floor(F.col("_at") / chunk))
    summed = _fields(keys, _chunk=T.LongType(), _summary=T.BinaryType())

    def composed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_chunk")
        head = group.iloc[0]
        parts = [_unpacked(data, int(head["used"])) for data in group["_summary"]]
        whole = parts[0]
        for part in parts[1:]:
            whole = _composed(whole, part)
        return pd.DataFrame([{**{k: head[k] for k in names}, "_chunk": head["_chunk"] // fan_in, "_summary": _packed(whole)}])

    def round_of(reach: float):
        def summary(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("_at")
            head = group.iloc[0]
            settings = _settings(np.array(head["_centre"]), reach)
            found = _summary(group["_y"].to_numpy() - head["_shift"], int(head["_at"]), int(head["used"]), settings)
            return pd.DataFrame([{**{k: head[k] for k in names}, "_chunk": head["_chunk"], "_summary": _packed(found)}])

        def chosen(group: pd.DataFrame) -> pd.DataFrame:
            head = group.iloc[0]
            search = _Search(int(head["used"]))
            search.centre, search.reach, search.loss, search.state = np.array(head["_centre"]), reach, head["_loss"], head["state"]
            search.take(_unpacked(head["_summary"], int(head["used"])))
            return pd.DataFrame([{
                **{k: head[k] for k in names}, "_centre": search.centre, "_loss": search.loss, "state": search.state, "used": head["used"],
            }])

        return summary, chosen

    for r in range(ROUNDS):
        summary, chosen = round_of(0.5 / 2**r)
        search = small_side(search)  # one row per series
        known = search.select(*by, "used")
        parts = points.join(search, names).groupBy(*by, "_chunk").applyInPandas(summary, summed)
        for _ in range(levels):
            parts = materialize(parts.join(known, names).groupBy(*by, F.floor(F.col("_chunk") / fan_in).alias("_to")).applyInPandas(composed, summed))
        search = parts.join(search, names).groupBy(*by).applyInPandas(chosen, _fields(keys, **searched))
    estimated = F.when(F.col("used") > 0, 3).otherwise(2) + 2 + F.col("used")
    aic = F.col("_n") * F.log(F.greatest("_loss", F.lit(1e-300)) / F.col("_n")) + 2 * estimated
    level = F.transform("state", lambda x, i: F.when(i == 0, x + F.col("_shift")).otherwise(x))
    shifts = small_side(points.where("_at = 0").select(*by, "_shift"))
    return search.join(sizes.select(*by, "_n"), names).join(shifts, names).select(
        *by, level.alias("state"), "used", aic.alias("aic")
    )


def run_time_series_forecast(
    df: DataFrame,
    date_col: str,
    value_col: str,
    periods: int = 12,
    seasonal_periods: int | None = None,
    partition_by=(),
    chunk: int = CHUNK,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """History and ``periods`` forecast rows per series, with the fitted model's name and AIC.

    Raw rows are averaged per moment and put on an even grid first.  No task reads more than ``chunk``
    points of a series, however long it is.
    """
    asked = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    even = even_series(df, date_col, value_col, asked).where("_filled is not null")
    if not asked:
        even = even.withColumn("_all", F.lit(0))
    names = asked or ["_all"]
    by = [ref(k) for k in names]
    series = materialize(even)
    keys = [series.schema[k] for k in names]
    season = F.col("season") if seasonal_periods is None else F.lit(seasonal_periods)
    sizes = small_side(series.groupBy(*by).agg(
        F.count("*").alias("_n"), F.min("_i").alias("_base"), F.max_by("_t", "_i").alias("_end"), F.min_by("_filled", "_i").alias("_shift"),
        F.first(season).cast("int").alias("_season"), *[F.first(c).alias(c) for c in ("_kind", "_step_us", "_step_m")],
    ))
    points = series.join(sizes.select(*by, "_n", "_base", "_season", "_shift"), names).select(
        *by, (F.col("_i") - F.col("_base")).alias("_at"), F.col("_filled").alias("_y"), "_n", "_season", "_shift"
    )
    is_long = F.col("_n") > chunk
    models = _short_models(points.where(~is_long).select(*by, "_at", "_y", "_season"), keys)
    long_sizes = sizes.where(is_long)
    if long_sizes.limit(1).count():
        models = models.unionByName(_long_models(points.where(is_long).select(*by, "_at", "_y", "_shift"), long_sizes, keys, chunk, fan_in))
    name = F.concat(F.lit("Holt-Winters (trend=add, seasonal="), F.when(F.col("used") > 0, "add").otherwise("none"), F.lit(")"))
    models = small_side(models.withColumns({"model": name, "aic": F.round("aic", 2)}))
    past = series.join(models.select(*by, "model", "aic"), names).select(
        *by, F.col("_t").alias("date"), F.col("_filled").alias("value"), F.lit("historical").alias("type"), "model", "aic"
    )
    ends = models.join(sizes, names).withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(periods)))) if periods > 0 else models.join(sizes, names).withColumn("_step", F.lit(0)).limit(0)
    offset = F.when(F.col("used") > 0, F.get("state", (2 + (F.col("_n") + F.col("_step") - 1) % F.greatest("used", F.lit(1))).cast("int"))).otherwise(0.0)
    value = F.get("state", F.lit(0)) + F.col("_step") * F.get("state", F.lit(1)) + offset
    ahead = ends.select(*by, grid_date(F.col("_end"), F.col("_step")).alias("date"), value.alias("value"), F.lit("forecast").alias("type"), "model", "aic")
    out = past.unionByName(ahead)
    return out.select(*[quoted(k) for k in asked], "date", "value", "type", "model", "aic")
