"""The data behind the charts: correlations, histograms, boxes, violins, scatters."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.scalars import correlation
from tidemill.functions.types import numeric_columns, quoted, ref, require_columns, require_operand
from tidemill.plans.gram import BUILT_IN_COLUMNS, pair_correlation, pair_moments
from tidemill.plans.hotkeys import small_side
from tidemill.plans.quantiles import grouped_quantiles

HISTOGRAM_BINS = 30


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson r of every unordered column pair, from one scan."""
    columns = numeric_columns(df) if columns is None else columns
    if len(columns) > BUILT_IN_COLUMNS:
        name = lambda place: F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(place) + 1)
        return pair_moments(df, [ref(c) for c in columns]).where("i < j").select(
            "i", "j", name("i").alias("column_a"), name("j").alias("column_b"), pair_correlation().alias("r")
        )
    cells = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(j).alias("j"),
            F.lit(a).alias("column_a"),
            F.lit(b).alias("column_b"),
            correlation(ref(a), ref(b)).alias("r"),
        )
        for (i, a), (j, b) in combinations(enumerate(columns), 2)
    ]
    if not cells:
        return df.sparkSession.createDataFrame([], "i int, j int, column_a string, column_b string, r double")
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame | None:
    """Symmetric matrix, one row per column; None with fewer than two numeric columns."""
    columns = numeric_columns(df) if columns is None else columns
    if len(columns) < 2:
        return None
    if len(columns) > BUILT_IN_COLUMNS:
        r = F.when(F.col("i") < F.col("j"), F.round(pair_correlation(), digits)).when(F.col("m2_i") > 0, F.lit(1.0))
        upper = pair_moments(df, [ref(c) for c in columns]).select("i", "j", r.alias("r"))
        both = upper.select(F.inline(F.array(F.struct("i", "j", "r"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "r"))))
        rows = both.groupBy("i").agg(*[F.max(F.when(F.col("j") == j, F.col("r"))).alias(c) for j, c in enumerate(columns)])
        label = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1).alias("column")
        return rows.orderBy("i").select(label, *[ref(c) for c in columns])
    aggs = {(i, i): F.when(F.stddev_pop(ref(c).cast("double")) > 0, F.lit(1.0)) for i, c in enumerate(columns)}
    for (i, a), (j, b) in combinations(enumerate(columns), 2):
        aggs[i, j] = F.round(correlation(ref(a), ref(b)), digits)
    once = df.agg(*[e.alias(f"r{i}_{j}") for (i, j), e in aggs.items()])
    rows = [
        F.struct(
            F.lit(a).alias("column"),
            *[F.col(f"r{min(i, j)}_{max(i, j)}").alias(b) for j, b in enumerate(columns)],
        )
        for i, a in enumerate(columns)
    ]
    return once.select(F.inline(F.array(*rows)))


def strongest_pair(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The pair with the largest absolute correlation; the first pair among ties."""
    pairs = correlation_pairs(df, columns).withColumn("strength", F.coalesce(F.abs("r"), F.lit(0.0)))
    return pairs.orderBy(F.desc("strength"), "i", "j").limit(1).select("column_a", "column_b", F.round("r", 4).alias("r"))


def correlated_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairs beyond 0.5 in absolute value, strong beyond 0.7."""
    size = F.abs("r")
    return (
        correlation_pairs(df, columns)
        .where(size > 0.5)
        .select(
            "column_a",
            "column_b",
            F.round("r", 4).alias("r"),
            F.when(size > 0.7, "strong").otherwise("moderate").alias("strength"),
            F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"),
        )
    )


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS, by: str | None = None) -> DataFrame:
    """Equal-width left-closed bins (the last one closed), empty bins included."""
    require_operand(df, column)
    x = ref(column).cast("double")
    row = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    schema = "bin int, lower double, upper double, count long"
    if row["lo"] is None:
        return df.sparkSession.createDataFrame([], schema)
    lo, hi = row["lo"], row["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    keys = [quoted(by)] if by else []
    present = df.where(ref(column).isNotNull())
    if by:
        present = present.where(ref(by).isNotNull())
    slot = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
    counted = present.groupBy(*keys, slot.alias("bin")).agg(F.count("*").alias("count"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        groups = counted.select(*keys).distinct()
        spine = groups.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    on = [by, "bin"] if by else ["bin"]
    return (
        spine.join(counted, on, "left")
        .select(
            *keys,
            "bin",
            (F.lit(lo) + F.col("bin") * width).alias("lower"),
            (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
        .orderBy(*keys, "bin")
    )


def box_statistics(df: DataFrame, category: str, value: str) -> DataFrame:
    """Quartiles and whiskers (extreme values inside the 1.5 IQR fences) per category."""
    require_columns(df, [category, value])
    quartiles = grouped_quantiles(df, [category], value, {"q1": 0.25, "median": 0.5, "q3": 0.75}).where("q1 is not null")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    x = F.col("_x")
    rows = df.where(ref(category).isNotNull()).select(ref(category), ref(value).cast("double").alias("_x"))
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        rows.join(small_side(quartiles), category)
        .groupBy(ref(category), "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, x)).alias("lower_whisker"),
            F.max(F.when(inside, x)).alias("upper_whisker"),
            F.min(x).alias("min"),
            F.max(x).alias("max"),
            F.count(x).alias("count"),
            F.count_if(~inside).alias("outliers"),
        )
        .orderBy(ref(category))
    )


def violin_data(df: DataFrame, category: str, value: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Per-category histogram on shared edges, with the category's quartiles."""
    shape = histogram(df, value, bins, by=category)
    quartiles = grouped_quantiles(df, [category], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return shape.join(quartiles, category).orderBy(ref(category), "bin")


def scatter_data(df: DataFrame, x: str, y: str, color: str | None = None, max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """The (x, y[, colour]) points; with ``max_rows``, a seeded sample of about that many."""
    columns = [x, y] + ([color] if color else [])
    require_columns(df, columns)
    points = df.select(*[ref(c) for c in columns])
    if max_rows is None:
        return points
    total = points.count()
    return points if total <= max_rows else points.sample(fraction=max_rows / total, seed=seed)


def scatter_pairs(df: DataFrame, columns: int | None = None) -> list[tuple[str, str]]:
    """Column pairs offered for pairwise plots: those among all, or the first, numeric columns."""
    return list(combinations(numeric_columns(df)[:columns], 2))
