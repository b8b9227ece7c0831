"""Grouping, pivoting and summarising."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tidemill.functions.scalars import full_sum, sample_kurtosis, sample_skewness
from tidemill.functions.types import (
    DIGEST_LENGTH,
    flat_columns,
    grouping_key,
    is_numeric,
    is_text,
    numeric_columns,
    ref,
    require_columns,
    require_operand,
    text_columns,
)
from tidemill.plans.hotkeys import small_side
from tidemill.plans.quantiles import column_quantiles, grouped_quantiles
from tidemill.plans.session import materialize

GROUP_AGGREGATES = ("mean", "sum", "count", "min", "max", "std", "median")
PIVOT_AGGREGATES = ("mean", "sum", "count", "min", "max")
MAX_PIVOT_COLUMNS = 1_000


def aggregate_column(agg: str, x):
    """The aggregate behind a name; sums over nothing are 0."""
    simple = {"mean": F.avg, "sum": full_sum, "count": F.count, "min": F.min, "max": F.max, "std": F.stddev_samp}
    if agg not in simple:
        raise ValueError(f"unknown aggregate: {agg}")
    return simple[agg](x)


def _present(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose grouping keys are all known: a missing key is not a group."""
    return df.dropna("any", subset=keys)


def _rounded(df: DataFrame, column: str, digits: int):
    return F.round(ref(column), digits) if is_numeric(df.schema[column].dataType) else ref(column)


def group_aggregate(df: DataFrame, key: str, measure: str, agg: str = "mean") -> DataFrame:
    """One aggregate per group in ``{agg}_{measure}``, largest first, 2 decimals."""
    require_operand(df, key)
    require_operand(df, measure)
    name = f"{agg}_{measure}"
    if agg == "median":
        result = grouped_quantiles(df, [key], measure, {name: 0.5})
    else:
        result = _present(df, [key]).groupBy(ref(key)).agg(aggregate_column(agg, ref(measure)).alias(name))
    ordered = result.orderBy(ref(name).desc_nulls_last(), ref(key))
    return ordered.select(ref(key), _rounded(result, name, 2).alias(name))


def _headers(values: DataFrame, name: str, limit: int | None) -> list:
    """The distinct values in order; an error beyond ``limit``."""
    found = values.distinct() if limit is None else values.distinct().limit(limit + 1)
    headers = sorted(r[0] for r in found.collect())
    if limit is not None and len(headers) > limit:
        raise ValueError(f"'{name}' has more than {limit} distinct values")
    return headers


def pivot_table(
    df: DataFrame, index: str, values: str, agg: str = "mean", columns: str | None = None,
    max_columns: int | None = MAX_PIVOT_COLUMNS,
) -> DataFrame:
    """Index by optional column values; cells rounded to 2 decimals, all-empty columns dropped.

    More than ``max_columns`` column values are an error; None lifts the limit.
    """
    if agg not in PIVOT_AGGREGATES:
        raise ValueError(f"agg must be one of {PIVOT_AGGREGATES}, got '{agg}'")
    require_columns(df, [index, values] + ([columns] if columns else []))
    cell = aggregate_column(agg, ref(values))
    if columns is None:
        flat = _present(df, [index]).groupBy(ref(index)).agg(cell.alias(values))
        return flat.where(ref(values).isNotNull()).select(ref(index), _rounded(flat, values, 2).alias(values)).orderBy(ref(index))
    # the source is aggregated once; headers and cells are both read from the materialised groups
    cells = materialize(
        _present(df, [index, columns])
        .groupBy(ref(index).alias("_i"), ref(columns).alias("_c"))
        .agg(cell.alias("_v"))
        .where("_v is not null")
    )
    headers = _headers(cells.select("_c"), columns, max_columns)
    numeric = isinstance(cells.schema["_v"].dataType, T.NumericType)
    kept = [F.max(F.when(F.col("_c") == h, F.col("_v"))) for h in headers]
    wide = cells.groupBy("_i").agg(*[(F.round(k, 2) if numeric else k).alias(str(h)) for h, k in zip(headers, kept)])
    return wide.withColumnRenamed("_i", index).orderBy(ref(index))


def grouped_mean(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Mean of ``y`` per ``x`` (and colour), in key order: bar, line and area data."""
    keys = [x] + ([color] if color else [])
    require_columns(df, [*keys, y])
    return (
        _present(df, keys)
        .groupBy(*[ref(k) for k in keys])
        .agg(F.avg(ref(y)).alias(y))
        .orderBy(*[ref(k) for k in keys])
    )


def value_counts(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Most frequent values first; ties in value order."""
    require_operand(df, column)
    counted = _present(df, [column]).groupBy(ref(column)).agg(F.count("*").alias("Count"))
    ordered = counted.orderBy(F.desc("Count"), ref(column))
    return ordered.limit(k) if k is not None else ordered


def contingency_table(df: DataFrame, a: str, b: str, max_columns: int | None = MAX_PIVOT_COLUMNS) -> DataFrame:
    """Counts of ``a`` by ``b``; pairs that never occur count 0.

    More than ``max_columns`` values of ``b`` are an error; None lifts the limit.
    """
    counted = materialize(_present(df, [a, b]).groupBy(ref(a), ref(b)).agg(F.count("*").alias("_n")))
    headers = _headers(counted.select(ref(b)), b, max_columns)
    cells = [
        F.coalesce(F.sum(F.when(ref(b) == h, F.col("_n"))), F.lit(0)).alias(str(h)) for h in headers
    ]
    return counted.groupBy(ref(a)).agg(*cells).orderBy(ref(a))


# -- summaries ----------------------------------------------------------------------------


def describe(df: DataFrame, columns: list[str] | None = None, percentiles=(0.25, 0.5, 0.75), digits: int = 2, approx: bool = False) -> DataFrame:
    """One row per numeric column: count, mean, std, min, percentiles (exact by default), max."""
    columns = numeric_columns(df) if columns is None else columns
    points = column_quantiles(df, {c: list(percentiles) for c in columns}, approx=approx)
    cells = []
    for c in columns:
        x = ref(c).cast("double")
        items = [F.lit(c).alias("column"), F.count(x).alias("count")]
        items += [F.round(f(x), digits).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min))]
        for p, v in zip(percentiles, points[c]):
            items.append(F.round(F.lit(v).cast("double"), digits).alias(f"p{round(p * 100)}"))
        items.append(F.round(F.max(x), digits).alias("max"))
        cells.append(F.struct(*items))
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def shape_statistics(df: DataFrame, columns: list[str] | None = None, digits: int = 3) -> DataFrame:
    """Skewness, excess kurtosis, coefficient of variation, range and IQR per numeric column."""
    columns = numeric_columns(df) if columns is None else columns
    quartiles = column_quantiles(df, {c: [0.25, 0.75] for c in columns})
    cells = []
    for c in columns:
        x = ref(c).cast("double")
        q1, q3 = quartiles[c]
        iqr = None if q1 is None else q3 - q1
        variation = F.when(F.avg(x) == 0, 0.0).otherwise(F.try_divide(F.stddev_samp(x), F.avg(x)))
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.round(sample_skewness(x), digits).alias("skewness"),
                F.round(sample_kurtosis(x), digits).alias("kurtosis"),
                F.round(variation, digits).alias("cv"),
                F.round(F.max(x) - F.min(x), digits).alias("range"),
                F.round(F.lit(iqr).cast("double"), digits).alias("iqr"),
            )
        )
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def value_census(df: DataFrame, columns: list[str] | None = None, whole_values: bool = True) -> DataFrame:
    """Distinct count, most and least frequent value of each column, from one shuffle.

    Values are counted under (column, value), combined before the shuffle, so a dominant
    value costs no more than a rare one.  Long texts are counted by digest and compared by their
    beginning; whole texts are only fetched for the winners.  Without ``whole_values`` long texts
    appear as digests: enough for distinct counts, not for showing the values.
    """
    columns = flat_columns(df) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, distinct long, top_value string, top_count long, bottom_value string, bottom_count long"
        )
    pairs = [
        F.struct(
            F.lit(i).alias("_i"), grouping_key(df, c).cast("string").alias("_v"),
            (F.left(ref(c), F.lit(DIGEST_LENGTH)) if is_text(df.schema[c].dataType) and whole_values else F.lit(None).cast("string")).alias("_start"),
        )
        for i, c in enumerate(columns)
    ]
    counted = (
        df.select(F.inline(F.array(*pairs)))
        .where("_v is not null")
        .groupBy("_i", "_v", "_start")
        .agg(F.count("*").alias("_n"))
        .withColumn("_v", F.coalesce("_start", "_v"))
    )
    # smallest value among equally frequent ones for the top, largest for the bottom
    per_column = counted.groupBy("_i").agg(
        F.count("*").alias("distinct"),
        F.min(F.struct((-F.col("_n")).alias("m"), F.col("_v").alias("v"))).alias("top"),
        F.max(F.struct((-F.col("_n")).alias("m"), F.col("_v").alias("v"))).alias("bottom"),
    )
    texts = [i for i, c in enumerate(columns) if is_text(df.schema[c].dataType)] if whole_values else []
    whole = []
    if texts:
        per_column = materialize(per_column)  # one row per column
        for row in per_column.where(F.col("_i").isin(texts)).collect():
            whole += [(row["_i"], side, -row[side]["m"], row[side]["v"]) for side in ("top", "bottom") if len(row[side]["v"]) == DIGEST_LENGTH]
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "_i int, column string")
    joined = F.broadcast(names).join(per_column, "_i", "left")  # one row per column
    top, bottom = F.col("top.v"), F.col("bottom.v")
    if whole:
        joined = joined.join(_whole_texts(df, columns, whole), "_i", "left")
        top, bottom = F.coalesce("top_text", top), F.coalesce("bottom_text", bottom)
    return joined.orderBy("_i").select(
        "column",
        F.coalesce("distinct", F.lit(0)).alias("distinct"),
        top.alias("top_value"),
        (-F.col("top.m")).alias("top_count"),
        bottom.alias("bottom_value"),
        (-F.col("bottom.m")).alias("bottom_count"),
    )


def _whole_texts(df: DataFrame, columns: list[str], wanted: list[tuple[int, str, int, str]]) -> DataFrame:
    """_i, top_text, bottom_text of winners known by (column, side, count, beginning).

    Texts that begin so are counted by digest; those with the wanted count are few unless most texts
    share their beginning, and only they are fetched, one per task and column.
    """
    begun = df.select(F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("_i"), F.lit(side).alias("_side"), F.lit(n).cast("long").alias("_wanted"),
            F.when(F.left(ref(columns[i]), F.lit(DIGEST_LENGTH)) == start, ref(columns[i])).alias("_text"),
        )
        for i, side, n, start in wanted
    ]))).where("_text is not null").withColumn("_digest", F.sha2("_text", 256))
    winners = begun.groupBy("_i", "_side", "_wanted", "_digest").agg(F.count("*").alias("_n")).where("_n = _wanted")
    found = begun.join(small_side(winners.select("_i", "_side", "_digest")), ["_i", "_side", "_digest"], "left_semi")
    return found.groupBy("_i").agg(
        F.min(F.when(F.col("_side") == "top", F.col("_text"))).alias("top_text"),
        F.max(F.when(F.col("_side") == "bottom", F.col("_text"))).alias("bottom_text"),
    )


def categorical_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values with the most and least common one per text column."""
    columns = text_columns(df) if columns is None else columns
    return value_census(df, columns).select(
        "column",
        F.col("distinct").alias("unique_values"),
        F.coalesce("top_value", F.lit("N/A")).alias("most_common"),
        F.coalesce("top_count", F.lit(0)).alias("most_common_freq"),
        F.coalesce("bottom_value", F.lit("N/A")).alias("least_common"),
        F.coalesce("bottom_count", F.lit(0)).alias("least_common_freq"),
    )


def column_overview(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: type, rows, non-null, null and distinct counts.

    Exact distinct counts shuffle every distinct value once; ``approx`` counts them within 5 %
    in the same scan as the rest.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    cells = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.lit(kinds[c]).alias("type"),
            F.count("*").alias("rows"),
            F.count(ref(c)).alias("non_null"),
            F.count_if(ref(c).isNull()).alias("nulls"),
            (F.approx_count_distinct(ref(c)) if approx else F.lit(None).cast("long")).alias("distinct"),
        )
        for i, c in enumerate(df.columns)
    ]
    basic = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    if approx:
        return basic.orderBy("position").drop("position")
    census = value_census(df, whole_values=False).select("column", "distinct")
    return basic.drop("distinct").join(census, "column", "left").orderBy("position").drop("position")
