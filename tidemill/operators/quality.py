"""Profiles, quality scores and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Row, functions as F

from tidemill.functions import wording
from tidemill.functions.scalars import number_like, share_pct
from tidemill.functions.types import grouping_key, numeric_columns, ref, text_columns
from tidemill.operators.aggregate import value_census
from tidemill.operators.clean import outlier_rows
from tidemill.plans.firstcells import first_cells
from tidemill.plans.quantiles import fences

VERY_LARGE_ROWS = 1_000_000


def _weighted(df: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies: one shuffle serves counts and duplicates.

    Columns ``k{i}`` stand in for the table's columns; ``like{i}`` says whether the i-th text
    column reads as a number.
    """
    keys = [grouping_key(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]
    likes = [number_like(ref(c)).alias(f"like{i}") for i, c in enumerate(text_columns(df))]
    rows = df.select(*keys, *likes)
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies"))


def _weighted_missing(df: DataFrame):
    """Missing cells counted over the output of ``_weighted``."""
    holes = [F.when(F.col(f"k{i}").isNull(), 1).otherwise(0) for i in range(len(df.columns))]
    return F.coalesce(F.sum(reduce(lambda a, b: a + b, holes) * F.col("_copies")), F.lit(0))


def quality_score(df: DataFrame) -> DataFrame:
    """Completeness (50), duplicates (25) and type consistency (25) as one row with the score."""
    w = F.col("_copies")
    texts = text_columns(df)
    aggs = [
        F.coalesce(F.sum(w), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(w - 1), F.lit(0)).alias("duplicates"),
        _weighted_missing(df).alias("missing"),
    ]
    for i, c in enumerate(texts):
        present = F.col(f"k{df.columns.index(c)}").isNotNull()
        aggs.append(F.sum(F.when(present, w)).alias(f"n{i}"))
        aggs.append(F.sum(F.when(present & F.col(f"like{i}"), w).otherwise(0)).alias(f"l{i}"))
    totals = _weighted(df).agg(*aggs)
    cells = F.col("rows") * len(df.columns)
    completeness = F.try_divide((cells - F.col("missing")).cast("double"), cells.cast("double")) * 50
    repeated = F.try_divide(F.col("duplicates").cast("double"), F.col("rows").cast("double"))
    uniqueness = F.greatest(F.lit(0.0), 25 * (1 - repeated * 5))
    mixed = F.lit(0)
    for i in range(len(texts)):
        ratio = F.try_divide(F.col(f"l{i}").cast("double"), F.col(f"n{i}").cast("double"))
        mixed = mixed + F.when((ratio > 0.1) & (ratio < 0.9), 1).otherwise(0)
    types = F.lit(25.0) if not texts else 25 - mixed / len(texts) * 25
    total = F.bround(completeness + uniqueness + types, 0)
    score = F.when(F.col("rows") == 0, 0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), total)))
    return totals.select(
        "rows",
        "duplicates",
        "missing",
        F.coalesce(F.round(completeness, 4), F.lit(0.0)).alias("completeness_points"),
        F.coalesce(F.round(uniqueness, 4), F.lit(0.0)).alias("duplicate_points"),
        F.round(types, 4).alias("type_points"),
        score.cast("int").alias("score"),
    )


def column_profiles(df: DataFrame, samples: int = 5, order_by=None) -> DataFrame:
    """Per column: type, counts, moments or mode, and a few sample values.

    Samples are the first values in ``order_by`` order, or any values without one.
    """
    numeric = set(numeric_columns(df))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    none = F.lit(None).cast("double")
    cells = []
    for i, c in enumerate(df.columns):
        x = ref(c).cast("double") if c in numeric else None
        cells.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.lit(kinds[c]).alias("dtype"),
                F.count(ref(c)).alias("non_null"),
                share_pct(F.count_if(ref(c).isNull()), F.count("*")).alias("null_pct"),
                (F.round(F.avg(x), 4) if c in numeric else none).alias("mean"),
                (F.round(F.stddev_samp(x), 4) if c in numeric else none).alias("std"),
                (F.min(x) if c in numeric else none).alias("min"),
                (F.max(x) if c in numeric else none).alias("max"),
            )
        )
    basic = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    census = value_census(df).select("column", F.col("distinct").alias("unique"), F.col("top_value"))
    out = basic.join(census, "column", "left")
    out = out.withColumn("mode", F.when(~F.col("column").isin(list(numeric)), F.col("top_value"))).drop("top_value")
    if samples:
        out = out.join(column_samples(df, samples, order_by), "column", "left")
        out = out.withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
    return out.orderBy("position").drop("position")


def column_samples(df: DataFrame, n: int, order_by=None) -> DataFrame:
    """The first ``n`` non-null values per column as text, all columns from one scan."""
    orders = [] if order_by is None else ([order_by] if isinstance(order_by, str) else list(order_by))
    # at most n rows per column reach this aggregate
    ranked = first_cells(df, n, orders).groupBy("column").agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("s"))
    return ranked.select("column", F.transform("s", lambda s: s["value"]).alias("sample_values"))


def quality_report(df: DataFrame) -> DataFrame:
    """Per column: nulls and distinct values in count and percent, min, max and mean."""
    numeric = set(numeric_columns(df))
    none = F.lit(None).cast("double")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    cells = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.lit(kinds[c]).alias("dtype"),
            F.count("*").alias("rows"),
            F.count(ref(c)).alias("non_null_count"),
            F.count_if(ref(c).isNull()).alias("null_count"),
            share_pct(F.count_if(ref(c).isNull()), F.count("*")).alias("null_percentage"),
            (F.min(ref(c)).cast("double") if c in numeric else none).alias("min"),
            (F.max(ref(c)).cast("double") if c in numeric else none).alias("max"),
            (F.round(F.avg(ref(c)), 2) if c in numeric else none).alias("mean"),
        )
        for i, c in enumerate(df.columns)
    ]
    basic = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    census = value_census(df, whole_values=False).select("column", F.col("distinct").alias("unique_count"))
    return (
        basic.join(census, "column", "left")
        .withColumn("unique_percentage", share_pct(F.col("unique_count"), F.col("rows")))
        .orderBy("position")
        .drop("position", "rows")
    )


def quality_totals(df: DataFrame) -> DataFrame:
    """Rows, columns, cells, duplicates and completeness of the whole table in one row."""
    w = F.col("_copies")
    totals = _weighted(df).agg(
        F.coalesce(F.sum(w), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(w - 1), F.lit(0)).alias("duplicate_rows"),
        _weighted_missing(df).alias("missing_values"),
    )
    width = F.lit(len(df.columns))
    cells = F.col("total_rows") * width
    return totals.select(
        "total_rows",
        width.alias("total_columns"),
        cells.alias("total_cells"),
        "missing_values",
        "duplicate_rows",
        share_pct(cells - F.col("missing_values"), cells).alias("completeness_score"),
        share_pct(F.col("duplicate_rows"), F.col("total_rows")).alias("duplicate_percentage"),
    )


def guided_score(df: DataFrame) -> DataFrame:
    """Completeness less half the duplicate percentage, not below 0."""
    score = F.greatest(F.lit(0.0), F.col("completeness_score") - 0.5 * F.col("duplicate_percentage"))
    return quality_totals(df).select(F.round(score, 4).alias("guided_score"))


def missing_table(df: DataFrame) -> DataFrame:
    """Columns with missing values, their count and percent."""
    cells = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.count_if(ref(c).isNull()).alias("missing"),
            share_pct(F.count_if(ref(c).isNull()), F.count("*")).alias("missing_pct"),
        )
        for i, c in enumerate(df.columns)
    ]
    rows = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return rows.where("missing > 0").orderBy("position").drop("position")


def validate_table(df: DataFrame) -> DataFrame:
    """Load check: one row with ``is_valid`` and the list of issues."""
    spark = df.sparkSession
    if not df.columns:
        empty = [wording.NO_COLUMNS]
        if df.isEmpty():
            empty.insert(0, wording.NO_ROWS)
        return spark.createDataFrame([Row(is_valid=False, issues=empty)])
    row = df.agg(F.count("*").alias("rows"), *[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    issues = []
    if row["rows"] == 0:
        issues.append(wording.NO_ROWS)
    if row["rows"] > VERY_LARGE_ROWS:
        issues.append(wording.VERY_LARGE.format(rows=row["rows"]))
    blank = [c for i, c in enumerate(df.columns) if row[f"n{i}"] == 0]
    if blank:
        issues.append(wording.ALL_EMPTY.format(columns=", ".join(blank)))
    # size alone is a warning
    valid = row["rows"] > 0 and not blank
    return spark.createDataFrame([(valid, issues)], "is_valid boolean, issues array<string>")


def detect_anomalies(df: DataFrame) -> DataFrame:
    """Numeric columns with values outside the 1.5 IQR fences."""
    columns = numeric_columns(df)
    bounds = {c: b for c, b in fences(df, columns).items() if b[0] is not None}
    schema = "column string, count long, lower_bound double, upper_bound double"
    if not bounds:
        return df.sparkSession.createDataFrame([], schema)
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if((ref(c) < lo) | (ref(c) > hi)).alias("count"),
            F.round(F.lit(lo), 2).alias("lower_bound"),
            F.round(F.lit(hi), 2).alias("upper_bound"),
        )
        for c, (_, _, lo, hi) in bounds.items()
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).where("count > 0")


def anomalous_rows(df: DataFrame, column: str, n: int = 10, order_by=None) -> DataFrame:
    """A few rows outside the column's fences."""
    return outlier_rows(df, column, 1.5, n, order_by)


def data_dictionary(df: DataFrame, descriptions: dict[str, str] | None = None, order_by=None) -> DataFrame:
    """Column, type, filled / total, distinct values, three samples and the user's description."""
    total = df.count()
    profile = column_profiles(df, 3, order_by)
    notes = df.sparkSession.createDataFrame(
        [(i, c, (descriptions or {}).get(c, "")) for i, c in enumerate(df.columns)],
        "position int, column string, description string",
    )
    joined = F.array_join("sample_values", ", ")
    shown = F.when(F.length(joined) > 80, F.concat(F.substring(joined, 1, 77), F.lit("..."))).otherwise(joined)
    return (
        F.broadcast(notes)  # one row per column
        .join(profile, "column", "left")
        .orderBy("position")
        .select(
            "column",
            F.col("dtype").alias("data_type"),
            F.concat(F.format_number("non_null", 0), F.lit(f" / {total:,}")).alias("non_null_count"),
            F.col("unique").alias("unique_values"),
            shown.alias("sample_values"),
            "description",
        )
    )


def dictionary_markdown(df: DataFrame, name: str, descriptions: dict[str, str] | None = None) -> str:
    rows = data_dictionary(df, descriptions).collect()
    total = rows[0]["non_null_count"].split(" / ")[1] if rows else "0"
    lines = [f"# Data Dictionary - {name}\n", f"**Rows:** {total} | **Columns:** {len(rows)}\n"]
    lines += ["| Column | Type | Non-Null | Unique | Description |", "|--------|------|----------|--------|-------------|"]
    lines += [
        f"| {r['column']} | {r['data_type']} | {r['non_null_count']} | {r['unique_values']} | {r['description']} |" for r in rows
    ]
    return "\n".join(lines)


def report_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The tables of the written report: overview, columns, quality and missing values."""
    overview = df.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(text_columns(df))).alias("categorical_columns"),
    )
    columns = quality_report(df).select("column", "dtype", "non_null_count", F.round("null_percentage", 1).alias("null_pct"))
    return {"overview": overview, "columns": columns, "quality": quality_totals(df), "missing": missing_table(df)}
