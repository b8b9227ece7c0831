"""Key figures: detection, cards with first-half / second-half change, and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemill.functions import wording
from tidemill.functions.types import INTEGER_TYPES, is_numeric, numeric_columns, ref, require_columns
from tidemill.plans.quantiles import column_quantiles
from tidemill.plans.roworder import precedes

def detect_kpi_columns(df: DataFrame, scanned: int | None = None, shown: int | None = None) -> DataFrame:
    """Key figures: ratios as percent, complete non-negative integers as totals, else means.

    All numeric columns are looked at and shown; ``scanned`` and ``shown`` keep the first ones.
    """
    columns = numeric_columns(df)[:scanned]
    cells = []
    for i, c in enumerate(columns):
        x = ref(c)
        ratio = (F.max(x) <= 1) & (F.min(x) >= 0)
        whole = isinstance(df.schema[c].dataType, INTEGER_TYPES)
        total = F.lit(whole) & (F.min(x) >= 0) & (F.count_if(x.isNull()) == 0)
        value = (
            F.when(ratio, F.round(F.avg(x) * 100, 1))
            .when(total, F.sum(x).cast("double"))
            .otherwise(F.round(F.avg(x), 2))
        )
        cells.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                value.alias("value"),
                F.when(ratio, f"Avg {c} (%)").when(total, f"Total {c}").otherwise(f"Avg {c}").alias("label"),
                F.when(ratio, "percent").when(total, "integer").otherwise("decimal").alias("format"),
                F.count(x).alias("n"),
            )
        )
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, value double, label string, format string")
    found = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    cards = found.where("n > 0").orderBy("position")
    return (cards if shown is None else cards.limit(shown)).drop("position", "n")


def kpi_card(df: DataFrame, column: str, agg: str = "mean", order_by=None) -> DataFrame:
    """Value of the column and the percent change of its mean from the first to the second half.

    Halves are taken over the non-null values in ``order_by`` order (ending in a unique column).
    """
    require_columns(df, [column])
    if order_by is None:
        raise ValueError("the two halves need order_by")
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    require_columns(df, keys)
    present = df.where(ref(column).isNotNull()).select(*[ref(k).alias(f"_k{i}") for i, k in enumerate(keys)], ref(column).cast("double").alias("_x"))
    total = present.count()
    x = F.col("_x")
    value = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}.get(agg, F.avg)(x).cast("double")
    early = precedes(present, [f"_k{i}" for i in range(len(keys))], total // 2, total)
    first = F.avg(F.when(early, x))
    second = F.avg(F.when(~early, x))
    delta = F.round(F.try_divide(second - first, F.abs(first)) * 100, 1)
    card = present.agg(value.alias("value"), delta.alias("delta"), F.count("*").alias("n"))
    return card.where("n > 0").select(F.round("value", 2).alias("value"), F.lit(f"{agg.capitalize()} of {column}").alias("label"), "delta")


def value_position(df: DataFrame, column: str, value) -> DataFrame:
    """Where a value stands in its column: one row of percentile and distance, or of frequency."""
    require_columns(df, [column])
    x = ref(column)
    if is_numeric(df.schema[column].dataType):
        median = column_quantiles(df, {column: [0.5]})[column][0]
        below = F.try_divide(F.count_if(x < value).cast("double"), F.count(x).cast("double")) * 100
        distance = F.try_divide(F.abs(F.lit(float(value)) - F.avg(x)), F.stddev_samp(x))
        row = df.agg(below.alias("percentile"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), distance.alias("distance"))
        band = F.when(F.col("percentile") >= 95, "top 5%").when(F.col("percentile") <= 5, "bottom 5%").otherwise("middle")
        return row.select(
            F.round("percentile", 4).alias("percentile"),
            F.round("mean", 4).alias("mean"),
            F.lit(median).cast("double").alias("median"),
            F.round("std", 4).alias("std"),
            F.round("distance", 4).alias("std_distance"),
            band.alias("band"),
        )
    hits = F.count_if(x == value)
    return df.agg(
        hits.alias("frequency"),
        F.round(F.try_divide(hits.cast("double"), F.count(x).cast("double")) * 100, 4).alias("share_pct"),
    )


def explain_this_number(df: DataFrame, column: str, value) -> str:
    """One sentence on a value; wording follows the column's kind and the value's band."""
    if column not in df.columns:
        return wording.NO_COLUMN
    row = value_position(df, column, value).first().asDict()
    if row.get("percentile", row.get("share_pct")) is None:
        return wording.NO_VALUES
    shown = {"value": value, "column": column}
    if "percentile" not in row:
        return wording.TEXT_SHARE.format(count=row["frequency"], pct=row["share_pct"], **shown)
    if row["band"] == "middle":
        return wording.MIDDLE.format(share=row["percentile"], mean=row["mean"], median=row["median"], **shown)
    edge, mark, side = ("top", "95th", "above") if row["band"] == "top 5%" else ("bottom", "5th", "below")
    away = "an undefined number of" if row["std_distance"] is None else f"{row['std_distance']:.1f}"
    return wording.EDGE.format(edge=edge, mark=mark, side=side, away=away, mean=row["mean"], **shown)
