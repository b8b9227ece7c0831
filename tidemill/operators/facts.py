"""The driver-side facts about one table that profiles, scores and insights share.

Each property is one Spark job over the whole table and is computed at most once; every
value held here is bounded by the number of columns, not rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.types import numeric_columns, ref, text_columns
from tidemill.operators.aggregate import value_census
from tidemill.operators.charts import correlation_pairs
from tidemill.operators.clean import duplicate_count
from tidemill.plans.quantiles import column_quantiles


class TableFacts:
    def __init__(self, df: DataFrame):
        self.df = df
        self.columns = df.columns
        self.types = {f.name: f.dataType.simpleString() for f in df.schema}
        self.numeric = numeric_columns(df)
        self.text = text_columns(df)

    @cached_property
    def basics(self) -> dict:
        """Row count, non-null count per column and moments per numeric column, in one scan."""
        aggs = [F.count("*").alias("rows")]
        for i, c in enumerate(self.columns):
            aggs.append(F.count(ref(c)).alias(f"n{i}"))
            if c in self.numeric:
                x = ref(c).cast("double")
                aggs += [
                    F.avg(x).alias(f"mean{i}"),
                    F.stddev_samp(x).alias(f"std{i}"),
                    F.min(x).alias(f"min{i}"),
                    F.max(x).alias(f"max{i}"),
                ]
        return self.df.agg(*aggs).first().asDict()

    @property
    def rows(self) -> int:
        return self.basics["rows"]

    @property
    def cells(self) -> int:
        return self.rows * len(self.columns)

    def non_null(self, column: str) -> int:
        return self.basics[f"n{self.columns.index(column)}"]

    def nulls(self, column: str) -> int:
        return self.rows - self.non_null(column)

    def moment(self, kind: str, column: str):
        return self.basics[f"{kind}{self.columns.index(column)}"]

    @cached_property
    def missing(self) -> int:
        return sum(self.nulls(c) for c in self.columns)

    @property
    def completeness(self) -> float:
        """Filled cells in percent; an empty table counts as complete."""
        return (self.cells - self.missing) / self.cells * 100 if self.cells else 100.0

    @cached_property
    def census(self) -> dict:
        """Distinct, top and bottom values of the text columns."""
        return {r["column"]: r.asDict() for r in value_census(self.df, self.text).collect()}

    @cached_property
    def duplicates(self) -> int:
        return duplicate_count(self.df).first()["duplicate_rows"]

    @cached_property
    def quartiles(self) -> dict:
        return column_quantiles(self.df, {c: [0.25, 0.5, 0.75] for c in self.numeric})

    def fence(self, column: str):
        """``(iqr, lower, upper)`` or None without values."""
        q1, _, q3 = self.quartiles[column]
        if q1 is None:
            return None
        iqr = q3 - q1
        return iqr, q1 - 1.5 * iqr, q3 + 1.5 * iqr

    @cached_property
    def outliers(self) -> dict:
        """Rows outside the fences per numeric column, counted together."""
        usable = [c for c in self.numeric if self.fence(c)]
        if not usable:
            return {}
        row = self.df.agg(
            *[
                F.count_if((ref(c) < self.fence(c)[1]) | (ref(c) > self.fence(c)[2])).alias(f"n{i}")
                for i, c in enumerate(usable)
            ]
        ).first()
        return {c: row[f"n{i}"] for i, c in enumerate(usable)}

    @cached_property
    def correlations(self) -> list:
        """``(column_a, column_b, r)`` for every numeric pair, in column order."""
        rows = correlation_pairs(self.df, self.numeric).collect()
        return [(r["column_a"], r["column_b"], r["r"]) for r in rows]

    def strongest(self):
        """The pair with the largest |r|; the first one among ties, None below two columns."""
        best = None
        for a, b, r in self.correlations:
            if best is None or abs(r or 0.0) > abs(best[2] or 0.0):
                best = (a, b, r)
        return best
