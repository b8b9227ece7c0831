"""Statistical tests from a single aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemill.functions import wording
from tidemill.functions.pvalues import chi2_p_value, f_p_value, t_p_value
from tidemill.functions.types import ref, require_columns
from tidemill.plans.session import materialize

SIGNIFICANCE = 0.05


def run_ttest(df: DataFrame, column: str, group_col: str, group_a, group_b) -> DataFrame:
    """Independent two-sample t-test with pooled variance; ``error`` is set when a group is too small."""
    require_columns(df, [column, group_col])
    x = ref(column).cast("double")
    in_a, in_b = (F.when(ref(group_col) == g, x) for g in (group_a, group_b))
    row = df.agg(
        F.count(in_a).alias("n_a"),
        F.count(in_b).alias("n_b"),
        F.avg(in_a).alias("m_a"),
        F.avg(in_b).alias("m_b"),
        F.var_samp(in_a).alias("v_a"),
        F.var_samp(in_b).alias("v_b"),
    )
    n_a, n_b = F.col("n_a"), F.col("n_b")
    enough = (n_a >= 2) & (n_b >= 2)
    dof = (n_a + n_b - 2).cast("double")
    pooled = F.try_divide((n_a - 1) * F.col("v_a") + (n_b - 1) * F.col("v_b"), dof)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b)))
    t = F.when(enough, F.try_divide(F.col("m_a") - F.col("m_b"), error))
    tested = row.withColumns({"t": t, "dof": dof}).withColumn("p", t_p_value("t", "dof"))
    return tested.select(
        F.round("t", 4).alias("t_statistic"),
        F.round("p", 6).alias("p_value"),
        F.round("m_a", 4).alias("mean_a"),
        F.round("m_b", 4).alias("mean_b"),
        "n_a",
        "n_b",
        (F.col("p") < SIGNIFICANCE).alias("significant"),
        F.when(~enough, wording.TTEST_SMALL).alias("error"),
    )


def run_chi_square(df: DataFrame, col_a: str, col_b: str) -> DataFrame:
    """Independence of two columns, with the continuity correction for a 2 x 2 table.

    Only pairs that occur are needed: the statistic is N * (sum(O^2 / (R C)) - 1).
    """
    require_columns(df, [col_a, col_b])
    a, b = ref(col_a), ref(col_b)
    pairs = materialize(
        df.where(a.isNotNull() & b.isNotNull()).groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").cast("double").alias("o"))
    )
    # margins by aggregation and joins, which spread a level with very many pairs; a window would not
    margins = pairs.join(pairs.groupBy("a").agg(F.sum("o").alias("r")), "a").join(
        pairs.groupBy("b").agg(F.sum("o").alias("c")), "b"
    )
    o, r, c = F.col("o"), F.col("r"), F.col("c")
    sums = margins.agg(
        F.sum("o").alias("n"),
        F.sum(o * o / (r * c)).alias("share"),
        F.sum(o / r).alias("rows"),
        F.sum(o / c).alias("cols"),
        F.sum(o / (r * r)).alias("inverse_r"),
        F.sum(o / (c * c)).alias("inverse_c"),
        F.max(F.struct("o", "r", "c")).alias("cell"),
    )
    n = F.col("n")
    rows, cols = (F.round(k).cast("long") for k in (F.coalesce("rows", F.lit(0.0)), F.coalesce("cols", F.lit(0.0))))
    sums = sums.withColumns({"rows": rows, "cols": cols})
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    # in a 2 x 2 table all four deviations have the same size, so one cell gives it
    deviation = F.abs(F.col("cell.o") - F.try_divide(F.col("cell.r") * F.col("cell.c"), n))
    shrunk = deviation - F.least(F.lit(0.5), deviation)
    corrected = shrunk * shrunk * n * F.col("inverse_r") * F.col("inverse_c")
    chi2 = F.when(dof == 1, corrected).otherwise(n * (F.col("share") - 1))
    enough = (F.col("rows") >= 2) & (F.col("cols") >= 2)
    tested = sums.withColumns({"dof": dof, "chi2": F.when(enough, chi2)}).withColumn(
        "p", chi2_p_value("chi2", F.col("dof").cast("double"))
    )
    return tested.select(
        F.round("chi2", 4).alias("chi2"),
        F.round("p", 6).alias("p_value"),
        "dof",
        (F.col("p") < SIGNIFICANCE).alias("significant"),
        F.when(~enough, wording.CHI2_SMALL).alias("error"),
    )


def anova_groups(df: DataFrame, value_col: str, group_col: str) -> DataFrame:
    """Size and mean of every group with at least two values."""
    x = ref(value_col).cast("double")
    return (
        df.where(ref(group_col).isNotNull())
        .groupBy(ref(group_col).cast("string").alias("group"))
        .agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"))
        .where("n >= 2")
    )


def run_anova(df: DataFrame, value_col: str, group_col: str) -> DataFrame:
    """One-way analysis of variance over the groups with at least two values."""
    require_columns(df, [value_col, group_col])
    n, mean = F.col("n").cast("double"), F.col("mean")
    groups = materialize(anova_groups(df, value_col, group_col))
    # deviations from the grand mean: sums of squares would cancel where means are large
    grand = groups.agg(F.try_divide(F.sum(n * mean), F.sum(n))).first()[0] or 0.0
    sums = groups.agg(
        F.count("*").alias("k"),
        F.sum(n).alias("total"),
        F.sum(n * (mean - grand) * (mean - grand)).alias("between"),
        F.sum((n - 1) * F.col("variance")).alias("within"),
    )
    between = F.col("between")
    d1, d2 = (F.col("k") - 1).cast("double"), F.col("total") - F.col("k")
    enough = F.col("k") >= 2
    f = F.when(enough, F.try_divide(F.try_divide(between, d1), F.try_divide(F.col("within"), d2)))
    tested = sums.withColumns({"f": f, "d1": d1, "d2": d2}).withColumn("p", f_p_value("f", "d1", "d2"))
    return tested.select(
        F.round("f", 4).alias("f_statistic"),
        F.round("p", 6).alias("p_value"),
        F.col("k").alias("n_groups"),
        (F.col("p") < SIGNIFICANCE).alias("significant"),
        F.when(~enough, wording.ANOVA_SMALL).alias("error"),
    )


def group_means(df: DataFrame, value_col: str, group_col: str) -> DataFrame:
    return anova_groups(df, value_col, group_col).select("group", F.round("mean", 4).alias("mean")).orderBy("group")
