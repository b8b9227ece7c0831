import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions import pvalues
from tidemill.operators import aggregate, charts, insights, kpi, models, quality, stats, timeseries, validate
from tidemill.operators.forecast import holt_winters, run_time_series_forecast

# -- grouping and summaries ---------------------------------------------------------------


@pytest.fixture
def groups(spark):
    data = [("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", None), (None, 9.0)]
    return spark.createDataFrame(data, "g string, x double")


@pytest.mark.parametrize(
    "agg,wanted",
    [
        ("mean", {"a": 2.0, "b": 5.0, "c": None}),
        ("sum", {"a": 4.0, "b": 5.0, "c": 0.0}),
        ("count", {"a": 2, "b": 1, "c": 0}),
        ("std", {"a": 1.41, "b": None, "c": None}),
        ("median", {"a": 2.0, "b": 5.0, "c": None}),
    ],
)
def test_group_rules(groups, agg, wanted):
    found = aggregate.group_aggregate(groups, "g", "x", agg)
    assert found.columns == ["g", f"{agg}_x"]
    assert {r[0]: r[1] for r in found.collect()} == wanted


def test_pivot_drops_missing_keys_and_empty_columns(spark):
    df = spark.createDataFrame([("a", "u", 1.0), ("a", "v", None), ("b", "u", 2.0), (None, "u", 3.0), ("b", None, 4.0)], "i string, c string, x double")
    out = aggregate.pivot_table(df, "i", "x", "mean", "c")
    assert out.columns == ["i", "u"]
    assert [tuple(r) for r in out.collect()] == [("a", 1.0), ("b", 2.0)]


def test_pivot_totals_equal_group_totals(tables):
    df = tables("lineitem")
    wide = aggregate.pivot_table(df, "l_returnflag", "l_quantity", "sum", "l_linestatus").collect()
    flat = {r[0]: r[1] for r in aggregate.group_aggregate(df, "l_returnflag", "l_quantity", "sum").collect()}
    assert {r[0]: sum(v or 0 for v in r[1:]) for r in wide} == flat


def test_value_counts_break_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    assert [tuple(r) for r in aggregate.value_counts(df, "v", 2).collect()] == [("a", 2), ("b", 2)]


def test_describe_matches_pandas(spark):
    x = np.random.default_rng(3).gamma(2, 10, 300)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    row = aggregate.describe(df, ["x"], digits=6).first()
    wanted = pd.Series(x).describe()
    np.testing.assert_allclose([row[k] for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")], wanted.to_numpy(), atol=1e-6)
    shape = aggregate.shape_statistics(df, ["x"], 6).first()
    np.testing.assert_allclose([shape["skewness"], shape["kurtosis"]], [pd.Series(x).skew(), pd.Series(x).kurt()], atol=1e-6)


def test_shapes_of_degenerate_columns(spark):
    df = spark.createDataFrame([(5.0, 1.0, None)] * 5 + [(5.0, -1.0, 2.0)], "c double, x double, few double")
    rows = {r["column"]: r for r in aggregate.shape_statistics(df).collect()}
    assert (rows["c"]["skewness"], rows["c"]["kurtosis"], rows["c"]["iqr"]) == (0.0, 0.0, 0.0)
    assert rows["few"]["skewness"] is None


def test_census_of_duplicates_nulls_and_signed_zero(spark):
    df = spark.createDataFrame([(0.0, "x"), (-0.0, "x"), (1.0, None)], "a double, b string")
    rows = {r["column"]: r for r in aggregate.value_census(df).collect()}
    assert rows["a"]["distinct"] == 2 and rows["a"]["top_count"] == 2
    assert (rows["b"]["distinct"], rows["b"]["top_value"], rows["b"]["bottom_value"]) == (1, "x", "x")


def test_correlation_of_a_constant_is_unknown(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 3.0, 5.0), (1.0, 5.0, 9.0)], "k double, x double, y double")
    rows = {(r["column_a"], r["column_b"]): r["r"] for r in charts.correlation_pairs(df).collect()}
    assert rows["k", "x"] is None and rows["x", "y"] == pytest.approx(1.0)
    assert [r[0] for r in charts.correlated_pairs(df).select("strength").collect()] == ["strong"]
    assert charts.correlation_matrix(df.select("k")) is None


def test_histogram_counts_every_value(tables):
    df = tables("events")
    assert charts.histogram(df, "value", 13).agg(F.sum("count")).first()[0] == df.count()
    single = charts.histogram(df.select(F.lit(2.0).alias("v")), "v").agg(F.sum("count")).first()[0]
    assert single == df.count()


def test_scatter_keeps_all_rows_unless_asked(tables):
    df = tables("events")
    assert charts.scatter_data(df, "user_id", "value").count() == df.count()
    assert 0 < charts.scatter_data(df, "user_id", "value", max_rows=100).count() < 200
    assert charts.scatter_pairs(tables("lineitem"))[0] == ("l_orderkey", "l_partkey")


def test_key_figures(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0), (4, None), (5, 60.0)], "i int, x double")
    card = kpi.kpi_card(df, "x", "sum", "i").first()
    assert (card["value"], card["label"], card["delta"]) == (120.0, "Sum of x", 200.0)
    empty = spark.createDataFrame([(1, None)], "i int, x double")
    assert kpi.kpi_card(empty, "x", "mean", "i").count() == 0
    assert "top 5%" in kpi.explain_this_number(df, "x", 1000)
    assert kpi.explain_this_number(df, "nope", 1) == "Cannot explain: column not found."
    assert kpi.explain_this_number(empty, "x", 1) == "Cannot explain: column has no data."


# -- time series --------------------------------------------------------------------------


@pytest.fixture
def moments(spark):
    rng = np.random.default_rng(11)
    when = pd.Timestamp("2021-01-03") + pd.to_timedelta(rng.integers(0, 400 * 24, 60), unit="h")
    pdf = pd.DataFrame({"t": when, "x": rng.normal(10, 3, 60).round(3)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("freq", ["D", "W", "MS", "QS", "YS"])
@pytest.mark.parametrize("agg", ["sum", "mean", "min", "max", "count"])
def test_periods_match_resample(moments, freq, agg):
    pdf, df = moments
    found = timeseries.build_time_series(df, "t", "x", freq, agg).orderBy("Period").toPandas()
    wanted = pdf.set_index("t").resample(freq)["x"].agg(agg).reset_index()
    assert found["Period"].tolist() == wanted["t"].tolist()
    np.testing.assert_allclose(found["x"].astype(float), wanted["x"].astype(float))


def test_changes_match_pct_change(moments):
    pdf, df = moments
    found = timeseries.compute_time_intelligence(df, "t", "x", "MS", "sum", 3).orderBy("Period").toPandas()
    series = pdf.set_index("t").resample("MS")["x"].sum()
    wanted = (series.pct_change(fill_method=None) * 100).replace([np.inf, -np.inf], np.nan)
    np.testing.assert_allclose(found["MoM %"].astype(float), wanted.round(2), atol=0.011)
    np.testing.assert_allclose(found["3-Period Rolling Avg"], series.rolling(3, min_periods=1).mean().round(2), atol=0.011)


def test_sundays_close_their_week(spark):
    df = spark.createDataFrame([("2024-01-07 10:00:00", 1.0), ("2024-01-08 00:00:00", 2.0), ("2024-01-14 23:00:00", 3.0)], "t string, x double")
    found = timeseries.build_time_series(df, "t", "x", "W", "sum").orderBy("Period").collect()
    assert [(str(r["Period"])[:10], r["x"]) for r in found] == [("2024-01-07", 1.0), ("2024-01-14", 5.0)]


def test_empty_series_keeps_its_columns(spark):
    df = spark.createDataFrame([("not a date", 1.0)], "t string, x double")
    out = timeseries.compute_time_intelligence(df, "t", "x", "QS")
    assert out.columns == ["Period", "x", "QoQ %", "YoY %", "3-Period Rolling Avg"] and out.count() == 0


def test_regular_grids(spark):
    def grid(dates, freq_values=None):
        pdf = pd.DataFrame({"t": pd.to_datetime(dates)})
        pdf["x"] = np.arange(len(pdf), dtype=float)
        out = timeseries.regularise(spark.createDataFrame(pdf), "t", "x").orderBy("date").toPandas()
        return out

    daily = grid(pd.date_range("2024-01-01", periods=8))
    assert len(daily) == 8 and set(daily["season"]) == {7} and not daily["is_filled"].any()
    assert set(grid(pd.date_range("2024-01-01", periods=8, freq="W"))["season"]) == {52}
    assert set(grid(pd.date_range("2020-01-01", periods=8, freq="QS"))["season"]) == {4}
    assert set(grid(pd.date_range("2020-01-01", periods=8, freq="ME"))["season"]) == {12}
    assert set(grid(pd.date_range("2010-01-01", periods=8, freq="YS"))["season"]) == {0}
    assert len(grid(pd.bdate_range("2024-01-03", periods=9))) == 9
    assert len(grid(pd.date_range("2024-01-01", periods=5))) == 0  # too few points
    # month starts with a hole: the hole is filled linearly
    holes = [d for i, d in enumerate(pd.date_range("2023-01-01", periods=9, freq="MS")) if i not in (3, 4)]
    filled = grid(holes)
    assert filled["value"].tolist() == pytest.approx([0, 1, 2, 2 + 1 / 3, 2 + 2 / 3, 3, 4, 5, 6])
    assert filled["is_filled"].sum() == 2


def test_holt_winters_recovers_trend_and_season():
    t = np.arange(48)
    season = np.tile([5.0, -3.0, 0.0, -2.0, 4.0, -4.0, 1.0, 2.0, -6.0, 3.0, -1.0, 1.0], 4)
    y = 100 + 2 * t + season
    values, aic, used = holt_winters(y, 12, 12)
    assert used
    np.testing.assert_allclose(values, 100 + 2 * np.arange(48, 60) + season[:12], atol=1e-4)
    line, _, used = holt_winters(3 + 0.5 * np.arange(10), 3, 12)
    assert not used
    np.testing.assert_allclose(line, [8.0, 8.5, 9.0], atol=1e-6)


def test_forecast_per_series(spark):
    days = pd.date_range("2024-01-01", periods=28)
    pdf = pd.concat([pd.DataFrame({"k": k, "t": days, "x": base + np.arange(28.0)}) for k, base in (("a", 0), ("b", 50))])
    out = run_time_series_forecast(spark.createDataFrame(pdf), "t", "x", 5, partition_by="k").toPandas()
    ahead = out[out["type"] == "forecast"].sort_values(["k", "date"])
    assert ahead["date"].min() == pd.Timestamp("2024-01-29")
    np.testing.assert_allclose(ahead["value"], np.r_[28:33, 78:83], atol=1e-3)


def test_summaries_of_stretches_compose():
    from tidemill.operators import forecast

    y = np.random.default_rng(2).normal(size=150).cumsum()
    settings = np.array([[0.3, 0.2, 0.6], [0.9, 0.1, 0.05]])
    whole = forecast._summary(y, 0, 7, settings)
    parts = [forecast._summary(y[a:b], a, 7, settings) for a, b in ((0, 70), (70, 71), (71, 150))]
    joined = forecast._composed(forecast._composed(parts[0], parts[1]), parts[2])
    for a, b in zip(whole, joined):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
    # the quadratic form is the sum of squared one-step errors from any start state
    start = np.random.default_rng(3).normal(size=9)
    level, trend, *season = start
    total = 0.0
    for t, value in enumerate(y):
        e = value - level - trend - season[t % 7]
        total += e * e
        level, trend, season[t % 7] = level + trend + 0.3 * e, trend + 0.3 * 0.2 * e, season[t % 7] + 0.6 * 0.7 * e
    x = np.r_[1, start]
    assert x @ whole[1][0] @ x == pytest.approx(total)
    np.testing.assert_allclose(whole[0][0] @ x, [1, level, trend, *season], atol=1e-9)


@pytest.mark.parametrize("season", [0, 7])
def test_long_series_are_fitted_in_chunks(spark, season):
    rng = np.random.default_rng(1)
    days = pd.date_range("2021-03-01", periods=100)
    pdf = pd.concat([pd.DataFrame({"k": k, "t": days[:n], "x": base + rng.normal(size=n).cumsum() + 3 * np.sin(np.arange(n))}) for k, base, n in (("a", 0, 100), ("b", 5000, 61), ("c", 9, 12))])
    df = spark.createDataFrame(pdf)
    plain = run_time_series_forecast(df, "t", "x", 9, season, "k").orderBy("k", "date").toPandas()
    for chunk, fan_in in ((7, 3),) if season else ((20, 32),):
        found = run_time_series_forecast(df, "t", "x", 9, season, "k", chunk=chunk, fan_in=fan_in).orderBy("k", "date").toPandas()
        assert found[["k", "date", "type", "model"]].equals(plain[["k", "date", "type", "model"]])
        np.testing.assert_allclose(found["value"], plain["value"], rtol=1e-6)
        np.testing.assert_allclose(found["aic"], plain["aic"], atol=0.011)


@pytest.mark.parametrize("freq", ["D", "h", "W", "MS", "ME", "QS", "YS", "B"])
def test_forecast_dates_go_on_with_the_grid(spark, freq):
    moments = pd.date_range("2024-01-29" if freq != "ME" else "2023-11-30", periods=19, freq=freq)
    pdf = pd.DataFrame({"t": moments[:12], "x": np.arange(12.0)})
    out = run_time_series_forecast(spark.createDataFrame(pdf), "t", "x", 7).orderBy("date").toPandas()
    assert out["date"].tolist() == moments.tolist()
    assert out["value"].tolist() == pytest.approx(list(range(19)), abs=1e-3)


def test_even_series_need_no_sequence_and_no_window(spark):
    moments = spark.range(200_000).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("t"), (F.col("id") % 7).cast("double").alias("x"))
    even = timeseries.regularise(moments, "t", "x").where("season = 0")
    assert even.count() == 200_000 and even.where("is_filled").count() == 0
    position = timeseries.even_series(moments, "t", "x")
    assert position.agg(F.max("_i"), F.count_distinct("_i")).first()[:] == (199_999, 200_000)
    plan = even._jdf.queryExecution().optimizedPlan().toString().partition("Union")[2].splitlines()
    points = [line for line in plan if line.startswith(":")]  # the first side of the union
    assert points and not any(word in line for line in points for word in ("Window", "sequence", "Generate"))


def test_trends(spark):
    df = spark.createDataFrame([(2020, 10.0), (2021, 20.0), (2022, 20.0)], "year int, x double")
    row = timeseries.detect_trends(df, "year", "x").first()
    assert (row["trend"], row["total_change_pct"], row["points"]) == ("increasing", 100.0, 3)
    assert timeseries.detect_trends(df.select("x")).count() == 0


# -- quality and validation ---------------------------------------------------------------


def test_quality_of_odd_tables(spark):
    empty = spark.createDataFrame([], "x double, s string")
    assert quality.quality_score(empty).first()["score"] == 0
    assert quality.quality_totals(empty).first()["total_cells"] == 0
    blank = spark.createDataFrame([(None, "1"), (None, "x"), (None, "2")], "x double, s string")
    row = quality.quality_score(blank).first()
    assert (row["missing"], row["type_points"]) == (3, 0.0)
    assert quality.validate_table(blank).first()["is_valid"] is False
    assert quality.validate_table(spark.createDataFrame([(1,)], "x int")).first()["is_valid"] is True


def test_scores_stay_between_0_and_100(spark):
    rng = np.random.default_rng(0)
    for n in (1, 5, 50):
        pdf = pd.DataFrame({"a": rng.choice([1.0, None], n), "b": rng.choice(["1", "x", None], n)})
        schema = "a double, b string"
        assert 0 <= quality.quality_score(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema)).first()["score"] <= 100


def test_profile_and_dictionary(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, None)], "i int, s string")
    rows = {r["column"]: r for r in quality.column_profiles(df, 2, "i").collect()}
    assert rows["s"]["mode"] == "a" and rows["s"]["null_pct"] == 25.0 and rows["s"]["sample_values"] == ["b", "a"]
    assert rows["i"]["mean"] == 2.5 and rows["i"]["mode"] is None
    text = quality.dictionary_markdown(df, "t", {"i": "key"})
    assert "| i | int | 4 / 4 | 4 | key |" in text


def test_validation_rules(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("b", None), (None, "-5")], "s string, n string")
    rules = [
        {"column": "s", "rule_type": "not_null"},
        {"column": "s", "rule_type": "unique"},
        {"column": "n", "rule_type": "range", "params": {"min": 0}},
        {"column": "n", "rule_type": "range"},
        {"column": "s", "rule_type": "allowed_values", "params": {"allowed": [" a ", "z"]}},
        {"column": "s", "rule_type": "regex", "params": {"pattern": "b|x"}},
        {"column": "s", "rule_type": "regex", "params": {"pattern": "("}},
        {"column": "s", "rule_type": "regex", "params": {}},
        {"column": "gone", "rule_type": "unique"},
    ]
    out = validate.run_validation(df, rules)
    assert [(r["status"], r["violations"]) for r in out.collect()] == [
        ("Fail", 1), ("Fail", 2), ("Fail", 2), ("Fail", 1), ("Fail", 1), ("Fail", 2), ("Error", 0), ("Pass", 0), ("Pass", 0),
    ]
    assert tuple(validate.validation_summary(out).first()) == (9, 2, 7)
    assert validate.violating_rows(df, rules[1]).count() == 2
    assert validate.describe_rule(rules[2]) == "`n` ≥ 0"
    assert validate.describe_rule({"column": "c", "rule_type": "allowed_values", "params": {"allowed": list(range(7))}}) == "`c` only in [0, 1, 2, 3, 4, ...]"


def test_patterns_match_at_the_start_only(spark):
    df = spark.createDataFrame([("ab",), ("ba",), ("x\nab",)], "s string")
    rule = {"column": "s", "rule_type": "regex", "params": {"pattern": "(?i)A"}}
    assert {r[0] for r in validate.violating_rows(df, rule).collect()} == {"ba", "x\nab"}


# -- insights -----------------------------------------------------------------------------


def test_insights_of_small_and_empty_tables(spark):
    empty = spark.createDataFrame([], "x double, s string")
    assert insights.insight_rows(empty).count() == 1
    assert insights.insight_cards(empty).count() == 0
    assert insights.executive_brief(empty) == "No data available for executive summary."
    df = spark.createDataFrame([(-5.0, "a"), (-5.1, "a"), (None, "a"), (-4.9, "b")], "x double, s string")
    texts = [r["text"] for r in insights.insight_rows(df).collect()]
    assert any("dominated by 'a'" in t for t in texts)
    assert not any("high variability" in t for t in texts)  # a negative mean alone is not variability
    assert any("x has 1 missing values (25.0%)" in t for t in texts)
    assert insights.confidence(df, "rule_based").first()["level"] == "Low"
    kinds = [r["type"] for r in insights.issue_queue(df).collect()]
    assert kinds[0] == "nulls"
    assert insights.auto_clean(df).where("x is null").count() == 0
    assert insights.row_loss_warning(10, 4) and not insights.row_loss_warning(10, 5)


def test_texts(tables):
    df = tables("customer")
    stats_of = insights.summary_stats(df)
    assert stats_of["shape"]["columns"] == 5
    text = insights.summary_markdown(df, stats_of)
    assert "| Metric | c_custkey |" in text and "No missing values detected." in text
    assert "Sample data (first 10 rows)" in insights.dataset_context(df, 10, "c_custkey")


# -- tests and models ---------------------------------------------------------------------


def test_p_values_match_the_jvm_library(spark):
    lib = spark._jvm.org.apache.commons.math3.distribution
    for dof in (1.0, 4.0, 37.0, 5000.0):
        for t in (0.0, 0.3, 1.7, 4.2, 9.0):
            wanted = 2 * lib.TDistribution(dof).cumulativeProbability(-t)
            assert pvalues.t_two_sided(t, dof) == pytest.approx(wanted, rel=1e-8, abs=1e-14)
        for x in (0.01, 1.0, 5.0, 40.0):
            wanted = 1 - lib.ChiSquaredDistribution(dof).cumulativeProbability(x)
            assert pvalues.chi2_upper(x, dof) == pytest.approx(wanted, abs=1e-10)
            wanted = 1 - lib.FDistribution(dof, 12.0).cumulativeProbability(x)
            assert pvalues.f_upper(x, dof, 12.0) == pytest.approx(wanted, abs=1e-10)


def test_two_group_anova_is_the_squared_t(tables):
    df = tables("orders").where("o_orderstatus in ('F', 'O')")
    t = stats.run_ttest(df, "o_totalprice", "o_orderstatus", "F", "O").first()
    f = stats.run_anova(df, "o_totalprice", "o_orderstatus").first()
    assert f["f_statistic"] == pytest.approx(t["t_statistic"] ** 2, rel=1e-2, abs=1e-3)
    assert f["p_value"] == pytest.approx(t["p_value"], abs=1e-4)


def test_too_little_data_is_reported(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, x double")
    assert stats.run_ttest(df, "x", "g", "a", "b").first()["error"]
    assert stats.run_anova(df, "x", "g").first()["error"]
    assert stats.run_chi_square(df.limit(1), "g", "g").first()["error"]
    assert "error" in models.run_linear_regression(df, "x", ["x"])
    assert "error" in models.run_logistic_regression(df, "g", ["x"])
    assert "error" in models.run_kmeans_clustering(df, ["x"], 3)


def test_corrected_chi_square(spark):
    cells = [("a", "u", 10), ("a", "v", 20), ("b", "u", 30), ("b", "v", 5)]
    df = spark.createDataFrame([(a, b) for a, b, n in cells for _ in range(n)], "a string, b string")
    n, r, c = 65, (30, 35), (40, 25)
    wanted = sum((abs(o - r[i // 2] * c[i % 2] / n) - 0.5) ** 2 / (r[i // 2] * c[i % 2] / n) for i, (_, _, o) in enumerate(cells))
    row = stats.run_chi_square(df, "a", "b").first()
    assert row["chi2"] == pytest.approx(wanted, abs=1e-4) and row["dof"] == 1
    assert row["p_value"] == pytest.approx(math.erfc(math.sqrt(wanted / 2)), abs=1e-6)


def test_regression_matches_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (200, 3))
    y = 3 + x @ [1.5, -2.0, 0.0] + rng.normal(0, 0.3, 200)
    pdf = pd.DataFrame(x, columns=list("abc")).assign(y=y, twin=x[:, 0])
    df = spark.createDataFrame(pdf)
    out = models.run_linear_regression(df, "y", list("abc"))
    beta, *_ = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)
    np.testing.assert_allclose([r["coefficient"] for r in out["coefficients"].collect()], beta, atol=1e-4)
    residual = y - np.c_[np.ones(200), x] @ beta
    row = out["summary"].first()
    assert row["residuals_std"] == pytest.approx(residual.std(), abs=1e-4)
    assert row["r_squared"] == pytest.approx(1 - residual.var() / y.var(), abs=1e-4)
    twins = models.run_linear_regression(df, "y", ["a", "twin"])["coefficients"].collect()
    assert twins[1]["coefficient"] == pytest.approx(twins[2]["coefficient"], abs=1e-3)


def test_logistic_gradient_vanishes(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (300, 2))
    y = (x @ [1.0, -1.0] + rng.logistic(0, 1, 300) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(y=np.where(y == 1, "yes", "no")))
    out = models.run_logistic_regression(df, "y", ["a", "b"])
    b, *w = [r["coefficient"] for r in out["coefficients"].collect()]
    p = 1 / (1 + np.exp(-(x @ w + b)))
    np.testing.assert_allclose(x.T @ (p - y) + w, 0, atol=0.05)
    assert abs((p - y).sum()) < 0.05
    row = out["summary"].first()
    assert row["classes"] == ["no", "yes"] and row["accuracy"] == pytest.approx(((p > 0.5) == y).mean(), abs=1e-4)


def test_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.1, (40, 2)) for m in (0, 10, 20)])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    out = models.run_kmeans_clustering(df, ["a", "b"], 3)
    assert sorted(round(r["a"]) for r in out["centers"].collect()) == [0, 10, 20]
    z = (x - x.mean(0)) / x.std(0)
    wanted = sum(((z[i * 40 : i * 40 + 40] - z[i * 40 : i * 40 + 40].mean(0)) ** 2).sum() for i in range(3))
    assert out["summary"].first()["inertia"] == pytest.approx(wanted, rel=1e-3)
    assert sorted(r["count"] for r in out["labels"].groupBy("cluster").count().collect()) == [40, 40, 40]
    assert models.describe_clusters(out["centers"]).count("Characterized by") == 3
