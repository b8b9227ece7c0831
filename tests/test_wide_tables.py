"""Tables with many columns: pair moments and first cells from one scan each."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import charts, models, quality
from tidemill.plans import gram

from test_scale_routes import plan_of


@pytest.fixture(scope="module")
def holed(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(0, 1, (4_000, 3))
    x = base @ rng.normal(0, 1, (3, 30)) + rng.normal(0, 0.5, (4_000, 30)) + 1e6 * np.arange(30)
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(30)])
    pdf["x3"] = 7.1
    pdf["x5"] = pdf["x5"].where(rng.random(4_000) < 0.2)
    pdf["x6"] = np.nan
    pdf.loc[:9, "x7"] = np.nan
    return pdf, spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf)).repartition(7)


def test_correlations_equal_the_pairwise_aggregates(holed, monkeypatch):
    pdf, df = holed
    wide = {(r["column_a"], r["column_b"]): r["r"] for r in charts.correlation_pairs(df).collect()}
    assert len(wide) == 30 * 29 // 2

    def expected(a, b):
        x, y = pdf.loc[pdf[a].notna() & pdf[b].notna(), [a, b]].to_numpy().T
        x, y = x - x.mean(), y - y.mean()
        return (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum())

    for (a, b), r in wide.items():
        if {a, b} & {"x3", "x6"}:
            assert r is None, (a, b)
        else:
            assert r == pytest.approx(expected(a, b), abs=1e-9), (a, b)
    matrix = charts.correlation_matrix(df).collect()
    monkeypatch.setattr(charts, "BUILT_IN_COLUMNS", 100)
    assert matrix == charts.correlation_matrix(df).collect()


def test_one_scan_for_three_hundred_columns(spark, tmp_path):
    spark.range(500).select(*[F.rand(i).alias(f"x{i}") for i in range(300)]).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    pairs = charts.correlation_pairs(df)
    assert plan_of(pairs).count("FileScan parquet") == 1
    assert pairs.count() == 300 * 299 // 2


def test_odd_values_and_empty_tables(spark, holed):
    _, df = holed
    names = df.columns
    odd = df.withColumn("x0", F.when(F.rand(1) < 0.1, F.lit(float("nan"))).otherwise(F.col("x0")))
    found = {(r["column_a"], r["column_b"]): r["r"] for r in charts.correlation_pairs(odd).collect()}
    assert np.isnan(found["x0", "x1"]) and not np.isnan(found["x1", "x2"])
    none = charts.correlation_pairs(df.where("false")).collect()
    assert all(r["r"] is None for r in none) and len(charts.correlation_matrix(df).columns) == len(names) + 1


def test_regression_with_many_features(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (2_000, 26))
    y = x @ np.arange(26) + 3 + rng.normal(0, 0.1, 2_000)
    df = spark.createDataFrame(pd.DataFrame({**{f"x{i}": x[:, i] for i in range(26)}, "y": y})).repartition(5)
    features = [f"x{i}" for i in range(26)]
    wide = models.run_linear_regression(df, "y", features)
    weights = {r["term"]: r["coefficient"] for r in wide["coefficients"].collect()}
    assert all(weights[f"x{i}"] == pytest.approx(i, abs=0.02) for i in range(26))
    monkeypatch.setattr(models, "BUILT_IN_COLUMNS", 100)
    narrow = models.run_linear_regression(df, "y", features)
    assert wide["coefficients"].collect() == narrow["coefficients"].collect()
    assert wide["summary"].collect() == narrow["summary"].collect()


def test_stretches_of_tasks_are_merged(holed, monkeypatch):
    _, df = holed
    once = gram.pair_moments(df, [F.col(c) for c in df.columns]).orderBy("i", "j").toPandas()
    monkeypatch.setattr(gram, "STRETCH", 2)
    twice = gram.pair_moments(df, [F.col(c) for c in df.columns]).orderBy("i", "j").toPandas()
    pd.testing.assert_frame_equal(once, twice, rtol=1e-9)


def test_first_cells(spark, tmp_path):
    data = [(k, None if k % 3 else f"t{k}", float("nan") if k == 4 else k / 2, k > 50, [k]) for k in range(200)]
    spark.createDataFrame(data, "k int, t string, x double, b boolean, a array<int>").repartition(6).write.parquet(str(tmp_path / "cells"))
    df = spark.read.parquet(str(tmp_path / "cells")).withColumn("gone", F.lit(None).cast("string"))

    def samples(order_by):
        out = quality.column_samples(df, 3, order_by)
        assert plan_of(out).count("FileScan parquet") == 1
        return {r["column"]: r["sample_values"] for r in out.collect()}

    assert samples("k") == {"k": ["0", "1", "2"], "t": ["t0", "t3", "t6"], "x": ["0.0", "0.5", "1.0"], "b": ["false"] * 3, "a": ["[0]", "[1]", "[2]"]}
    assert samples(["b", "x"])["k"] == ["0", "1", "2"]
    # null first, then texts by their bytes
    assert samples(["t", "k"])["k"] == ["1", "2", "4"] and samples(["t"])["t"] == ["t0", "t102", "t105"]
    assert samples(["a"])["k"] == ["0", "1", "2"]
    free = samples(None)
    assert {c: len(v) for c, v in free.items()} == {"k": 3, "t": 3, "x": 3, "b": 3, "a": 3}
    assert quality.column_samples(df.where("false"), 3, "k").count() == 0
