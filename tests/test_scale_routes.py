"""The routes for tables too big or too uneven for the plain operator give the same results."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators.aggregate import value_census
from tidemill.operators.clean import duplicate_count
from tidemill.operators.combine import join_datasets
from tidemill.operators.quality import quality_score
from tidemill.operators.timeseries import trend_points
from tidemill.operators.validate import run_validation, violating_rows
from tidemill.plans.hotkeys import hot_keys
from tidemill.plans.quantiles import column_quantiles, grouped_quantiles
from tidemill.plans.roworder import carry_fill, with_row_index

POINTS = [0.0, 0.01, 0.25, 0.5, 0.753, 0.99, 1.0]


@pytest.fixture(scope="module")
def uneven(spark):
    """One key and one value hold a third of the rows."""
    rng = np.random.default_rng(1)
    n = 30_000
    pdf = pd.DataFrame(
        {
            "i": np.arange(n),
            "k": np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 50, n).astype(str)),
            "x": np.where(rng.random(n) < 0.34, 5.0, rng.lognormal(2, 2, n)),
            "y": rng.normal(0, 1, n),
        }
    )
    return pdf, spark.createDataFrame(pdf).repartition(8)


@pytest.mark.parametrize("limit", [3, 200, 10**9])
def test_column_quantiles(uneven, limit):
    pdf, df = uneven
    found = column_quantiles(df, {"x": POINTS, "y": POINTS}, limit)
    for c in ("x", "y"):
        np.testing.assert_allclose(found[c], pdf[c].quantile(POINTS), rtol=1e-9)


def test_quantiles_of_little_data(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (4.0, None)], "x double, y double")
    assert column_quantiles(df, {"x": [0.5], "y": [0.5]}, 0) == {"x": [2.5], "y": [None]}


@pytest.mark.parametrize("limit", [3, 10**9])
def test_grouped_quantiles(uneven, limit):
    pdf, df = uneven
    found = grouped_quantiles(df, ["k"], "x", {"a": 0.1, "b": 0.5, "c": 0.9}, limit).toPandas().set_index("k").sort_index()
    wanted = pdf.groupby("k").x.quantile([0.1, 0.5, 0.9]).unstack().sort_index()
    np.testing.assert_allclose(found.to_numpy(), wanted.to_numpy(), rtol=1e-9)


def test_row_index(uneven):
    pdf, df = uneven
    found = with_row_index(df, ["x", "i"]).toPandas().sort_values("row_index")
    assert (found["row_index"].to_numpy() == np.arange(len(pdf))).all()
    assert (found["i"].to_numpy() == pdf.sort_values(["x", "i"])["i"].to_numpy()).all()


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_carry_fill(uneven, backward, keys):
    pdf, df = uneven
    gone = pdf["i"] % 10 < 7
    source = df.withColumn("y", F.when(F.col("i") % 10 >= 7, F.col("y")))
    found = carry_fill(source, "y", "i", keys, backward).toPandas().sort_values("i")["y"].to_numpy()
    series = pdf["y"].mask(gone)
    grouped = series.groupby(pdf["k"]) if keys else series
    wanted = grouped.bfill() if backward else grouped.ffill()
    np.testing.assert_array_equal(found, wanted.to_numpy())


def test_trend_routes_agree(uneven):
    _, df = uneven
    few = {tuple(r) for r in trend_points(df.where("i < 500"), "i", "x").collect()}
    many = {tuple(r) for r in trend_points(df.where("i < 500"), "i", "x", window_keys=1).collect()}
    assert few == many


def test_hot_keys_are_counted_exactly(uneven):
    pdf, df = uneven
    assert [r["k"] for r in hot_keys(df, "k", 5_000).collect()] == ["hot"]
    assert (pdf["k"] == "hot").sum() >= 5_000


@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_any_number_of_heavy_keys(spark, how):
    left = spark.range(2400).select((F.col("id") % 600).alias("k"), F.col("id").alias("a"))
    right = spark.range(2100).select((F.col("id") % 700 + 100).alias("k"), F.col("id").alias("b"))
    plain = join_datasets(left, right, "k", "k", how, hot_rows=10**9)
    routed = join_datasets(left, right, "k", "k", how, hot_rows=3)
    assert sorted(map(str, plain.collect())) == sorted(map(str, routed.collect()))


def test_kmeans_does_not_depend_on_partitions(uneven):
    from tidemill.operators.models import run_kmeans_clustering

    _, df = uneven
    first = run_kmeans_clustering(df, ["x", "y"], 3, id_cols=["i"])
    again = run_kmeans_clustering(df.repartition(3), ["x", "y"], 3)
    assert first["centers"].collect() == again["centers"].collect()
    assert first["labels"].columns == ["i", "x", "y", "cluster"] and first["labels"].count() == 30_000


def test_approximate_quantiles_stay_close_in_rank(uneven):
    pdf, df = uneven
    found = column_quantiles(df, {"y": [0.25, 0.5]}, approx=True)["y"]
    for p, v in zip([0.25, 0.5], found):
        assert abs((pdf["y"] <= v).mean() - p) < 0.001


def test_long_texts_group_by_digest(spark):
    import hashlib

    long = "7" * 64
    digest = hashlib.sha256(long.encode()).hexdigest()
    values = [long, long, digest, "7" * 63, "7" * 63, None, None, "x" * 200]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert duplicate_count(df).first()[0] == 3
    assert value_census(df, whole_values=False).first()["distinct"] == 4
    assert value_census(df).first()["top_value"] == "7" * 63
    row = quality_score(df).first()
    assert (row["duplicates"], row["missing"], row["type_points"]) == (3, 2, 0.0)
    rule = {"column": "s", "rule_type": "unique"}
    assert run_validation(df, [rule]).first()["violations"] == 4
    assert violating_rows(df, rule).count() == 4


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_index_never_gathers_one_partition(uneven):
    _, df = uneven
    assert "SinglePartition" not in plan_of(with_row_index(df, ["x", "i"]))


def test_row_rules_are_counted_together(tables):
    rules = [
        {"column": "o_totalprice", "rule_type": "range", "params": {"min": 0}},
        {"column": "o_orderstatus", "rule_type": "allowed_values", "params": {"allowed": ["F", "O", "P"]}},
        {"column": "o_orderpriority", "rule_type": "regex", "params": {"pattern": r"\d-"}},
        {"column": "o_orderkey", "rule_type": "not_null"},
    ]
    found = run_validation(tables("orders"), rules).collect()
    assert [r["status"] for r in found] == ["Pass"] * 4


def test_filters_reach_the_scan(tables):
    from tidemill.operators.clean import remove_outliers_iqr

    plan = plan_of(remove_outliers_iqr(tables("lineitem").select("l_orderkey", "l_extendedprice"), "l_extendedprice"))
    assert "PushedFilters: [IsNotNull(l_extendedprice), GreaterThanOrEqual(l_extendedprice" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan


EAGER_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.mark.parametrize("how", ["left", "outer"])
def test_heavy_optional_side_is_split(spark, how):
    """A key with 40 % of the rows on the optional side: only the routed join is split."""
    before = {k: spark.conf.get(k) for k in EAGER_SKEW}
    for k, v in EAGER_SKEW.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(2000).select(F.col("id").alias("k"), F.rand(1).alias("a"))
        spread = (F.rand(3) * 2500).cast("long")
        right = spark.range(300_000, numPartitions=8).select(
            F.when(F.rand(2) < 0.4, F.lit(7)).otherwise(spread).alias("k"), F.rand(4).alias("b")
        )
        plain = join_datasets(left, right, "k", "k", how, hot_rows=10**9)
        routed = join_datasets(left, right, "k", "k", how, hot_rows=50_000)
        assert len(plain.collect()) == len(routed.collect())
        assert "skew=true" not in plan_of(plain)
        assert "skew=true" in plan_of(routed)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_kmeans_finds_a_few_far_rows_among_many(spark, monkeypatch):
    """Twenty rows far away among 200,000: seeds come from all rows, whatever the partitions."""
    from pyspark.sql import functions as F
    from tidemill.operators.models import run_kmeans_clustering
    from tidemill.plans import kmeans

    far = F.col("id") % 10_000 == 3
    rows = spark.range(200_000).select(
        (F.when(far, 500).otherwise(0) + F.col("id") % 97 / 97).alias("x"), (F.when(far, -400).otherwise(0) + F.col("id") % 89 / 89).alias("y")
    )
    found = run_kmeans_clustering(rows, ["x", "y"], 2)
    assert sorted(r["count"] for r in found["labels"].groupBy("cluster").count().collect()) == [20, 199_980]
    monkeypatch.setattr(kmeans, "DIRECT_ROWS", 0)
    again = run_kmeans_clustering(rows.repartition(13), ["x", "y"], 2)
    assert found["centers"].collect() == again["centers"].collect()
    copies = spark.createDataFrame([(0.0,)] * 500 + [(1.0,)] * 3 + [(9.0,)], "x double")
    assert [r["x"] for r in run_kmeans_clustering(copies, ["x"], 3)["centers"].collect()] == [0.0, 1.0, 9.0]
    assert run_kmeans_clustering(copies, ["x"], 5)["centers"].count() == 5  # more clusters than distinct rows


def test_kmeans_of_a_small_table_takes_few_tasks_a_pass(spark):
    """The shuffle before dealt the rows over 211 partitions: the passes over them follow their size."""
    from pyspark.sql import functions as F
    from tidemill.operators.models import run_kmeans_clustering

    cells = [((F.xxhash64("id", F.lit(i)) % 1000) / 100 + F.col("id") % 3 * 20).alias(f"x{i}") for i in range(3)]
    settings = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    context = spark.sparkContext
    context.setJobGroup("few tasks", "k-means of 600 rows")
    try:
        found = run_kmeans_clustering(spark.range(600).select(*cells), ["x0", "x1", "x2"], 3)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("few tasks")]
    wide = [j.jobId for j in jobs if sum(tracker.getStageInfo(s).numCompletedTasks for s in j.stageIds) >= 211]
    assert len(jobs) > 8 and len(wide) <= 2  # at most the shuffles before the first pass, no pass
    assert sorted(r["count"] for r in found["labels"].groupBy("cluster").count().collect()) == [200, 200, 200]


def test_kmeans_merged_by_a_shuffle_equals_the_direct_way(spark, monkeypatch):
    """Blocks of a few rows, many partitions, equal and odd rows; sums and draws as by plain numpy."""
    from pyspark.sql import functions as F
    from tidemill.operators.models import run_kmeans_clustering
    from tidemill.plans import kmeans

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(m, 1, (150, 5)) for m in (0, 4, 9)] + [np.full((40, 5), 2.5)])
    columns = [f"a.{i}" for i in range(5)]  # names that need quoting
    cells = [tuple(map(float, r)) for r in x] + [(None, 1.0, 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(cells, "struct<" + ", ".join(f"`{c}`: double" for c in columns) + ">")
    first = run_kmeans_clustering(df, columns, 3)
    z = (x - x.mean(0)) / x.std(0)
    member = np.array([r["cluster"] for r in first["labels"].collect()])
    assert len(member) == len(x) and first["summary"].first()["n_observations"] == len(x)
    cost = sum(((z[member == c] - z[member == c].mean(0)) ** 2).sum() for c in range(3))
    assert first["summary"].first()["inertia"] == pytest.approx(cost, rel=1e-6)
    for name, value in (("DIRECT_ROWS", 0), ("PART", 64), ("PACKED", 32), ("BLOCK", 100)):
        monkeypatch.setattr(kmeans, name, value)
    again = run_kmeans_clustering(df.repartition(5), columns, 3)
    assert first["centers"].collect() == again["centers"].collect()
    assert again["labels"].where(F.col("`a.0`").isNull()).count() == 0


def test_doubles_keep_their_value_as_sql_text(spark):
    from tidemill.functions.types import double_sql

    values = [0.1, -0.1, 1e-300, -5e-324, 1.7976931348623157e308, 3.0, 123456789.12345679, float("inf"), float("-inf")]
    row = spark.range(1).selectExpr(*[f"1 * {double_sql(v)} AS c{i}" for i, v in enumerate([*values, float("nan")])]).first()
    assert list(row)[:-1] == values and row[-1] != row[-1]


def test_quantiles_of_large_groups_are_narrowed_by_counts(spark, monkeypatch):
    import pandas as pd
    from tidemill.plans import quantiles

    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"g": rng.choice(["big", "big", "b", "c"], 30_000), "x": np.exp(8 * rng.normal(size=30_000))})
    pdf.loc[:9000, "x"] = 7.25  # a value that holds many ranks
    pdf = pd.concat([pdf, pd.DataFrame({"g": ["one", "two", "two", "none", None], "x": [3.0, 1.0, 2.0, np.nan, 1.0]})])
    df = spark.createDataFrame(pdf).repartition(7)
    points = {"low": 0.25, "mid": 0.5, "top": 0.999}
    rows = df.select("g", quantiles._as_double("x").alias("_v")).where("g is not null")
    found = quantiles._grouped_by_bracket(rows, ["g"], points, limit=50)
    got = found.toPandas().set_index("g")
    expected = pdf.dropna(subset=["g"]).groupby("g")["x"].quantile([0.25, 0.5, 0.999]).unstack()
    for name, p in points.items():
        np.testing.assert_allclose(got[name].loc[expected.index].astype(float), expected[p], rtol=1e-12)
    assert "Window" not in plan_of(found)


def test_rows_before_a_position(spark, monkeypatch):
    from tidemill.plans import roworder

    monkeypatch.setattr(roworder, "SELECTED_ROWS", 20)
    df = spark.range(3000).selectExpr(
        "if(id % 3 = 0, null, id % 2) as a", "cast(id % 5 as string) as t", "date_add(date'2024-01-01', cast(id % 40 as int)) as d", "(id * 7919) % 3000 as i"
    ).repartition(5).cache()
    for order in (["i"], ["a", "i"], ["d", "i"], ["t", "i"], ["a", "d", "i"]):
        ranked = df.orderBy(*order).toPandas()["i"].tolist()
        for position in (0, 1, 700, 1500, 2999, 3000):
            condition = roworder.precedes(df, order, position, 3000)
            assert {r["i"] for r in df.where(condition).select("i").collect()} == set(ranked[:position]), (order, position)


def test_key_figures_need_no_sort(spark):
    from tidemill.operators.kpi import kpi_card

    df = spark.range(50_000).selectExpr("id % 7 as k", "id as i", "cast(id % 100 as double) as x")
    plan = plan_of(kpi_card(df, "x", "mean", ["k", "i"]))
    assert "Sort " not in plan and "Exchange range" not in plan


def test_views_of_the_caller_survive_the_sql_box(spark):
    from tidemill.operators.sql import run_sql_query

    spark.range(3).createOrReplaceTempView("mine")
    result, _, error = run_sql_query(spark, "SELECT count(*) AS n FROM mine JOIN other USING (id)", {"mine": spark.range(10), "other": spark.range(5)})
    assert error is None and result.first()["n"] == 5
    assert spark.table("mine").count() == 3 and not spark.catalog.tableExists("other")
    assert run_sql_query(spark, "SELECT nothing FROM mine", {"mine": spark.range(10)})[2] and spark.table("mine").count() == 3


@pytest.mark.parametrize("backward", [False, True])
def test_carry_fill_shuffles_once_and_crosses_tasks(spark, backward):
    from tidemill.plans import roworder

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"i": np.arange(4000), "k": np.where(np.arange(4000) < 3000, 1, np.arange(4000) % 5), "t": rng.choice(["x", "y"], 4000)})
    pdf["v"] = np.where(rng.random(4000) < 0.002, np.round(rng.random(4000), 6), np.nan)  # long runs without a value
    pdf.loc[pdf["i"] % 50 == 0, "t"] = None
    df = spark.createDataFrame(pdf).withColumns({"v": F.when(~F.isnan("v"), F.col("v")), "d": F.struct("v")}).repartition(6)
    found = carry_fill(df, "v", "i", ["k", "t"], backward)
    assert found.columns == df.columns
    order = pdf.sort_values("i", ascending=not backward)
    expected = order.groupby(["k", order["t"].fillna("none")])["v"].ffill().sort_index()
    got = found.toPandas().sort_values("i")["v"].astype(float).to_numpy()
    np.testing.assert_array_equal(got, expected.to_numpy())
    nested = carry_fill(df.withColumn("d", F.when(F.col("v").isNotNull(), F.struct("v"))), "d", "i", [], backward).toPandas().sort_values("i")
    plain = pdf["v"].bfill() if backward else pdf["v"].ffill()
    np.testing.assert_array_equal([np.nan if x is None else x["v"] for x in nested["d"]], plain.to_numpy())
    planned = []
    keep, roworder.materialize = roworder.materialize, lambda frame: planned.append(plan_of(frame)) or keep(frame)
    try:
        after = plan_of(carry_fill(df, "v", "i", ["k"], backward))
    finally:
        roworder.materialize = keep
    assert planned[0].count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in planned[0] + after and "Window" not in planned[0] + after


def test_most_and_least_common_long_texts(spark):
    begin = "The same beginning of every text, longer than any digest is: " + "-" * 20
    counts = {begin + "b": 5, begin + "a": 5, begin: 5, begin + "z" * 900: 1, begin + "y": 1, "short": 5, "zz": 2}
    rows = [(v, n, "k") for v, n in counts.items() for _ in range(n)] + [(None, 0, None)]
    df = spark.createDataFrame(rows, "s string, n int, k string").repartition(4)
    plain = Counter(r[0] for r in rows if r[0] is not None)
    found = {r["column"]: r for r in value_census(df).collect()}
    top = min((v for v, n in plain.items() if n == 5))
    bottom = max((v for v, n in plain.items() if n == 1))
    assert (found["s"]["top_value"], found["s"]["top_count"]) == (top, 5) and top == begin
    assert (found["s"]["bottom_value"], found["s"]["bottom_count"], found["s"]["distinct"]) == (bottom, 1, 7)
    assert found["k"]["top_value"] == "k" and found["n"]["distinct"] == 4
    unique = spark.range(500).select(F.concat(F.lit("x" * 80), F.lpad(F.col("id").cast("string"), 4, "0")).alias("s"))
    row = value_census(unique).first()
    assert row["top_value"] == "x" * 80 + "0000" and row["bottom_value"] == "x" * 80 + "0499"
