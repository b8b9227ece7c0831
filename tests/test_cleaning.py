import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import clean, privacy
from tidemill.operators.combine import concat_datasets, join_datasets
from tidemill.plans.steps import run_steps, undo


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def column(df, name, order):
    return [r[0] for r in df.orderBy(order).select(F.col(f"`{name}`")).collect()]


@pytest.fixture
def numbers(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 10.0])], "i int, x double")


def test_bins_are_right_closed_like_cut(numbers):
    labels = list("abcde")
    found = column(clean.bin_numeric(numbers, "x", 5, labels), "x_binned", "i")
    assert found == pd.cut(pd.Series([0.0, 1, 2, 3, 4, 5, 10]), 5, labels=labels).tolist()


def test_bin_labels_match_interval_text(numbers):
    found = column(clean.bin_numeric(numbers, "x", 5, ["too", "few"]), "x_binned", "i")
    assert found == [str(v) for v in pd.cut(pd.Series([0.0, 1, 2, 3, 4, 5, 10]), 5)]


@pytest.mark.parametrize("n", [3, 4, 5])
def test_constant_column_lands_in_the_middle_bin(spark, n):
    df = spark.createDataFrame([(7.0,)] * 3, "x double")
    labels = [str(i) for i in range(n)]
    found = {r[0] for r in clean.bin_numeric(df, "x", n, labels).select("x_binned").collect()}
    assert found == set(pd.cut(pd.Series([7.0] * 3), n, labels=labels).astype(str))


@pytest.mark.parametrize("seed", range(3))
def test_random_bins_match_cut(spark, seed):
    x = np.random.default_rng(seed).normal(100, 30, 200).round(2)
    df = spark.createDataFrame(pd.DataFrame({"i": range(200), "x": x}))
    assert column(clean.bin_numeric(df, "x", 7), "x_binned", "i") == [str(v) for v in pd.cut(pd.Series(x), 7)]


def test_title_case_restarts_after_any_non_letter(spark):
    text = ["o'neil mc-donald 3rd", "  tabs\tand  blanks ", "", None]
    df = spark.createDataFrame(list(enumerate(text)), "i int, v string")
    assert column(clean.standardize_text(df, "v", "titlecase"), "v", "i") == [t.title() if t is not None else None for t in text]
    assert column(clean.standardize_text(df, "v", "strip"), "v", "i") == [t.strip() if t is not None else None for t in text]
    assert column(clean.standardize_text(df, "v", "strip_all"), "v", "i")[1] == "tabs and blanks"


def test_messy_numbers(spark):
    text = ["1.5", "x", " 7 ", "1e3", "NaN", "1d", "", None, "-.5", "+2.", "inf", "0x10"]
    df = spark.createDataFrame(list(enumerate(text)), "i int, v string")
    expected = [1.5, None, 7.0, 1000.0, None, None, None, None, -0.5, 2.0, None, None]
    assert column(clean.convert_column_type(df, "v", "numeric"), "v", "i") == expected


def test_integer_conversion_refuses_fractions(spark):
    with pytest.raises(ValueError):
        clean.convert_column_type(spark.createDataFrame([(1.5,)], "x double"), "x", "integer")
    whole = clean.convert_column_type(spark.createDataFrame([("4",), ("z",)], "x string"), "x", "integer")
    assert {r[0] for r in whole.collect()} == {4, None}


def test_calculated_columns(spark):
    df = spark.createDataFrame([(-7, 3, 2.0), (7, -3, 0.0)], "`a b` int, c int, d double")
    out = clean.add_calculated_column(df, "m", "`a b` % c")
    out = clean.add_calculated_column(out, "q", "`a b` // c")
    out = clean.add_calculated_column(out, "r", "c / d")
    out = clean.add_calculated_column(out, "t", "c > 0 & `a b` < 0 | not d > 1")
    found = [tuple(r) for r in out.select("m", "q", "r", "t").collect()]
    assert found == [(-7 % 3, -7 // 3, 1.5, True), (7 % -3, 7 // -3, None, True)]


@pytest.mark.parametrize("text", ["__import__('os')", "c.real", "c if d else 1", "abs(c)", "c +", "unknown + 1", "[c]"])
def test_expressions_allow_operators_only(spark, text):
    df = spark.createDataFrame([(1, 2)], "c int, d int")
    with pytest.raises(ValueError):
        clean.add_calculated_column(df, "x", text)


def test_fills(spark):
    df = spark.createDataFrame([(1, 2.0, "b"), (2, None, "a"), (3, 4.0, None), (4, 9.0, "a"), (5, None, "b")], "i int, x double, s string")
    assert column(clean.fill_missing(df, "x", "mean"), "x", "i")[1] == 5.0
    assert column(clean.fill_missing(df, "x", "median"), "x", "i")[1] == 4.0
    assert column(clean.fill_missing(df, "s", "mode"), "s", "i")[2] == "a"
    assert column(clean.fill_missing(df, "x", "zero"), "x", "i")[4] == 0.0
    assert column(clean.fill_missing(df, "x", "forward", "i"), "x", "i") == [2.0, 2.0, 4.0, 9.0, 9.0]
    assert column(clean.fill_missing(df, "x", "backward", "i"), "x", "i") == [2.0, 4.0, 4.0, 9.0, None]


def test_fill_of_integers_may_become_fractional(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert sorted(r[0] for r in clean.fill_missing(df, "x", "mean").collect()) == [1.0, 1.5, 2.0]


def test_fill_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert clean.fill_missing(df, "x", "mean").where("x is null").count() == 2
    assert {r[0] for r in clean.fill_missing(df, "x", "mode").collect()} == {0.0}


def test_outliers_drop_missing_rows_and_caps_keep_them(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    assert sorted(r["x"] for r in clean.remove_outliers_iqr(df, "x").collect()) == [1.0, 2.0, 3.0, 4.0]
    assert column(clean.cap_outliers(df, "x"), "x", "i") == [1.0, 2.0, 3.0, 4.0, 7.0, None]


def test_duplicates_with_missing_values(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (None, None)], "x int, y string")
    assert clean.remove_duplicates(df).count() == 3
    assert sorted(clean.remove_duplicates(df, keep=False).collect(), key=str) == sorted([(2, "a"), (None, None)], key=str)
    assert clean.duplicate_count(df).first()[0] == 1
    assert clean.duplicate_rows(df).count() == 2


def test_one_hot_leaves_missing_rows_all_zero(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "v string")
    out = clean.one_hot_encode(df, "v")
    assert out.columns == ["v", "v_a", "v_b"]
    assert {tuple(r) for r in out.collect()} == {("b", 0, 1), ("a", 1, 0), (None, 0, 0)}


def test_split_and_regex(spark):
    df = spark.createDataFrame([(1, "a.b. c"), (2, "d"), (3, None)], "i int, v string")
    out = clean.split_column(df, "v", ".").orderBy("i")
    assert [tuple(r)[2:] for r in out.collect()] == [("a", "b", "c"), ("d", None, None), (None, None, None)]
    assert clean.string_operations(df, "v", "extract_regex", "(").columns == df.columns
    assert clean.string_operations(df, "v", "extract_regex", "a" * 201).columns == df.columns
    found = clean.string_operations(df, "v", "extract_regex", "[a-c]")
    assert column(found, "v_extracted", "i") == ["a", None, None]


def test_columns_checks(spark):
    df = spark.createDataFrame([(1, [1])], "x int, a array<int>")
    with pytest.raises(KeyError):
        clean.drop_columns(df, ["y"])
    with pytest.raises(TypeError):
        clean.bin_numeric(df, "a")
    assert clean.rename_columns(df, {"y": "z", "x": "w"}).columns == ["w", "a"]


def test_date_columns(spark):
    df = spark.createDataFrame([(1999, 5, "x", dt.date(2020, 1, 1))], "code int, n int, birthday string, d date")
    assert {r["column"]: r["reason"] for r in clean.detect_date_columns(df).collect()} == {
        "code": "4-digit values", "birthday": "name", "d": "datetime type",
    }
    parts = clean.extract_date_parts(df, "code").first()
    assert (parts["code_year"], parts["code_month"], parts["code_weekday"]) == (1999, 1, "Friday")


def test_masks(spark):
    df = spark.createDataFrame([(1, "abcdef"), (2, "abcd"), (3, None), (4, "abcde")], "i int, v string")
    assert column(privacy.mask_column(df, "v", "partial"), "v", "i") == ["ab**ef", "****", None, "ab*de"]
    assert column(privacy.mask_column(df, "v", "full"), "v", "i") == ["***REDACTED***"] * 2 + [None, "***REDACTED***"]
    hashed = column(privacy.mask_column(df, "v", "hash"), "v", "i")
    assert [None if h is None else len(h) for h in hashed] == [12, 12, None, 12]


def test_sensitive_columns(spark):
    data = [("a@b.org", "555-123-4567", "123-45-6789", "1234 5678 9012 3456", "10.0.0.1", "plain", 1, "x")] * 3
    df = spark.createDataFrame(data, "contact string, p string, s string, c string, host string, note string, shipdate int, surname string")
    found = {r["column"]: (r["sensitivity_type"], r["confidence"]) for r in privacy.detect_sensitive_columns(df).collect()}
    assert found["contact"] == ("email", "high")
    assert found["p"] == ("phone", "high")
    assert found["s"] == ("ssn", "high")
    assert found["c"][1] == "high"
    assert found["host"] == ("ip_address", "high")
    assert found["shipdate"] == ("ip", "medium")  # a keyword may sit inside another word
    assert found["surname"] == ("name", "medium")
    assert "note" not in found


# -- joins and stacking -------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("hot_rows", [2, 10**9])
def test_joins_match_merge(spark, how, hot_rows):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"k": rng.choice([1.0, 2.0, 3.0, np.nan], 30), "v": range(30)})
    right = pd.DataFrame({"k": rng.choice([2.0, 3.0, 4.0, np.nan], 20), "v": range(20)})
    wanted = left.merge(right, on="k", how=how, suffixes=("_left", "_right"))
    frames = [spark.createDataFrame(f.astype(object).where(f.notna(), None), "k double, v double") for f in (left, right)]
    found = join_datasets(*frames, "k", "k", how, hot_rows).toPandas()
    assert list(found.columns) == list(wanted.columns)
    order = list(found.columns)
    pd.testing.assert_frame_equal(
        found.sort_values(order).reset_index(drop=True).astype(float), wanted.sort_values(order).reset_index(drop=True).astype(float)
    )


def test_join_checks(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, s string"), spark.createDataFrame([(1, "y")], "id int, s string")
    with pytest.raises(ValueError):
        join_datasets(a, b, "id", "id", "cross")
    with pytest.raises(ValueError):
        join_datasets(a, b, "id", "s", "inner")
    assert join_datasets(a, b.withColumnRenamed("id", "key"), "id", "key").columns == ["id", "s_left", "key", "s_right"]


def test_full_join_is_inner_plus_both_rests(tables):
    c, n = tables("customer"), tables("nation").withColumn("n_nationkey", F.col("n_nationkey") + 5)
    count = {h: join_datasets(c, n, "c_nationkey", "n_nationkey", h).count() for h in ("inner", "left", "right", "outer")}
    assert count["outer"] == count["left"] + count["right"] - count["inner"]


def test_stacking_widens_types(spark):
    a, b = spark.createDataFrame([(1, 2.0)], "id int, v double"), spark.createDataFrame([("x", 3)], "id string, w long")
    out = concat_datasets([a, b])
    assert {tuple(r) for r in out.collect()} == {("1", 2.0, None), ("x", None, 3)}
    assert concat_datasets([]) is None


def test_side_by_side_by_position(spark):
    a, b = spark.createDataFrame([(3,), (1,), (2,)], "x int"), spark.createDataFrame([(9,), (8,)], "x int")
    out = concat_datasets([a, b], 1, ["x", "x"])
    assert out.columns == ["x", "x_2"]
    assert {tuple(r) for r in out.collect()} == {(1, 8), (2, 9), (3, None)}


def test_steps_log_and_undo(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 5.0), (3, 1000.0)], "k int, x double")
    steps = [
        ("dedupe", "remove_duplicates", {}),
        ("flag", "flag_missing", {}),
        ("drop", "drop_missing_rows", {"columns": ["x"]}),
        ("calc", "add_calculated_column", {"name": "y", "expression": "x * 2"}),
    ]
    cleaned, log = run_steps(df, steps)
    assert [(r["step"], r["rows_affected"]) for r in log.orderBy("step").collect()] == [(1, 1), (2, 1), (3, 1), (4, 2)]
    assert {tuple(r) for r in cleaned.select("k", "y").collect()} == {(2, 10.0), (3, 2000.0)}
    assert "y" not in run_steps(df, undo(steps))[0].columns
