"""Inputs that careless readers and formulas get wrong."""

import json

import pytest

from tidemill.operators import aggregate, clean, stats, validate
from tidemill.sources import files


def test_json_records_per_line_under_any_name(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text("".join(json.dumps({"a": k}) + "\n" for k in range(5)))
    assert files.load_table(spark, str(path)).count() == 5
    path.write_text(json.dumps([{"a": k} for k in range(4)], indent=1))
    assert files.load_table(spark, str(path)).count() == 4
    path.write_text(json.dumps({"a": 1}, indent=1))
    assert files.load_table(spark, str(path)).count() == 1


def test_csv_and_pasted_text_keep_quoted_line_ends(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x\ny"), (2, 'say "hi"')], "id int, note string")
    path = str(tmp_path / "out.csv")
    files.save_csv(rows, path)
    back = files.load_table(spark, path)
    assert dict(back.dtypes)["id"] == "int" and sorted(map(tuple, back.collect())) == [(1, "x\ny"), (2, 'say "hi"')]
    pasted, error = files.parse_pasted_csv(spark, 'id,note\n1,"x\ny"\n2,z\n')
    assert error is None and pasted.count() == 2


def test_files_of_a_folder_are_read_each_their_way(spark, tmp_path):
    folder = tmp_path / "a b%20c.json"
    folder.mkdir()
    (folder / "lines.json").write_text('\n{"a": 1}\n{"a": 2}\n')
    (folder / "list.json").write_text(json.dumps([{"a": 3}, {"a": 4, "b": "x"}], indent=1))
    (folder / "one line.json").write_text(json.dumps([{"a": 5}, {"a": 6.5}]) + "\n")
    (folder / "object.json").write_text('{"a": 7,\n "c": {"d": 1}}')
    (folder / "empty.json").write_text("")
    assert sorted(r["a"] for r in files.load_table(spark, str(folder)).collect()) == [1, 2, 3, 4, 5, 6.5, 7]
    table = tmp_path / "t.csv"
    table.mkdir()
    (table / "plain.csv").write_text("a,b\n1,x\n2,y\n")
    (table / "spans.csv").write_text('a,b\n3.5,"two\n""quoted"" lines"\n4,5\n')
    found = sorted(map(tuple, files.load_table(spark, str(table)).collect()))
    assert found == [(1.0, "x"), (2.0, "y"), (3.5, 'two\n"quoted" lines'), (4.0, "5")]


def test_a_large_file_with_a_record_per_line_is_split(spark, tmp_path):
    rows = "".join(f'{k},"a ""word"" {k}"\n' for k in range(20_000))
    (tmp_path / "large.csv").write_text("id,note\n" + rows)
    (tmp_path / "large.json").write_text("".join(json.dumps({"id": k, "note": "x" * 9}) + "\n" for k in range(20_000)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for name in ("large.csv", "large.json"):
            df = files.load_table(spark, str(tmp_path / name))
            assert df.rdd.getNumPartitions() > 4 and df.count() == 20_000
            assert df.select("id").distinct().count() == 20_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_anova_is_invariant_to_a_shift(spark):
    data = [(g, float(v)) for g, vs in {"a": (1, 2, 3, 4), "b": (2, 3, 5, 6), "c": (5, 6, 7, 9)}.items() for v in vs]
    plain = spark.createDataFrame(data, "g string, x double")
    far = plain.selectExpr("g", "x + 1e9 as x")
    assert abs(stats.run_anova(plain, "x", "g").first()["f_statistic"] - stats.run_anova(far, "x", "g").first()["f_statistic"]) < 1e-3


def test_cross_table_has_no_column_for_pairs_with_a_null(spark):
    df = spark.createDataFrame([("p", "x"), (None, "q")], "a string, b string")
    assert aggregate.contingency_table(df, "a", "b").columns == ["a", "x"]


def test_patterns_run_as_written(spark):
    df = spark.createDataFrame([("hello",)], "v string")
    assert clean.string_operations(df, "v", "extract_regex", r"(l)\1").first()["v_extracted"] == "ll"
    rules = [
        {"column": "v", "rule_type": "regex", "params": {"pattern": "(a)?(?(1)b|c)"}},
        {"column": "v", "rule_type": "not_null"},
    ]
    found = validate.run_validation(df, rules).collect()
    assert len(found) == 2 and "Could not evaluate" in found[0]["detail"]


def test_pivot_of_text(spark):
    df = spark.createDataFrame([("a", "k", "z"), ("a", "k", "y")], "i string, c string, v string")
    assert aggregate.pivot_table(df, "i", "v", "min", "c").first()["k"] == "y"


def test_every_column_is_examined_by_default(spark):
    from tidemill.operators import charts, insights, kpi, timeseries

    n = [f"x{i}" for i in range(9)]
    # the last column alone holds far outliers
    rows = [(i, *[float(i % 7 + k) for k in range(8)], 1000.0 * (i % 10 == 0) + i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, ["year", *n])
    titles = [r["title"] for r in insights.insight_cards(df).collect()]
    assert "Outliers in x8" in titles
    assert kpi.detect_kpi_columns(df).count() == 10 and kpi.detect_kpi_columns(df, shown=4).count() == 4
    assert timeseries.detect_trends(df).count() == 10
    assert len(charts.scatter_pairs(df)) == 45 and len(charts.scatter_pairs(df, 3)) == 3
    kinds = {r["type"]: r["x"] for r in insights.dashboard_charts(df).collect()}
    assert set(kinds) == {"histogram", "heatmap", "scatter", "line"} and kinds["heatmap"].count(",") == 9


def test_header_limits_can_be_lifted(spark):
    from tidemill.operators import aggregate, clean

    df = spark.createDataFrame([(i % 2, i, 1) for i in range(12)], "a int, b int, v int")
    for table in (aggregate.pivot_table(df, "a", "v", "sum", "b", max_columns=None), aggregate.contingency_table(df, "a", "b", max_columns=None)):
        assert len(table.columns) == 13
    with pytest.raises(ValueError):
        aggregate.contingency_table(df, "a", "b", max_columns=5)
    assert len(clean.one_hot_encode(df, "b", max_columns=None).columns) == 15


@pytest.mark.parametrize("dof", [1e6, 1e8, 1e10, 1e14])
def test_tails_do_not_drift_with_the_number_of_rows(dof):
    from tidemill.functions import pvalues

    assert pvalues.t_two_sided(1.0, dof) == pytest.approx(0.317311, abs=1e-6)
    assert pvalues.f_upper(1.0, 1.0, dof) == pytest.approx(0.317311, abs=1e-6)
    assert pvalues.f_upper(2.0, 4.0, dof) == pytest.approx(pvalues.chi2_upper(8.0, 4.0), abs=1e-6)
    # a chi-square value one deviation above its mean
    assert pvalues.chi2_upper(dof + (2 * dof) ** 0.5, dof) == pytest.approx(0.158655, abs=3e-4)


def test_tail_routes_agree_at_their_borders():
    from tidemill.functions import pvalues

    for below, above, f in ((1e6, 1e6 * (1 + 1e-9), lambda d: pvalues.t_two_sided(2.3, d)), (1e6, 1e6 * (1 + 1e-9), lambda d: pvalues.f_upper(3.1, 5.0, d))):
        assert f(below) == pytest.approx(f(above), abs=1e-8)
    for s in (1e3, 1e7):
        low, high = (pvalues.gamma_tail(s * k, s * k + 0.7 * (s * k) ** 0.5) for k in (1 - 1e-9, 1 + 1e-9))
        assert low == pytest.approx(high, abs=1e-7)


def test_keys_heavy_on_both_sides_join_once(spark):
    from tidemill.plans.hotkeys import uneven_join

    left = spark.createDataFrame([("b", i) for i in range(6)] + [("l", i) for i in range(6)] + [("x", 0)], "lk string, li int")
    right = spark.createDataFrame([("b", i) for i in range(5)] + [("r", i) for i in range(5)] + [("y", 0)], "rk string, ri int")
    plain = left.join(right, left.lk == right.rk, "full").collect()
    found = uneven_join(left, right, "lk", "rk", "full", at_least=4).collect()
    assert sorted(map(str, found)) == sorted(map(str, plain))
