import pytest

from tidemill.operators.sql import register_tables, run_sql_query, validate_query
from tidemill.plans.session import scratch_path
from tidemill.sources import corpus, files, logs
from tidemill.sources.versions import VersionStore
from tidemill.streaming.rowwise import apply_rowwise, tag_stream


@pytest.mark.parametrize(
    "query",
    [
        "SELECT 1", "  -- note\nselect 1", "/* a */ WITH x AS (SELECT 1 AS a) SELECT * FROM x", "SELECT 'insert into t' AS s",
        "SELECT `delete from` FROM t", "SELECT '-- not a comment' AS a, 1 AS b",
    ],
)
def test_reading_queries_pass(query):
    assert validate_query(query) is None


@pytest.mark.parametrize(
    "query",
    [
        "", "-- only", "DROP TABLE t", "insert into t values (1)", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x",
        "WITH x AS (SELECT 1) DELETE FROM t", "WITH x AS (SELECT 1) UPDATE t SET a = 1", "WITH x AS (SELECT 1) MERGE INTO t USING x ON 1=1",
        "WITH x AS (SELECT 1) INSERT/**/INTO t SELECT 1", "PRAGMA x",
    ],
)
def test_writing_queries_are_refused(query):
    assert validate_query(query)


def test_sql_box(spark, tables):
    result, seconds, error = run_sql_query(spark, "SELECT count(*) AS n FROM mine", {"mine": tables("nation")}, execute=True)
    assert error is None and seconds > 0 and result.first()["n"] == 25
    result, _, error = run_sql_query(spark, "SELECT * FROM nowhere_at_all")
    assert result is None and "nowhere_at_all" in error
    assert register_tables({"a": None, "b": tables("nation"), "c": tables("nation").limit(0)}, skip_empty=True) == ["b"]


def test_formats(spark):
    assert [files.detect_file_type(p) for p in ("a.CSV?x=1", "b.json#f", "c.xlsx", "d.bin", "e.parquet")] == [
        "csv", "json", "excel", "unknown", "parquet",
    ]
    path = scratch_path(spark, "fmt") + ".csv"
    df = spark.createDataFrame([(1, 'say "hi", you', None), (2, "b", 1.5)], "i int, s string, x double")
    files.save_csv(df, path)
    back, error = files.load_file_flexible(spark, path)
    assert error is None and {tuple(r) for r in back.collect()} == {(1, 'say "hi", you', None), (2, "b", 1.5)}
    assert files.load_file_flexible(spark, "/nowhere/x.parquet")[1].startswith("Error reading file")
    assert files.load_file_flexible(spark, None)[1] == "No file provided."
    lines = scratch_path(spark, "fmt") + ".jsonl"
    files.save_json(df, lines)
    assert files.load_table(spark, lines, "jsonl").count() == 2


def test_pasted_text(spark):
    df, error = files.parse_pasted_csv(spark, "a\tb\n1\tx,y\n2\tz")
    assert error is None and [tuple(r) for r in df.collect()] == [(1, "x,y"), (2, "z")]
    assert files.parse_pasted_csv(spark, "a,b\n")[1] == "Parsed data is empty."
    assert files.parse_pasted_csv(spark, "  ")[1] == "No data pasted."


def test_nan_is_missing(spark):
    path = scratch_path(spark, "nan") + ".parquet"
    spark.createDataFrame([(float("nan"),), (1.0,)], "x double").write.parquet(path)
    assert files.load_table(spark, path).where("x is null").count() == 1


def test_versions(spark):
    store = VersionStore(spark, scratch_path(spark, "store"))
    first = store.save("t", spark.range(3).toDF("n"), "one", owner="ann")
    store.save("t", spark.range(5).toDF("n"), "two", owner="bob")
    assert [r["version_note"] for r in store.versions("t").collect()] == ["two", "one"]
    assert [r["row_count"] for r in store.datasets("ann").collect()] == [3]
    assert store.datasets(admin=True).count() == 2
    assert store.restore(first).count() == 3
    with pytest.raises(KeyError):
        store.restore("none")


def test_logs(spark):
    path = scratch_path(spark, "log")
    for i in range(3):
        logs.log_action(spark, path, f"Action {i}", user_id="u1")
    log = spark.read.parquet(path)
    users = spark.createDataFrame([("u1", "Ann@x.org")], "id string, email string")
    assert [r["action"] for r in logs.newest(log, 2).collect()] == ["Action 2", "Action 1"]
    # the limit comes before the filter
    assert logs.activity(log, users, "ANN", "action 0", limit=2).count() == 0
    assert logs.activity(log, users, "ANN", "action 0").count() == 1
    feedback = scratch_path(spark, "feedback")
    logs.save_feedback(spark, feedback, 5, "good")
    assert spark.read.parquet(feedback).first()["rating"] == 5


def test_page_tables():
    html = """<p>x</p><script>var t = '<table><tr><td>no</td></tr></table>'</script>
    <table><thead><tr><th>a<th>b</thead><tr><td rowspan="2">1</td><td>two  words</td></tr><tr><td>3</td></tr></table>
    <table><tr><td>out <table><tr><td>in</td></tr></table></td></tr></table><table></table>"""
    assert corpus.page_tables(html) == [
        [["a", "b"], ["1", "two words"], ["1", "3"]], [["out in"]], [["in"]],
    ]
    assert corpus.page_tables("no tables") == [] and corpus.page_tables(None) == []


def test_document_cut(spark):
    df = spark.createDataFrame([(n, "é" * n) for n in (29_999, 30_000, 30_001)], "n int, text string")
    rows = {r["n"]: r["text"] for r in corpus.truncate_for_context(df).collect()}
    assert len(rows[29_999]) == 29_999 and len(rows[30_000]) == 30_000
    assert rows[30_001] == "é" * 30_000 + corpus.CUT_NOTE


def test_files_with_bad_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff end")
    assert corpus.read_documents(spark, str(tmp_path)).first()["text"] == "ok � end"


def test_rowwise_steps_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, " A "), (2, None)], "i int, s string").write.parquet(source)
    stream = spark.readStream.schema("i int, s string").parquet(source)
    steps = [("standardize_text", {"column": "s", "method": "strip"}), ("mask_column", {"column": "s", "mask_type": "full"})]
    cleaned = tag_stream(apply_rowwise(stream, steps), [{"column": "s", "rule_type": "not_null"}])
    run = cleaned.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    run.awaitTermination(60)
    found = {r["i"]: (r["s"], len(r["violated_rules"])) for r in spark.table("cleaned").collect()}
    assert found == {1: ("***REDACTED***", 0), 2: (None, 1)}
    with pytest.raises(ValueError):
        apply_rowwise(stream, [("remove_duplicates", {})])


def test_flags_and_date_parts_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "moments")
    spark.createDataFrame([(1, "2024-02-29 10:00:00"), (2, None), (3, "no date")], "i int, at string").write.parquet(source)
    stream = spark.readStream.schema("i int, at string").parquet(source)
    steps = [("flag_missing", {"columns": ["at"]}), ("extract_date_parts", {"column": "at"})]
    running = apply_rowwise(stream, steps).writeStream.format("memory").queryName("moment_parts").start()
    running.processAllAvailable()
    running.stop()
    found = {r["i"]: r for r in spark.table("moment_parts").collect()}
    assert (found[1]["at_is_missing"], found[1]["at_year"], found[1]["at_weekday"]) == (False, 2024, "Thursday")
    assert found[2]["at_is_missing"] and found[3]["at_year"] is None
    for step in (("flag_missing", {}), ("extract_date_parts", {"column": "i"})):
        with pytest.raises(ValueError):
            apply_rowwise(stream, [step])
