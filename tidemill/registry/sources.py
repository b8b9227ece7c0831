"""Files, versions, logs, pages and documents."""

from pyspark.sql import functions as F

from tidemill.plans.session import scratch_path
from tidemill.registry import query
from tidemill.sources import corpus, files, logs
from tidemill.sources.versions import VersionStore

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query("csv_round_trip", "SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS c_mktsegment FROM customer")
def _csv(t, spark):
    path = scratch_path(spark, "csv")
    df = t("customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("MACHINERY")))
    files.save_csv(df, path)
    return files.load_table(spark, path, "csv")


@query("json_round_trip", f"SELECT * EXCLUDE (o_orderdate), strftime(o_orderdate, '%Y-%m-%d') AS day FROM ({_ORDERS})")
def _json(t, spark):
    path = scratch_path(spark, "json")
    df = t("orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")).drop("o_orderdate")
    files.save_json(df, path)
    return files.load_table(spark, path, "json", df.schema)


@query("parquet_save_load", _ORDERS)
def _parquet(t, spark):
    root = scratch_path(spark, "saved")
    files.save_dataframe(t("orders"), root, "orders")
    return files.load_dataframe(spark, root, "orders")


@query("version_restore", _ORDERS)
def _restore(t, spark):
    store = VersionStore(spark, scratch_path(spark, "versions"))
    version = store.save("orders", t("orders"), "all orders")
    store.save("orders", t("orders").drop("o_orderdate"), "no dates")
    return store.restore(version)


@query(
    "version_list",
    """SELECT 'orders' AS dataset_name, 'second' AS version_note, count(*) AS row_count, 6 AS column_count FROM orders
       UNION ALL SELECT 'orders', 'first', count(*), 5 FROM orders""",
)
def _versions(t, spark):
    store = VersionStore(spark, scratch_path(spark, "versions"))
    store.save("orders", t("orders").drop("o_orderdate"), "first")
    store.save("customers", t("customer"), "other")
    store.save("orders", t("orders"), "second")
    return store.versions("orders").select("dataset_name", "version_note", "row_count", "column_count")


_USERS = "(SELECT c_custkey AS id, lower(c_mktsegment) || c_custkey || '@example.com' AS email FROM customer)"


def _log(t):
    log = t("events").select(
        F.col("event_id").alias("id"), F.col("user_id"), F.col("event_type").alias("action"), F.col("ts").alias("created_at")
    )
    users = t("customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lower("c_mktsegment"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email")
    )
    return log, users


@query(
    "log_newest",
    "SELECT event_id AS id, user_id, event_type AS action, ts AS created_at FROM events ORDER BY ts DESC, event_id LIMIT 50",
)
def _newest(t, spark):
    return logs.newest(_log(t)[0])


@query(
    "log_query",
    f"""WITH l AS (SELECT event_id AS id, user_id, event_type AS action, ts AS created_at FROM events ORDER BY ts DESC, event_id LIMIT 200)
        SELECT l.*, email FROM l LEFT JOIN {_USERS} u ON u.id = l.user_id
        WHERE lower(coalesce(email, '')) LIKE '%e%' AND lower(action) LIKE '%c%'""",
)
def _activity(t, spark):
    log, users = _log(t)
    return logs.activity(log, users, "E", "C").select("id", "user_id", "action", "created_at", "email")


@query("log_append", "SELECT event_type AS action, 2 * count(*) AS n FROM events GROUP BY 1")
def _append(t, spark):
    path = scratch_path(spark, "log")
    log, _ = _log(t)
    logs.append_rows(log, path)
    logs.append_rows(log, path)
    return spark.read.parquet(path).groupBy("action").agg(F.count("*").alias("n"))


@query("html_tables", "SELECT page_id, 0 AS table_idx, 0 AS row_idx, '' AS cells FROM pages WHERE html LIKE '%<table%'")
def _tables(t, spark):
    found = corpus.html_tables(t("pages"))
    return found.select("page_id", "table_idx", "row_idx", F.array_join("cells", "|").alias("cells"))


@query(
    "html_tables_spans",
    """SELECT page_id, 0 AS table_idx, r AS row_idx, CASE r WHEN 0 THEN 'page|url|url' WHEN 1 THEN page_id || '|' || url || '|both'
              ELSE page_id || '|x & y|both' END AS cells FROM pages, (VALUES (0), (1), (2)) v(r)
       UNION ALL SELECT page_id, 1, 0, 'inner' FROM pages
       UNION ALL SELECT page_id, 2, 0, 'last' FROM pages""",
)
def _spans(t, spark):
    page = F.col("page_id").cast("string")
    table = F.concat(
        F.lit("<table><tr><th>page</th><th colspan='2'>url</th></tr><tr><td rowspan=2>"), page, F.lit("</td><td> "),
        F.col("url"), F.lit("</td><td rowspan=2>both</td></tr><tr><td>x\n&amp; y</td></tr></table>"),
        F.lit("<TABLE><tr><td>inner</td></tr></TABLE><table><tr><td>last</table>"),
    )
    pages = t("pages").select("page_id", F.concat("html", table).alias("html"))
    found = corpus.html_tables(pages)
    return found.select("page_id", "table_idx", "row_idx", F.array_join("cells", "|").alias("cells"))


@query(
    "doc_truncate",
    """SELECT doc_id, CASE WHEN length(text) > 30000 THEN left(text, 30000) || chr(10) || chr(10) ||
         '[... Content truncated for analysis. First 30,000 characters shown.]' ELSE text END AS text FROM documents""",
)
def _truncate(t, spark):
    return corpus.truncate_for_context(t("documents").select("doc_id", "text"))


# a small table as a user would paste it
@query("pasted_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _pasted(t, spark):
    line = F.concat_ws("\t", "n_nationkey", "n_name", "n_regionkey")
    rows = t("nation").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text")).first()["text"]
    found, error = files.parse_pasted_csv(spark, "n_nationkey\tn_name\tn_regionkey\n" + rows)
    if error:
        raise ValueError(error)
    return found


@query(
    "log_search_all",
    """SELECT e.event_id AS id, c.c_name AS email, e.event_type AS action FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey
       WHERE e.event_type LIKE '%c%' AND lower(coalesce(c.c_name, '')) LIKE '%7%'""",
)
def _search_all(t, spark):
    log = t("events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("action"), F.col("ts").alias("created_at"))
    users = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"))
    return logs.activity(log, users, "7", "C", limit=None).select("id", "email", "action")
