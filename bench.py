"""Time the headline queries; prints one JSON line.

Each query is built and its full result is written to the no-op sink, so every row and column
is computed.  Every query runs twice and the second run is reported: the first one pays for
loading and compiling code, which a small table would otherwise mostly measure.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemill import registry  # noqa: E402
from tidemill.plans.session import build_session  # noqa: E402

HEADLINE = [
    "segment_order_value", "join_inner", "join_left", "join_outer", "join_outer_null_keys", "join_hot_keys",
    "concat_vertical", "concat_horizontal", "calc_column", "calc_mod_floor", "filter_isin",
    "fill_mean", "fill_median", "fill_mode", "fill_forward", "fill_forward_by_user", "outliers_remove", "outliers_cap",
    "dedupe", "dedupe_none", "duplicate_count", "split_column", "text_titlecase", "document_blanks", "date_parts",
    "bin_numeric", "one_hot", "mask_hash", "group_mean", "group_median", "group_median_many", "pivot_mean",
    "value_counts_l_partkey", "crosstab", "describe", "shape_stats", "cat_summary", "corr_matrix", "histogram",
    "box_stats", "kpi_detect", "kpi_card_mean", "explain_value", "time_day", "time_intelligence_w",
    "time_intelligence_ms", "time_by_event_type", "trends", "regularise_monthly", "forecast_monthly", "profile",
    "quality_score", "quality_report", "anomalies", "run_validation", "violations_unique", "pii_rates",
    "insight_cards", "issue_queue", "auto_clean", "ttest", "chi2", "anova", "ols", "logistic", "kmeans_centers",
    "sql_inner_join_chain", "sql_correlated_subquery", "sql_ranking_windows", "html_tables_spans", "doc_truncate",
    "cleaning_steps", "parquet_save_load",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        for _ in range(2):
            started = time.perf_counter()
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "run": "second of two",
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
