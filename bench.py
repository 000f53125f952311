"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query after one warm-up (default 3)
BENCH_QUERIES comma-separated names instead of the headline list
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabulon.plans.catalog import queries  # noqa: E402
from tabulon.session import get_session  # noqa: E402

HEADLINE = [
    "stats_overall", "stats_by_state", "stats_by_age", "stats_income_label", "stats_all",
    "clients_page_totals", "validate_records", "json_rows", "csv_roundtrip",
    "value_counts", "describe", "column_info", "duplicate_count", "modes", "corr_matrix",
    "count_table", "box_cgpa_by_label", "histogram", "density", "price_quantiles",
    "string_index", "frequency_codes", "label_encode", "one_hot", "prepare_training",
    "survey_features", "split_hash", "split_stratified",
    "auc", "class_report", "confusion_matrix", "boosted_leaves", "deep_page_indexed", "csv_split",
    # the first one also trains the forest, in its warm-up
    "forest_scores", "score_records", "permutation_importance",
]


def run(spark, query, base_dir) -> float:
    start = time.perf_counter()
    query(spark, base_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    base_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES")
    spark = get_session("bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    catalogue, seconds = queries(), {}
    for name in names.split(",") if names else HEADLINE:
        run(spark, catalogue[name], base_dir)
        timed = [run(spark, catalogue[name], base_dir) for _ in range(runs)]
        seconds[name] = round(statistics.median(timed), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total of median query seconds", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(base_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
