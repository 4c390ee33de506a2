"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultline.catalog import load  # noqa: E402
from faultline.session import build_session  # noqa: E402

HEADLINE = [
    "pivot_metrics", "rolling_metric_stats", "rolling_log_counts", "rolling_zscore", "union_windows",
    "label_point_in_fault", "label_window_overlap", "label_future_fault", "mttd_join", "asof_nearest",
    "cooccurrence_edges", "span_dependency_edges", "duration_quartiles", "percentile_linear", "roc_auc",
    "average_precision", "tune_threshold", "rate", "max_avg_over_time", "count_over_time", "histogram_quantile",
    "alert_for_duration", "topk_error_messages", "temporal_split_3way", "tfidf_features", "build_alerts",
    "dbscan_incidents", "rca_rank", "fit_isolation_forest", "score_incident_prob", "stream_log_counts",
    "end_to_end_features", "end_to_end_root_causes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    queries["log_level_summary"](spark, folder).collect()  # start the JVM's code paths
    times = {}
    for key in HEADLINE:
        start = time.time()
        queries[key](spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
