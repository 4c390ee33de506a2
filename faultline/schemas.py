"""Table shapes of the telemetry model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLES = "metric STRING, labels MAP<STRING,STRING>, ts TIMESTAMP, value DOUBLE"
METRICS = ("run_id STRING, window_start STRING, window_end STRING, ts TIMESTAMP, "
           "service STRING, metric STRING, value DOUBLE")
LOGS = ("run_id STRING, ts STRING, service STRING, level STRING, message STRING, "
        "line STRING, labels MAP<STRING,STRING>")
LOG_ARRAY = f"ARRAY<STRUCT<{LOGS}>>"
LABELS = "run_id STRING, service STRING, fault_type STRING, start_ts STRING, end_ts STRING"
ALERTS = ("run_id STRING, service STRING, window_start TIMESTAMP, window_end TIMESTAMP, "
          "ts TIMESTAMP, signal STRING, score DOUBLE, details STRING")
GRAPH = ("edges ARRAY<STRUCT<src: STRING, dst: STRING, weight: DOUBLE>>, type STRING, "
         "window_seconds LONG")
SPANS = "trace_id STRING, span_id STRING, parent STRING, service STRING, duration_ms DOUBLE"

# Columns each table must have before an operator accepts it.
REQUIRED = {
    "labels": ["run_id", "service", "fault_type", "start_ts", "end_ts"],
    "features": ["run_id", "service", "window_start", "window_end"],
    "alerts": ["run_id", "service", "ts", "score"],
    "incidents": ["incident_id", "run_id", "service", "ts", "score"],
    "metric_summary": ["service", "metric", "count", "mean", "min", "max"],
}

METRIC_NAMES = ["rps", "eps", "error_ratio", "p95_latency"]


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def time_violations(df: DataFrame, time_columns: list[str]) -> DataFrame:
    """One row per time column: how many values are absent or unparsable."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in time_columns])
    return counts.select(F.explode(F.create_map(*[
        x for c in time_columns for x in (F.lit(c), F.col(c))])).alias("column_name", "violations"))
