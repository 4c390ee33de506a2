"""Aggregations and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.catalog.cleaning import flagged_logs
from faultline.catalog.joins import MTTD_SQL, SPAN_EDGES_SQL, mttd
from faultline.catalog.registry import query
from faultline.catalog.views import BOUNDS, HOUR
from faultline.operators import aggregates as A
from faultline.operators import alerts, evaluation, graph, ordering, range_vectors, rolling, sketches, text
from faultline.schemas import METRIC_NAMES
from faultline.session import cut_lineage

SUMMARY = ["run_id", "service", "metric"]
SUMMARY_SQL = "SELECT run_id, service, metric, count(value) AS count, avg(value) AS mean, min(value) AS min, max(value) AS max FROM v_metrics GROUP BY ALL"


@query("pivot_metrics", "SELECT run_id, ts, service, " + ", ".join(f"round({m}, 6) AS {m}" for m in METRIC_NAMES) + " FROM v_pivot")
def pivot_metrics(t):
    return rolling.pivot_metrics(t.metrics)


@query("metric_summary", f"SELECT run_id, service, metric, count, round(mean, 6) AS mean, round(min, 6) AS min, round(max, 6) AS max FROM ({SUMMARY_SQL})")
def metric_summary(t):
    return A.metric_summary(t.metrics, SUMMARY)


@query("log_level_summary", "SELECT service, level, count(*) AS count FROM v_logs GROUP BY ALL")
def log_level_summary(t):
    return A.log_level_summary(t.logs)


@query("value_counts", "SELECT message, count(*) AS count FROM v_logs WHERE message IS NOT NULL GROUP BY ALL")
def value_counts(t):
    return A.value_counts(t.logs, "message")


@query("summary_rollup", f"""
SELECT service, metric, count(*) AS n_rows, round(avg(mean), 6) AS mean_of_mean, round(max(max), 6) AS max_of_max, round(min(min), 6) AS min_of_min
FROM ({SUMMARY_SQL}) GROUP BY ALL""")
def summary_rollup(t):
    return A.summary_rollup(A.metric_summary(t.metrics, SUMMARY))


@query("pivot_mean_matrix", "SELECT service, " + ", ".join(
    f"round(avg(mean) FILTER (WHERE metric = '{m}'), 6) AS {m}" for m in METRIC_NAMES) + f" FROM ({SUMMARY_SQL}) GROUP BY service")
def pivot_mean_matrix(t):
    return A.mean_matrix(A.metric_summary(t.metrics, SUMMARY), METRIC_NAMES)


@query("dedup_alerts", """
SELECT run_id, service, date_trunc('hour', ts) AS ts, level AS signal, min(ts) AS window_start, max(ts) AS window_end, max(event_id / 2) AS score,
  arg_min('event ' || CAST(event_id AS VARCHAR), ts) AS details FROM v_logs GROUP BY ALL""")
def dedup_alerts(t):
    raw = t.logs.select("run_id", "service", F.col("ts").alias("window_start"), F.col("ts").alias("window_end"),
                        F.date_trunc("hour", "ts").alias("ts"), F.col("level").alias("signal"), (F.col("event_id") / 2).alias("score"),
                        F.format_string("event %d", "event_id").alias("details"))
    return alerts.dedup_alerts(raw)


@query("bucket_documents", """
SELECT run_id, service, window_end, CAST((n - 1) // 3 AS BIGINT) AS part, string_agg(text, ' ' ORDER BY n) AS text
FROM (SELECT *, date_trunc('hour', ts) AS window_end, row_number() OVER (PARTITION BY run_id, service, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM v_log_flags)
GROUP BY run_id, service, window_end, (n - 1) // 3""")
def bucket_documents(t):
    """Parts of three lines, so that many documents have several."""
    return text.bucket_documents(flagged_logs(t), HOUR, "event_id", lines_per_part=3)


def daily_incidents(t):
    """Each run's error events as one incident, the event's amount as its score."""
    return t.events.filter("event_type = 'error'").select(
        F.concat("run_id", F.lit("_inc0")).alias("incident_id"), "run_id", "service", "ts", F.col("amount").alias("score"))


INCIDENTS_SQL = "(SELECT run_id || '_inc0' AS incident_id, run_id, service, ts, amount AS score FROM v_events WHERE event_type = 'error')"


@query("service_magnitude", f"SELECT incident_id, service, round(avg(score), 6) AS magnitude FROM {INCIDENTS_SQL} GROUP BY ALL")
def service_magnitude(t):
    return graph.incident_services(daily_incidents(t)).select("incident_id", "service", "magnitude")


@query("first_seen", f"SELECT incident_id, service, min(ts) AS first_seen FROM {INCIDENTS_SQL} GROUP BY ALL")
def first_seen(t):
    return graph.incident_services(daily_incidents(t)).select("incident_id", "service", "first_seen")


@query("incident_summary", f"SELECT incident_id, count(*) AS n_alerts, min(run_id) AS run_id FROM {INCIDENTS_SQL} GROUP BY ALL")
def incident_summary(t):
    return graph.incident_summary(daily_incidents(t))


@query("spans_per_trace", "SELECT trace_id, count(*) AS num_spans FROM v_spans GROUP BY ALL")
def spans_per_trace(t):
    return A.spans_per_trace(t.spans)


@query("latency_per_trace", "SELECT trace_id, sum(duration_ms) AS duration_ms FROM v_spans GROUP BY ALL")
def latency_per_trace(t):
    return A.latency_per_trace(t.spans)


_FIVE = [("min", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("max", 1.0)]


@query("duration_quartiles", "SELECT service, " + ", ".join(f"round(quantile_cont(duration_ms, {q}), 6) AS {n}" for n, q in _FIVE) + " FROM v_spans GROUP BY ALL")
def duration_quartiles(t):
    return A.five_numbers(t.spans, ["service"], "duration_ms")


@query("histogram_bins", """
WITH l AS (SELECT trace_id, sum(duration_ms) AS d FROM v_spans GROUP BY ALL), e AS (SELECT min(d) AS lo, max(d) AS hi FROM l)
SELECT CAST(least(floor((d - lo) / ((hi - lo) / 5)), 4) AS INT) AS bin, round(lo + bin * (hi - lo) / 5, 6) AS bin_start, count(*) AS count FROM l, e GROUP BY ALL""")
def histogram_bins(t):
    return evaluation.equal_width_bins(A.latency_per_trace(t.spans), "duration_ms", 5)


@query("degree_features", f"""
WITH e AS ({SPAN_EDGES_SQL})
SELECT s AS service, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree
FROM (SELECT src AS s, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY ALL""")
def degree_features(t):
    return graph.degrees(graph.span_edges(t.spans))


@query("mttd_stats", f"""
SELECT count(mttd_seconds) AS n_detected, round(avg(mttd_seconds), 6) AS mttd_mean_seconds, round(median(mttd_seconds), 6) AS mttd_median_seconds FROM ({MTTD_SQL})""")
def mttd_stats(t):
    return evaluation.mttd_stats(mttd(t))


@query("percentile_linear", """
SELECT service, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM v_events GROUP BY ALL""")
def percentile_linear(t):
    mean = t.events.groupBy("service").agg(F.avg("value").alias("mean"))
    return mean.join(ordering.exact_quantiles(t.events, ["service"], "value", {"p50": 0.5, "p95": 0.95}), "service")


@query("percentile_sketch", "SELECT service, count(value) AS n, true AS p50, true AS p95, true AS p99 FROM v_events GROUP BY ALL")
def percentile_sketch(t):
    """Daily sketches merged to one per service; whether each quantile's rank is within twice the stated error."""
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    daily = cut_lineage(sketches.quantile_sketches(t.events, ["service"], "value", "ts"))
    found = sketches.sketch_quantiles(sketches.merge_sketches(daily, ["service"]), points)
    gaps = sketches.rank_gaps(t.events, found, ["service"], "value", points)
    return gaps.select("service", "n", *[(F.col(p) <= 2 * sketches.rank_error()).alias(p) for p in points])


@query("sum_by", """
SELECT ts AS eval_ts, metric, round(sum(value), 6) AS value FROM v_metrics GROUP BY ALL""")
def sum_by(t):
    return range_vectors.sum_by(t.metrics.withColumnRenamed("ts", "eval_ts"), ["metric"], "value")


BUCKETS_SQL = "(SELECT run_id, service, ts, b AS le, CAST(count(*) FILTER (WHERE value <= b) AS DOUBLE) AS value FROM v_hist, (SELECT unnest([10.0, 25.0, 50.0, 100.0, 200.0, 350.0, 500.0, 'Infinity'::DOUBLE]) AS b) GROUP BY ALL)"


@query("latency_bucket_counts", f"SELECT run_id, service, ts, CAST(le AS VARCHAR) AS le, value FROM {BUCKETS_SQL}")
def latency_bucket_counts(t):
    out = A.bucket_counts(t.hist, ["run_id", "service", "ts"], "value", BOUNDS)
    return out.withColumn("le", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")))


@query("histogram_quantile", f"""
WITH b AS (SELECT *, lag(le) OVER w AS lo, lag(value) OVER w AS below, max(value) OVER (PARTITION BY run_id, service, ts) AS total
  FROM {BUCKETS_SQL} WINDOW w AS (PARTITION BY run_id, service, ts ORDER BY le))
SELECT run_id, service, ts, round(arg_min(CASE WHEN le = 'Infinity'::DOUBLE THEN lo
  ELSE coalesce(lo, 0) + (le - coalesce(lo, 0)) * (0.95 * total - coalesce(below, 0)) / (value - coalesce(below, 0)) END, le), 6) AS quantile
FROM b WHERE value >= 0.95 * total AND (below IS NULL OR below < 0.95 * total) GROUP BY ALL""")
def histogram_quantile(t):
    buckets = A.bucket_counts(t.hist, ["run_id", "service", "ts"], "value", BOUNDS)
    return range_vectors.histogram_quantile(buckets, ["run_id", "service", "ts"], 0.95)


@query("request_counters", "SELECT service, event_type, run_id, count(*) AS requests FROM v_events GROUP BY ALL")
def request_counters(t):
    return A.request_counters(t.events, ["service", "event_type", "run_id"])


