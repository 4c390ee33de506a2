"""Interval, as-of, equi- and anti-joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.catalog.cleaning import flagged_logs, metric_features
from faultline.catalog.registry import query
from faultline.catalog.views import HOUR, HOURS, LOG_FEATURES, METRIC_FEATURES, WINDOWS
from faultline.functions import scalars as S
from faultline.operators import graph, intervals, rolling, text
from faultline.plans import features as plan

_M = [c for w in HOURS for c in METRIC_FEATURES[w]]
_L = [c for w in HOURS for c in LOG_FEATURES[w]]
_KEY = "run_id, service, window_start, window_end"


@query("label_point_in_fault", """
SELECT event_id, CAST(EXISTS (SELECT 1 FROM v_faults f WHERE f.run_id = e.run_id AND f.service = e.service
  AND f.start_ts <= e.ts AND e.ts <= f.end_ts) AS INT) AS y FROM v_events e""")
def label_point_in_fault(t):
    return intervals.label_points(t.events, t.faults, "ts", HOUR).select("event_id", "y")


def windows(t):
    return metric_features(t).select("run_id", "service", "window_start", "window_end", "error_ratio_mean_1h")


@query("label_window_overlap", f"""
WITH hit AS (SELECT w.run_id, w.service, w.window_start, w.window_end, arg_min(f.fault_type, f.label_seq) AS ft
  FROM v_metric_features w JOIN v_faults f ON f.run_id = w.run_id AND f.service = w.service AND w.window_start <= f.end_ts AND f.start_ts <= w.window_end
  GROUP BY ALL)
SELECT {_KEY}, CAST(ft IS NOT NULL AS INT) AS y_true, coalesce(ft, 'normal') AS fault_type
FROM v_metric_features LEFT JOIN hit USING ({_KEY})""")
def label_window_overlap(t):
    out = intervals.label_windows(windows(t), t.faults, 4 * HOUR)
    return out.select("run_id", "service", "window_start", "window_end", "y_true", "fault_type")


FUTURE_SQL = f"""
SELECT {_KEY}, CAST(bool_or(f.start_ts <= w.window_end + INTERVAL 5 HOUR AND f.end_ts >= w.window_end)
  AND NOT bool_or(f.start_ts <= w.window_end AND f.end_ts >= w.window_start) AS INT) AS y_future
FROM v_metric_features w LEFT JOIN v_faults f USING (run_id, service) GROUP BY ALL"""


@query("label_future_fault", f"SELECT {_KEY}, coalesce(y_future, 0) AS y_future FROM ({FUTURE_SQL})")
def label_future_fault(t):
    out = intervals.label_future(windows(t), t.faults, 5 * HOUR, 4 * HOUR)
    return out.select("run_id", "service", "window_start", "window_end", "y_future")


MTTD_SQL = """
SELECT *, round((epoch_us(first_detect_ts) - epoch_us(fault_start)) / 1e6, 6) AS mttd_seconds FROM (
  SELECT f.label_seq, f.run_id, f.service, f.fault_type, f.start_ts AS fault_start, f.end_ts AS fault_end, min(w.window_start) AS first_detect_ts
  FROM v_faults f LEFT JOIN (SELECT * FROM v_metric_features WHERE error_ratio_mean_1h >= 0.05) w
    ON f.run_id = w.run_id AND f.service = w.service AND w.window_start <= f.end_ts AND f.start_ts <= w.window_end GROUP BY ALL)"""


def mttd(t):
    flagged = windows(t).withColumn("y_pred", (S.finite_or_zero(F.col("error_ratio_mean_1h")) >= 0.05).cast("int"))
    return intervals.detection_delay(flagged, t.faults, bin_us=4 * HOUR)


@query("mttd_join", MTTD_SQL)
def mttd_join(t):
    return mttd(t)


@query("merge_features", f"""
SELECT {_KEY}, {', '.join(f'round(coalesce({c}, 0), 6) AS {c}' for c in _M)}, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in _L)}
FROM v_metric_features LEFT JOIN (SELECT * FROM v_hour_log_features) USING ({_KEY})""")
def merge_features(t):
    """Log windows end on whole hours here, so that the exact join finds partners."""
    hourly = flagged_logs(t).withColumn("ts", F.date_trunc("hour", "ts"))
    return plan.merge_features(metric_features(t), rolling.rolling_log_counts(hourly, WINDOWS))


TFIDF_DOCS = """
WITH tok AS (SELECT run_id, service, date_trunc('hour', ts) AS bucket, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM v_log_flags),
vocab AS (SELECT term FROM tok GROUP BY term ORDER BY count(*) DESC, term LIMIT 50),
ranked AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM vocab),
tf AS (SELECT run_id, service, bucket, idx, term, count(*) AS tf FROM tok JOIN ranked USING (term) GROUP BY ALL),
dfq AS (SELECT idx, count(*) AS df FROM tf GROUP BY idx),
n AS (SELECT count(*) AS n FROM (SELECT DISTINCT run_id, service, date_trunc('hour', ts) FROM v_log_flags)),
raw AS (SELECT run_id, service, bucket, idx, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN dfq USING (idx), n),
tfidf AS (SELECT run_id, service, bucket, idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY run_id, service, bucket)) AS weight FROM raw)"""


def hourly_tfidf(t):
    docs = text.log_documents(flagged_logs(t), HOUR)
    return text.tfidf_wide(docs, ["run_id", "service", "window_start", "window_end"])


_TF = [f"tfidf_{i}" for i in range(50)]


@query("attach_tfidf", TFIDF_DOCS + f"""
SELECT f.run_id, f.service, f.window_start, f.window_end,
  {', '.join(f"round(coalesce(max(weight) FILTER (WHERE idx = {i}), 0), 6) AS tfidf_{i}" for i in range(50))}
FROM v_hour_log_features f LEFT JOIN tfidf d ON d.run_id = f.run_id AND d.service = f.service AND d.bucket = f.window_end
  AND d.bucket - INTERVAL 1 HOUR = f.window_start GROUP BY ALL""")
def attach_tfidf(t):
    hourly = flagged_logs(t).withColumn("ts", F.date_trunc("hour", "ts"))
    out = plan.attach_tfidf(rolling.rolling_log_counts(hourly, WINDOWS), hourly_tfidf(t))
    return out.select("run_id", "service", "window_start", "window_end", *_TF)


@query("merge_log_aggs", "SELECT run_id, service, ts AS window_end, " + ", ".join(f"max({c}) AS {c}" for c in _L) + " FROM v_log_rolling GROUP BY ALL")
def merge_log_aggs(t):
    return rolling.rolling_log_counts(flagged_logs(t), WINDOWS, layout="wide")


@query("asof_nearest", """
WITH a AS (SELECT event_id, run_id, service, ts FROM v_logs WHERE level = 'ERROR'),
f AS (SELECT run_id, service, ts AS fts, rps FROM v_pivot),
b AS (SELECT a.*, f.fts AS b_ts, f.rps AS b_v FROM a ASOF LEFT JOIN f ON a.run_id = f.run_id AND a.service = f.service AND a.ts >= f.fts),
c AS (SELECT a.event_id, f.fts AS c_ts, f.rps AS c_v FROM a ASOF LEFT JOIN f ON a.run_id = f.run_id AND a.service = f.service AND a.ts <= f.fts),
j AS (SELECT b.*, c_ts, c_v, CASE WHEN ts - b_ts <= INTERVAL 1 HOUR THEN epoch_us(ts) - epoch_us(b_ts) END AS db,
  CASE WHEN c_ts - ts <= INTERVAL 1 HOUR THEN epoch_us(c_ts) - epoch_us(ts) END AS dc FROM b JOIN c USING (event_id))
SELECT event_id, CASE WHEN db IS NOT NULL AND (dc IS NULL OR db <= dc) THEN b_ts WHEN dc IS NOT NULL THEN c_ts END AS embed_window_end,
  round(coalesce(CASE WHEN db IS NOT NULL AND (dc IS NULL OR db <= dc) THEN b_v WHEN dc IS NOT NULL THEN c_v END, 0), 6) AS tfidf_0,
  db IS NOT NULL OR dc IS NOT NULL AS has_embed FROM j""")
def asof_nearest(t):
    errors = t.logs.filter("level = 'ERROR'").select("event_id", "run_id", "service", "ts")
    pivot = rolling.pivot_metrics(t.metrics)
    rows = pivot.select("run_id", "service", F.col("ts").alias("window_end"), F.col("ts").alias("window_start"), F.col("rps").alias("tfidf_0"))
    return intervals.attach_embeddings(errors, rows, ["tfidf_0"], HOUR).select("event_id", "embed_window_end", "tfidf_0", "has_embed")


@query("cooccurrence_edges", """
WITH i AS (SELECT event_id, run_id, run_id || '_' || level AS incident_id, ts, service FROM v_logs WHERE level <> 'INFO'),
p AS (SELECT a.service AS s1, b.service AS s2 FROM i a JOIN i b ON a.run_id = b.run_id AND a.incident_id = b.incident_id
  AND a.event_id < b.event_id AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 2 * 3600000000 AND a.service <> b.service)
SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT s1 AS src, s2 AS dst FROM p UNION ALL SELECT s2, s1 FROM p) GROUP BY ALL""")
def cooccurrence_edges(t):
    rows = t.logs.filter("level <> 'INFO'").withColumn("incident_id", F.concat_ws("_", "run_id", "level"))
    return graph.cooccurrence_edges(rows, 2 * HOUR)


SPAN_EDGES_SQL = "SELECT DISTINCT p.service AS src, c.service AS dst FROM v_spans c JOIN v_spans p ON c.parent = p.span_id"


@query("span_dependency_edges", SPAN_EDGES_SQL)
def span_dependency_edges(t):
    return graph.span_edges(t.spans)


@query("join_components", """
WITH m AS (SELECT run_id, service, avg(amount) AS magnitude, epoch_us(min(ts)) AS first FROM v_events WHERE event_type = 'error' GROUP BY ALL),
g AS (SELECT service, count(*) / 4096 AS centrality FROM v_events WHERE service <> 'auth' GROUP BY ALL),
e AS (SELECT *, 1 / (1 + (first - min(first) OVER (PARTITION BY run_id)) / 1e6) AS raw FROM m)
SELECT e.run_id AS incident_id, e.service, round(magnitude, 6) AS magnitude, round(coalesce(centrality, 0), 6) AS centrality,
  round(raw / (max(raw) OVER (PARTITION BY e.run_id) + 1e-12), 6) AS earliness FROM e LEFT JOIN g USING (service)""")
def join_components(t):
    rows = t.events.filter("event_type = 'error'").select(F.col("run_id").alias("incident_id"), "run_id", "service", "ts", F.col("amount").alias("score"))
    scores = t.events.filter("service <> 'auth'").groupBy("service").agg((F.count(F.lit(1)) / 4096).alias("centrality"))
    return graph.score_causes(rows, scores).select("incident_id", "service", "magnitude", "centrality", "earliness")


@query("fault_active_grid", """
WITH f AS (SELECT *, CAST(ceil(epoch_us(start_ts) / 3e8) AS BIGINT) AS s, CAST(floor(epoch_us(end_ts) / 3e8) AS BIGINT) AS e FROM v_faults),
r AS (SELECT run_id, min(s) AS lo, max(e) AS hi FROM f GROUP BY ALL),
g AS (SELECT DISTINCT run_id, service, fault_type, unnest(generate_series(lo, hi)) AS k FROM f JOIN r USING (run_id))
SELECT run_id, service, fault_type, make_timestamp(k * 300000000) AS ts,
  CAST(EXISTS (SELECT 1 FROM f WHERE f.run_id = g.run_id AND f.service = g.service AND f.fault_type = g.fault_type AND s <= k AND k <= e) AS INT) AS active FROM g""")
def fault_active_grid(t):
    return intervals.fault_active_grid(t.faults, 300_000_000)


@query("coverage_check", """
WITH wanted AS (SELECT DISTINCT unnest(['simulator-' || service, 'simulator-cache']) AS service FROM v_events),
seen AS (SELECT DISTINCT 'logs' AS signal, '/repo-simulator-' || service || '-1' AS name FROM v_events
  UNION SELECT DISTINCT 'metrics', 'simulator-' || service FROM v_events WHERE service <> 'auth' UNION SELECT 'traces', 'simulator-user'),
hit AS (SELECT signal, service, coalesce(bool_or(contains(name, service)), false) AS found
  FROM (VALUES ('logs'), ('metrics'), ('traces')) s(signal) CROSS JOIN wanted LEFT JOIN seen USING (signal) GROUP BY ALL)
SELECT signal, string_agg(service, ',' ORDER BY service) FILTER (WHERE NOT found) AS missing,
  CASE WHEN signal = 'traces' THEN bool_or(found) ELSE bool_and(found) END AS ok FROM hit GROUP BY signal""")
def coverage_check(t):
    """Metrics and logs need all services, traces any; a service is seen where an observed name contains it."""
    name = F.concat(F.lit("simulator-"), "service")
    expected = t.events.select(F.explode(F.array(name, F.lit("simulator-cache"))).alias("service"))
    observed = (t.events.select(F.lit("logs").alias("signal"), F.concat(F.lit("/repo-"), name, F.lit("-1")).alias("name"))
                .unionByName(t.events.filter("service <> 'auth'").select(F.lit("metrics").alias("signal"), name.alias("name")))
                .unionByName(t.events.filter("service = 'user'").select(F.lit("traces").alias("signal"), name.alias("name"))))
    return intervals.coverage(expected, observed, {"metrics": "all", "logs": "all", "traces": "any"})


@query("vector_match_divide", """
WITH n AS (SELECT ts AS eval_ts, service, sum(value) AS a FROM v_metrics WHERE metric = 'eps' GROUP BY ALL),
d AS (SELECT ts AS eval_ts, service, sum(value) AS b FROM v_metrics WHERE metric = 'rps' GROUP BY ALL)
SELECT eval_ts, service, round(a / greatest(b, 1e-6), 6) AS ratio FROM n JOIN d USING (eval_ts, service)""")
def vector_match_divide(t):
    from faultline.operators.range_vectors import ratio, sum_by
    side = t.metrics.withColumnsRenamed({"ts": "eval_ts", "value": "rate"})
    return ratio(sum_by(side.filter("metric = 'eps'"), ["service"]), sum_by(side.filter("metric = 'rps'"), ["service"]), ["service"])


