"""Streaming queries over the given tables; each processes all of its input and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.catalog.aggregates import INCIDENTS_SQL, daily_incidents
from faultline.catalog.learning import KEYS, MODEL_COLUMNS, _training, model_rows
from faultline.catalog.registry import query
from faultline.catalog.sorting import CENTRALITY_SQL, RANKED_SQL, flat_centrality
from faultline.catalog.views import HOUR, METRICS, Tables
from faultline.operators import intervals
from faultline.operators.regression import fit_incident_model
from faultline.plans import detect
from faultline.session import scratch_path
from faultline.streaming import live


def streamed(t) -> Tables:
    """The same views, with the events table read as a stream."""
    s = Tables(t.spark, t.folder)
    stored = t.raw

    def raw(name):
        return live.read_stream(t.spark, t.folder, name) if name == "events" else stored(name)

    s.raw = raw
    return s


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM v_events)"


@query("stream_log_counts", f"""
WITH w AS (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS i FROM v_logs), s AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(CAST(i * 10 AS INT)) AS ws FROM w)
SELECT ws AS window_start, ws + INTERVAL 1 HOUR AS window_end, service, count(*) FILTER (WHERE level = 'ERROR') AS errors,
  count(*) FILTER (WHERE level = 'WARN') AS warnings, count(*) AS total FROM s WHERE ws + INTERVAL 1 HOUR <= {CLOSED} GROUP BY ALL""")
def stream_log_counts(t):
    return live.run_append(live.log_counts(streamed(t).logs, "1 hour", "10 minutes", "1 hour"), "log_counts")


STREAM_WINDOWS = ((1, 1), (5, 1), (15, 5))  # width and slide in hours


def _stream_features_sql(width: int, slide: int) -> str:
    stats = ", ".join(f"round({fn}(value) FILTER (WHERE metric = '{m}'), 6) AS {m}_{s}" for m in METRICS
                      for s, fn in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
    return (f"SELECT run_id, service, ws AS window_start, ws + INTERVAL {width} HOUR AS window_end, {stats} FROM (SELECT *, "
            f"time_bucket(INTERVAL {slide} HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(CAST(i * {slide} AS INT)) AS ws "
            f"FROM v_metrics, (SELECT unnest(range({width // slide})) AS i)) "
            f"WHERE ws + INTERVAL {width} HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM v_metrics) GROUP BY ALL")


@query("stream_metric_features", " UNION ALL ".join(_stream_features_sql(*w) for w in STREAM_WINDOWS))
def stream_metric_features(t):
    """The three window lengths, the longer ones sliding."""
    out = None
    for width, slide in STREAM_WINDOWS:
        rows = live.metric_features(streamed(t).metrics, f"{width} hours", f"{slide} hours" if slide < width else None, "1 hour")
        part = live.run_append(rows, f"metric_features_{width}")
        out = part if out is None else out.unionByName(part)
    return out


def _feature_files(t):
    """Feature rows written as a table that arrives in several batches."""
    path = scratch_path(t.spark, "feature_rows")
    model_rows(t).repartition(3, *KEYS).write.parquet(path)
    return path


_SAME = f"SELECT {', '.join(KEYS)}, 0.0::DOUBLE AS change FROM v_metric_features"


def _change(stream, batch, score):
    """Every streamed row against the batch result of the same window."""
    both = stream.select(*KEYS, score).join(batch.select(*KEYS, F.col(score).alias("_batch")), KEYS, "full")
    return both.select(*KEYS, F.abs(F.col(score) - F.col("_batch")).alias("change"))


@query("stream_detect", _SAME)
def stream_detect(t):
    """Scores of rows that arrive in several batches, less those of one batch."""
    path = _feature_files(t)
    rows = t.spark.read.parquet(path)
    scaler, forest = detect.fit_detector(rows, MODEL_COLUMNS, KEYS, trees=200)
    model = detect.Detector(scaler, forest, 0, 0, 0.05)
    out = model.transform(live.read_stream(t.spark, path, files_per_batch=1)).select(*KEYS, "anomaly_score", "anomaly_flag")
    return _change(live.run_append(out, "detect"), model.transform(rows), "anomaly_score")


@query("stream_predict", _SAME)
def stream_predict(t):
    """Probabilities of rows that arrive in several batches, less those of one batch."""
    path = _feature_files(t)
    model = fit_incident_model(_training(t).filter("split_no = 0"), MODEL_COLUMNS)
    out = model.transform(live.read_stream(t.spark, path, files_per_batch=1)).select(*KEYS, "probability", "flag")
    return _change(live.run_append(out, "predict"), model.transform(t.spark.read.parquet(path)), "probability")


@query("stream_latest_gauge", "SELECT service, max(ts) AS ts, round(arg_max(score, ts), 6) AS score, arg_max(y, ts) AS y FROM v_scored GROUP BY ALL")
def stream_latest_gauge(t):
    return live.run_update(live.latest_gauges(streamed(t).scored, ["score", "y"]), "gauges", ["service"])


@query("stream_alert_for", f"""
WITH x AS (SELECT service, amount, unnest([0, 1, 2, 3, 4, 5]) AS i, time_bucket(INTERVAL 10 MINUTE, ts) AS b FROM v_events),
a AS (SELECT service, b + INTERVAL 1 HOUR - to_minutes(CAST(i * 10 AS INT)) AS eval_ts, max(amount) AS hi, avg(amount) AS mid FROM x GROUP BY ALL),
c AS (SELECT service, eval_ts, 'high_peak' AS rule, hi > 80 AS cond, 2 AS hold FROM a UNION ALL SELECT service, eval_ts, 'high_mean', mid > 40, 3 FROM a),
f AS (SELECT * FROM c WHERE eval_ts <= {CLOSED}),
h AS (SELECT *, count(*) FILTER (WHERE cond) OVER (PARTITION BY rule, service ORDER BY eval_ts RANGE BETWEEN INTERVAL 20 MINUTE PRECEDING AND CURRENT ROW) AS h2,
  count(*) FILTER (WHERE cond) OVER (PARTITION BY rule, service ORDER BY eval_ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS h3 FROM f)
SELECT rule, service, eval_ts, cond, CASE WHEN NOT cond THEN 'inactive' WHEN (hold = 2 AND h2 = 3) OR (hold = 3 AND h3 = 4) THEN 'firing' ELSE 'pending' END AS state FROM h""")
def stream_alert_for(t):
    gauge = streamed(t).events.select("service", "ts", F.col("amount").alias("value"))
    rules = {"high_peak": (F.col("hi") > 80, 2), "high_mean": (F.col("mid") > 40, 3)}
    path = scratch_path(t.spark, "ticks")
    ticks = live.run_append(live.gauge_ticks(gauge, "1 hour", "10 minutes", "1 hour"), "ticks", path)
    arriving = t.spark.readStream.schema(ticks.schema).parquet(f"{path}/out")
    return live.run_append(live.alert_states(arriving, rules, 600_000_000), "alerts")


@query("stream_request_counters", """
SELECT service, event_type, count(*) AS requests, count(*) FILTER (WHERE value <= 10) AS le_10, count(*) FILTER (WHERE value <= 50) AS le_50, count(*) AS le_inf
FROM v_events GROUP BY ALL""")
def stream_request_counters(t):
    out = live.request_counters(streamed(t).events, ["service", "event_type"], "value", [10.0, 50.0, float("inf")])
    return live.run_update(out, "counters", ["service", "event_type"])


_RECENT = f"(SELECT *, row_number() OVER (ORDER BY began DESC, incident_id DESC) AS place FROM (SELECT incident_id, min(ts) AS began FROM {INCIDENTS_SQL} GROUP BY ALL) ORDER BY place LIMIT 20)"


@query("stream_recent_incidents", "WITH " + RANKED_SQL.format(incidents=INCIDENTS_SQL, graph=CENTRALITY_SQL, k=3).replace(
    "SELECT incident_id, run_id, CAST(row_number()", "SELECT CAST(place AS INT) AS place, incident_id, run_id, began, CAST(row_number()").replace(" FROM f QUALIFY", f" FROM f JOIN {_RECENT} USING (incident_id) QUALIFY"))
def stream_recent_incidents(t):
    """Root-cause gauges of the newest 20 incidents, kept up to date while alerts arrive in four batches."""
    path = scratch_path(t.spark, "recent")
    daily_incidents(t).repartitionByRange(4, "ts").write.parquet(f"{path}/alerts")
    causes = live.RecentCauses(t.spark, path, flat_centrality(t), 20, 3, 40 * 24 * HOUR)
    return causes.run(live.read_stream(t.spark, f"{path}/alerts", files_per_batch=1))


def _marks(t):
    kind = F.col("event_type")
    message = F.when(kind == "error", "fault_start").when(kind == "signup", "fault_end").when(kind == "view", "fault_cleared").otherwise("request_ok")
    return t.events.select("run_id", "service", "ts", message.alias("message"))


_INTERVALS = """
WITH m AS (SELECT run_id, service, ts, event_type = 'error' AS is_start FROM v_events WHERE event_type IN ('error', 'signup', 'view')),
p AS (SELECT *, min(CASE WHEN NOT is_start THEN ts END) OVER (PARTITION BY run_id, service ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS end_ts FROM m)
SELECT run_id, service, ts AS start_ts, end_ts FROM p WHERE is_start"""


@query("fault_intervals_from_logs", _INTERVALS)
def fault_intervals_from_logs(t):
    return intervals.intervals_from_events(_marks(t), ["run_id", "service"], span_us=HOUR)


@query("stream_fault_intervals", _INTERVALS + f" AND end_ts IS NOT NULL AND epoch_ms(end_ts) * 1000 + 1000 <= (SELECT epoch_ms(max(ts)) * 1000 - 3600000000 FROM v_events WHERE event_type IN ('error', 'signup', 'view'))")
def stream_fault_intervals(t):
    return live.run_append(live.fault_intervals(_marks(streamed(t)), delay="1 hour", block_ms=HOUR // 1000), "intervals")


