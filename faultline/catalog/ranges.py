"""Rolling frames, range vectors, for-duration alerts, set operations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from faultline.catalog.aggregates import INCIDENTS_SQL, daily_incidents
from faultline.catalog.cleaning import flagged_logs, metric_features
from faultline.catalog.registry import query
from faultline.catalog.views import HOUR, HOURS, LOG_FEATURES, METRIC_FEATURES, WINDOWS, rounded
from faultline.functions import scalars as S
from faultline.operators import aggregates as A
from faultline.operators import alerts, graph, intervals, range_vectors, rolling
from faultline.plans import features as plan

_M = [c for w in HOURS for c in METRIC_FEATURES[w]]
_L = [c for w in HOURS for c in LOG_FEATURES[w]]
_KEY = "run_id, service, window_start, window_end"
STEP = 300_000_000


@query("rolling_metric_stats", f"SELECT run_id, service, ts AS window_end, {rounded(_M)} FROM v_rolling")
def rolling_metric_stats(t):
    return metric_features(t, layout="wide")


@query("union_windows", f"SELECT {_KEY}, {rounded(_M)} FROM v_metric_features")
def union_windows(t):
    return metric_features(t)


@query("rolling_log_counts", f"SELECT DISTINCT {_KEY}, {', '.join(_L)} FROM v_log_features")
def rolling_log_counts(t):
    return rolling.rolling_log_counts(flagged_logs(t), WINDOWS)


_Z = """
SELECT event_id, round(z, 6) AS z_score, CAST(z >= 2 AS INT) AS y_pred FROM (
  SELECT event_id, CASE WHEN count(score) OVER w >= 4 AND stddev_samp(score) OVER w <> 0
    THEN (score - avg(score) OVER w) / stddev_samp(score) OVER w ELSE 0 END AS z FROM v_scored
  WINDOW w AS ({part} ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""


@query("rolling_zscore", _Z.format(part="PARTITION BY run_id, service"))
def rolling_zscore(t):
    out = rolling.rolling_zscore(t.scored, "score", ["ts", "event_id"], 12, 2.0, ["run_id", "service"])
    return out.select("event_id", "z_score", "y_pred")


@query("rolling_zscore_global", _Z.format(part=""))
def rolling_zscore_global(t):
    """One sequence over all services."""
    return rolling.rolling_zscore(t.scored, "score", ["ts", "event_id"], 12, 2.0).select("event_id", "z_score", "y_pred")


@query("minute_bucket", "SELECT event_id, date_trunc('minute', ts) AS minute, time_bucket(INTERVAL 5 MINUTE, ts) AS five FROM v_events")
def minute_bucket(t):
    return t.events.select("event_id", A.minute_bucket(F.col("ts")).alias("minute"), A.minute_bucket(F.col("ts"), STEP).alias("five"))


@query("elapsed_from_start", "SELECT event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY run_id)) / 1e6, 6) AS elapsed_seconds FROM v_events")
def elapsed_from_start(t):
    return A.elapsed_from_start(t.events, ["run_id"]).select("event_id", "elapsed_seconds")


@query("earliness", f"""
WITH f AS (SELECT incident_id, service, epoch_us(min(ts)) AS first FROM {INCIDENTS_SQL} GROUP BY ALL),
e AS (SELECT *, 1 / (1 + (first - min(first) OVER (PARTITION BY incident_id)) / 1e6) AS raw FROM f)
SELECT incident_id, service, round(raw / (max(raw) OVER (PARTITION BY incident_id) + 1e-12), 6) AS earliness FROM e""")
def earliness(t):
    return graph.incident_services(daily_incidents(t)).select("incident_id", "service", "earliness")


@query("max_normalize", """
WITH s AS (SELECT run_id, service, sum(cents) AS total FROM v_events GROUP BY ALL)
SELECT run_id, service, round(total / (max(total) OVER () + 1e-12), 6) AS of_all, round(total / (max(total) OVER (PARTITION BY run_id) + 1e-12), 6) AS of_run FROM s""")
def max_normalize(t):
    sums = t.events.groupBy("run_id", "service").agg(F.sum("cents").alias("total"))
    return graph.max_normalize(graph.max_normalize(sums, "total", "of_all"), "total", "of_run", ["run_id"]).drop("total")


_TICKS = """
s AS (SELECT service, epoch_us(ts) AS t, value AS v, lag(value) OVER (PARTITION BY service ORDER BY ts) AS prev FROM v_counters),
x AS (SELECT *, unnest(generate_series(CAST(ceil(t / 3e8) AS BIGINT), CAST(ceil((t + 3600000000) / 3e8) AS BIGINT) - 1)) AS k FROM s),"""


@query("rate", f"""
WITH {_TICKS}
a AS (SELECT service, k, min(t) AS t0, max(t) AS t1, count(*) AS n, arg_min(v, t) AS v0, arg_max(v, t) AS v1,
  sum(CASE WHEN v < prev THEN prev ELSE 0 END) - arg_min(CASE WHEN v < prev THEN prev ELSE 0 END, t) AS resets FROM x GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT *, v1 - v0 + resets AS inc, (t1 - t0) / 1e6 AS span, (t0 - (k * 300000000 - 3600000000)) / 1e6 AS h0, (k * 300000000 - t1) / 1e6 AS e0 FROM a),
c AS (SELECT *, CASE WHEN h0 >= span / (n - 1) * 1.1 THEN span / (n - 1) / 2 ELSE h0 END AS h1, CASE WHEN e0 >= span / (n - 1) * 1.1 THEN span / (n - 1) / 2 ELSE e0 END AS e1 FROM b),
d AS (SELECT *, CASE WHEN inc > 0 AND v0 >= 0 AND span * v0 / inc < h1 THEN span * v0 / inc ELSE h1 END AS h2 FROM c)
SELECT service, make_timestamp(k * 300000000) AS eval_ts, round(inc * ((span + h2 + e1) / span) / 3600, 6) AS rate FROM d""")
def rate(t):
    return range_vectors.rate(t.counters, ["service"], HOUR, STEP)


@query("range_eval_grid", """
WITH r AS (SELECT run_id, epoch_us(min(start_ts)) - 1800000000 AS s, epoch_us(max(end_ts)) + 1800000000 AS e FROM v_faults GROUP BY ALL),
g AS (SELECT run_id, unnest(generate_series(s, e, 300000000)) AS t FROM r)
SELECT c.run_id, c.service, make_timestamp(g.t) AS eval_ts, arg_max(c.value, c.ts) AS value
FROM g JOIN v_counters c ON c.run_id = g.run_id AND epoch_us(c.ts) > g.t - 3600000000 AND epoch_us(c.ts) <= g.t GROUP BY ALL""")
def range_eval_grid(t):
    ranges = intervals.run_time_window(t.faults, HOUR // 2)
    return range_vectors.evaluate_on_grid(t.counters, ranges, ["run_id", "service"], STEP, HOUR)


@query("max_avg_over_time", """
WITH x AS (SELECT service, amount, unnest(generate_series(CAST(ceil(epoch_us(ts) / 3e8) AS BIGINT), CAST(ceil((epoch_us(ts) + 3600000000) / 3e8) AS BIGINT) - 1)) AS k FROM v_events)
SELECT service, make_timestamp(k * 300000000) AS eval_ts, round(max(amount), 6) AS max_over_time, round(avg(amount), 6) AS avg_over_time FROM x GROUP BY ALL""")
def max_avg_over_time(t):
    return range_vectors.over_time(t.events, ["service"], HOUR, STEP, "amount").select("service", "eval_ts", "max_over_time", "avg_over_time")


@query("count_over_time", """
WITH x AS (SELECT service, level, unnest(generate_series(CAST(ceil(epoch_us(ts) / 3.6e9) AS BIGINT), CAST(ceil(epoch_us(ts) / 3.6e9) AS BIGINT) + 4)) AS k FROM v_logs)
SELECT service, level, make_timestamp(k * 3600000000) AS eval_ts, count(*) AS count_over_time FROM x GROUP BY ALL""")
def count_over_time(t):
    return range_vectors.over_time(t.logs, ["service", "level"], 5 * HOUR, HOUR, None).select("service", "level", "eval_ts", "count_over_time")


@query("active_services", """
WITH x AS (SELECT service, unnest(generate_series(CAST(ceil(epoch_us(ts) / 3.6e9) AS BIGINT), CAST(ceil(epoch_us(ts) / 3.6e9) AS BIGINT) + 4)) AS k FROM v_logs WHERE level = 'ERROR')
SELECT make_timestamp(k * 3600000000) AS eval_ts, count(DISTINCT service) AS n_series FROM x GROUP BY ALL""")
def active_services(t):
    """Services with error lines in the last five hours, at each tick."""
    return range_vectors.count_by(range_vectors.over_time(t.logs.filter("level = 'ERROR'"), ["service"], 5 * HOUR, HOUR, None))


@query("last_not_null", "SELECT service, metric, round(arg_max(value, ts), 6) AS value, max(ts) AS ts FROM (SELECT service, event_type AS metric, ts, amount AS value FROM v_events WHERE cents > 500) GROUP BY ALL")
def last_not_null(t):
    series = t.events.select("service", F.col("event_type").alias("metric"), "ts", F.when(F.col("cents") > 500, F.col("amount")).alias("value"))
    return A.latest(series, ["service", "metric"], "value")


@query("threshold_color", """
WITH c AS (SELECT service, date_trunc('hour', ts) AS hour, sum(is_error) AS errors, sum(is_warn) AS warnings FROM v_log_flags GROUP BY ALL)
SELECT service, hour, CASE WHEN errors >= 5 THEN 'red' WHEN errors >= 1 THEN 'orange' ELSE 'green' END AS error_color,
  CASE WHEN warnings >= 20 THEN 'red' WHEN warnings >= 5 THEN 'orange' ELSE 'green' END AS warning_color FROM c""")
def threshold_color(t):
    counts = flagged_logs(t).groupBy("service", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("is_error").alias("e"), F.sum("is_warn").alias("w"))
    return counts.select("service", "hour", S.threshold_color(F.col("e"), S.ERROR_STEPS).alias("error_color"),
                         S.threshold_color(F.col("w"), S.WARNING_STEPS).alias("warning_color"))


ALERT_TICKS_SQL = """
x AS (SELECT service, amount, unnest(generate_series(CAST(ceil(epoch_us(ts) / 6e8) AS BIGINT), CAST(ceil(epoch_us(ts) / 6e8) AS BIGINT) + 5)) AS k FROM v_events),
a AS (SELECT service, k, max(amount) AS hi, avg(amount) AS mid FROM x GROUP BY ALL),
c AS (SELECT 'high_probability' AS rule, 'warning' AS severity, service, k, hi > 60 AS cond, 3 AS need FROM a
  UNION ALL SELECT 'high_p95_latency', 'warning', service, k, mid > 40, 3 FROM a
  UNION ALL SELECT 'high_error_ratio', 'warning', service, k, mid > 45, 3 FROM a
  UNION ALL SELECT 'incident_flag', 'critical', service, k, hi > 80, 2 FROM a),
h AS (SELECT *, count(*) FILTER (WHERE cond) OVER (PARTITION BY rule, service ORDER BY k RANGE BETWEEN CASE rule WHEN 'incident_flag' THEN 2 ELSE 3 END PRECEDING AND CURRENT ROW) AS held FROM c)
SELECT rule, severity, service, make_timestamp(k * 600000000) AS eval_ts, cond,
  CASE WHEN NOT cond THEN 'inactive' WHEN held = need + 1 THEN 'firing' ELSE 'pending' END AS state FROM h"""
SIM_RULES = {"high_probability": 60.0, "high_p95_latency": 40.0, "high_error_ratio": 45.0, "incident_flag": None}


@query("alert_for_duration", "WITH " + ALERT_TICKS_SQL)
def alert_for_duration(t):
    """All rules on one gauge, evaluated every ten minutes (ten seconds at full speed); the flag is 1 above 80, else 0."""
    gauge = t.events.select("service", "ts", F.col("amount").alias("value"))
    flag = gauge.withColumn("value", (F.col("value") > 80).cast("double"))
    out = None
    for rule in range_vectors.ALERT_RULES:
        limit = SIM_RULES[rule[0]]
        part = range_vectors.evaluate_rule(flag if limit is None else gauge, ["service"], rule, HOUR, 600_000_000, 60_000_000, limit)
        out = part if out is None else out.unionByName(part)
    return out


RULES = alerts.AlertRules(metric_col="error_ratio_mean_1h", metric_thr=0.05, log_err_col="logs_error_count_1h",
                          log_kw_col="logs_error_keywords_1h", log_err_thr=2.0, log_kw_thr=6.0,
                          use_prediction=True, prob_col="pred_prob", prob_thr=0.6)
FEATURE_ROWS_SQL = f"""
feats AS (SELECT {_KEY}, coalesce(error_ratio_mean_1h, 0) AS error_ratio_mean_1h, coalesce(logs_error_count_1h, 0) AS logs_error_count_1h,
  coalesce(logs_error_keywords_1h, 0) AS logs_error_keywords_1h, coalesce(error_ratio_max_5h, 0) * 4 AS pred_prob
  FROM v_metric_features LEFT JOIN v_hour_log_features USING ({_KEY}))"""
RAISED_SQL = f"""
raised AS (SELECT {_KEY}, window_end AS ts, 'metric_rule' AS signal, error_ratio_mean_1h AS score, 'error_ratio_mean_1h>=0.05' AS details FROM feats WHERE error_ratio_mean_1h >= 0.05
  UNION ALL SELECT {_KEY}, window_end, 'log_rule', logs_error_count_1h + logs_error_keywords_1h, 'logs_error_count_1h>=2.0 OR logs_error_keywords_1h>=6.0'
  FROM feats WHERE logs_error_count_1h >= 2 OR logs_error_keywords_1h >= 6
  UNION ALL SELECT {_KEY}, window_end, 'prediction', pred_prob, 'pred_prob>=0.6' FROM feats WHERE pred_prob >= 0.6)"""
BUILT_SQL = """
built AS (SELECT run_id, service, ts, signal, min(window_start) AS window_start, max(window_end) AS window_end, max(score) AS score, arg_min(details, window_start) AS details
  FROM raised GROUP BY ALL)"""


def feature_rows(t):
    hourly = flagged_logs(t).withColumn("ts", F.date_trunc("hour", "ts"))
    rows = plan.merge_features(metric_features(t), rolling.rolling_log_counts(hourly, WINDOWS))
    return rows.withColumn("pred_prob", F.col("error_ratio_max_5h") * 4)


def _only(signal):
    return (f"WITH {FEATURE_ROWS_SQL}, {RAISED_SQL} SELECT {_KEY}, ts, signal, round(score, 6) AS score, details FROM raised"
            + (f" WHERE signal = '{signal}'" if signal else ""))


@query("alert_metric_rule", _only("metric_rule"))
def alert_metric_rule(t):
    return alerts.raise_alerts(feature_rows(t), replace(RULES, use_log=False, use_prediction=False))


@query("alert_log_rule", _only("log_rule"))
def alert_log_rule(t):
    return alerts.raise_alerts(feature_rows(t), replace(RULES, use_metric=False, use_prediction=False))


@query("alert_prediction_rule", _only("prediction"))
def alert_prediction_rule(t):
    return alerts.raise_alerts(feature_rows(t), replace(RULES, use_metric=False, use_log=False))


@query("union_alerts", _only(None))
def union_alerts(t):
    return alerts.raise_alerts(feature_rows(t), RULES)


@query("build_alerts", f"WITH {FEATURE_ROWS_SQL}, {RAISED_SQL}, {BUILT_SQL} SELECT * REPLACE (round(score, 6) AS score) FROM built")
def build_alerts(t):
    return alerts.build_alerts(feature_rows(t), RULES)


@query("union_metrics", """
SELECT 'rps' AS metric, run_id, service, ts, CAST(count(*) AS DOUBLE) AS value FROM v_hist GROUP BY ALL
UNION ALL SELECT 'eps', run_id, service, ts, CAST(count(*) FILTER (WHERE value > 90) AS DOUBLE) FROM v_hist GROUP BY ALL
UNION ALL SELECT 'error_ratio', run_id, service, ts, round(count(*) FILTER (WHERE value > 90) / greatest(count(*), 1e-6), 6) FROM v_hist GROUP BY ALL
UNION ALL SELECT 'p95_latency', run_id, service, ts, round(max(value), 6) FROM v_hist GROUP BY ALL""")
def union_metrics(t):
    """The four metrics of each run, service and hour, from one aggregation."""
    n, bad = F.count(F.lit(1)).cast("double"), F.count_if(F.col("value") > 90).cast("double")
    sums = t.hist.groupBy("run_id", "service", "ts").agg(n.alias("rps"), bad.alias("eps"), (bad / S.clamp_min(n, 1e-6)).alias("error_ratio"),
                                                         F.max("value").alias("p95_latency"))
    return rolling.union_metrics(sums, ["run_id", "service", "ts"])


@query("distinct_windows", f"SELECT DISTINCT {_KEY} FROM v_log_features")
def distinct_windows(t):
    return rolling.rolling_log_counts(flagged_logs(t), WINDOWS).select("run_id", "service", "window_start", "window_end").dropDuplicates()


@query("label_values", "SELECT DISTINCT service, event_type FROM v_events")
def label_values(t):
    return t.events.select("service", "event_type").distinct()
