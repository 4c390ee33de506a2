"""Whole plans from raw metrics and logs to features, models, and root causes."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.catalog.joins import TFIDF_DOCS
from faultline.catalog.learning import COOC_SQL, DBSCAN_SQL, ITERATIONS, feature_table, pagerank_sql
from faultline.catalog.ranges import BUILT_SQL, RAISED_SQL
from faultline.catalog.registry import query
from faultline.catalog.sorting import RANKED_SQL
from faultline.catalog.views import BOUNDS, HOUR, HOURS, LOG_FEATURES, METRIC_FEATURES
from faultline.operators import intervals
from faultline.operators.alerts import AlertRules
from faultline.plans import detect, metrics, predict, rca
from faultline.session import cut_lineage

_KEY = "run_id, service, window_start, window_end"
_M = [c for w in HOURS for c in METRIC_FEATURES[w]]
_L = [c for w in HOURS for c in LOG_FEATURES[w]]


_TFIDF_COLS = ", ".join(f"max(weight) FILTER (WHERE idx = {i}) AS tfidf_{i}" for i in range(50))
ALL_FEATURES_SQL = TFIDF_DOCS + f""",
wide AS (SELECT run_id, service, bucket - INTERVAL 1 HOUR AS window_start, bucket AS window_end, {_TFIDF_COLS} FROM tfidf GROUP BY ALL),
allf AS (SELECT {_KEY}, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _M + _L)}, {', '.join(f'coalesce(tfidf_{i}, 0) AS tfidf_{i}' for i in range(50))}
  FROM v_metric_features LEFT JOIN v_hour_log_features USING ({_KEY}) LEFT JOIN wide USING ({_KEY}))"""


@query("end_to_end_features", ALL_FEATURES_SQL + f"""
SELECT {_KEY}, {', '.join(f'round({c}, 6) AS {c}' for c in _M)}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _L)}, {', '.join(f'round(tfidf_{i}, 6) AS tfidf_{i}' for i in range(50))} FROM allf""")
def end_to_end_features(t):
    return feature_table(t)


@query("end_to_end_train_detector", f"""
SELECT count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM v_faults f WHERE f.run_id = w.run_id AND f.service = w.service AND f.start_ts <= w.window_start
  AND w.window_start <= f.end_ts)) AS n_train_normal, count(*) AS n_total, 0.05::DOUBLE AS contamination, 110 AS n_features,
  '{','.join([*_M, *_L, *[f'tfidf_{i}' for i in range(50)]])}' AS feature_columns FROM v_metric_features w""")
def end_to_end_train_detector(t):
    """The training summary of a detector fitted on all feature columns."""
    return detect.train_detector(feature_table(t), t.faults, bin_us=4 * HOUR).summary(t.spark)


@query("end_to_end_eval_detector")
def end_to_end_eval_detector(t):
    """Model comparison: threshold, z-score and isolation forest on the last fifth."""
    return detect.evaluate_detector(feature_table(t), t.faults, "error_ratio_mean_1h", 0.05, bin_us=4 * HOUR)["metrics"]


@query("end_to_end_train_predictor")
def end_to_end_train_predictor(t):
    return predict.train_predictor(feature_table(t), t.faults, 5 * HOUR, 4 * HOUR)[1]


@query("end_to_end_eval_predictor")
def end_to_end_eval_predictor(t):
    table = cut_lineage(feature_table(t))
    model, _ = predict.train_predictor(table, t.faults, 5 * HOUR, 4 * HOUR)
    return predict.evaluate_predictor(table, t.faults, model, 5 * HOUR, 4 * HOUR)["metrics"]


def _rates_sql(name: str, source: str, labels: str) -> str:
    """The rate of every series of `source` at the ticks of its run, in SQL."""
    keys = f"run_id, s, e, {labels}"
    return f"""
{name}_n AS (SELECT {keys}, epoch_us(ts) - s AS t, value AS v FROM {source} JOIN r USING (run_id) WHERE epoch_us(ts) > s - 3600000000 AND epoch_us(ts) <= e),
{name}_s AS (SELECT *, lag(v) OVER (PARTITION BY {keys} ORDER BY t) AS prev FROM {name}_n),
{name}_x AS (SELECT *, unnest(generate_series(CAST(ceil(t / 3e8) AS BIGINT), CAST(ceil((t + 3600000000) / 3e8) AS BIGINT) - 1)) AS k FROM {name}_s),
{name}_a AS (SELECT {keys}, k, min(t) AS t0, max(t) AS t1, count(*) AS n, arg_min(v, t) AS v0, arg_max(v, t) AS v1,
  sum(CASE WHEN v < prev THEN prev ELSE 0 END) - arg_min(CASE WHEN v < prev THEN prev ELSE 0 END, t) AS resets FROM {name}_x
  WHERE k >= 0 AND k * 300000000 <= e - s GROUP BY ALL HAVING count(*) >= 2),
{name}_b AS (SELECT *, v1 - v0 + resets AS inc, (t1 - t0) / 1e6 AS span, (t0 - (k * 300000000 - 3600000000)) / 1e6 AS h0, (k * 300000000 - t1) / 1e6 AS e0 FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN h0 >= span / (n - 1) * 1.1 THEN span / (n - 1) / 2 ELSE h0 END AS h1, CASE WHEN e0 >= span / (n - 1) * 1.1 THEN span / (n - 1) / 2 ELSE e0 END AS e1 FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN inc > 0 AND v0 >= 0 AND span * v0 / inc < h1 THEN span * v0 / inc ELSE h1 END AS h2 FROM {name}_c),
{name} AS (SELECT {keys}, make_timestamp(s + k * 300000000) AS ts, inc * ((span + h2 + e1) / span) / 3600 AS rate FROM {name}_d)"""


@query("end_to_end_metrics", f"""
WITH r AS (SELECT run_id, epoch_us(min(start_ts)) - 1800000000 AS s, epoch_us(max(end_ts)) + 1800000000 AS e FROM v_faults GROUP BY ALL),
req AS (SELECT run_id, service, event_type AS endpoint, ts, CAST(event_id % 500 AS DOUBLE) AS value FROM v_events),
bad AS (SELECT run_id, service, event_type AS endpoint, ts, CAST(event_id % 250 AS DOUBLE) AS value FROM v_events WHERE event_type IN ('error', 'view')),
lat AS (SELECT run_id, service, event_type AS endpoint, ts, le, floor(event_id % 500 * least(le, 500) / 500) AS value
  FROM v_events, (SELECT unnest([10.0, 25.0, 50.0, 100.0, 200.0, 350.0, 500.0, 'Infinity'::DOUBLE]) AS le)),
{_rates_sql("rq", "req", "service, endpoint")}, {_rates_sql("er", "bad", "service, endpoint")}, {_rates_sql("bk", "lat", "service, endpoint, le")},
rps AS (SELECT run_id, service, ts, sum(rate) AS v FROM rq GROUP BY ALL), eps AS (SELECT run_id, service, ts, sum(rate) AS v FROM er GROUP BY ALL),
h AS (SELECT run_id, service, ts, le, sum(rate) AS v FROM bk GROUP BY ALL),
w AS (SELECT *, max(v) FILTER (WHERE le = 'Infinity') OVER p AS total, lag(le) OVER q AS lo, coalesce(lag(v) OVER q, 0) AS below, row_number() OVER q AS i FROM h
  WINDOW p AS (PARTITION BY run_id, service, ts), q AS (PARTITION BY run_id, service, ts ORDER BY le)),
p95 AS (SELECT run_id, service, ts, arg_min(CASE WHEN total = 0 THEN NULL WHEN le = 'Infinity' THEN lo ELSE coalesce(lo, 0) + (le - coalesce(lo, 0)) * (total * 0.95::DOUBLE - below) / (v - below) END, le) AS v
  FROM w WHERE total = 0 OR (v >= total * 0.95::DOUBLE AND (i = 1 OR below < total * 0.95::DOUBLE)) GROUP BY ALL)
SELECT run_id, service, ts, 'rps' AS metric, round(v, 6) AS value FROM rps UNION ALL SELECT run_id, service, ts, 'eps', round(v, 6) FROM eps
UNION ALL SELECT run_id, service, ts, 'error_ratio', round(eps.v / greatest(rps.v, 1e-6), 6) FROM eps JOIN rps USING (run_id, service, ts)
UNION ALL SELECT run_id, service, ts, 'p95_latency', round(v, 6) FROM p95""")
def end_to_end_metrics(t):
    """Counters with resets and latency buckets to four metrics on each run's padded grid."""
    series = t.events.select("run_id", "service", F.col("event_type").alias("endpoint"), "ts", "event_id")
    counter = lambda rows, cycle: rows.withColumn("value", (F.col("event_id") % cycle).cast("double"))
    bounds = F.explode(F.array(*[F.lit(b) for b in BOUNDS]))
    buckets = counter(series, 500).withColumn("le", bounds)
    buckets = buckets.withColumn("value", F.floor(F.col("value") * F.least("le", F.lit(500.0)) / 500).cast("double"))
    ranges = intervals.run_time_window(t.faults, HOUR // 2)
    return metrics.export_metrics(counter(series, 500), counter(series.filter("endpoint in ('error', 'view')"), 250), buckets, ranges, HOUR, 300_000_000)


RCA_EPS = 1.0
SETTINGS = rca.RcaSettings(
    rules=AlertRules(metric_col="error_ratio_mean_1h", metric_thr=0.05, log_err_col="logs_error_count_1h",
                     log_kw_col="logs_error_keywords_1h", log_err_thr=2.0, log_kw_thr=6.0, use_prediction=False),
    eps=RCA_EPS, tolerance_us=HOUR, window_us=2 * HOUR, iterations=ITERATIONS)

# the nearest document, standardised per run and column, in long form
_EMBED_SQL = """
feats AS (SELECT *, 0 AS pred_prob FROM allf), {raised}, {built},
pts AS (SELECT *, row_number() OVER (ORDER BY run_id, ts, service, signal) AS aid FROM built),
rows1 AS (SELECT run_id, service, window_end, max(window_start) AS window_start FROM allf GROUP BY ALL),
bwd AS (SELECT aid, r.window_end AS we, r.window_start AS ws FROM pts p ASOF JOIN rows1 r ON p.run_id = r.run_id AND p.service = r.service AND p.ts >= r.window_end),
long AS (
  SELECT p.run_id, p.aid, 0 AS col, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY p.run_id)) / 1e6 * 0.05 AS v FROM pts p
  UNION ALL SELECT run_id, aid, 1, score FROM pts
  UNION ALL SELECT p.run_id, p.aid, 2 + i, vals[i + 1] FROM (SELECT p.run_id, p.aid, """ + "[" + ", ".join(f"f.tfidf_{i}" for i in range(50)) + """] AS vals, unnest(generate_series(0, 49)) AS i
    FROM pts p JOIN bwd USING (aid) JOIN allf f ON f.run_id = p.run_id AND f.service = p.service AND f.window_end = bwd.we AND f.window_start = bwd.ws) p),
norm AS (SELECT run_id, aid, col, (v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w = 0 THEN 1 ELSE stddev_pop(v) OVER w END AS x FROM long WINDOW w AS (PARTITION BY run_id, col)),
vecs AS (SELECT aid, list(x ORDER BY col) AS x FROM norm GROUP BY aid),
sc AS (SELECT pts.*, x FROM pts JOIN vecs USING (aid))"""


@query("end_to_end_root_causes", TFIDF_DOCS.replace("WITH ", "WITH RECURSIVE ", 1) + ALL_FEATURES_SQL[len(TFIDF_DOCS):] + f""",
{_EMBED_SQL.format(raised=RAISED_SQL, built=BUILT_SQL)}, {DBSCAN_SQL.format(near=f"list_distance(a.x, b.x) <= {RCA_EPS}", least=3)},
{COOC_SQL.format(inc="clustered", window=2 * HOUR)}, {pagerank_sql("edges", "pr")},
cent AS (SELECT service, rank / ((SELECT max(rank) FROM pr) + 1e-12) AS centrality FROM pr),
{RANKED_SQL.format(incidents="clustered", graph="cent", k=3)}""")
def end_to_end_root_causes(t):
    return rca.root_causes(feature_table(t), SETTINGS)["ranked"]
