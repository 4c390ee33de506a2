"""Scaling, text weights, clustering, graph scores, models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from faultline.catalog.aggregates import INCIDENTS_SQL, daily_incidents
from faultline.catalog.cleaning import metric_features
from faultline.catalog.joins import FUTURE_SQL, MTTD_SQL, mttd, windows
from faultline.catalog.ranges import BUILT_SQL, FEATURE_ROWS_SQL, RAISED_SQL, RULES, feature_rows
from faultline.catalog.registry import query
from faultline.catalog.sorting import RANKED_SQL
from faultline.catalog.views import HOUR, HOURS, LOG_FEATURES, METRIC_FEATURES, WINDOWS
from faultline.functions import scalars as S
from faultline.operators import alerts, clustering, evaluation, forest, graph, intervals, ordering, scaling, text
from faultline.operators.forest import IsolationForest, fit_isolation_forest
from faultline.operators.regression import IncidentModel, fit_incident_model
from faultline.plans import detect, features, predict
from faultline.session import cut_lineage, scratch_path

MODEL_COLUMNS = [*[c for w in HOURS for c in METRIC_FEATURES[w]], *[c for w in HOURS for c in LOG_FEATURES[w]], *[f"tfidf_{i}" for i in range(50)]]
KEYS = ["run_id", "service", "window_start", "window_end"]


def hourly_logs(t):
    """Log times moved to their hour, so that metric and log windows end together."""
    return t.logs.withColumn("ts", F.date_trunc("hour", "ts")).drop("event_id")


def feature_table(t):
    return features.build_features(t.metrics, hourly_logs(t), WINDOWS, HOUR)


def model_rows(t):
    """Every feature column, as the models take them."""
    return feature_table(t).select(*KEYS, *[F.col(c).cast("double").alias(c) for c in MODEL_COLUMNS])


@query("standard_scale", """
WITH p AS (SELECT run_id, avg(amount) AS m1, stddev_pop(amount) AS s1, avg(user_id) AS m2, stddev_pop(user_id) AS s2 FROM v_events GROUP BY ALL)
SELECT event_id, round((amount - m1) / s1, 6) AS a, round((user_id - m2) / s2, 6) AS b, 0.0::DOUBLE AS c FROM v_events JOIN p USING (run_id)""")
def standard_scale(t):
    rows = t.events.select("event_id", "run_id", F.col("amount").alias("a"), F.col("user_id").cast("double").alias("b"), F.lit(7.0).alias("c"))
    return scaling.standard_scale(rows, ["a", "b", "c"], ["run_id"]).drop("run_id")


@query("tfidf_features", """
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM v_docs),
vocab AS (SELECT term FROM tok GROUP BY term ORDER BY count(*) DESC, term LIMIT 50),
ranked AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx FROM vocab),
tf AS (SELECT doc_id, idx, term, count(*) AS tf FROM tok JOIN ranked USING (term) GROUP BY ALL),
dfq AS (SELECT idx, count(*) AS df FROM tf GROUP BY idx), n AS (SELECT count(*) AS n FROM v_docs),
raw AS (SELECT doc_id, idx, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN dfq USING (idx), n)
SELECT doc_id, CAST(idx AS INT) AS idx, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""")
def tfidf_features(t):
    return text.tfidf(t.docs.select("doc_id", "text"), ["doc_id"])


MATRIX_SQL = """
pts AS (SELECT *, row_number() OVER (ORDER BY run_id, ts, service, signal) AS aid FROM built),
mat AS (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY run_id)) / 1e6 * 0.05 AS c_time FROM pts),
sc AS (SELECT *, (c_time - avg(c_time) OVER w) / CASE WHEN stddev_pop(c_time) OVER w = 0 THEN 1 ELSE stddev_pop(c_time) OVER w END AS x1,
  (score - avg(score) OVER w) / CASE WHEN stddev_pop(score) OVER w = 0 THEN 1 ELSE stddev_pop(score) OVER w END AS x2 FROM mat WINDOW w AS (PARTITION BY run_id))"""
# brute force: all pairs, components by spreading the smaller label
DBSCAN_SQL = """
nb AS (SELECT a.aid AS a, b.aid AS b FROM sc a JOIN sc b ON a.run_id = b.run_id AND {near}),
core AS (SELECT a AS aid FROM nb GROUP BY a HAVING count(*) >= {least}),
ce AS (SELECT a, b FROM nb WHERE a IN (SELECT aid FROM core) AND b IN (SELECT aid FROM core)),
reach AS (SELECT aid, aid AS lab FROM core UNION SELECT ce.b, r.lab FROM reach r JOIN ce ON ce.a = r.aid AND r.lab < ce.b),
comp AS (SELECT aid, min(lab) AS lab FROM reach GROUP BY aid),
num AS (SELECT lab, row_number() OVER (PARTITION BY run_id ORDER BY lab) - 1 AS cluster_id FROM (SELECT DISTINCT lab FROM comp) JOIN sc ON aid = lab),
lab AS (SELECT aid, cluster_id FROM comp JOIN num USING (lab)
  UNION ALL SELECT nb.a, min(cluster_id) FROM nb JOIN comp ON nb.b = comp.aid JOIN num USING (lab) WHERE nb.a NOT IN (SELECT aid FROM core) GROUP BY nb.a),
clustered AS (SELECT sc.*, coalesce(cluster_id, -1) AS cluster_id,
  run_id || CASE WHEN cluster_id IS NULL THEN '_inc_outlier' ELSE '_inc' || CAST(cluster_id AS VARCHAR) END AS incident_id FROM sc LEFT JOIN lab USING (aid))"""
EPS = 0.3
_NEAR2 = f"(a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2 <= {EPS} * {EPS}"
_CLUSTERED = f"WITH RECURSIVE {FEATURE_ROWS_SQL}, {RAISED_SQL}, {BUILT_SQL}, {MATRIX_SQL}, {DBSCAN_SQL.format(near=_NEAR2, least=3)}"


def built_alerts(t):
    return cut_lineage(alerts.build_alerts(feature_rows(t), RULES, ordered=False))


@query("clustering_matrix", f"WITH {FEATURE_ROWS_SQL}, {RAISED_SQL}, {BUILT_SQL}, {MATRIX_SQL} SELECT run_id, service, ts, signal, round(c_time, 6) AS c_time, round(score, 6) AS c_score FROM mat")
def clustering_matrix(t):
    rows, cols = scaling.clustering_columns(alerts.build_alerts(feature_rows(t), RULES, ordered=False), [])
    return rows.select("run_id", "service", "ts", "signal", F.col(cols[0]).alias("c_time"), F.col(cols[1]).alias("c_score"))


@query("dbscan_incidents", f"{_CLUSTERED} SELECT run_id, service, ts, signal, CAST(cluster_id AS INT) AS cluster_id FROM clustered")
def dbscan_incidents(t):
    out = clustering.group_alerts(built_alerts(t), [], EPS, 3)
    return out.select("run_id", "service", "ts", "signal", "cluster_id")


@query("assign_incident_id", """
SELECT event_id, run_id || CASE WHEN event_type = 'error' THEN '_inc_outlier' ELSE '_inc' || CAST(user_id % 5 AS VARCHAR) END AS incident_id FROM v_events""")
def assign_incident_id(t):
    rows = t.events.select("event_id", "run_id", F.when(F.col("event_type") == "error", -1).otherwise(F.col("user_id") % 5).alias("cluster_id"))
    return alerts.assign_incident_id(rows).select("event_id", "incident_id")


ITERATIONS = 20


def pagerank_sql(edges: str, out: str, steps: int = ITERATIONS) -> str:
    """Unrolled steps over the edge table `edges`; the last one is called `out`."""
    parts = [f"""pr_w AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM {edges}),
pr_n AS (SELECT src AS service FROM {edges} UNION SELECT dst FROM {edges}),
pr_d AS (SELECT service FROM pr_n WHERE service NOT IN (SELECT src FROM {edges})),
pr_0 AS MATERIALIZED (SELECT service, 1.0 / (SELECT count(*) FROM pr_n) AS rank FROM pr_n)"""]
    for i in range(1, steps + 1):
        name = out if i == steps else f"pr_{i}"
        prev = f"pr_{i - 1}"
        parts.append(f"""{name} AS MATERIALIZED (SELECT n.service, 0.85 * (coalesce((SELECT sum(p.rank * w.share) FROM pr_w w JOIN {prev} p ON p.service = w.src WHERE w.dst = n.service), 0)
  + coalesce((SELECT sum(p.rank) FROM {prev} p JOIN pr_d USING (service)), 0) / (SELECT count(*) FROM pr_n)) + 0.15 / (SELECT count(*) FROM pr_n) AS rank FROM pr_n n)""")
    return ",\n".join(parts)


SPAN_GRAPH_SQL = """
g AS (SELECT p.service AS src, c.service AS dst, CAST(count(*) AS DOUBLE) AS weight FROM v_spans c JOIN v_spans p ON c.parent = p.span_id GROUP BY ALL
  UNION ALL SELECT service, 'sink' || CAST(trace_id % 3 AS VARCHAR), CAST(count(*) AS DOUBLE) FROM v_spans GROUP BY ALL)"""


def span_graph(t):
    """Weighted calls between services, plus calls to sinks that call nobody."""
    s = t.spans
    calls = (s.filter("parent IS NOT NULL").groupBy("parent", F.col("service").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
             .join(s.select(F.col("span_id").alias("parent"), F.col("service").alias("src")), "parent")
             .groupBy("src", "dst").agg(F.sum("n").cast("double").alias("weight")))
    sinks = s.groupBy(F.col("service").alias("src"), F.concat(F.lit("sink"), (F.col("trace_id") % 3).cast("string")).alias("dst")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    return calls.unionByName(sinks)


@query("pagerank", f"WITH {SPAN_GRAPH_SQL}, {pagerank_sql('g', 'pr')} SELECT service, round(rank / ((SELECT max(rank) FROM pr) + 1e-12), 6) AS centrality FROM pr")
def pagerank(t):
    return graph.centrality(span_graph(t), iterations=ITERATIONS)


COOC_SQL = """
edges AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (
  SELECT a.service AS src, b.service AS dst FROM {inc} a JOIN {inc} b ON a.incident_id = b.incident_id AND a.run_id = b.run_id AND a.service <> b.service
    AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= {window}) GROUP BY ALL)"""


@query("rca_rank", f"""
WITH {COOC_SQL.format(inc=INCIDENTS_SQL, window=2 * HOUR)}, {pagerank_sql('edges', 'pr')},
cent AS (SELECT service, rank / ((SELECT max(rank) FROM pr) + 1e-12) AS centrality FROM pr),
{RANKED_SQL.format(incidents=INCIDENTS_SQL, graph='cent', k=3)}""")
def rca_rank(t):
    incidents = daily_incidents(t)
    scores = graph.centrality(graph.cooccurrence_edges(incidents, 2 * HOUR), iterations=ITERATIONS)
    return graph.rank_causes(incidents, scores, 3)


@query("training_summary", """
SELECT count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM v_faults f WHERE f.run_id = w.run_id AND f.service = w.service AND f.start_ts <= w.window_start AND w.window_start <= f.end_ts)) AS n_train_normal,
  count(*) AS n_total FROM v_metric_features w""")
def training_summary(t):
    return detect.training_counts(metric_features(t), t.faults, 4 * HOUR)


@query("evaluation_summary", f"""
WITH hit AS (SELECT w.run_id, w.service, w.window_start, w.window_end, count(f.label_seq) > 0 AS y, coalesce(any_value(w.error_ratio_mean_1h), 0) >= 0.05 AS p FROM v_metric_features w LEFT JOIN v_faults f
  ON f.run_id = w.run_id AND f.service = w.service AND w.window_start <= f.end_ts AND f.start_ts <= w.window_end GROUP BY ALL),
r AS (SELECT y, p, row_number() OVER (ORDER BY window_start, window_end, run_id, service) - 1 AS pos, count(*) OVER () AS n FROM hit)
SELECT count(*) AS n_windows_total, count(*) FILTER (WHERE test) AS n_test_windows, round(avg(CAST(y AS DOUBLE)) FILTER (WHERE test), 6) AS positive_rate_test,
  round(coalesce(count(*) FILTER (WHERE test AND y AND p) / nullif(count(*) FILTER (WHERE test AND p), 0), 0), 6) AS threshold_precision,
  round(coalesce(count(*) FILTER (WHERE test AND y AND p) / nullif(count(*) FILTER (WHERE test AND y), 0), 0), 6) AS threshold_recall,
  (SELECT count(mttd_seconds) FROM ({MTTD_SQL})) AS n_detected, (SELECT round(avg(mttd_seconds), 6) FROM ({MTTD_SQL})) AS mttd_mean_seconds,
  (SELECT round(median(mttd_seconds), 6) FROM ({MTTD_SQL})) AS mttd_median_seconds
FROM (SELECT y, p, pos >= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) AS test FROM r)""")
def evaluation_summary(t):
    """Windows, the threshold model on the last fifth, and its detection delays over everything, in one row."""
    rows = cut_lineage(intervals.label_windows(windows(t), t.faults, 4 * HOUR).select(
        *KEYS, "y_true", (S.finite_or_zero(F.col("error_ratio_mean_1h")) >= 0.05).cast("int").alias("y_pred")))
    split = cut_lineage(ordering.temporal_split(rows, detect.SPLIT_ORDER, [0.6, 0.2]))
    test = F.col("split_no") == 2
    counts = split.agg(F.count(F.lit(1)).alias("n_windows_total"), F.count_if(test).alias("n_test_windows"),
                       F.avg(F.when(test, F.col("y_true").cast("double"))).alias("positive_rate_test"))
    model = evaluation.precision_recall_f1(split.filter(test), "y_true", "y_pred").select(F.struct("*").alias("s")).scalar()
    delays = evaluation.mttd_stats(mttd(t)).select(F.struct("*").alias("s")).scalar()
    return counts.select("*", model["precision"].alias("threshold_precision"), model["recall"].alias("threshold_recall"),
                         *[delays[c].alias(c) for c in ("n_detected", "mttd_mean_seconds", "mttd_median_seconds")])


def _forest(t, rows):
    return fit_isolation_forest(rows, MODEL_COLUMNS, KEYS, trees=TREES)


_WINDOWS = f"{', '.join(KEYS)} FROM v_metric_features"
TREES = 200


@query("fit_isolation_forest", f"SELECT unnest(range({TREES})) AS tree, 1 AS roots, 0 AS lost_children, true AS one_leaf_more, true AS isolates")
def fit_forest(t):
    """The fitted trees, one row each: a root, children that exist, one leaf more than splits, no path beyond the depth limit."""
    model = _forest(t, cut_lineage(model_rows(t)))
    nodes = t.spark.createDataFrame(model.nodes, "tree INT, node INT, feature INT, threshold DOUBLE, left INT, right INT, path DOUBLE")
    split = F.col("feature") >= 0
    children = F.explode(F.array("left", "right"))
    named = nodes.filter(split).select("tree", children.alias("node")).withColumn("_child", F.lit(1))
    joined = nodes.join(named, ["tree", "node"], "full")
    longest = forest.average_path(model.sample) + math.ceil(math.log2(max(model.sample, 2)))
    return joined.groupBy("tree").agg(
        F.count_if(F.col("_child").isNull()).cast("int").alias("roots"), F.count_if(F.col("feature").isNull()).cast("int").alias("lost_children"),
        (F.count_if(~split) == F.count_if(split) + 1).alias("one_leaf_more"), (F.max("path") <= longest).alias("isolates"))


@query("score_isolation_forest", f"SELECT {_WINDOWS.replace(' FROM', ', true AS in_range, true AS flag_follows FROM')}")
def score_forest(t):
    """Every window scored: scores lie where offset and path lengths put them, flags follow the score."""
    rows = cut_lineage(model_rows(t))
    model = _forest(t, rows)
    out = model.transform(rows, 0.10, strict=False)
    score = F.col("anomaly_score")
    return out.select(*KEYS, score.between(model.offset, model.offset + 1).alias("in_range"),
                      (F.col("anomaly_flag") == (score >= 0.10).cast("int")).alias("flag_follows"))


def _training(t):
    return predict.labelled_rows(model_rows(t), t.faults, 5 * HOUR, 4 * HOUR)


@query("fit_incident_lr", f"SELECT unnest({[*MODEL_COLUMNS, 'intercept']}) AS feature, 0.0::DOUBLE AS gradient")
def fit_lr(t):
    """The gradient of the weighted loss at the fitted coefficients, to three decimals: the fit is stationary in every column."""
    rows = cut_lineage(_training(t).filter("split_no = 0"))
    model = fit_incident_model(rows, MODEL_COLUMNS)
    n, pos = rows.agg(F.count(F.lit(1)), F.count_if(F.col("y_future") == 1)).first()
    weight = F.when(F.col("y_future") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
    scored = model.transform(rows).withColumn("_e", weight * (F.col("probability") - F.col("y_future")))
    scaled = model.scaler.expressions()
    sums = scored.selectExpr(*[f"sum(_e * ({scaled[c]})) AS `{c}`" for c in MODEL_COLUMNS], "sum(_e) AS intercept").first()
    penalty = [*[b / n for b in model.regression.coefficients], 0.0]
    total = [(c, round(float(sums[c] / n + p), 3) + 0.0) for c, p in zip([*MODEL_COLUMNS, "intercept"], penalty)]
    return t.spark.createDataFrame(total, "feature STRING, gradient DOUBLE")


@query("score_incident_prob", f"SELECT {', '.join(KEYS)}, coalesce(y_future, 0) AS y_future, true AS is_probability, true AS flag_follows, true AS decision_agrees FROM ({FUTURE_SQL})")
def score_prob(t):
    """Labels and scores of every window; the decision value and the plain prediction order rows as the probability does."""
    rows = _training(t)
    model = fit_incident_model(rows.filter("split_no = 0"), MODEL_COLUMNS)
    scored = cut_lineage(model.scores(rows).select(*KEYS, "y_future", "probability", "decision", "prediction"))
    p = F.col("probability")
    agrees = (F.col("prediction") == (p > 0.5).cast("double")) & F.col("_soft").between(0, 1)
    return evaluation.minmax_normalize(scored, "decision", "_soft").select(
        *KEYS, "y_future", p.between(0, 1).alias("is_probability"), ((p >= model.threshold) == (F.col("decision") >= math.log(model.threshold / (1 - model.threshold)))).alias("flag_follows"),
        agrees.alias("decision_agrees"))


_ALERT_TIMES = "SELECT DISTINCT run_id, service, window_end AS ts, true AS as_scored FROM v_metric_features"


@query("predicted_alerts", _ALERT_TIMES)
def predicted_alerts(t):
    """Alerts from the fitted model's probabilities: at each time, raised if and only if a window's score reaches the threshold, with the highest."""
    rows = _training(t)
    model = fit_incident_model(rows.filter("split_no = 0"), MODEL_COLUMNS)
    scored = cut_lineage(predict.with_probabilities(rows, model).select(*KEYS, "pred_prob"))
    rules = alerts.AlertRules(use_metric=False, use_log=False, use_prediction=True)
    raised = alerts.build_alerts(scored, rules, ordered=False).select("run_id", "service", "ts", "score", F.lit(True).alias("_raised"))
    best = scored.groupBy("run_id", "service", F.col("window_end").alias("ts")).agg(F.max("pred_prob").alias("best"))
    both = best.join(raised, ["run_id", "service", "ts"], "full")
    right = F.when(F.col("best") >= rules.prob_thr, F.col("score") == F.col("best")).otherwise(F.col("_raised").isNull())
    return both.select("run_id", "service", "ts", F.coalesce(right, F.lit(False)).alias("as_scored"))


@query("persist_model", f"SELECT {_WINDOWS.replace(' FROM', ', 0.0::DOUBLE AS probability_change, 0.0::DOUBLE AS forest_change, 0.0::DOUBLE AS detector_change FROM')}")
def persist_model(t):
    """Change of every score when the models are written and read back."""
    rows = _training(t)
    path = scratch_path(t.spark, "models")
    predictor = fit_incident_model(rows.filter("split_no = 0"), MODEL_COLUMNS)
    trees = _forest(t, rows)
    scaler, inner = detect.fit_detector(rows, MODEL_COLUMNS, KEYS, trees=TREES)
    detector = detect.Detector(scaler, inner, 0, 0, 0.05)
    predictor.save(t.spark, f"{path}/predictor")
    trees.save(t.spark, f"{path}/forest")
    detector.save(t.spark, f"{path}/detector")
    pairs = ((predictor, IncidentModel.load(t.spark, f"{path}/predictor"), "probability", "flag"),
             (trees, IsolationForest.load(t.spark, f"{path}/forest"), "anomaly_score", "anomaly_flag"),
             (detector, detect.Detector.load(t.spark, f"{path}/detector"), "anomaly_score", "anomaly_flag"))
    out = rows
    for i, (own, read, score, flag) in enumerate(pairs):
        out = own.transform(out).withColumnRenamed(score, f"_own{i}").drop(flag)
        out = read.transform(out).withColumn(f"_change{i}", F.abs(F.col(score) - F.col(f"_own{i}"))).drop(score, flag)
    return out.select(*KEYS, *[F.col(f"_change{i}").alias(n) for i, n in enumerate(("probability_change", "forest_change", "detector_change"))])
