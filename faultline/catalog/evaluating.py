"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.catalog.registry import query
from faultline.operators import evaluation

CUT = 0.05
_PRED = f"(SELECT *, CAST(score >= {CUT} AS INT) AS y_pred FROM v_scored)"


def predicted(t):
    return t.scored.withColumn("y_pred", (F.col("score") >= CUT).cast("int"))


_PRF = """CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall"""
_F1 = "CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END"
_COUNTS = """count(*) FILTER (WHERE y = 0 AND y_pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND y_pred = 1) AS tp"""


@query("confusion_counts", f"SELECT service, {_COUNTS} FROM {_PRED} GROUP BY service")
def confusion_counts(t):
    return evaluation.confusion(predicted(t), by=["service"])


@query("precision_recall_f1", f"""
SELECT service, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F1}, 6) AS f1
FROM (SELECT *, {_PRF} FROM (SELECT service, {_COUNTS} FROM {_PRED} GROUP BY service))""")
def precision_recall_f1(t):
    return evaluation.precision_recall_f1(predicted(t), by=["service"])


REPORT_SQL = f"""
c AS (SELECT {_COUNTS} FROM {{pred}}),
k AS (SELECT 0 AS cls, tn AS hit, fn AS wrong, fp AS missed FROM c UNION ALL SELECT 1, tp, fp, fn FROM c),
q AS (SELECT cls, hit / (hit + wrong) AS p, hit / (hit + missed) AS r, hit + missed AS n FROM k),
m AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM q),
a AS (SELECT (tn + tp) / (tn + fp + fn + tp) AS acc, tn + fp + fn + tp AS n FROM c)
SELECT CAST(cls AS VARCHAR) AS label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, n AS support FROM m
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM a
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(n) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(p * n) / sum(n), 6), round(sum(r * n) / sum(n), 6), round(sum(f * n) / sum(n), 6), CAST(sum(n) AS BIGINT) FROM m"""


@query("classification_report", "WITH " + REPORT_SQL.format(pred=_PRED))
def classification_report(t):
    return evaluation.classification_report(predicted(t))


@query("roc_auc", """
WITH r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS mid FROM v_scored)
SELECT round((sum(mid) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc FROM r""")
def roc_auc(t):
    return evaluation.roc_auc(t.scored)


_CUM = """g AS (SELECT score, sum(y) AS pos, count(*) - sum(y) AS neg FROM v_scored GROUP BY score),
c AS (SELECT score, pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g)"""


@query("average_precision", f"WITH {_CUM} SELECT round(sum(pos * tp / (tp + fp)) / max(p), 6) AS average_precision FROM c")
def average_precision(t):
    return evaluation.average_precision(t.scored)


@query("roc_pr_points", f"""
WITH {_CUM} SELECT round(score, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM c""")
def roc_pr_points(t):
    return evaluation.curve_points(t.scored)


@query("class_balance", "SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) AS positive_rate FROM v_scored")
def class_balance(t):
    return evaluation.class_balance(t.scored)


TUNE_SQL = f"""
g AS (SELECT i, round(0.05 * i, 2)::DOUBLE AS threshold FROM (SELECT unnest(generate_series(1, 19)) AS i)),
s AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND y = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND y = 0) AS fp,
  count(*) FILTER (WHERE score < threshold AND y = 1) AS fn FROM {{scored}}, g GROUP BY threshold),
tuned AS (SELECT threshold, precision, recall, {_F1} AS f1 FROM (SELECT threshold, {_PRF} FROM s))"""
# scores of the whole table
_SCORED = "(SELECT y, score AS score FROM v_scored)"


@query("tune_threshold", "WITH " + TUNE_SQL.format(scored=_SCORED) + " SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM tuned")
def tune_threshold(t):
    return evaluation.tune_threshold(t.scored)


@query("best_threshold", "WITH " + TUNE_SQL.format(scored=_SCORED) + " SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM tuned ORDER BY round(f1, 12) DESC, threshold LIMIT 1")
def best_threshold(t):
    return evaluation.best_threshold(evaluation.tune_threshold(t.scored))


@query("minmax_normalize", """
SELECT event_id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER () + 1e-9), 6) AS normalized FROM v_scored""")
def minmax_normalize(t):
    return evaluation.minmax_normalize(t.scored, "score", "normalized").select("event_id", "normalized")


@query("baseline_threshold", f"SELECT event_id, y_pred, round(score, 6) AS score FROM {_PRED}")
def baseline_threshold(t):
    return predicted(t).select("event_id", "y_pred", "score")
