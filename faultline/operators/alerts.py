"""Rule alerts over feature rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.scalars import finite_or_zero, rule_text
from faultline.schemas import ALERTS

ALERT_COLUMNS = ["run_id", "service", "window_start", "window_end", "ts", "signal", "score", "details"]


@dataclass(frozen=True)
class AlertRules:
    """Thresholds of the three rules; a rule whose flag is off never fires."""

    use_metric: bool = True
    metric_col: str = "error_ratio_mean_1min"
    metric_thr: float = 0.10
    use_log: bool = True
    log_err_col: str = "logs_error_count_1min"
    log_kw_col: str = "logs_error_keywords_1min"
    log_err_thr: float = 1.0
    log_kw_thr: float = 1.0
    use_prediction: bool = False
    prob_col: str = "pred_prob"
    prob_thr: float = 0.45


def _need(df: DataFrame, *columns: str) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"alert rule needs columns {absent}")


def _fired(signal: str, condition: Column, score: Column, details: str) -> Column:
    return F.when(condition, F.struct(F.lit(signal).alias("signal"), score.cast("double").alias("score"),
                                      F.lit(details).alias("details")))


def metric_rule(df: DataFrame, r: AlertRules) -> Column:
    _need(df, r.metric_col)
    score = finite_or_zero(F.col(r.metric_col))
    return _fired("metric_rule", score >= r.metric_thr, score, rule_text(r.metric_col, r.metric_thr))


def log_rule(df: DataFrame, r: AlertRules) -> Column:
    _need(df, r.log_err_col, r.log_kw_col)
    err, kw = finite_or_zero(F.col(r.log_err_col)), finite_or_zero(F.col(r.log_kw_col))
    text = f"{rule_text(r.log_err_col, r.log_err_thr)} OR {rule_text(r.log_kw_col, r.log_kw_thr)}"
    return _fired("log_rule", (err >= r.log_err_thr) | (kw >= r.log_kw_thr), err + kw, text)


def prediction_rule(df: DataFrame, r: AlertRules) -> Column:
    _need(df, r.prob_col)
    prob = finite_or_zero(F.col(r.prob_col))
    return _fired("prediction", prob >= r.prob_thr, prob, rule_text(r.prob_col, r.prob_thr))


def raise_alerts(df: DataFrame, r: AlertRules) -> DataFrame:
    """Union of all enabled rules in one pass over the features; no rule gives a typed empty table."""
    fired = []
    if r.use_metric:
        fired.append(metric_rule(df, r))
    if r.use_log:
        fired.append(log_rule(df, r))
    if r.use_prediction:
        fired.append(prediction_rule(df, r))
    if not fired:
        return df.sparkSession.createDataFrame([], ALERTS)
    hits = df.select("run_id", "service", "window_start", "window_end",
                     F.explode(F.array_compact(F.array(*fired))).alias("hit"))
    return hits.select("run_id", "service", "window_start", "window_end",
                       F.col("window_end").alias("ts"), "hit.signal", "hit.score", "hit.details")


def dedup_alerts(alerts: DataFrame) -> DataFrame:
    """One alert per run, service, time and signal: widest window, highest score, earliest text."""
    return (alerts.groupBy("run_id", "service", "ts", "signal")
            .agg(F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"),
                 F.max("score").alias("score"), F.min_by("details", "window_start").alias("details"))
            .select(*ALERT_COLUMNS))


def sort_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy("run_id", "ts", "service", "signal")


def build_alerts(df: DataFrame, rules: AlertRules = AlertRules(), ordered: bool = True) -> DataFrame:
    out = dedup_alerts(raise_alerts(df, rules))
    return sort_alerts(out) if ordered else out


def assign_incident_id(clustered: DataFrame) -> DataFrame:
    suffix = F.when(F.col("cluster_id") >= 0, F.concat(F.lit("_inc"), F.col("cluster_id").cast("string")))
    return clustered.withColumn("incident_id", F.concat("run_id", F.coalesce(suffix, F.lit("_inc_outlier"))))
