"""Metrics and logs to one feature row per run, service and window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions import scalars as S
from faultline.operators import rolling, text
from faultline.operators.intervals import MINUTE, RUN_SERVICE, WINDOW_KEY, nearest_row


def fill_zero(df: DataFrame) -> DataFrame:
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.na.fill(0, numeric)


def attach_tfidf(log_windows: DataFrame, weights: DataFrame) -> DataFrame:
    """Text weights where a document has exactly this window, else zeros."""
    out = log_windows.join(weights, WINDOW_KEY, "left")
    return out.na.fill(0.0, S.tfidf_columns(weights))


def merge_features(metrics: DataFrame, logs: DataFrame | None = None, traces: DataFrame | None = None,
                   align: str = "exact", tolerance_us: int = MINUTE) -> DataFrame:
    """Metric windows with the log (and trace) windows of the same key; missing numbers become 0.

    `align="asof"` takes the nearest log window of equal length instead of one
    that ends at the very same instant.
    """
    out = metrics
    for side, suffix in ((logs, "_logs"), (traces, "_traces")):
        if side is None:
            continue
        clash = [c for c in side.columns if c in out.columns and c not in WINDOW_KEY]
        side = side.withColumnsRenamed({c: f"{c}{suffix}" for c in clash})
        if align == "exact":
            out = out.join(side, WINDOW_KEY, "left")
        else:
            width = S.micros("window_end") - S.micros("window_start")
            payload = [c for c in side.columns if c not in WINDOW_KEY]
            out = nearest_row(out.withColumn("_width", width), side.withColumn("_width", width),
                              [*RUN_SERVICE, "_width"], "window_end", "window_end", payload, tolerance_us,
                              matched="_matched").drop("_width", "_matched")
    return fill_zero(out)


def prepare_logs(logs: DataFrame) -> DataFrame:
    """Text, level flags and keyword count of each line with a time."""
    line = S.log_text(F.col("message"), F.col("line"))
    level = S.log_level(F.col("level"))
    return logs.filter(F.col("ts").isNotNull()).select(
        "run_id", "ts", S.normalize_service(F.col("service")).alias("service"), level.alias("level"), line.alias("text"),
        S.is_level(level, "ERROR").alias("is_error"), S.is_level(level, "WARN").alias("is_warn"),
        S.error_keyword_count(line).alias("err_kw"))


def build_features(metrics: DataFrame, logs: DataFrame | None, windows: dict[str, int] = rolling.WINDOWS,
                   bucket_us: int = MINUTE, tfidf_size: int = 50, layout: str = "long",
                   align: str = "exact", document_label: str = "start") -> DataFrame:
    """The whole feature plan: pivot, rolling statistics, rolling log counts, text weights, merge."""
    metric_rows = rolling.rolling_stats(rolling.pivot_metrics(metrics), windows=windows, layout=layout)
    if layout == "wide":
        metric_rows = metric_rows.withColumn("window_start", S.from_micros(S.micros("window_end") - min(windows.values())))
    if logs is None:
        return fill_zero(metric_rows)
    prepared = prepare_logs(logs)
    log_rows = rolling.rolling_log_counts(prepared, windows, layout=layout)
    if layout == "wide":
        log_rows = log_rows.withColumn("window_start", S.from_micros(S.micros("window_end") - min(windows.values())))
    weights = text.tfidf_wide(text.log_documents(prepared, bucket_us, document_label), WINDOW_KEY, size=tfidf_size)
    return merge_features(metric_rows, attach_tfidf(log_rows, weights), align=align, tolerance_us=bucket_us)
