"""Summaries by service, level, metric, trace and run. All combine map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.scalars import from_micros, micros
from faultline.operators.ordering import exact_quantiles
from faultline.session import sized_side


def last_run(labels: DataFrame) -> DataFrame:
    return labels.agg(F.max("run_id").alias("run_id"))


def end_from_duration(start: Column, seconds: Column) -> Column:
    return start + F.make_dt_interval(secs=seconds)


def metric_summary(metrics: DataFrame, by: list[str]) -> DataFrame:
    return metrics.groupBy(*by).agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                    F.min("value").alias("min"), F.max("value").alias("max"))


def log_level_summary(logs: DataFrame) -> DataFrame:
    return logs.groupBy("service", "level").count()


def value_counts(df: DataFrame, column: str) -> DataFrame:
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), column)


def summary_rollup(summary: DataFrame) -> DataFrame:
    return summary.groupBy("service", "metric").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("mean").alias("mean_of_mean"),
        F.max("max").alias("max_of_max"), F.min("min").alias("min_of_min"))


def mean_matrix(summary: DataFrame, metrics: list[str]) -> DataFrame:
    return summary.groupBy("service").pivot("metric", metrics).agg(F.avg("mean"))


def top_by_metric(summary: DataFrame, k: int = 5, tie: tuple[str, ...] = ("service",)) -> DataFrame:
    best = Window.partitionBy("metric").orderBy(F.desc("mean"), *tie)
    return summary.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def spans_per_trace(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(F.count(F.lit(1)).alias("num_spans"))


def latency_per_trace(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(F.sum("duration_ms").alias("duration_ms"))


def five_numbers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Minimum, quartiles, maximum: what a box plot shows."""
    return exact_quantiles(df, by, value, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0})


def bucket_counts(df: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative histogram: rows at or below each bound, the last bound being infinity."""
    counted = df.groupBy(*by).agg(*[F.count_if(F.col(value) <= F.lit(b)).alias(f"_b{i}") for i, b in enumerate(bounds)])
    return counted.select(*by, F.inline(F.array(*[
        F.struct(F.lit(b).alias("le"), F.col(f"_b{i}").cast("double").alias("value")) for i, b in enumerate(bounds)])))


def request_counters(requests: DataFrame, by: list[str]) -> DataFrame:
    return requests.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"))


def latest(df: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """Last non-null value of each series."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys)
            .agg(F.max_by(value, micros(ts)).alias(value), F.max(ts).alias(ts)))


def null_census(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])))


def elapsed_from_start(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Seconds since the first row of the key: one aggregate joined back, no window over a whole key."""
    first = sized_side(df.groupBy(*keys).agg(F.min(micros(ts)).alias("_t0")))
    return df.join(first, keys).withColumn("elapsed_seconds", (micros(ts) - F.col("_t0")) / 1e6).drop("_t0")


def minute_bucket(ts: Column, width_us: int = 60_000_000) -> Column:
    return from_micros(micros(ts) - F.pmod(micros(ts), F.lit(width_us)))
