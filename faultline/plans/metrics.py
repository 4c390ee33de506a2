"""Counters and latency buckets to the four service metrics on each run's grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.scalars import from_micros, micros
from faultline.operators import range_vectors, rolling
from faultline.operators.intervals import MINUTE, RUN_SERVICE
from faultline.session import sized_side


def rates_on_grid(samples: DataFrame, ranges: DataFrame, series: list[str], window_us: int, step_us: int) -> DataFrame:
    """run_id, series labels, eval_ts, rate of every counter series at start, start + step, ... up to the run's end.

    Times are taken relative to the run's start, so that one grid serves all runs.
    """
    r = sized_side(ranges.select("run_id", micros("start_ts").alias("_s"), micros("end_ts").alias("_e")))
    near = samples.join(r, "run_id").filter((micros("ts") > F.col("_s") - window_us) & (micros("ts") <= F.col("_e")))
    keys = ["run_id", "_s", "_e", *series]
    shifted = near.select(*keys, from_micros(micros("ts") - F.col("_s")).alias("ts"), "value")
    ticks = range_vectors.rate(shifted, keys, window_us, step_us)
    inside = ticks.filter((micros("eval_ts") >= 0) & (micros("eval_ts") <= F.col("_e") - F.col("_s")))
    return inside.select("run_id", *series, from_micros(micros("eval_ts") + F.col("_s")).alias("eval_ts"), "rate")


def export_metrics(requests: DataFrame, errors: DataFrame, buckets: DataFrame, ranges: DataFrame, window_us: int = MINUTE,
                   step_us: int = 5_000_000, quantile: float = 0.95, floor: float = 1e-6) -> DataFrame:
    """run_id, service, ts, metric, value: rps, eps, error_ratio and p95_latency of every service on the run's grid.

    `requests` and `errors` are counters (run_id, service, endpoint, ts, value), `buckets` cumulative
    latency counters with a bound `le`. Rates are taken by series, with resets added back,
    before they are added up. error_ratio has a row where both rates have one; a service without
    traffic in the window has a latency of NaN, which becomes null.
    """
    def total(samples: DataFrame, labels: list[str]) -> DataFrame:
        return range_vectors.sum_by(rates_on_grid(samples, ranges, labels, window_us, step_us), ["run_id", *[x for x in labels if x != "endpoint"]])

    rps = total(requests, ["service", "endpoint"]).withColumnRenamed("rate", "rps")
    eps = total(errors, ["service", "endpoint"]).withColumnRenamed("rate", "eps")
    p95 = range_vectors.histogram_quantile(total(buckets, ["service", "endpoint", "le"]), ["run_id", "service", "eval_ts"], quantile, value="rate")
    keys = [*RUN_SERVICE, "eval_ts"]
    wide = rps.join(eps, keys, "full").join(p95.withColumnRenamed("quantile", "p95_latency"), keys, "full")
    wide = wide.withColumn("error_ratio", F.col("eps") / F.greatest(F.col("rps"), F.lit(floor)))
    wide = wide.withColumn("error_ratio", F.when(F.col("rps").isNotNull(), F.col("error_ratio")))
    rows = rolling.union_metrics(wide.withColumnRenamed("eval_ts", "ts"), [*RUN_SERVICE, "ts"])
    return rows.filter(F.col("value").isNotNull()).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
