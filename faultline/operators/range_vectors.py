"""Range-vector functions: what a metric store evaluates over a counter's recent samples.

Ticks are `origin + k * step`. A sample belongs to every tick whose range
(tick - window, tick] holds it. Samples are first reduced to one row per series
and step, then those rows are spread to the ticks and merged, so both shuffles
move partial results only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.scalars import bin_of, clamp_min, from_micros, micros
from faultline.operators.blocks import home_rows, with_time_blocks
from faultline.operators.intervals import MINUTE
from faultline.session import sized_side


def _first_tick(ts: Column, step_us: int, origin_us: int) -> Column:
    return -bin_of(-(micros(ts) - F.lit(origin_us)), step_us)


def _spread(df: DataFrame, window_us: int, step_us: int) -> DataFrame:
    if window_us % step_us:
        raise ValueError("the window must be a whole number of steps")
    return df.withColumn("_k", F.explode(F.sequence(F.col("_k"), F.col("_k") + (window_us // step_us - 1))))


def _tick_time(step_us: int, origin_us: int) -> Column:
    return from_micros(F.col("_k") * F.lit(step_us) + F.lit(origin_us)).alias("eval_ts")


def over_time(samples: DataFrame, keys: list[str], window_us: int = MINUTE, step_us: int = 5_000_000,
              value: str | None = "value", origin_us: int = 0) -> DataFrame:
    """count / sum / avg / max / min / last of each series at each tick."""
    v = F.col(value) if value else F.lit(1.0)
    steps = (samples.withColumns({"_k": _first_tick(F.col("ts"), step_us, origin_us), "_t": micros("ts")})
             .groupBy(*keys, "_k")
             .agg(F.count(v).alias("_n"), F.sum(v).alias("_s"), F.max(v).alias("_hi"), F.min(v).alias("_lo"),
                  F.max_by(v, "_t").alias("_v"), F.max("_t").alias("_t")))
    ticks = (_spread(steps, window_us, step_us).groupBy(*keys, "_k")
             .agg(F.sum("_n").alias("count_over_time"), F.sum("_s").alias("sum_over_time"),
                  F.max("_hi").alias("max_over_time"), F.min("_lo").alias("min_over_time"),
                  F.max_by("_v", "_t").alias("last_over_time")))
    return ticks.select(*keys, _tick_time(step_us, origin_us), "count_over_time", "sum_over_time",
                        (F.col("sum_over_time") / F.col("count_over_time")).alias("avg_over_time"),
                        "max_over_time", "min_over_time", "last_over_time")


def grid(ranges: DataFrame, step_us: int) -> DataFrame:
    """start, start + step, ... up to end, for every row of (..., start_ts, end_ts)."""
    return ranges.withColumn("eval_ts", F.explode(F.transform(
        F.sequence(micros("start_ts"), micros("end_ts"), F.lit(step_us)), from_micros)))


def evaluate_on_grid(samples: DataFrame, ranges: DataFrame, keys: list[str], step_us: int,
                     lookback_us: int) -> DataFrame:
    """Latest sample within the lookback at each tick of the run's own grid.

    Each run's grid starts at its own start time, so a sample's ticks follow
    from it by arithmetic; samples meet ranges on run_id only.
    """
    r = sized_side(ranges.select("run_id", micros("start_ts").alias("_s"), micros("end_ts").alias("_e")))
    s = samples.select(*keys, micros("ts").alias("_t"), "value").join(r, "run_id")
    s = (s.withColumn("_k", F.greatest(-bin_of(-(F.col("_t") - F.col("_s")), step_us), F.lit(0)))
         .withColumn("_end", F.least(-bin_of(-(F.col("_t") + lookback_us - F.col("_s")), step_us) - 1,
                                     bin_of(F.col("_e") - F.col("_s"), step_us)))
         .filter(F.col("_k") <= F.col("_end")))
    latest = (s.groupBy(*keys, "_s", "_k", "_end").agg(F.max_by("value", "_t").alias("value"), F.max("_t").alias("_t"))
              .withColumn("_k", F.explode(F.sequence("_k", "_end")))
              .groupBy(*keys, "_s", "_k").agg(F.max_by("value", "_t").alias("value")))
    return latest.select(*keys, from_micros(F.col("_s") + F.col("_k") * step_us).alias("eval_ts"), "value")


def rate(samples: DataFrame, keys: list[str], window_us: int = MINUTE, step_us: int = 5_000_000,
         origin_us: int = 0, value: str = "value") -> DataFrame:
    """Per-second increase of a counter; resets are added back, edges extrapolated.

    At least two samples are needed. The gap to each edge of the range counts in
    full below 1.1 mean spacings, else as half a spacing, and never reaches
    below a zero counter.
    """
    s = samples.select(*keys, micros("ts").alias("_t"), F.col(value).alias("_v"))
    s = with_time_blocks(s, F.col("_t"), 60 * window_us, window_us)
    before = F.lag("_v").over(Window.partitionBy(*keys, "_block").orderBy("_t"))
    s = home_rows(s.withColumn("_prev", before))
    s = (s.withColumn("_reset", F.when(F.col("_v") < F.col("_prev"), F.col("_prev")).otherwise(F.lit(0.0)))
         .withColumn("_k", -bin_of(-(F.col("_t") - F.lit(origin_us)), step_us)))

    def merged(df: DataFrame, t0: str, t1: str, v0: str, v1: str, r0: str, r: str, n: Column) -> DataFrame:
        return df.groupBy(*keys, "_k").agg(
            F.min(t0).alias("_t0"), F.max(t1).alias("_t1"),
            F.min_by(v0, t0).alias("_v0"), F.max_by(v1, t1).alias("_v1"),
            F.min_by(r0, t0).alias("_r0"), F.sum(r).alias("_r"), n.alias("_n"))

    steps = merged(s, "_t", "_t", "_v", "_v", "_reset", "_reset", F.count(F.lit(1)))
    ticks = merged(_spread(steps, window_us, step_us), "_t0", "_t1", "_v0", "_v1", "_r0", "_r", F.sum("_n"))
    ticks = ticks.filter("_n >= 2")
    inc = F.col("_v1") - F.col("_v0") + F.col("_r") - F.col("_r0")
    end = F.col("_k") * F.lit(step_us) + F.lit(origin_us)
    span = (F.col("_t1") - F.col("_t0")) / 1e6
    mean_gap = span / (F.col("_n") - 1)
    head = (F.col("_t0") - (end - F.lit(window_us))) / 1e6
    tail = (end - F.col("_t1")) / 1e6
    head = F.when(head >= mean_gap * 1.1, mean_gap / 2).otherwise(head)
    tail = F.when(tail >= mean_gap * 1.1, mean_gap / 2).otherwise(tail)
    zero = F.try_divide(span * F.col("_v0"), inc)
    head = F.when((inc > 0) & (F.col("_v0") >= 0) & (zero < head), zero).otherwise(head)
    per_second = inc * ((span + head + tail) / span) / F.lit(window_us / 1e6)
    return ticks.select(*keys, _tick_time(step_us, origin_us), per_second.alias("rate"))


def sum_by(vector: DataFrame, by: list[str], value: str = "rate") -> DataFrame:
    return vector.groupBy("eval_ts", *by).agg(F.sum(value).alias(value))


def count_by(vector: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of series with a value at each tick, per label set; e.g. the services that logged anything."""
    return vector.groupBy("eval_ts", *(by or [])).agg(F.count(F.lit(1)).alias("n_series"))


def ratio(numerator: DataFrame, denominator: DataFrame, on: list[str], value: str = "rate",
          floor: float = 1e-6) -> DataFrame:
    """Element-wise quotient of two vectors with equal labels; the divisor is kept above the floor."""
    d = denominator.withColumnRenamed(value, "_den")
    return (numerator.join(d, ["eval_ts", *on])
            .select("eval_ts", *on, (F.col(value) / clamp_min(F.col("_den"), floor)).alias("ratio")))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float, le: str = "le", value: str = "value") -> DataFrame:
    """Quantile from cumulative buckets, linear inside the bucket.

    A rank in the open last bucket gives the bound before it; an empty histogram
    gives NaN. A group holds one row per bucket bound.
    """
    part = Window.partitionBy(*keys)
    walk = part.orderBy(le)
    b = buckets.withColumns({
        "_total": F.max(F.when(F.col(le) == F.lit(float("inf")), F.col(value))).over(part),
        "_lo": F.lag(le).over(walk), "_below": F.lag(value).over(walk)})
    rank = F.col("_total") * F.lit(q)
    crossing = (F.col(value) >= rank) & (F.col("_below").isNull() | (F.col("_below") < rank))
    start = F.coalesce("_lo", F.when(F.col(le) > 0, F.lit(0.0)).otherwise(F.col(le)))
    inside = start + (F.col(le) - start) * (rank - F.coalesce("_below", F.lit(0.0))) / (
        F.col(value) - F.coalesce("_below", F.lit(0.0)))
    picked = (F.when(F.col("_total") == 0, F.lit(float("nan")))
              .when(F.col(le) == F.lit(float("inf")), F.col("_lo")).otherwise(inside))
    return (b.filter(crossing | (F.col("_total") == 0))
            .groupBy(*keys).agg(F.min_by(picked, F.col(le)).alias("quantile")))


def alert_for(vector: DataFrame, keys: list[str], condition: Column, for_us: int, step_us: int) -> DataFrame:
    """inactive / pending / firing at each tick.

    Firing means the condition held at every tick of the last `for`; a tick with
    no value breaks the streak. The frame is bounded by `for`, so blocks of time
    are enough however long an alert lasts.
    """
    need = -(-for_us // step_us)
    v = vector.select(*keys, "eval_ts", F.coalesce(condition, F.lit(False)).alias("cond"),
                      micros("eval_ts").alias("_t"))
    v = with_time_blocks(v, F.col("_t"), 240 * (need + 1) * step_us, need * step_us)
    frame = Window.partitionBy(*keys, "_block").orderBy("_t").rangeBetween(-need * step_us, 0)
    v = home_rows(v.withColumn("_held", F.count_if(F.col("cond")).over(frame)))
    state = (F.when(~F.col("cond"), "inactive").when(F.col("_held") == need + 1, "firing").otherwise("pending"))
    return v.select(*keys, "eval_ts", "cond", state.alias("state"))


# Rule name, range function, threshold (null = any non-zero value), hold in
# seconds, severity. Latency thresholds are in the metric's own unit.
ALERT_RULES = [
    ("incident_flag", "max_over_time", None, 20, "critical"),
    ("high_probability", "max_over_time", 0.75, 30, "warning"),
    ("high_error_ratio", "avg_over_time", 0.05, 30, "warning"),
    ("high_p95_latency", "avg_over_time", 400.0, 30, "warning"),
]


def evaluate_rule(samples: DataFrame, keys: list[str], rule: tuple, window_us: int = MINUTE,
                  step_us: int = 10_000_000, unit_us: int = 1_000_000, threshold: float | None = None) -> DataFrame:
    name, fn, limit, hold, severity = rule
    limit = threshold if threshold is not None else limit
    vector = over_time(samples, keys, window_us, step_us)
    cond = (F.col(fn) != 0) if limit is None else (F.col(fn) > limit)
    return (alert_for(vector, keys, cond, hold * unit_us, step_us)
            .withColumns({"rule": F.lit(name), "severity": F.lit(severity)}))
