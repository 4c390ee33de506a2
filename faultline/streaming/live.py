"""The live paths as Structured Streaming queries.

Windows here are aligned to a grid and half-open [start, end). Rows later than
the watermark are dropped; everything else gives the batch result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from faultline.functions.scalars import from_micros, micros
from faultline.operators.graph import score_services
from faultline.operators.intervals import RUN_SERVICE
from faultline.operators.rolling import STATS
from faultline.schemas import METRIC_NAMES
from faultline.session import scratch_path
from faultline.streaming.keyed import AlertHold, FaultPairing, IncidentState
from faultline.streaming.tables import CurrentTable


def read_stream(spark: SparkSession, folder: str, name: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the schema comes from the files already there."""
    path = f"{folder}/{name}.parquet" if name else folder
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if name:
        reader = reader.option("pathGlobFilter", f"{name}.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def log_counts(logs: DataFrame, width: str = "1 minute", slide: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Errors, warnings and all lines per service in each sliding window."""
    w = F.window("ts", width, slide)
    return (logs.withWatermark("ts", delay).groupBy(w, "service")
            .agg(F.count_if(F.col("level") == "ERROR").alias("errors"), F.count_if(F.col("level") == "WARN").alias("warnings"),
                 F.count(F.lit(1)).alias("total"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "service", "errors", "warnings", "total"))


def metric_features(metrics: DataFrame, width: str = "1 minute", slide: str | None = None, delay: str = "1 minute") -> DataFrame:
    """Mean, deviation, minimum and maximum of each metric per window; metrics arrive one per row."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    aggs = [F.expr(f"{fn}(CASE WHEN metric = '{m}' THEN value END) AS {m}_{s}") for m in METRIC_NAMES for s, fn in STATS.items()]
    return (metrics.withWatermark("ts", delay).groupBy(w, *RUN_SERVICE).agg(*aggs)
            .select(*RUN_SERVICE, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    *[f"{m}_{s}" for m in METRIC_NAMES for s in STATS]))


def latest_gauges(scored: DataFrame, values: list[str], key: str = "service") -> DataFrame:
    """Newest value of each gauge by event time: a late row never replaces a newer one. For update mode."""
    return scored.groupBy(key).agg(F.max("ts").alias("ts"), *[F.max_by(v, micros("ts")).alias(v) for v in values])


def request_counters(requests: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Running counts and cumulative latency buckets per label set. For update mode."""
    return requests.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), *[
        F.count_if(F.col(value) <= F.lit(b)).alias("le_inf" if b == float("inf") else f"le_{b:g}") for b in bounds])


def gauge_ticks(gauge: DataFrame, range_width: str = "1 minute", step: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Maximum and mean of each service's gauge over the last range at each step, once the step is complete."""
    return (gauge.withWatermark("ts", delay).groupBy(F.window("ts", range_width, step), "service")
            .agg(F.max("value").alias("hi"), F.avg("value").alias("mid"))
            .select(F.col("window.end").alias("eval_ts"), "service", "hi", "mid"))


def alert_states(ticks: DataFrame, rules: dict[str, tuple[Column, int]], step_us: int = 10_000_000, delay: str = "0 seconds",
                 lifetime_ms: int = 3_600_000) -> DataFrame:
    """inactive / pending / firing per rule and service at each tick, in the order of the ticks.

    `rules` maps a name to (condition on `hi` and `mid`, hold in steps). Ticks come from the
    table `gauge_ticks` writes, one row per service and step of whole milliseconds. A tick waits
    for the watermark, so ticks may arrive in any order within `delay`; what a key keeps goes
    `lifetime_ms` after its last tick.
    """
    if lifetime_ms * 1000 <= step_us:
        raise ValueError("the lifetime must be longer than a step")
    entries = [F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("cond"), F.lit(hold).cast("long").alias("hold"))
               for n, (c, hold) in rules.items()]
    rows = ticks.withWatermark("eval_ts", delay).select("service", "eval_ts", micros("eval_ts").alias("at"), F.inline(F.array(*entries)))
    states = keyed_rows(rows, ["rule", "service"], AlertHold(step_us, lifetime_ms), "rule STRING, service STRING, at LONG, cond BOOLEAN, state STRING")
    return states.select("rule", "service", from_micros("at").alias("eval_ts"), "cond", "state")


def fault_intervals(events: DataFrame, start_message: str = "fault_start",
                    end_messages: tuple[str, ...] = ("fault_end", "fault_cleared"), delay: str = "1 minute",
                    block_ms: int = 60_000) -> DataFrame:
    """Closed fault intervals per run and service, paired in event-time order.

    Events wait in the state until the watermark has passed them, so their
    arrival order does not matter; only fault events are kept. They wait in blocks of
    `block_ms` (about the delay), which are read and written whole; the result is the same for any.
    """
    marks = (events.filter(F.col("message").isin(start_message, *end_messages)).withWatermark("ts", delay)
             .select(*RUN_SERVICE, "ts", micros("ts").alias("at"), (F.col("message") == start_message).alias("is_start")))
    pairs = keyed_rows(marks, RUN_SERVICE, FaultPairing(block_ms), "run_id STRING, service STRING, start LONG, end LONG", pandas=True)
    return pairs.select(*RUN_SERVICE, from_micros("start").alias("start_ts"), from_micros("end").alias("end_ts"))


def incident_changes(alerts: DataFrame, delay: str = "1 minute", lifetime_ms: int = 0) -> DataFrame:
    """Whenever alerts reach an incident: all its services with mean score, first time,
    when the incident began, and its number of alerts as the version.

    Alerts carry incident_id, run_id, service, ts, score; later ones than the watermark are
    dropped. With a lifetime an incident is forgotten that long after its last alert.
    """
    rows = (alerts.filter(F.col("incident_id").isNotNull() & F.col("service").isNotNull()).withWatermark("ts", delay)
            .select("incident_id", "run_id", "service", "ts", micros("ts").alias("at"), F.col("score").cast("double").alias("score")))
    changed = keyed_rows(rows, ["incident_id"], IncidentState(lifetime_ms),
                         "incident_id STRING, run_id STRING, service STRING, magnitude DOUBLE, first LONG, began LONG, version LONG")
    return changed.select("incident_id", "run_id", "service", "magnitude", from_micros("first").alias("first_seen"), from_micros("began").alias("began"), "version")


def keyed_rows(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, pandas: bool = False) -> DataFrame:
    """Rows a stateful processor gives, which takes single rows or pandas tables; its state lies in RocksDB, not in the executor's heap."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    groups = rows.groupBy(*keys)
    return (groups.transformWithStateInPandas if pandas else groups.transformWithState)(processor, schema, "append", "eventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_append(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Process what is there and read the finished rows back."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    (stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out")
     .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def run_update(stream: DataFrame, name: str, keys: list[str], path: str | None = None, compact_every: int = 8) -> DataFrame:
    """Process what is there; the newest row of every key, from a table of bounded size (`CurrentTable`)."""
    path = path or scratch_path(stream.sparkSession, name)
    table = CurrentTable(stream.sparkSession, f"{path}/out", keys, compact_every)
    (stream.writeStream.outputMode("update").foreachBatch(table.upsert)
     .option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination())
    return table.read()


CAUSE_COLUMNS = ["place", "incident_id", "run_id", "began", "rank", "service", "score", "magnitude", "centrality", "earliness"]


def rank_recent(pool: DataFrame, graph_scores: DataFrame, keep: int, top_k: int) -> DataFrame:
    """Root-cause gauges of the newest `keep` incidents: the batch's scores and ranks, from one row per incident and service."""
    newest = pool.select("incident_id", "began").distinct().orderBy(F.desc("began"), F.desc("incident_id")).limit(keep)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("began"), F.desc("incident_id"))  # over `keep` rows
    placed = newest.withColumn("place", F.row_number().over(order)).drop("began")
    scored = score_services(pool.join(F.broadcast(placed), "incident_id"), graph_scores)
    best = Window.partitionBy("incident_id").orderBy(F.desc("score"), "service")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k).select(CAUSE_COLUMNS)


class RecentCauses:
    """Keeps the gauges of the newest incidents up to date, batch by batch, and tells which incidents have left.

    The pool holds the newest `keep` incidents and those that an alert the watermark still
    admits could bring back: an incident leaves for good once the watermark has passed its
    beginning, as no other can begin before it any more. So the pool is bounded by `keep`
    and the incidents that began within `delay_us` of the newest alert time seen.
    """

    def __init__(self, spark: SparkSession, path: str, graph_scores: DataFrame, keep: int = 20, top_k: int = 3, delay_us: int = 60_000_000):
        self.pool = CurrentTable(spark, f"{path}/pool", ["incident_id", "service"])
        self.gauges = CurrentTable(spark, f"{path}/gauges", ["incident_id", "rank"])
        self.path, self.graph_scores, self.keep, self.top_k, self.delay_us = path, graph_scores, keep, top_k, delay_us

    def update(self, changes: DataFrame, epoch: int) -> None:
        latest = changes.groupBy("incident_id").agg(F.max("version").alias("version"))
        changes = changes.join(latest, ["incident_id", "version"], "left_semi").drop("version").persist()
        held = self.pool.read()
        pool = changes if held is None else held.join(changes.select("incident_id").distinct(), "incident_id", "left_anti").unionByName(changes)
        began = pool.groupBy("incident_id").agg(F.first("began").alias("_began"), F.max("first_seen").alias("_seen"))
        newest = began.agg(F.max("_seen")).first()[0]
        if newest is None:
            changes.unpersist()
            return
        top = began.orderBy(F.desc("_began"), F.desc("incident_id")).limit(self.keep).select("incident_id").withColumn("_top", F.lit(True))
        open_ = F.col("_began") >= from_micros(micros(F.lit(newest)) - self.delay_us)
        kept = began.join(F.broadcast(top), "incident_id", "left").filter(F.coalesce("_top", F.lit(False)) | open_).select("incident_id")
        self.pool.replace(pool.join(kept, "incident_id"), epoch)
        before = self.gauges.read()
        now = rank_recent(self.pool.read(), self.graph_scores, self.keep, self.top_k)
        if before is not None:
            gone = before.select("incident_id").distinct().join(now.select("incident_id"), "incident_id", "left_anti")
            gone.write.mode("overwrite").parquet(f"{self.path}/left/epoch={epoch}")
        self.gauges.replace(now, epoch)
        changes.unpersist()

    def departures(self) -> DataFrame:
        """incident_id, epoch: the batches in which incidents left the newest ones; they may have come back since."""
        return self.pool.spark.read.schema("incident_id STRING, epoch INT").parquet(f"{self.path}/left")

    def run(self, alerts: DataFrame, lifetime_ms: int = 0) -> DataFrame:
        """Process what is there; the current gauges."""
        (incident_changes(alerts, f"{self.delay_us} microseconds", lifetime_ms).writeStream.outputMode("append").foreachBatch(self.update)
         .option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start().awaitTermination())
        return self.gauges.read()
