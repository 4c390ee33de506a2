"""Sources, sinks and run bookkeeping. Sinks are checked by reading back what was written."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.catalog.registry import query
from faultline.catalog.views import HOUR
from faultline.functions import scalars as S
from faultline.operators import aggregates as A
from faultline.operators import intervals
from faultline.schemas import time_violations
from faultline.session import scratch_path
from faultline.sources import readers, sinks


@query("read_table", "SELECT * FROM orders")
def read_table(t):
    return readers.read_table(t.spark, f"{t.folder}/orders")


@query("require_columns", """
SELECT 'ts' AS column_name, count(*) FILTER (WHERE ts IS NULL) AS violations FROM v_logs
UNION ALL SELECT 'bad_ts', count(*) FILTER (WHERE props = '{"k": 9}') FROM v_events""")
def require_columns(t):
    stamps = t.events.select("ts", S.parse_ts_utc(
        F.when(F.col("props") == '{"k": 9}', "not a time").otherwise(F.col("ts").cast("string"))).alias("bad_ts"))
    return time_violations(stamps, ["ts", "bad_ts"])


@query("read_logs_jsonl", """
SELECT CASE WHEN level = 'WARN' THEN 'backfill' ELSE run_id END AS run_id, CASE WHEN level <> 'ERROR' THEN ts END AS ts, service, level, message
FROM v_logs""")
def read_logs_jsonl(t):
    """Every event as a JSON line, with a blank and a broken line after each; all good lines come back."""
    path = scratch_path(t.spark, "logs")
    obj = F.to_json(F.struct(
        F.when(F.col("level") != "WARN", F.col("run_id")).alias("run_id"),
        F.when(F.col("level") == "ERROR", "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("ts"),
        "service", "level", "message", "line"))
    t.logs.select(F.explode(F.array(obj, F.lit(""), F.concat(obj, F.lit("}{")), F.substring(obj, 1, 20))).alias("value")).write.text(path)
    return readers.read_logs_jsonl(t.spark, path, "backfill").select("run_id", "ts", "service", "level", "message")


def _metric_payloads(t):
    """One stored response per event; some values are not numbers and some series have no service."""
    e = t.events
    labels = F.when(F.col("event_type") == "view", F.to_json(F.struct(F.lit("rps").alias("metric")))).otherwise(
        F.to_json(F.struct("service", F.lit("rps").alias("metric"))))
    text_value = F.when(F.col("event_type") == "error", "NaN").when(F.col("event_type") == "signup", "-Inf").otherwise(
        F.col("value").cast("string"))
    return e.select(F.concat(
        F.lit('{"status":"success","data":{"result":[{"metric":'), labels, F.lit(',"values":[['),
        F.unix_seconds("ts").cast("string"), F.lit(',"'), text_value, F.lit('"],['),
        (F.unix_seconds("ts") + 5).cast("string"), F.lit(',"1.5"]]}]}}')).alias("payload"))


@query("flatten_metric_response", """
WITH e AS (SELECT CASE WHEN event_type = 'view' THEN 'unknown' ELSE service END AS service, date_trunc('second', ts) AS ts,
  CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS value FROM v_events)
SELECT service, 'rps' AS metric, ts, round(value, 6) AS value FROM e
UNION ALL SELECT service, 'rps', ts + INTERVAL 5 SECOND, 1.5 FROM e""")
def flatten_metric_response(t):
    rows = readers.flatten_metric_response(_metric_payloads(t))
    return rows.select("service", F.col("labels")["metric"].alias("metric"), "ts", "value")


def _log_payloads(t):
    e = t.events
    stream = (F.when(F.col("event_type") == "view", F.to_json(F.struct(F.concat(F.lit("/x-simulator-"), "service", F.lit("-1")).alias("container"))))
              .when(F.col("event_type") == "click", F.to_json(F.struct(F.lit("").alias("service"), F.lit("shop").alias("app"))))
              .otherwise(F.lit("{}")))
    line = (F.when(F.col("event_type") == "error", F.to_json(F.struct(F.lit("").alias("level"), F.lit("ERROR").alias("lvl"), F.lit("bad").alias("msg"), "service")))
            .when(F.col("event_type") == "signup", F.lit("plain text")).otherwise(F.lit('{"level":"INFO","message":"ok"}')))
    return e.select(F.concat(
        F.lit('{"status":"success","data":{"result":[{"stream":'), stream, F.lit(',"values":[["'),
        S.ts_to_epoch_nanos("ts").cast("string"), F.lit('",'), F.substring(F.to_json(F.array(line)), 2, 100000).alias("x"),
        F.lit("]}]}}")).alias("payload"))


@query("flatten_log_response", """
SELECT ts, CASE event_type WHEN 'view' THEN service || '-1' WHEN 'click' THEN 'shop' WHEN 'error' THEN service ELSE 'unknown' END AS service,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN NULL ELSE 'INFO' END AS level,
  CASE event_type WHEN 'error' THEN 'bad' WHEN 'signup' THEN NULL ELSE 'ok' END AS message FROM v_events""")
def flatten_log_response(t):
    return readers.flatten_log_response(_log_payloads(t)).select("ts", "service", "level", "message")


@query("read_fault_labels", """
SELECT run_id, service, fault_type, start_ts, end_ts, row_number() OVER (PARTITION BY run_id, service ORDER BY label_seq % 5 > 0, label_seq) AS place FROM v_faults""")
def read_fault_labels(t):
    """Two appended files of unequal size; the place of a label among those of its run and service follows the files."""
    path = scratch_path(t.spark, "labels")
    ordered = t.faults.repartition(1).sortWithinPartitions("label_seq")
    for part in ("label_seq % 5 = 0", "label_seq % 5 > 0"):
        sinks.append_labels(ordered.filter(part), path)
    place = F.row_number().over(Window.partitionBy("run_id", "service").orderBy("label_seq"))
    return readers.read_fault_labels(t.spark, path).withColumn("place", place).drop("label_seq")


_GRAPH_EDGES = """
SELECT service AS src, event_type AS dst, round(sum(CASE WHEN event_type = 'view' THEN 1.0 ELSE cents / 256 END), 6) AS weight
FROM v_events GROUP BY ALL"""


def _event_edges(t):
    """One edge per event; views carry no weight."""
    return t.events.select(F.col("service").alias("src"), F.col("event_type").alias("dst"),
                           F.when(F.col("event_type") != "view", F.col("cents") / 256).alias("weight"))


@query("read_graph_json", _GRAPH_EDGES)
def read_graph_json(t):
    """One edge document per event; repeated edges add up."""
    path = scratch_path(t.spark, "graph")
    _event_edges(t).select(F.array(F.struct("src", "dst", "weight")).alias("edges"),
                           F.lit("test").alias("type")).write.json(path)
    return readers.read_graph_json(t.spark, path, multi_line=False)


@query("write_run_parquet", "SELECT run_id, ts, service, metric, round(value, 6) AS value FROM v_metrics")
def write_run_parquet(t):
    path = scratch_path(t.spark, "metrics")
    sinks.write_run_parquet(t.metrics, path)
    return t.spark.read.schema("ts TIMESTAMP, service STRING, metric STRING, value DOUBLE, run_id STRING").parquet(path)


@query("write_logs_jsonl", "SELECT run_id, ts, service, level, message, line, service AS label_service FROM v_logs")
def write_logs_jsonl(t):
    path = scratch_path(t.spark, "logs")
    sinks.write_logs_jsonl(t.logs.withColumn("labels", F.create_map(F.lit("service"), F.col("service"))), path)
    return readers.read_logs_jsonl(t.spark, path).select(
        "run_id", "ts", "service", "level", "message", "line", F.col("labels")["service"].alias("label_service"))


@query("write_graph_json", _GRAPH_EDGES)
def write_graph_json(t):
    edges = t.events.groupBy(F.col("service").alias("src"), F.col("event_type").alias("dst")).agg(
        F.sum(F.when(F.col("event_type") == "view", F.lit(1.0)).otherwise(F.col("cents") / 256)).alias("weight"))
    path = sinks.write_graph_json(edges, 120, scratch_path(t.spark, "graph"), "multi")
    return readers.read_graph_json(t.spark, path)


@query("append_labels", """
SELECT run_id, service, fault_type, start_ts, end_ts FROM v_faults
UNION ALL SELECT run_id, service, 'memory', start_ts, end_ts FROM v_faults""")
def append_labels(t):
    path = scratch_path(t.spark, "labels")
    sinks.append_labels(t.faults, path)
    sinks.append_labels(t.faults.withColumn("fault_type", F.lit("memory")), path)
    return readers.read_fault_labels(t.spark, path).drop("label_seq")


@query("write_csv_summaries", "SELECT service, level, count(*) AS count FROM v_logs GROUP BY ALL")
def write_csv_summaries(t):
    path = scratch_path(t.spark, "summary")
    sinks.write_csv_summary(A.log_level_summary(t.logs), path)
    return t.spark.read.csv(path, header=True, schema="service STRING, level STRING, count LONG")


@query("last_run", "SELECT max(run_id) AS run_id FROM v_faults")
def last_run(t):
    return A.last_run(t.faults)


@query("run_time_window", """
SELECT run_id, min(start_ts) - INTERVAL 30 MINUTE AS start_ts, max(end_ts) + INTERVAL 30 MINUTE AS end_ts FROM v_faults GROUP BY run_id""")
def run_time_window(t):
    return intervals.run_time_window(t.faults, HOUR // 2)


@query("fault_end_from_duration", "SELECT label_seq, start_ts, end_ts FROM v_faults")
def fault_end_from_duration(t):
    seconds = (F.lit(20) + F.col("label_seq") % 41) * 60
    return t.faults.select("label_seq", "start_ts", A.end_from_duration(F.col("start_ts"), seconds).alias("end_ts"))


