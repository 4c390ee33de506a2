"""Readers for tables, logs, labels, graphs and stored query responses."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.operators.graph import merge_edges
from faultline.schemas import GRAPH, LABELS, LOG_ARRAY, REQUIRED, require_columns
from faultline.session import file_system
from faultline.sources.sinks import GRAPH_MANIFEST


def read_table(spark: SparkSession, path_no_ext: str, csv_schema: str | None = None) -> DataFrame:
    """`<path>.parquet` if it is there, else `<path>.csv`; neither is an error."""
    try:
        return spark.read.parquet(f"{path_no_ext}.parquet")
    except AnalysisException:
        pass
    try:
        reader = spark.read.option("header", True)
        reader = reader.schema(csv_schema) if csv_schema else reader.option("inferSchema", True)
        return reader.csv(f"{path_no_ext}.csv")
    except AnalysisException as err:
        raise FileNotFoundError(f"neither {path_no_ext}.parquet nor {path_no_ext}.csv exists") from err


def read_features(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
    df = require_columns(df, REQUIRED["features"])
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("window_start", "window_end")})


def read_logs_jsonl(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped, a missing run_id is filled in, bad times are null."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    # inside an array a line must be one whole object: text after it makes the array malformed
    one = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), LOG_ARRAY)
    rows = lines.select(one.alias("r")).filter((F.size("r") == 1) & F.col("r")[0].isNotNull()).select(F.inline("r"))
    return rows.withColumns({"run_id": F.coalesce("run_id", F.lit(run_id)), "ts": S.parse_ts_utc("ts")})


def read_fault_labels(spark: SparkSession, path: str) -> DataFrame:
    """CSV labels with UTC times. `label_seq` orders rows as they were appended.

    It is a struct that compares in that order: by the batch number `append_labels` gave,
    then file name and place in the file. Files of other writers have no number and come
    first, by modification time and path.
    """
    rows = spark.read.csv(path, header=True, schema=LABELS, enforceSchema=False, recursiveFileLookup=True)
    df = require_columns(rows, REQUIRED["labels"])
    meta = F.col("_metadata")
    batch = F.regexp_extract(meta["file_path"], r"/batch=(\d+)/[^/]*$", 1).try_cast("long")
    place = F.struct(batch.alias("batch"), F.when(batch.isNull(), meta["file_modification_time"]).alias("changed"), meta["file_path"].alias("file"),
                     meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select("run_id", "service", "fault_type", S.parse_ts_utc("start_ts").alias("start_ts"),
                     S.parse_ts_utc("end_ts").alias("end_ts"), place.alias("label_seq"))


def read_graph_json(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Edge documents; repeated edges add up and a missing weight is 1.

    A folder that `write_graph_json` finished (it has a manifest) holds a document per line,
    which splits over tasks, and must be complete. Of other files each is one document, unless
    `multi_line=False`.
    """
    manifest = f"{path}/{GRAPH_MANIFEST}"
    finished = multi_line is None and file_system(spark, path).exists(f"{manifest}/_SUCCESS")
    docs = spark.read.schema(GRAPH).json(path, multiLine=not finished if multi_line is None else multi_line)
    if finished:
        told = spark.read.schema("documents LONG, edges LONG").json(manifest).first()
        there = docs.agg(F.count("*"), F.coalesce(F.sum(F.size("edges")), F.lit(0))).first()
        if tuple(told) != tuple(there):
            raise ValueError(f"{path}: {there[0]} documents with {there[1]} edges, but {told[0]} with {told[1]} were written")
    return merge_edges(docs.select(F.inline("edges")))


def failed_responses(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The documents whose status is not success, unreadable ones included."""
    status = F.from_json(column, "status STRING")["status"]
    return payloads.filter(F.coalesce(status, F.lit("")) != "success")


def _results(payloads: DataFrame, column: str, schema: str, on_failure: str) -> DataFrame:
    """Results of successful documents; others stop the query, or with `on_failure="skip"` are left to `failed_responses`."""
    if on_failure not in ("raise", "skip"):
        raise ValueError("on_failure is raise or skip")
    parsed = payloads.select(F.from_json(column, schema).alias("p"), F.col(column).alias("_raw"))
    good = F.coalesce(F.col("p.status"), F.lit("")) == "success"
    stop = F.raise_error(F.concat(F.lit("the query response failed: "), F.coalesce(F.substring("_raw", 1, 200), F.lit("null"))))
    result = F.col("p.data.result")
    return parsed.select(F.inline(F.when(good, result) if on_failure == "skip" else F.when(good, result).otherwise(stop)))


def flatten_metric_response(payloads: DataFrame, column: str = "payload", on_failure: str = "raise") -> DataFrame:
    """Range-query documents to rows (labels, service, ts, value); NaN and infinities become null."""
    schema = ("status STRING, data STRUCT<result: ARRAY<STRUCT<metric: MAP<STRING,STRING>, "
              "`values`: ARRAY<ARRAY<STRING>>>>>")
    series = _results(payloads, column, schema, on_failure)
    points = series.select("metric", F.explode("values").alias("v"))
    return points.select(
        F.col("metric").alias("labels"),
        F.coalesce(F.try_element_at("metric", F.lit("service")), F.lit("unknown")).alias("service"),
        F.timestamp_micros(F.round(F.col("v")[0].cast("double") * 1e6).cast("long")).alias("ts"),
        S.finite_or_null(F.expr("try_cast(v[1] AS DOUBLE)")).alias("value"))


def flatten_log_response(payloads: DataFrame, column: str = "payload", on_failure: str = "raise") -> DataFrame:
    """Stream documents to rows (ts, line, service, level, message, labels)."""
    schema = ("status STRING, data STRUCT<result: ARRAY<STRUCT<stream: MAP<STRING,STRING>, "
              "`values`: ARRAY<ARRAY<STRING>>>>>")
    streams = _results(payloads, column, schema, on_failure)
    rows = streams.select(F.col("stream").alias("labels"), F.explode("values").alias("v"))
    line = F.col("v")[1]
    return rows.select(
        S.epoch_nanos_to_ts(F.col("v")[0]).alias("ts"), line.alias("line"),
        S.resolve_service(line, F.col("labels")).alias("service"),
        S.log_field(line, "level", "lvl").alias("level"),
        S.log_field(line, "message", "msg").alias("message"), "labels")


# Discovery labels of a container.
CONTAINER_NAME = "__meta_docker_container_name"
CONTAINER_ID = "__meta_docker_container_id"


def relabel_logs(raw: DataFrame, service_label: str) -> DataFrame:
    """Discovery labels to service / container / container_id; level and time from the JSON line.

    `service_label` is the discovery label that holds the service; other labels are not looked at.
    """
    line = F.col("line")
    return raw.select(
        F.try_element_at("labels", F.lit(service_label)).alias("service"),
        F.try_element_at("labels", F.lit(CONTAINER_NAME)).alias("container"),
        F.try_element_at("labels", F.lit(CONTAINER_ID)).alias("container_id"),
        S.log_field(line, "level").alias("level"), S.log_field(line, "message").alias("message"),
        F.coalesce(S.parse_ts_utc(F.get_json_object(line, "$.timestamp")), F.col("ts")).alias("ts"), "line")


def json_line_level(line: Column) -> Column:
    return F.get_json_object(line, "$.level")
