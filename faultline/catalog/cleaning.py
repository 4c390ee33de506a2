"""Projections, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.catalog.registry import query
from faultline.catalog.views import HOUR, METRIC_FEATURES, WINDOWS
from faultline.functions import scalars as S
from faultline.operators import aggregates as A
from faultline.operators import rolling
from faultline.sources import readers

NAN, INF = float("nan"), float("inf")


def flagged_logs(t):
    """Log rows with their text, level flags and keyword count."""
    text = S.log_text(F.col("message"), F.col("line"))
    level = S.log_level(F.col("level"))
    return t.logs.select("event_id", "run_id", "ts", S.normalize_service(F.col("service")).alias("service"), level.alias("level"),
                         text.alias("text"), S.is_level(level, "ERROR").alias("is_error"),
                         S.is_level(level, "WARN").alias("is_warn"), S.error_keyword_count(text).alias("err_kw"))


@query("parse_ts_utc", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN ts END AS ts,
  CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END AS iso FROM v_events""")
def parse_ts_utc(t):
    kind, fmt = F.col("event_type"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    ahead = F.timestamp_micros(F.unix_micros("ts") + 2 * HOUR)
    stamp = (F.when(kind == "error", "not a time").when(kind == "view", F.date_format("ts", fmt))
             .when(kind == "click", F.concat(F.date_format("ts", fmt), F.lit("Z")))
             .otherwise(F.concat(F.date_format(ahead, fmt), F.lit("+02:00"))))
    parsed = t.events.select("event_id", S.parse_ts_utc(stamp).alias("ts"))
    return parsed.withColumn("iso", S.to_rfc3339("ts"))


@query("epoch_to_ts", """
SELECT event_id, date_trunc('second', ts) AS from_seconds, ts AS from_nanos, epoch_us(ts) * 1000 AS nanos FROM v_events""")
def epoch_to_ts(t):
    nanos = S.ts_to_epoch_nanos("ts")
    return t.events.select("event_id", S.epoch_seconds_to_ts(F.unix_seconds("ts").cast("double")).alias("from_seconds"),
                           S.epoch_nanos_to_ts(nanos.cast("string")).alias("from_nanos"), nanos.alias("nanos"))


@query("drop_incomplete", """
SELECT event_id, ts, service, message FROM v_logs WHERE ts IS NOT NULL AND service IS NOT NULL AND message IS NOT NULL""")
def drop_incomplete(t):
    return t.logs.select("event_id", "ts", "service", "message").na.drop(subset=["ts", "service", "message"])


@query("filter_run", "SELECT event_id, ts, service, level FROM v_logs WHERE run_id = '20240115'")
def filter_run(t):
    return t.logs.filter(F.col("run_id") == "20240115").select("event_id", "ts", "service", "level")


@query("time_range_filter", """
SELECT event_id, ts, value FROM v_events WHERE ts BETWEEN TIMESTAMP '2024-01-05 11:30:00' AND TIMESTAMP '2024-01-09 12:30:00'""")
def time_range_filter(t):
    """The bounds are compared in the file's own type, so the scan can skip row groups."""
    bound = [F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05 11:30:00", "2024-01-09 12:30:00")]
    return t.raw("events").filter(F.col("ts").between(*bound)).select("event_id", "ts", "value")


@query("normalize_service", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown' ELSE service END AS service FROM v_events""")
def normalize_service(t):
    kind = F.col("event_type")
    raw = (F.when(kind == "error", F.lit(None)).when(kind == "view", F.concat(F.lit("  simulator-"), "service", F.lit("-12 ")))
           .when(kind == "click", F.concat("service", F.lit("-1"))).otherwise(F.col("service")))
    return t.events.select("event_id", S.normalize_service(raw).alias("service"))


@query("resolve_service", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'payload' WHEN 'click' THEN 'app-' || service WHEN 'purchase' THEN 'job1'
  WHEN 'signup' THEN service || '-3' ELSE 'unknown' END AS service FROM v_events""")
def resolve_service(t):
    kind = F.col("event_type")
    line = F.when(kind == "view", F.lit('{"service":"payload"}')).when(kind == "click", F.lit('{"service":""}')).otherwise(F.lit("text"))
    labels = (F.when(kind == "click", F.create_map(F.lit("service"), F.lit(""), F.lit("app"), F.concat(F.lit("app-"), "service")))
              .when(kind == "purchase", F.create_map(F.lit("job"), F.lit("job1"), F.lit("x"), F.lit("")))
              .when(kind == "signup", F.create_map(F.lit("container"), F.concat(F.lit("/a-simulator-"), "service", F.lit("-3")), F.lit("y"), F.lit("")))
              .otherwise(F.create_map(F.lit("container"), F.lit("/proxy"), F.lit("z"), F.lit(""))))
    return t.events.select("event_id", S.resolve_service(line, labels).alias("service"))


@query("log_field_fallback", """
SELECT event_id, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN 'short' ELSE 'long' END AS level,
  CASE WHEN event_type = 'error' THEN 'm' ELSE event_type END AS message FROM v_events""")
def log_field_fallback(t):
    kind = F.col("event_type")
    level = F.when(kind.isin("view", "click"), F.lit("")).otherwise(F.lit("long"))
    lvl = F.when(kind == "click", F.lit("short"))
    line = F.to_json(F.struct(level.alias("level"), lvl.alias("lvl"), F.when(kind == "error", F.lit("m")).alias("message"), kind.alias("msg")))
    return t.events.select("event_id", S.log_field(line, "level", "lvl").alias("level"), S.log_field(line, "message", "msg").alias("message"))


@query("relabel_logs", """
SELECT service, '/x-' || service AS container, CAST(event_id AS VARCHAR) AS container_id, level, message, ts FROM v_logs""")
def relabel_logs(t):
    own = "__meta_docker_container_label_shop_service"
    labels = F.create_map(F.lit(own), F.col("service"), F.lit("__meta_docker_container_label_a_service"), F.lit("other"),
                          F.lit("__meta_docker_container_name"), F.concat(F.lit("/x-"), "service"),
                          F.lit("__meta_docker_container_id"), F.col("event_id").cast("string"))
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "level", "message"))
    raw = t.logs.select(labels.alias("labels"), line.alias("line"), F.lit(None).cast("timestamp").alias("ts"))
    return readers.relabel_logs(raw, own).drop("line")


@query("log_text_level", "SELECT event_id, coalesce(message, line, '') AS text, upper(coalesce(level, 'unknown')) AS level FROM v_logs")
def log_text_level(t):
    return flagged_logs(t).select("event_id", "text", "level")


@query("error_keyword_count", "SELECT event_id, err_kw FROM v_log_flags")
def error_keyword_count(t):
    return flagged_logs(t).select("event_id", "err_kw")


@query("severity_flags", "SELECT event_id, is_error, is_warn FROM v_log_flags")
def severity_flags(t):
    return flagged_logs(t).select("event_id", "is_error", "is_warn")


@query("fill_unknown", "SELECT event_id, coalesce(message, 'unknown') AS message, level FROM v_logs")
def fill_unknown(t):
    return t.logs.select("event_id", "message", "level").na.fill("unknown", ["message", "level"])


@query("coerce_numeric", """
SELECT 'from_props' AS column_name, count(*) FILTER (WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NULL) AS nulls FROM v_events
UNION ALL SELECT 'from_type', count(*) FROM v_events
UNION ALL SELECT 'message', count(*) FILTER (WHERE event_type = 'view') FROM v_events""")
def coerce_numeric(t):
    df = t.events.select(F.expr("try_cast(get_json_object(props, '$.k') AS DOUBLE)").alias("from_props"),
                         F.expr("try_cast(event_type AS DOUBLE)").alias("from_type"),
                         F.when(F.col("event_type") != "view", "m").alias("message"))
    return A.null_census(df, ["from_props", "from_type", "message"])


@query("clean_features", """
SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'error') THEN 0.0 ELSE round(value, 6) END AS a, round(value, 6) AS b FROM v_events""")
def clean_features(t):
    kind = F.col("event_type")
    dirty = F.when(kind == "view", F.lit(INF)).when(kind == "click", F.lit(NAN)).when(kind == "error", F.lit(None)).otherwise(F.col("value"))
    return S.clean_features(t.events.select("event_id", dirty.alias("a"), F.col("value").alias("b")), ["a", "b"])


def metric_features(t, layout="long"):
    return rolling.rolling_stats(rolling.pivot_metrics(t.metrics), windows=WINDOWS, layout=layout)


_FEATS = [c for w in METRIC_FEATURES for c in METRIC_FEATURES[w]]


@query("select_numeric_features", "SELECT " + ", ".join(
    f"count({c}) AS {c}" for c in _FEATS) + " FROM v_metric_features")
def select_numeric_features(t):
    df = metric_features(t)
    return df.agg(*[F.count(c).alias(c) for c in S.numeric_features(df)])


@query("select_tfidf_cols", """
SELECT round(sum(cents / 256), 6) AS tfidf_0, round(sum(cents / 128), 6) AS tfidf_2, round(sum(cents / 64), 6) AS tfidf_10 FROM v_events""")
def select_tfidf_cols(t):
    df = t.events.select((F.col("cents") / 64).alias("tfidf_10"), (F.col("cents") / 128).alias("tfidf_2"),
                         (F.col("cents") / 256).alias("tfidf_0"), F.col("service").alias("tfidf_name"))
    return df.agg(*[F.sum(c).alias(c) for c in S.tfidf_columns(df)])


@query("align_vector", """
SELECT event_id, CASE event_type WHEN 'view' THEN round(cents, 6) WHEN 'click' THEN 0.0 WHEN 'purchase' THEN 3.0 END AS f1,
  CAST(CASE event_type WHEN 'view' THEN 0.0 WHEN 'click' THEN 0.0 WHEN 'purchase' THEN 4.0 END AS DOUBLE) AS f2,
  CAST(CASE event_type WHEN 'view' THEN 10.0 WHEN 'click' THEN 7.0 WHEN 'purchase' THEN 5.0 END AS DOUBLE) AS f3,
  CASE event_type WHEN 'signup' THEN 'bad_feature_length' WHEN 'error' THEN 'feature_names_mismatch' END AS reject FROM v_events""")
def align_vector(t):
    kind = F.col("event_type")
    names = (F.when(kind == "view", F.array(F.lit("f3"), F.lit("f1"))).when(kind == "click", F.array(F.lit("f3")))
             .when(kind == "error", F.array(F.lit("f1"), F.lit("f2"))))
    values = (F.when(kind == "view", F.array(F.lit(10.0), F.col("cents"))).when(kind == "click", F.array(F.lit(7.0)))
              .when(kind == "purchase", F.array(F.lit(3.0), F.lit(4.0), F.lit(5.0))).otherwise(F.array(F.lit(1.0))))
    out = t.events.select("event_id", S.align_vector(names, values, ["f1", "f2", "f3"]).alias("r"))
    return out.select("event_id", *[F.col("r.vector")[i].alias(f"f{i + 1}") for i in range(3)], "r.reject")


@query("label_match", """
SELECT event_id, service, event_type FROM v_events WHERE regexp_full_match(service, 'user|auth') AND event_type = 'click'
UNION ALL SELECT event_id, service, event_type FROM v_events WHERE event_type = 'view' AND service = 'orders'""")
def label_match(t):
    e = t.events.select("event_id", "service", "event_type")
    container = F.concat(F.lit("/x-simulator-"), "service", F.lit("-1"))
    first = e.filter(S.anchored_match(F.col("service"), "user|auth") & (F.col("event_type") == "click"))
    second = e.filter((F.col("event_type") == "view") & S.anchored_match(container, ".*simulator-(orders).*"))
    return first.unionByName(second)


@query("json_stage_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM v_events WHERE json_extract_string(props, '$.k') = '42'")
def json_stage_filter(t):
    k = F.get_json_object("props", "$.k")
    return t.events.filter(k == "42").select("event_id", k.cast("long").alias("k"))


@query("clamp_min", "SELECT event_id, round(cents / greatest(cents - 300, 1e-6), 6) AS ratio FROM v_events")
def clamp_min(t):
    return t.events.select("event_id", (F.col("cents") / S.clamp_min(F.col("cents") - 300, 1e-6)).alias("ratio"))


@query("render_details", """
SELECT event_id, 'value>=0.1' AS metric_text, 'err>=1.0 OR kw>=' || CAST(event_id % 3 AS VARCHAR) AS log_text FROM v_events""")
def render_details(t):
    return t.events.select("event_id", F.lit(S.rule_text("value", 0.10)).alias("metric_text"),
                           F.format_string("err>=%s OR kw>=%d", F.lit("1.0"), F.col("event_id") % 3).alias("log_text"))


