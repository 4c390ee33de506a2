"""The given tables in the roles of the telemetry model.

One minute of telemetry is played by one hour of `events`, so windows of
1/5/15 minutes become 1/5/15 hours. Each view is defined once for Spark and once
as SQL for the check. Values are multiples of 2**-26, so sums are exact in any
order and averages do not fall on a rounding tie.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
WINDOWS = {"1h": HOUR, "5h": 5 * HOUR, "15h": 15 * HOUR}
SERVICES = ["user", "auth", "orders"]
BOUNDS = [10.0, 25.0, 50.0, 100.0, 200.0, 350.0, 500.0, float("inf")]


def pick(names: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


class Tables:
    """Reads the tables of one folder and plays the telemetry roles with them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        return self.raw("events").select(
            "event_id", ts.alias("ts"), "user_id", "event_type", "value", "props",
            F.date_format(ts, "yyyyMMdd").alias("run_id"), pick(SERVICES, F.col("user_id") % 3).alias("service"),
            F.round(F.col("value") * 100).alias("cents"), (F.round(F.col("value") * 100) * 65521 / 67108864).alias("amount"))

    @cached_property
    def metrics(self) -> DataFrame:
        kind = F.col("event_type")
        metric = (F.when(kind == "view", "rps").when(kind == "click", "eps")
                  .when(kind == "purchase", "p95_latency").when(kind == "signup", "error_ratio"))
        value = F.when(kind == "signup", F.col("cents") * 511 / 67108864).otherwise(F.col("amount"))
        return self.events.filter(kind != "error").select(
            "run_id", F.date_trunc("hour", "ts").alias("ts"), "service", metric.alias("metric"), value.alias("value"))

    @cached_property
    def logs(self) -> DataFrame:
        kind = F.col("event_type")
        level = F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").otherwise("INFO")
        message = (F.when(kind == "error", "Connection refused: request failed with TIMEOUT")
                   .when(kind == "signup", "critical quota warning")
                   .when(kind == "purchase", "request_ok order placed").when(kind == "click", "request_ok click"))
        return self.events.select("event_id", "run_id", "ts", "service", level.alias("level"),
                                  message.alias("message"), F.col("props").alias("line"))

    @cached_property
    def faults(self) -> DataFrame:
        minutes = F.lit(20) + F.col("event_id") % 41
        return (self.events.filter((F.col("event_type") == "error") & (F.col("cents") < 250))
                .select("run_id", "service", pick(["latency", "errors", "cpu"], F.col("event_id") % 3).alias("fault_type"),
                        F.col("ts").alias("start_ts"),
                        F.timestamp_micros(F.unix_micros("ts") + minutes * 60_000_000).alias("end_ts"),
                        F.col("event_id").alias("label_seq")))

    @cached_property
    def counters(self) -> DataFrame:
        """A request counter per service that starts again every 500 events."""
        return self.events.select("service", "ts", "run_id", (F.col("event_id") % 500).cast("double").alias("value"))

    @cached_property
    def hist(self) -> DataFrame:
        return self.events.select("run_id", "service", F.date_trunc("hour", "ts").alias("ts"), "value")

    @cached_property
    def spans(self) -> DataFrame:
        li = (self.raw("lineitem").groupBy("l_orderkey", "l_linenumber")
              .agg(F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("duration_ms")))
        sid = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        up = F.lag(sid).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
        return li.select(F.col("l_orderkey").alias("trace_id"), sid.alias("span_id"), up.alias("parent"),
                         F.concat(F.lit("svc"), (F.col("s") % 8).cast("string")).alias("service"), "duration_ms")

    @cached_property
    def docs(self) -> DataFrame:
        return self.raw("documents").select("doc_id", "text", "source", "lang")

    @cached_property
    def scored(self) -> DataFrame:
        return self.events.select("event_id", "run_id", "service", "ts",
                                  (F.col("event_type") == "error").cast("int").alias("y"),
                                  (F.col("cents") / 65536).alias("score"))


VIEWS_SQL: dict[str, str] = {
    "v_events": """
SELECT event_id, ts, user_id, event_type, value, props, strftime(ts, '%Y%m%d') AS run_id,
       (['user', 'auth', 'orders'])[CAST(user_id % 3 AS INT) + 1] AS service, round(value * 100) AS cents,
       round(value * 100) * 65521 / 67108864 AS amount
FROM events""",
    "v_metrics": """
SELECT run_id, date_trunc('hour', ts) AS ts, service,
       CASE event_type WHEN 'view' THEN 'rps' WHEN 'click' THEN 'eps' WHEN 'purchase' THEN 'p95_latency'
                       WHEN 'signup' THEN 'error_ratio' END AS metric,
       CASE WHEN event_type = 'signup' THEN cents * 511 / 67108864 ELSE amount END AS value
FROM v_events WHERE event_type <> 'error'""",
    "v_logs": """
SELECT event_id, run_id, ts, service,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level,
       CASE event_type WHEN 'error' THEN 'Connection refused: request failed with TIMEOUT'
                       WHEN 'signup' THEN 'critical quota warning' WHEN 'purchase' THEN 'request_ok order placed'
                       WHEN 'click' THEN 'request_ok click' END AS message,
       props AS line
FROM v_events""",
    "v_faults": """
SELECT run_id, service, (['latency', 'errors', 'cpu'])[CAST(event_id % 3 AS INT) + 1] AS fault_type, ts AS start_ts,
       ts + to_minutes(CAST(20 + event_id % 41 AS INT)) AS end_ts, event_id AS label_seq
FROM v_events WHERE event_type = 'error' AND cents < 250""",
    "v_counters": "SELECT service, ts, run_id, CAST(event_id % 500 AS DOUBLE) AS value FROM v_events",
    "v_hist": "SELECT run_id, service, date_trunc('hour', ts) AS ts, value FROM v_events",
    "v_spans": """
SELECT l_orderkey AS trace_id, l_orderkey * 10 + l_linenumber AS span_id,
       lag(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS parent,
       'svc' || CAST(s % 8 AS VARCHAR) AS service, duration_ms
FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s, min(l_quantity) AS duration_ms
      FROM lineitem GROUP BY ALL)""",
    "v_docs": "SELECT doc_id, text, source, lang FROM documents",
    "v_scored": """
SELECT event_id, run_id, service, ts, CAST(event_type = 'error' AS INT) AS y, cents / 65536 AS score FROM v_events""",
    "v_pivot": """
SELECT run_id, ts, service, avg(value) FILTER (WHERE metric = 'rps') AS rps, avg(value) FILTER (WHERE metric = 'eps') AS eps,
       avg(value) FILTER (WHERE metric = 'error_ratio') AS error_ratio,
       avg(value) FILTER (WHERE metric = 'p95_latency') AS p95_latency
FROM v_metrics GROUP BY ALL""",
}

METRICS = ["rps", "eps", "error_ratio", "p95_latency"]
_FN = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
HOURS = {"1h": 1, "5h": 5, "15h": 15}


def _rolling_sql() -> str:
    """Rolling statistics of the pivoted metrics, all three window lengths side by side."""
    cols = [f"{fn}({m}) OVER w{w} AS {m}_{s}_{w}" for w in HOURS for m in METRICS for s, fn in _FN.items()]
    wins = [f"w{w} AS (PARTITION BY run_id, service ORDER BY epoch_us(ts) RANGE BETWEEN {h * HOUR - 1} PRECEDING AND CURRENT ROW)"
            for w, h in HOURS.items()]
    return f"SELECT run_id, service, ts, {', '.join(cols)} FROM v_pivot WINDOW {', '.join(wins)}"


def _stack_sql(source: str, names: dict[str, list[str]]) -> str:
    """One SELECT per window length with the other lengths' columns null."""
    parts = []
    for w, h in HOURS.items():
        cols = [c if w == x else f"NULL::DOUBLE AS {c}" for x in HOURS for c in names[x]]
        parts.append(f"SELECT run_id, service, ts - INTERVAL {h} HOUR AS window_start, ts AS window_end, {', '.join(cols)} FROM {source}")
    return " UNION ALL ".join(parts)


METRIC_FEATURES = {w: [f"{m}_{s}_{w}" for m in METRICS for s in _FN] for w in HOURS}
LOG_FEATURES = {w: [f"logs_{m}_{w}" for m in ("count", "error_count", "warn_count", "error_keywords")] for w in HOURS}
KEYWORDS = ["error", "exception", "timeout", "failed", "connection", "unavailable", "refused", "traceback", "critical"]

VIEWS_SQL["v_rolling"] = _rolling_sql()
VIEWS_SQL["v_metric_features"] = _stack_sql("v_rolling", METRIC_FEATURES)
VIEWS_SQL["v_log_flags"] = (
    "SELECT *, coalesce(message, line, '') AS text, CAST(level = 'ERROR' AS INT) AS is_error, CAST(level = 'WARN' AS INT) AS is_warn, "
    + " + ".join(f"CAST(contains(lower(coalesce(message, line, '')), '{k}') AS INT)" for k in KEYWORDS)
    + " AS err_kw FROM v_logs")
_LOG_EXPR = {"count": "count(*)", "error_count": "sum(is_error)", "warn_count": "sum(is_warn)", "error_keywords": "sum(err_kw)"}
VIEWS_SQL["v_log_rolling"] = (
    "SELECT run_id, service, ts, "
    + ", ".join(f"CAST({fn} OVER w{w} AS BIGINT) AS logs_{m}_{w}" for w in HOURS for m, fn in _LOG_EXPR.items())
    + " FROM v_log_flags WINDOW "
    + ", ".join(f"w{w} AS (PARTITION BY run_id, service ORDER BY epoch_us(ts) RANGE BETWEEN {h * HOUR - 1} PRECEDING AND CURRENT ROW)"
                for w, h in HOURS.items()))
VIEWS_SQL["v_log_features"] = _stack_sql("v_log_rolling", LOG_FEATURES).replace("NULL::DOUBLE", "NULL::BIGINT")


def rounded(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)

# log windows of events moved to the start of their hour, so that they end where metric windows end
VIEWS_SQL["v_hour_flags"] = "SELECT * REPLACE (date_trunc('hour', ts) AS ts) FROM v_log_flags"
VIEWS_SQL["v_hour_log_rolling"] = VIEWS_SQL["v_log_rolling"].replace("SELECT run_id", "SELECT DISTINCT run_id", 1).replace("v_log_flags", "v_hour_flags")
VIEWS_SQL["v_hour_log_features"] = _stack_sql("v_hour_log_rolling", LOG_FEATURES).replace("NULL::DOUBLE", "NULL::BIGINT")
