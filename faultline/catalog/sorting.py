"""Orders, limits, top-k and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.catalog.aggregates import INCIDENTS_SQL, SUMMARY, SUMMARY_SQL, daily_incidents
from faultline.catalog.cleaning import metric_features
from faultline.catalog.ranges import BUILT_SQL, FEATURE_ROWS_SQL, RAISED_SQL, RULES, feature_rows
from faultline.catalog.registry import query
from faultline.catalog.views import HOUR
from faultline.operators import aggregates as A
from faultline.operators import alerts, graph, ordering, range_vectors
from faultline.session import scratch_path
from faultline.sources import sinks

ORDER = ["window_start", "window_end", "run_id", "service"]
_KEY = "run_id, service, window_start, window_end"


@query("temporal_split_3way", f"""
WITH r AS (SELECT {_KEY}, row_number() OVER (ORDER BY window_start, window_end, run_id, service) - 1 AS pos, count(*) OVER () AS n FROM v_metric_features)
SELECT {_KEY}, CASE WHEN pos < floor(n * 0.6::DOUBLE) THEN 0 WHEN pos < floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 1 ELSE 2 END AS split_no FROM r""")
def temporal_split_3way(t):
    rows = metric_features(t).select("run_id", "service", "window_start", "window_end")
    return ordering.temporal_split(rows, ORDER, [0.6, 0.2])


@query("temporal_split_2way", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM v_scored)
SELECT event_id, CASE WHEN pos < floor(n * 0.7::DOUBLE) THEN 0 ELSE 1 END AS split_no FROM r""")
def temporal_split_2way(t):
    return ordering.temporal_split(t.scored, ["ts", "event_id"], [0.7]).select("event_id", "split_no")


@query("sort_alerts", f"""
WITH {FEATURE_ROWS_SQL}, {RAISED_SQL}, {BUILT_SQL}
SELECT run_id, ts, service, signal, row_number() OVER (ORDER BY run_id, ts, service, signal) - 1 AS pos FROM built""")
def sort_alerts(t):
    """The place of each alert in the sorted report."""
    rows = alerts.build_alerts(feature_rows(t), RULES, ordered=False).select("run_id", "ts", "service", "signal")
    return ordering.positions(rows, ["run_id", "ts", "service", "signal"])


@query("ordered_log_limit", "SELECT event_id, ts, service, level FROM v_logs WHERE service IN ('user', 'auth') ORDER BY ts, event_id LIMIT 5000")
def ordered_log_limit(t):
    return (t.logs.filter(F.col("service").isin("user", "auth")).select("event_id", "ts", "service", "level")
            .orderBy("ts", "event_id").limit(5000))


@query("topk_error_messages", """
WITH x AS (SELECT service, line AS message, unnest(generate_series(CAST(ceil(epoch_us(ts) / 3.6e9) AS BIGINT), CAST(ceil(epoch_us(ts) / 3.6e9) AS BIGINT) + 14)) AS k FROM v_logs WHERE level = 'ERROR'),
c AS (SELECT service, message, k, count(*) AS n FROM x GROUP BY ALL)
SELECT make_timestamp(k * 3600000000) AS eval_ts, service, message, n AS count_over_time, CAST(row_number() OVER (PARTITION BY k ORDER BY n DESC, service, message) AS INT) AS rank
FROM c QUALIFY rank <= 10""")
def topk_error_messages(t):
    errors = t.logs.filter("level = 'ERROR'").select("service", F.col("line").alias("message"), "ts")
    counts = range_vectors.over_time(errors, ["service", "message"], 15 * HOUR, HOUR, None)
    best = Window.partitionBy("eval_ts").orderBy(F.desc("count_over_time"), "service", "message")
    return (counts.select("eval_ts", "service", "message", "count_over_time")
            .withColumn("rank", F.row_number().over(best)).filter("rank <= 10"))


@query("topk_by_group", f"""
SELECT run_id, service, metric, count, round(mean, 6) AS mean, round(min, 6) AS min, round(max, 6) AS max,
  CAST(row_number() OVER (PARTITION BY metric ORDER BY mean DESC, run_id, service) AS INT) AS rank FROM ({SUMMARY_SQL}) QUALIFY rank <= 5""")
def topk_by_group(t):
    return A.top_by_metric(A.metric_summary(t.metrics, SUMMARY), 5, ("run_id", "service"))


RANKED_SQL = """
m AS (SELECT incident_id, min(run_id) AS run_id, service, avg(score) AS magnitude, epoch_us(min(ts)) AS first FROM {incidents} GROUP BY incident_id, service),
e AS (SELECT *, 1 / (1 + (first - min(first) OVER (PARTITION BY incident_id)) / 1e6) AS raw FROM m),
c AS (SELECT e.*, coalesce(g.centrality, 0) AS centrality, raw / (max(raw) OVER (PARTITION BY incident_id) + 1e-12) AS earliness FROM e LEFT JOIN {graph} g USING (service)),
f AS (SELECT *, magnitude + 0.6 * centrality + 0.4 * earliness AS score FROM c)
SELECT incident_id, run_id, CAST(row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, service) AS INT) AS rank, service, round(score, 6) AS score,
  round(magnitude, 6) AS magnitude, round(centrality, 6) AS centrality, round(earliness, 6) AS earliness FROM f QUALIFY rank <= {k}"""
CENTRALITY_SQL = "(SELECT service, count(*) / 65536 AS centrality FROM v_events WHERE service <> 'auth' GROUP BY ALL)"


def flat_centrality(t):
    return t.events.filter("service <> 'auth'").groupBy("service").agg((F.count(F.lit(1)) / 65536).alias("centrality"))


@query("rca_topk", "WITH " + RANKED_SQL.format(incidents=INCIDENTS_SQL, graph=CENTRALITY_SQL, k=2))
def rca_topk(t):
    return graph.rank_causes(daily_incidents(t), flat_centrality(t), top_k=2)


@query("rca_one_incident", "WITH " + RANKED_SQL.format(incidents=f"(SELECT * FROM {INCIDENTS_SQL} WHERE incident_id = (SELECT max(incident_id) FROM {INCIDENTS_SQL}))", graph=CENTRALITY_SQL, k=3))
def rca_one_incident(t):
    """The causes of the last incident by name."""
    incidents = daily_incidents(t)
    return graph.rank_causes(graph.one_incident(incidents, incidents.agg(F.max("incident_id")).first()[0]), flat_centrality(t), 3)


@query("write_rca_json", "WITH " + RANKED_SQL.format(incidents=INCIDENTS_SQL, graph=CENTRALITY_SQL, k=3).replace(
    "SELECT incident_id, run_id, CAST(row_number()", f"SELECT incident_id, run_id, (SELECT count(*) FROM {INCIDENTS_SQL} i WHERE i.incident_id = f.incident_id) AS n_alerts, CAST(row_number()"))
def write_rca_json(t):
    """One document per incident, read back with the candidates' places in their lists."""
    incidents = daily_incidents(t)
    path = scratch_path(t.spark, "rca")
    sinks.write_rca_json(graph.rank_causes(incidents, flat_centrality(t), 3), graph.incident_summary(incidents), path)
    fields = "service STRING, score DOUBLE, magnitude DOUBLE, centrality DOUBLE, earliness DOUBLE"
    docs = t.spark.read.schema(f"incident_id STRING, run_id STRING, n_alerts LONG, candidates ARRAY<STRUCT<{fields}>>").json(path)
    rows = docs.select("incident_id", "run_id", "n_alerts", F.posexplode("candidates").alias("pos", "c"))
    return rows.select("incident_id", "run_id", "n_alerts", (F.col("pos") + 1).alias("rank"), "c.*")


@query("recent_incidents", f"""
SELECT incident_id, min(ts) AS first_seen FROM {INCIDENTS_SQL} GROUP BY ALL ORDER BY 2 DESC, 1 DESC LIMIT 20""")
def recent_incidents(t):
    return graph.recent_incidents(daily_incidents(t), 20)


@query("head_preview", "SELECT event_id, service, message FROM v_logs WHERE level = 'ERROR' ORDER BY ts, event_id LIMIT 10")
def head_preview(t):
    return t.logs.filter("level = 'ERROR'").orderBy("ts", "event_id").select("event_id", "service", "message").limit(10)
