"""Streams fed in several files give the batch result; late rows follow the watermark."""

import pytest
from pyspark.sql import functions as F

from faultline.operators import aggregates, intervals
from faultline.session import scratch_path
from faultline.streaming import live

GAUGE = "service STRING, ts TIMESTAMP, value DOUBLE, level STRING"


def feed(spark, parts, schema):
    """One file per part, oldest first."""
    path = scratch_path(spark, "feed")
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(path)
    return live.read_stream(spark, path, files_per_batch=1)


def test_log_counts_and_late_rows(spark, at):
    early = [("s", at(5), 1.0, "ERROR"), ("s", at(15), 1.0, "INFO"), ("s", at(200), 1.0, "WARN")]
    late = [("s", at(6), 1.0, "ERROR"), ("s", at(400), 1.0, "INFO")]
    parts = [early, [("s", at(210), 1.0, "INFO")], late]
    got = live.run_append(live.log_counts(feed(spark, parts, GAUGE), "1 minute", "1 minute", "30 seconds"), "t")
    rows = {r.window_start: (r.errors, r.warnings, r.total) for r in got.collect()}
    assert rows == {at(0): (1, 0, 2), at(180): (0, 1, 2)}  # the row at 6 s came after its window had closed


def test_latest_gauge_ignores_older_rows(spark, at):
    stream = feed(spark, [[("s", at(50), 5.0, "x")], [("s", at(10), 1.0, "x"), ("t", at(1), 2.0, "x")]], GAUGE)
    got = live.run_update(live.latest_gauges(stream, ["value"]), "t", ["service"])
    assert sorted(map(tuple, got.select("service", "value", "ts").collect())) == [("s", 5.0, at(50)), ("t", 2.0, at(1))]


def test_counters_add_up_over_batches(spark, at):
    parts = [[("s", at(i), float(i), "x") for i in range(4)], [("s", at(9), 1.0, "x")]]
    got = live.run_update(live.request_counters(feed(spark, parts, GAUGE), ["service"], "value", [1.0, float("inf")]), "t", ["service"])
    assert got.first().asDict() == {"service": "s", "requests": 5, "le_1": 3, "le_inf": 5}


@pytest.mark.parametrize("cut", [2, 5])
def test_alert_streak_spans_batches(spark, at, cut):
    cond = [1, 1, 1, 1, 0, 1, 1, 1, 1]
    ticks = [("s", at(10 * i), 100.0 * c, 0.0) for i, c in enumerate(cond)]
    stream = feed(spark, [ticks[:cut], ticks[cut:]], "service STRING, eval_ts TIMESTAMP, hi DOUBLE, mid DOUBLE")
    got = live.run_append(live.alert_states(stream, {"hot": (F.col("hi") > 50, 3)}), "t")
    states = [r.state for r in got.orderBy("eval_ts").collect()]
    assert states == ["pending"] * 3 + ["firing", "inactive"] + ["pending"] * 3 + ["firing"]


def test_fault_intervals_out_of_order(spark, at):
    schema = "run_id STRING, service STRING, ts TIMESTAMP, message STRING"
    data = [("r", "s", at(0), "fault_start"), ("r", "s", at(30), "fault_end"), ("r", "s", at(20), "fault_start"),
            ("r", "s", at(90), "fault_start"), ("r", "s", at(95), "fault_cleared")]
    tail = [("r", "s", at(900), "fault_start"), ("r", "s", at(2000), "fault_start")]
    got = live.run_append(live.fault_intervals(feed(spark, [data[:2], data[2:], tail], schema)), "t")
    batch = intervals.intervals_from_events(spark.createDataFrame(data + tail, schema), ["run_id", "service"]).filter("end_ts IS NOT NULL")
    key = lambda df: sorted(map(tuple, df.select("start_ts", "end_ts").collect()))
    assert key(got) == key(batch) == [(at(0), at(30)), (at(20), at(30)), (at(90), at(95))]


def test_batch_and_stream_counters_agree(spark):
    folder = "/root/testdata/sf0.001"
    batch = aggregates.request_counters(spark.read.parquet(f"{folder}/events.parquet"), ["event_type"])
    stream = live.request_counters(live.read_stream(spark, folder, "events"), ["event_type"], "value", [10.0])
    got = live.run_update(stream, "t", ["event_type"]).select("event_type", "requests")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_models_score_streams_like_tables(spark):
    from faultline.operators.regression import fit_incident_model
    from faultline.plans import detect
    data = spark.range(400).selectExpr("id", "cast(hash(id) % 1000 as double) a", "cast(hash(id + 7) % 1000 as double) b",
                                       "cast(hash(id) % 1000 > 300 as int) y_future")
    path = scratch_path(spark, "feed")
    data.repartition(3, "id").write.parquet(path)
    table = spark.read.parquet(path)
    scaler, forest = detect.fit_detector(table, ["a", "b"], ["id"], trees=20)
    detector, predictor = detect.Detector(scaler, forest, 0, 0, 0.05), fit_incident_model(table, ["a", "b"])
    for model, col in ((detector, "anomaly_score"), (predictor, "probability")):
        got = live.run_append(model.transform(live.read_stream(spark, path, files_per_batch=1)).select("id", col), "t")
        assert got.count() == 400 and got.exceptAll(model.transform(table).select("id", col)).count() == 0
