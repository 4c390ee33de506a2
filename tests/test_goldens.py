"""Published results, rebuilt from the fault windows and sampling grid they came from."""

import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from faultline.operators import evaluation, graph, intervals, ordering, rolling
from faultline.plans.detect import SPLIT_ORDER

RUN = "20251215T013009Z"
START = datetime(2025, 12, 15, 1, 30, 9)
# The run's fault windows.
FAULTS = [
    (RUN, "orders", "latency", datetime(2025, 12, 15, 1, 30, 39), datetime(2025, 12, 15, 1, 31, 39), 0),
    (RUN, "auth", "errors", datetime(2025, 12, 15, 1, 32, 9), datetime(2025, 12, 15, 1, 32, 54), 1),
    (RUN, "user", "cpu", datetime(2025, 12, 15, 1, 33, 29), datetime(2025, 12, 15, 1, 33, 49), 2),
]
LABEL = "run_id STRING, service STRING, fault_type STRING, start_ts TIMESTAMP, end_ts TIMESTAMP, label_seq LONG"


def windows(spark):
    rows = [(RUN, s, START + timedelta(seconds=5 * i), 1.0) for s in ("user", "auth", "orders") for i in range(51)]
    samples = spark.createDataFrame(rows, "run_id STRING, service STRING, ts TIMESTAMP, rps DOUBLE")
    return rolling.rolling_stats(samples, ["rps"])


def test_labels_and_split(spark):
    faults = spark.createDataFrame(FAULTS, LABEL)
    w = windows(spark)
    assert w.count() == 459
    assert intervals.label_points(w, faults).filter("y = 0").count() == 436
    assert intervals.label_future(w, faults).filter("y_future = 1").count() == 210
    labelled = intervals.label_windows(w, faults)
    test = ordering.temporal_split(labelled, SPLIT_ORDER, [0.6, 0.2]).filter("split_no = 2")
    assert test.count() == 93
    # rows with equal window_start straddle the cut; their order was arbitrary, so allow for the ties
    assert abs(test.filter("y_true = 1").count() - 44) <= 3


def test_run_window_of_the_export(spark):
    got = intervals.run_time_window(spark.createDataFrame(FAULTS, LABEL)).first()
    assert (got.start_ts, got.end_ts) == (START, datetime(2025, 12, 15, 1, 34, 19))


def test_report(spark):
    rows = [(1, 1)] * 210 + [(0, 1)] * 105 + [(0, 0)] * 144
    r = {x.label: x for x in evaluation.classification_report(spark.createDataFrame(rows, "y INT, y_pred INT")).collect()}
    assert (r["0"].support, r["1"].support, r["accuracy"].support) == (249, 210, 459)
    assert math.isclose(r["1"].precision, 0.6666666666666666) and r["1"].recall == 1.0 and math.isclose(r["1"].f1, 0.8)
    assert [round(r[k].f1, 2) for k in ("0", "accuracy", "macro avg", "weighted avg")] == [0.73, 0.77, 0.77, 0.76]
    assert [round(r[k].precision, 2) for k in ("macro avg", "weighted avg")] == [0.83, 0.85]


def test_ranking_arithmetic(spark):
    published = [("auth", 0.20336796572252128, 0.9999999999974959, 1.2033679657206187),
                 ("user", 0.12185938161316874, 0.9918626364943557, 1.1169769635093822),
                 ("orders", 0.10573580002927829, 0.5122993972165606, 0.8131154383588146)]
    inc = spark.createDataFrame([("i", RUN, s, START, m) for s, m, _, _ in published], "incident_id STRING, run_id STRING, service STRING, ts TIMESTAMP, score DOUBLE")
    cent = spark.createDataFrame([(s, c) for s, _, c, _ in published], "service STRING, centrality DOUBLE")
    out = graph.rank_causes(inc, cent).orderBy("rank").collect()
    assert [r.service for r in out] == ["auth", "user", "orders"]
    assert all(math.isclose(r.score, p[3], abs_tol=1e-9) and math.isclose(r.earliness, 0.9999999999989999) for r, p in zip(out, published))


def test_earliness(spark):
    inc = spark.createDataFrame([("i", "r", "a", START, 1.0), ("i", "r", "b", START + timedelta(seconds=105), 1.0),
                                 ("i", "r", "c", START + timedelta(seconds=140), 1.0)], "incident_id STRING, run_id STRING, service STRING, ts TIMESTAMP, score DOUBLE")
    got = {r.service: r.earliness for r in graph.incident_services(inc).select("service", "earliness").collect()}
    assert math.isclose(got["b"], 0.009433962264141508) and math.isclose(got["c"], 0.007092198581553191)


def test_grid_has_the_published_steps():
    assert [round(x, 2) for x in evaluation.threshold_grid()] == [round(0.05 * i, 2) for i in range(1, 20)]


def test_future_positive_rate(spark):
    y = intervals.label_future(windows(spark), spark.createDataFrame(FAULTS, LABEL)).withColumnRenamed("y_future", "y")
    assert math.isclose(evaluation.class_balance(y).first().positive_rate, 0.45751633986928103)
    assert y.select(F.max("y")).first()[0] == 1
