"""The dyadic interval index: pieces, and joins of mixed lengths against brute force."""

import random
from datetime import timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from faultline.operators import intervals

LABELS = "run_id STRING, service STRING, start_ts TIMESTAMP, end_ts TIMESTAMP, label_seq LONG, fault_type STRING"
WINDOWS = "run_id STRING, service STRING, window_start TIMESTAMP, window_end TIMESTAMP, y_pred INT"


def test_pieces_make_up_the_range_once(spark):
    rng = random.Random(1)
    spans = [(0, 0), (-1, 0), (-8, 7), (5, 5), (-1000, 999), (3, 2**40)] + [(a, a + rng.randrange(300)) for a in (rng.randrange(-400, 400) for _ in range(200))]
    df = spark.createDataFrame(spans, "a LONG, b LONG")
    rows = intervals.dyadic_index(df.distinct(), "a", "b", True).groupBy("a", "b").agg(F.collect_list(F.struct("_level", "_bin")))
    found = rows.collect()
    assert len(found) == len(set(spans))
    for a, b, pieces in found:
        assert max([p[0] for p in pieces].count(level) for level in range(64)) <= 2
        ends = sorted((p[1] << p[0], (p[1] + 1) << p[0]) for p in pieces)
        assert ends[0][0] == a and ends[-1][1] == b + 1
        assert all(x[1] == y[0] for x, y in zip(ends, ends[1:]))


def test_a_fault_open_for_ten_years_is_few_rows(spark, at):
    one = spark.createDataFrame([("r", "s", at(0), at(10 * 366 * 86400), 0, "x")], LABELS)
    bins = one.select(*[intervals.bin_of(intervals.micros(c), 15 * intervals.MINUTE).alias(n) for c, n in (("start_ts", "a"), ("end_ts", "b"))])
    assert 10 < intervals.dyadic_index(bins, "a", "b", True).count() < 100


@pytest.fixture(scope="module")
def mixed(spark):
    """Faults of seconds to years, some on a window's edge, some equal, one inside out; windows of a second to weeks."""
    rng = random.Random(2)
    labels, windows = [], []
    for i in range(120):
        start = rng.randrange(-40, 40) * 3600 + rng.choice([0, 0, 17])
        length = rng.choice([0, 20, 3600, 86400, 30 * 86400, 3650 * 86400])
        labels.append((rng.choice("rq"), rng.choice("st"), T0 + timedelta(seconds=start), T0 + timedelta(seconds=start + length), i, f"f{i}"))
    labels.append(("r", "s", T0, T0 - timedelta(seconds=5), 120, "inside out"))
    for i in range(150):
        start = rng.randrange(-100, 100) * 3600 + rng.choice([0, 0, 7])
        length = rng.choice([0, 1, 60, 900, 3600, 5 * 86400, 40 * 86400])
        windows.append((rng.choice("rq"), rng.choice("stu"), T0 + timedelta(seconds=start), T0 + timedelta(seconds=start + length), i % 2))
    return labels, windows


def test_pairs_of_mixed_lengths(spark, mixed):
    labels, windows = mixed
    right = spark.createDataFrame(labels, LABELS).drop("fault_type")
    left = spark.createDataFrame(windows, WINDOWS).withColumn("w", F.monotonically_increasing_id())
    for bin_us in (intervals.MINUTE, 240 * intervals.MINUTE):
        got = intervals.overlap_pairs(left, right, intervals.RUN_SERVICE, (F.col("window_start"), F.col("window_end")), (F.col("start_ts"), F.col("end_ts")), bin_us)
        rows = [(r.run_id, r.service, r.window_start, r.window_end, r.label_seq) for r in got.collect()]
        want = [(w[0], w[1], w[2], w[3], x[4]) for w in windows for x in labels if w[:2] == x[:2] and x[2] <= x[3] and w[2] <= x[3] and x[2] <= w[3]]
        assert sorted(rows) == sorted(want) and len(want) > 500


def test_points_and_delays_of_mixed_lengths(spark, mixed):
    labels, windows = mixed
    table, faults = spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(labels, LABELS)
    got = intervals.label_points(table, faults)
    want = [(w[0], w[1], w[2], int(any(w[:2] == x[:2] and x[2] <= w[2] <= x[3] for x in labels))) for w in windows]
    assert sorted((r.run_id, r.service, r.window_start, r.y) for r in got.collect()) == sorted(want)
    first = {r.label_seq: r.first_detect_ts for r in intervals.detection_delay(table, faults).collect()}
    for x in labels:
        hits = [w[2] for w in windows if w[4] == 1 and w[:2] == x[:2] and x[2] <= x[3] and w[2] <= x[3] and x[2] <= w[3]]
        assert first[x[4]] == (min(hits) if hits else None)


def test_empty_sides(spark, mixed):
    labels, windows = mixed
    table, faults = spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(labels, LABELS)
    assert intervals.label_windows(table, faults.limit(0)).filter("y_true = 1").count() == 0
    assert intervals.label_windows(table.limit(0), faults).count() == 0
