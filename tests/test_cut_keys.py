"""Keys at places of the global order, against sorting."""

import random
from datetime import timedelta

import pytest
from conftest import T0
from pyspark.sql import functions as F

from faultline.operators import ordering

ROWS = "t TIMESTAMP, n LONG, s STRING"


@pytest.fixture(scope="module")
def rows():
    """Ties in each column, nulls, and a time that a third of all rows share."""
    rng = random.Random(9)
    out = []
    for _ in range(4000):
        t = None if rng.random() < 0.02 else T0 + timedelta(microseconds=rng.choice([0, 0, 1, rng.randrange(-10**12, 10**12)]))
        out.append((t, rng.choice([None, -5, 0, 3, rng.randrange(10**6)]), rng.choice(["", "a", "é", "b" * 30, None])))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0, ) if not isinstance(x, str) else (True, x.encode()) for x in r))


@pytest.mark.parametrize("bins,fetched", [(1 << 14, 10_000), (16, 50), (16, 1), (3, 0)])
def test_places_of_the_order(spark, rows, monkeypatch, bins, fetched):
    monkeypatch.setattr(ordering, "BINS", bins)
    monkeypatch.setattr(ordering, "FETCHED_KEYS", fetched)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    want = in_order(rows)
    places = [0, 1, 700, 2000, 2000, 3999, 4000, 10**9]
    got = ordering.keys_at(df, ["t", "n", "s"], places)
    assert [None if r is None else (r.t, r.n, r.s) for r in got] == [want[p] if p < len(want) else None for p in places]


def test_order_that_starts_with_text(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    want = sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or T0))
    got = ordering.keys_at(df, ["s", "t"], [10, 2500])
    assert [(r.s, r.t) for r in got] == [(want[p][2], want[p][0]) for p in (10, 2500)]


def test_split_reads_the_table_a_few_times_and_sorts_nothing(spark, monkeypatch):
    df = spark.range(200_000).select(F.timestamp_micros(F.col("id") * 7_919 % 1_000_003 * 10**6).alias("t"), "id")
    seen = []
    monkeypatch.setattr(ordering, "prefix_sums", lambda *a: seen.append(a))
    out = ordering.temporal_split(df, ["t", "id"], [0.6, 0.2])
    assert not seen
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.split_no: r["count"] for r in out.groupBy("split_no").count().collect()} == {0: 120_000, 1: 40_000, 2: 40_000}
    top = out.groupBy("split_no").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("split_no").collect()
    assert all(x.b <= y.a for x, y in zip(top, top[1:]))


def test_empty_table(spark):
    df = spark.createDataFrame([], ROWS)
    assert ordering.keys_at(df, ["t", "n"], [0]) == [None]
    assert ordering.temporal_split(df, ["t", "n"], [0.5]).count() == 0
