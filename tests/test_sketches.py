"""Quantile sketches: rank errors against the values, merging, and values that are left out."""

import random

from pyspark.sql import functions as F

from faultline.operators import sketches

POINTS = {"low": 0.01, "half": 0.5, "high": 0.99}
ROWS = "g STRING, ts TIMESTAMP, v DOUBLE"


def test_merged_sketches_stay_within_the_bound(spark, at):
    rng = random.Random(1)
    draw = {"even": lambda i: float(i), "skewed": lambda i: rng.paretovariate(0.6), "tied": lambda i: float(i % 7), "few": lambda i: float(i)}
    rows = [(g, at(86400 * (i % 9)), f(i)) for g, f in draw.items() for i in range(60_000 if g != "few" else 5)]
    df = spark.createDataFrame(rows, ROWS).repartition(6)
    daily = sketches.quantile_sketches(df, ["g"], "v", "ts")
    assert daily.count() == 3 * 9 + 5
    found = sketches.sketch_quantiles(sketches.merge_sketches(daily, ["g"]), POINTS)
    assert {r.g: r.n for r in found.collect()} == {"even": 60_000, "skewed": 60_000, "tied": 60_000, "few": 5}
    gaps = sketches.rank_gaps(df, found, ["g"], "v", POINTS).collect()
    assert all(r[p] <= 2 * sketches.rank_error() for r in gaps for p in POINTS)
    few = next(r for r in found.collect() if r.g == "few")
    assert (few.low, few.half, few.high) == (0.0, 2.0, 4.0)
    assert found.select(F.max(F.octet_length("sketch"))).first()[0] < 40_000


def test_nulls_and_nan_are_left_out(spark, at):
    df = spark.createDataFrame([("a", at(0), None), ("a", at(1), float("nan")), ("a", at(2), 3.0), ("b", at(3), None)], ROWS)
    found = sketches.sketch_quantiles(sketches.merge_sketches(sketches.quantile_sketches(df, ["g"], "v", "ts"), ["g"]), {"half": 0.5})
    assert [tuple(r) for r in found.select("g", "n", "half").collect()] == [("a", 1, 3.0)]
