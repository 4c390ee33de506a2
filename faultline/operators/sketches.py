"""Approximate quantiles from sketches that are kept by group and time and merged when asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 800  # items a sketch keeps about three times of, however many values it has seen


def rank_error(size: int = SIZE) -> float:
    """Share of the values by which a quantile's rank may be off, in 99 of 100 cases (the published fit for these sketches)."""
    return 2.296 / size ** 0.9021


def quantile_sketches(df: DataFrame, groups: list[str], value: str, at: str, bucket: str = "1 day", size: int = SIZE) -> DataFrame:
    """One sketch per group and time bucket: groups, bucket, n, sketch. Nulls and NaN are left out.

    Each task sums up its own rows, so sketches are exchanged, not values; a
    table of sketches takes later buckets by appending.
    """
    number = F.col(value).cast("double")
    rows = df.filter(number.isNotNull() & ~F.isnan(number))
    return rows.groupBy(*groups, F.window(at, bucket)["start"].alias("bucket")).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(number, F.lit(size)).alias("sketch"))


def merge_sketches(sketches: DataFrame, groups: list[str], size: int = SIZE) -> DataFrame:
    """One sketch per group over whatever buckets are given: groups, n, sketch."""
    return sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, points: dict[str, float]) -> DataFrame:
    """Adds a column for each named share: a value whose rank is about that share of all values."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for name, q in points.items()})


def rank_gaps(df: DataFrame, quantiles: DataFrame, groups: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """How far each quantile's place is from its share, as a share of the group's values: groups, n and a column per point.

    Equal values take up a stretch of ranks; a share inside it has no gap.
    """
    number = F.col(value).cast("double")
    rows = df.filter(number.isNotNull() & ~F.isnan(number)).join(quantiles.select(*groups, *points), groups)
    counts = rows.groupBy(*groups).agg(F.count("*").alias("n"), *[x for p in points for x in (
        F.count_if(number < F.col(p)).alias(f"_below_{p}"), F.count_if(number <= F.col(p)).alias(f"_upto_{p}"))])
    gap = lambda p, q: F.greatest(F.col(f"_below_{p}") / F.col("n") - q, q - F.col(f"_upto_{p}") / F.col("n"), F.lit(0.0))
    return counts.select(*groups, "n", *[gap(p, q).alias(p) for p, q in points.items()])
