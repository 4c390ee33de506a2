"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.words import stored


def connected(links: DataFrame) -> DataFrame:
    """node, label (the same for all nodes of a component) of links (a, b); nodes without links do not appear.

    Every node points to its least neighbour, links are moved to those and the equal ones
    dropped, until none is left. Node numbers should be hashes: then the rest shrinks by
    a constant factor each round and the rounds grow with its logarithm. Tables stay
    distributed and are written to the shared folder after each round.
    """
    edges = stored(links.filter(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "steps")
        steps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("label").alias("_a"))
        right = step.select(F.col("node").alias("b"), F.col("label").alias("_b"))
        moved = edges.join(left, "a").join(right, "b").filter(F.col("_a") != F.col("_b"))
        edges = stored(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    labels = steps[-1]
    for step in reversed(steps[:-1]):
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("_label"))
        labels = step.join(later, "label", "left").select("node", F.coalesce("_label", "label").alias("label"))
    return stored(labels, "labels")
