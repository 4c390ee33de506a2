"""Isolation forest: subsamples and scoring are Spark jobs, one small tree is one task's numpy work.

Samples and splits follow from a hash of (seed, tree, row key), so a lost task
repeats exactly. The model has at most trees * (2 * sample - 1) nodes whatever
the table's size, which bounds what is collected and broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.operators.ordering import exact_quantiles

NODE_SCHEMA = "tree INT, node INT, feature INT, threshold DOUBLE, left INT, right INT, path DOUBLE"


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(x: np.ndarray, tree: int, seed: int) -> pd.DataFrame:
    """Random splits of one sample down to single rows or the depth limit."""
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, "left")]
    while todo:
        rows, depth, parent, side = todo.pop()
        node = len(nodes)
        if parent >= 0:
            nodes[parent][4 if side == "left" else 5] = node
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        varied = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(varied):
            nodes.append([tree, node, -1, 0.0, -1, -1, depth + average_path(len(rows))])
            continue
        f = int(rng.choice(varied))
        cut = float(rng.uniform(lo[f], hi[f]))
        goes_left = x[rows, f] <= cut
        if goes_left.all():
            cut = float(np.nextafter(hi[f], lo[f]))
            goes_left = x[rows, f] <= cut
        nodes.append([tree, node, f, cut, -1, -1, 0.0])
        todo.append((rows[~goes_left], depth + 1, node, "right"))
        todo.append((rows[goes_left], depth + 1, node, "left"))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])


def subsamples(df: DataFrame, columns: list[str], keys: list[str], trees: int, sample: int, n: int, seed: int) -> DataFrame:
    """(tree, h, x): `sample` distinct rows per tree, by lowest hash among slightly more candidates."""
    rows = df.select(*keys, F.expr("array(" + ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in columns) + ") AS x"))
    scale = float(1 << 53)

    def uniform(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)) / scale

    share = min(1.0, (sample + 6 * math.sqrt(sample) + 10) / n)
    cols = [F.col(k) for k in keys]
    if trees * share <= 1:
        drawn = rows.withColumn("_u", uniform(*cols)).filter(F.col("_u") < trees * share)
        drawn = drawn.withColumn("tree", F.least(F.floor(F.col("_u") / share), F.lit(trees - 1)).cast("int"))
        drawn = drawn.withColumn("h", uniform(F.lit(1), *cols))
    else:
        drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        drawn = drawn.withColumn("h", uniform(F.col("tree"), *cols)).filter(F.col("h") < share)
    lowest = Window.partitionBy("tree").orderBy("h", *keys)
    return drawn.withColumn("_r", F.row_number().over(lowest)).filter(F.col("_r") <= sample).select("tree", "_r", "x")


@dataclass
class IsolationForest:
    """A fitted forest: node arrays (trees x nodes), sample size, score offset, column order."""

    columns: list[str]
    sample: int
    offset: float
    nodes: pd.DataFrame

    def arrays(self) -> dict[str, np.ndarray]:
        trees, width = int(self.nodes["tree"].max()) + 1, int(self.nodes["node"].max()) + 1
        at = (self.nodes["tree"].to_numpy(), self.nodes["node"].to_numpy())
        out = {}
        for name, kind in (("feature", np.int32), ("threshold", float), ("left", np.int32), ("right", np.int32), ("path", float)):
            a = np.zeros((trees, width), dtype=kind)
            a[at] = self.nodes[name].to_numpy()
            out[name] = a
        return out

    def score_samples(self, spark: SparkSession) -> Column:
        """-2 ** (-mean path / expected path): near -1 for outliers."""
        shared = spark.sparkContext.broadcast(self.arrays())
        steps = math.ceil(math.log2(max(self.sample, 2))) + 1
        norm = average_path(self.sample) or 1.0

        @F.pandas_udf("double")
        def score(block: pd.DataFrame) -> pd.Series:
            m = shared.value
            x = block.to_numpy(dtype=float)
            rows, trees = np.arange(len(x))[:, None], np.arange(m["feature"].shape[0])[None, :]
            out = []
            for part in np.array_split(np.arange(len(x)), max(1, len(x) // 2000)):
                at = np.zeros((len(part), trees.shape[1]), dtype=np.int32)
                for _ in range(steps):
                    f = m["feature"][trees, at]
                    leaf = f < 0
                    left = x[part][rows[:len(part)], np.where(leaf, 0, f)] <= m["threshold"][trees, at]
                    at = np.where(leaf, at, np.where(left, m["left"][trees, at], m["right"][trees, at]))
                out.append(-np.exp2(-m["path"][trees, at].mean(axis=1) / norm))
            return pd.Series(np.concatenate(out) if out else [], dtype=float)

        return score(F.expr("struct(" + ", ".join(f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in self.columns) + ")"))

    def transform(self, df: DataFrame, flag_at: float = 0.0, strict: bool = True) -> DataFrame:
        """anomaly_score = offset - score; flagged above the cut (`strict`) or from it on."""
        scored = df.withColumn("anomaly_score", F.lit(self.offset) - self.score_samples(df.sparkSession))
        s = F.col("anomaly_score")
        return scored.withColumn("anomaly_flag", ((s > flag_at) if strict else (s >= flag_at)).cast("int"))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(self.columns, self.sample, self.offset)], "columns ARRAY<STRING>, sample INT, offset DOUBLE") \
            .write.mode("overwrite").parquet(f"{path}/params")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForest":
        p = spark.read.parquet(f"{path}/params").first()
        return IsolationForest(list(p["columns"]), p["sample"], p["offset"], spark.read.parquet(f"{path}/trees").toPandas())


def fit_isolation_forest(df: DataFrame, columns: list[str], keys: list[str], trees: int = 200, max_samples: int = 256,
                         contamination: float = 0.05, seed: int = 42) -> IsolationForest:
    """`keys` identify a row. The offset is the contamination quantile of the training scores."""
    n = df.count()
    if not n:
        raise ValueError("no training rows")
    sample = min(max_samples, n)
    drawn = subsamples(df, columns, keys, trees, sample, n, seed)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("_r")
        return grow_tree(np.stack(ordered["x"].to_numpy()), int(key[0]), seed)

    nodes = drawn.groupBy("tree").applyInPandas(build, NODE_SCHEMA).toPandas()
    model = IsolationForest(columns, sample, 0.0, nodes)
    scores = df.select(model.score_samples(df.sparkSession).alias("s"))
    model.offset = exact_quantiles(scores, [], "s", {"q": contamination}).first()["q"]
    return model
