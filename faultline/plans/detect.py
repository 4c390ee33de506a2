"""Anomaly detector: training and evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.operators import evaluation, intervals, ordering, rolling
from faultline.operators.forest import IsolationForest, fit_isolation_forest
from faultline.operators.intervals import MINUTE, WINDOW_KEY
from faultline.operators.regression import Scaler
from faultline.session import cut_lineage

SPLIT_ORDER = ["window_start", "window_end", "run_id", "service"]


@dataclass
class Detector:
    scaler: Scaler
    forest: IsolationForest
    n_normal: int
    n_total: int
    contamination: float

    def transform(self, df: DataFrame, flag_at: float = 0.0, strict: bool = True) -> DataFrame:
        names = {c: f"_x_{i}" for i, c in enumerate(self.scaler.columns)}
        rows = df.selectExpr("*", *[f"{S.finite_or_zero_sql(c)} AS {v}" for c, v in names.items()])
        inner = Scaler(list(names.values()), self.scaler.mean, self.scaler.deviation).transform(rows)
        forest = IsolationForest(list(names.values()), self.forest.sample, self.forest.offset, self.forest.nodes)
        return forest.transform(inner, flag_at, strict).drop(*names.values())

    def save(self, spark: SparkSession, path: str) -> None:
        self.scaler.save(spark, f"{path}/scaler")
        self.forest.save(spark, f"{path}/forest")
        self.summary(spark).write.mode("overwrite").parquet(f"{path}/summary")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Detector":
        s = spark.read.parquet(f"{path}/summary").first()
        return Detector(Scaler.load(spark, f"{path}/scaler"), IsolationForest.load(spark, f"{path}/forest"),
                        s["n_train_normal"], s["n_total"], s["contamination"])

    def summary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.n_normal, self.n_total, self.contamination, len(self.scaler.columns), ",".join(self.scaler.columns))],
            "n_train_normal LONG, n_total LONG, contamination DOUBLE, n_features INT, feature_columns STRING")


def fit_detector(normal: DataFrame, columns: list[str], keys: list[str], contamination: float = 0.05,
                 trees: int = 200, seed: int = 42) -> tuple[Scaler, IsolationForest]:
    scaler = Scaler.fit(normal, columns)
    return scaler, fit_isolation_forest(scaler.transform(normal), columns, keys, trees, contamination=contamination, seed=seed)


def training_counts(features: DataFrame, labels: DataFrame, bin_us: int) -> DataFrame:
    """How many rows the detector would train on."""
    labelled = intervals.label_points(features.select(*WINDOW_KEY), labels, "window_start", bin_us)
    return labelled.agg(F.count_if(F.col("y") == 0).alias("n_train_normal"), F.count(F.lit(1)).alias("n_total"))


def train_detector(features: DataFrame, labels: DataFrame, contamination: float = 0.05, trees: int = 200, seed: int = 42,
                   bin_us: int = 15 * MINUTE, least_normal: int = 50) -> Detector:
    """Fit on the rows whose start lies in no fault."""
    columns = S.numeric_features(features)
    rows = S.clean_features(intervals.label_points(features, labels, "window_start", bin_us), columns)
    rows = cut_lineage(rows)
    n_total, n_normal = rows.agg(F.count(F.lit(1)), F.count_if(F.col("y") == 0)).first()
    if n_normal < least_normal:
        raise ValueError(f"only {n_normal} normal rows; {least_normal} needed")
    scaler, forest = fit_detector(rows.filter("y = 0"), columns, WINDOW_KEY, contamination, trees, seed)
    return Detector(scaler, forest, n_normal, n_total, contamination)


def evaluate_detector(features: DataFrame, labels: DataFrame, baseline_col: str = "error_ratio_mean_1min", baseline_thr: float = 0.10,
                      zscore_window: int = 12, zscore_thr: float = 3.0, if_score_thr: float = 0.10, contamination: float = 0.05,
                      trees: int = 200, bin_us: int = 15 * MINUTE, detector: Detector | None = None, least_normal: int = 10) -> dict[str, DataFrame]:
    """Model comparison on the last fifth, detection delays on everything, and a one-row summary.

    Without a detector one is fitted on the normal rows of the first three fifths, or on all of
    them if fewer than `least_normal` are normal; the summary's `trained_on` says which.
    """
    columns = S.numeric_features(features)
    labelled = S.clean_features(intervals.label_windows(features, labels, bin_us), columns)
    rows = ordering.temporal_split(cut_lineage(labelled), SPLIT_ORDER, [0.6, 0.2])
    test = rows.filter("split_no = 2")

    parts = []
    if baseline_col in columns:
        flat = test.select("y_true", (F.col(baseline_col) >= baseline_thr).cast("int").alias("y_pred"), F.col(baseline_col).alias("score"))
        parts.append(evaluation.score_metrics(flat, "baseline_threshold", "y_true", "y_pred", "score"))
        z = rolling.rolling_zscore(test.select(*SPLIT_ORDER, "y_true", baseline_col), baseline_col, SPLIT_ORDER, zscore_window, zscore_thr)
        parts.append(evaluation.score_metrics(cut_lineage(z), "baseline_zscore", "y_true", "y_pred", "z_score"))

    trained_on = "given"
    if detector is None:
        train = rows.filter("split_no = 0")
        normal, trained_on = train.filter("y_true = 0"), "normal"
        if normal.count() < least_normal:
            normal, trained_on = train, "all"
        scaler, forest = fit_detector(normal, columns, WINDOW_KEY, contamination, trees)
        detector = Detector(scaler, forest, 0, 0, contamination)
    scored = cut_lineage(detector.transform(rows, if_score_thr, strict=False)
                         .select(*WINDOW_KEY, "y_true", "split_no", "anomaly_score", F.col("anomaly_flag").alias("y_pred")))
    parts.append(evaluation.score_metrics(scored.filter("split_no = 2"), "isolation_forest", "y_true", "y_pred", "anomaly_score"))
    metrics = parts[0]
    for p in parts[1:]:
        metrics = metrics.unionByName(p)
    delays = intervals.detection_delay(scored, labels, bin_us=bin_us)
    counts = rows.agg(F.count(F.lit(1)).alias("n_windows_total"), F.count_if(F.col("split_no") == 2).alias("n_test_windows"),
                      F.avg(F.when(F.col("split_no") == 2, F.col("y_true").cast("double"))).alias("positive_rate_test"))
    stats = evaluation.mttd_stats(delays).select(F.struct("*").alias("s")).scalar()
    summary = counts.select("*", stats["mttd_mean_seconds"].alias("mttd_mean_seconds"), stats["mttd_median_seconds"].alias("mttd_median_seconds"), F.lit(trained_on).alias("trained_on"))
    return {"metrics": metrics, "mttd": delays, "summary": summary, "scored": scored}
