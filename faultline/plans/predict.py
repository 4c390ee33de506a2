"""Future-incident predictor: training and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.operators import evaluation, intervals, ordering
from faultline.operators.intervals import MINUTE
from faultline.operators.regression import IncidentModel, fit_incident_model
from faultline.plans.detect import SPLIT_ORDER
from faultline.session import cut_lineage


def labelled_rows(features: DataFrame, labels: DataFrame, horizon_us: int = 5 * MINUTE, bin_us: int = 15 * MINUTE) -> DataFrame:
    """Clean features with y_future and split_no (0 = the first 70 percent of time)."""
    columns = S.numeric_features(features)
    rows = S.clean_features(intervals.label_future(features, labels, horizon_us, bin_us), columns)
    return ordering.temporal_split(cut_lineage(rows), SPLIT_ORDER, [0.7])


def with_probabilities(features: DataFrame, model: IncidentModel, name: str = "pred_prob") -> DataFrame:
    """Feature rows with the model's probability, as the prediction rule of the alerts reads it."""
    columns = [c for c in model.scaler.columns if c in features.columns]
    return model.scores(S.clean_features(features, columns)).withColumnRenamed("probability", name).drop("decision", "prediction")


def train_predictor(features: DataFrame, labels: DataFrame, horizon_us: int = 5 * MINUTE, bin_us: int = 15 * MINUTE,
                    threshold: float = 0.45) -> tuple[IncidentModel, DataFrame]:
    """The model and its report on the last 30 percent of time, at the usual cut of one half."""
    rows = labelled_rows(features, labels, horizon_us, bin_us)
    model = fit_incident_model(rows.filter("split_no = 0"), S.numeric_features(features), threshold=threshold)
    test = model.transform(rows.filter("split_no = 1")).withColumn("y_pred", (F.col("probability") > 0.5).cast("int"))
    return model, evaluation.classification_report(test, "y_future", "y_pred")


def evaluate_predictor(features: DataFrame, labels: DataFrame, model: IncidentModel, horizon_us: int = 5 * MINUTE,
                       bin_us: int = 15 * MINUTE, split: str = "test") -> dict[str, DataFrame]:
    """Threshold grid, metrics and report at its best F1. `split="all"` includes the training rows."""
    rows = labelled_rows(features, labels, horizon_us, bin_us)
    if split == "test":
        rows = rows.filter("split_no = 1")
    scored = cut_lineage(model.transform(rows).select(*SPLIT_ORDER, F.col("y_future").alias("y"), F.col("probability").alias("score")))
    grid = evaluation.tune_threshold(scored)
    best = evaluation.best_threshold(grid).first()["threshold"]
    flagged = scored.withColumn("y_pred", (F.col("score") >= best).cast("int"))
    metrics = evaluation.score_metrics(flagged, "predictor", "y", "y_pred", "score").withColumn("threshold", F.lit(best))
    return {"grid": grid, "metrics": metrics, "report": evaluation.classification_report(flagged), "scored": flagged}
