"""Future-incident classifier: scaling, balanced weights, logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.scalars import replace_columns
from faultline.operators.evaluation import minmax_normalize
from faultline.operators.scaling import fit_scaler, scaled


@dataclass
class Scaler:
    """Means and population deviations of the model's columns: one number pair per column."""

    columns: list[str]
    mean: list[float]
    deviation: list[float]

    @staticmethod
    def fit(df: DataFrame, columns: list[str]) -> "Scaler":
        row = fit_scaler(df, columns).first()
        return Scaler(columns, [row[f"_mu_{c}"] or 0.0 for c in columns], [row[f"_sd_{c}"] or 0.0 for c in columns])

    def transform(self, df: DataFrame) -> DataFrame:
        return replace_columns(df, self.expressions())

    def expressions(self) -> dict[str, str]:
        return {c: scaled(f"CAST(`{c}` AS DOUBLE)", f"{m!r}D", f"{s!r}D") for c, m, s in zip(self.columns, self.mean, self.deviation)}

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.columns, self.mean, self.deviation)],
                              "columns ARRAY<STRING>, mean ARRAY<DOUBLE>, deviation ARRAY<DOUBLE>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Scaler":
        r = spark.read.parquet(path).first()
        return Scaler(list(r["columns"]), list(r["mean"]), list(r["deviation"]))


@dataclass
class IncidentModel:
    scaler: Scaler
    regression: LogisticRegressionModel
    threshold: float = 0.45

    def scores(self, df: DataFrame) -> DataFrame:
        """Adds `probability`, `decision` (log odds) and `prediction` (0 or 1), all from one pass of the model."""
        names = {c: f"_x_{i}" for i, c in enumerate(self.scaler.columns)}
        texts = self.scaler.expressions()
        rows = df.selectExpr("*", *[f"{texts[c]} AS {v}" for c, v in names.items()])
        rows = VectorAssembler(inputCols=list(names.values()), outputCol="_features").transform(rows)
        out = self.regression.transform(rows).withColumns(
            {"probability": vector_to_array("_prob")[1], "decision": vector_to_array("_raw")[1], "prediction": F.col("_pred")})
        return out.drop("_features", "_raw", "_prob", "_pred", *names.values())

    def transform(self, df: DataFrame, method: str = "probability") -> DataFrame:
        """Adds `probability` and `flag`. Scores that are no probabilities are spread to 0..1 or taken as they are."""
        out = self.scores(df)
        if method == "decision":
            out = minmax_normalize(out.drop("probability"), "decision", "probability")
        elif method == "prediction":
            out = out.withColumn("probability", F.col("prediction"))
        return out.drop("decision", "prediction").withColumn("flag", (F.col("probability") >= self.threshold).cast("int"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.scaler.save(spark, f"{path}/scaler")
        self.regression.write().overwrite().save(f"{path}/regression")
        spark.createDataFrame([(self.threshold,)], "threshold DOUBLE").write.mode("overwrite").parquet(f"{path}/threshold")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IncidentModel":
        return IncidentModel(Scaler.load(spark, f"{path}/scaler"), LogisticRegressionModel.load(f"{path}/regression"),
                             spark.read.parquet(f"{path}/threshold").first()["threshold"])


def fit_incident_model(df: DataFrame, columns: list[str], label: str = "y_future", c: float = 1.0,
                       max_iter: int = 1000, threshold: float = 0.45) -> IncidentModel:
    """Classes weigh n / (2 * n_class); the penalty 1 / (C * sum of weights) equals the usual C."""
    n, pos = df.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    if pos in (0, n):
        raise ValueError("training needs both classes")
    scaler = Scaler.fit(df, columns)
    rows = scaler.transform(df.select(label, *columns))
    weight = F.when(F.col(label) == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos)))
    rows = VectorAssembler(inputCols=columns, outputCol="_features").transform(rows.withColumn("_weight", weight))
    lr = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_weight", regParam=1.0 / (c * n), maxIter=max_iter,
                            standardization=False, tol=1e-6, rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_pred")
    return IncidentModel(scaler, lr.fit(rows.select("_features", label, "_weight")), threshold)
