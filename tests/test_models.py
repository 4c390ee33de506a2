"""Model invariants: planted outliers, base rates, and models that survive a round trip."""

import math

import numpy as np
import pytest

from faultline.operators import evaluation
from faultline.operators.forest import IsolationForest, average_path, fit_isolation_forest, subsamples
from faultline.operators.regression import IncidentModel, fit_incident_model


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=3)), 0) for i in range(600)]
    rows += [(1000 + i, *map(float, rng.normal(size=3) + 9), 1) for i in range(6)]
    return spark.createDataFrame(rows, "id INT, a DOUBLE, b DOUBLE, c DOUBLE, y INT").cache()


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1
    assert math.isclose(average_path(256), 2 * (math.log(255) + np.euler_gamma) - 2 * 255 / 256)


def test_forest(spark, cloud, tmp_path):
    model = fit_isolation_forest(cloud, ["a", "b", "c"], ["id"], trees=50)
    assert model.nodes["tree"].nunique() == 50 and model.sample == 256
    scored = model.transform(cloud).cache()
    top = [r.id for r in scored.orderBy("anomaly_score", ascending=False).limit(6).collect()]
    assert all(i >= 1000 for i in top)
    raw = [r.s for r in cloud.select(model.score_samples(spark).alias("s")).collect()]
    assert all(-1 <= s < 0 for s in raw)
    assert abs(scored.filter("anomaly_flag = 1").count() / 606 - 0.05) < 0.01
    again = fit_isolation_forest(cloud.repartition(7), ["a", "b", "c"], ["id"], trees=50)
    assert again.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(model.nodes.sort_values(["tree", "node"]).reset_index(drop=True))
    model.save(spark, str(tmp_path / "m"))
    loaded = IsolationForest.load(spark, str(tmp_path / "m")).transform(cloud)
    assert loaded.select("id", "anomaly_score").exceptAll(scored.select("id", "anomaly_score")).count() == 0


def test_subsamples_are_whole_and_distinct(spark):
    df = spark.range(20000).selectExpr("id", "cast(id as double) as a")
    for trees, sample in ((5, 100), (300, 256)):
        got = subsamples(df, ["a"], ["id"], trees, sample, 20000, 3).groupBy("tree").agg({"x": "count"}).collect()
        assert len(got) == trees and all(r[1] == sample for r in got)


def test_regression(spark, cloud, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(float(x), float(z), int(x + 0.3 * rng.normal() > 1)) for x, z in rng.normal(size=(800, 2))]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, y_future INT")
    model = fit_incident_model(df, ["a", "b"])
    out = model.transform(df)
    assert evaluation.roc_auc(out, "y_future", "probability").first()[0] > 0.95
    assert model.regression.coefficients[0] > 5 * abs(model.regression.coefficients[1])
    model.save(spark, str(tmp_path / "p"))
    same = IncidentModel.load(spark, str(tmp_path / "p")).transform(df)
    assert same.select("a", "probability").exceptAll(out.select("a", "probability")).count() == 0
    spread = model.transform(df, "decision").agg({"probability": "max"}).first()[0]
    assert 0.999 < spread <= 1
    assert {r[0] for r in model.transform(df, "prediction").select("probability").distinct().collect()} == {0.0, 1.0}
    with pytest.raises(ValueError):
        fit_incident_model(df.filter("y_future = 0"), ["a", "b"])


def test_regression_minimises_the_documented_loss(spark):
    """Gradient of 1/2 |w|^2 + sum of weighted losses is zero at the fit."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=120) > 0.8).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(t)) for (a, b), t in zip(x, y)], "a DOUBLE, b DOUBLE, y_future INT")
    m = fit_incident_model(df, ["a", "b"]).regression
    z = (x - x.mean(0)) / x.std(0)
    w, b = np.array(m.coefficients), m.intercept
    weight = np.where(y == 1, 60 / y.sum(), 60 / (120 - y.sum()))
    resid = weight * (1 / (1 + np.exp(-(z @ w + b))) - y)
    assert np.abs(w + z.T @ resid).max() < 1e-2 and abs(resid.sum()) < 1e-2
