"""Nets of many fits at once against Spark's own, and metrics of many models at once against those of one."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier, MultilayerPerceptronClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from panelwright.ml import evaluation, models, nets
from panelwright.operators import curves


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(i, *(rng.gauss(0, 1) for _ in range(3)), float(rng.randrange(2))) for i in range(1024)]
    df = spark.createDataFrame([(*r, int(r[1] * r[2] > 0) + int(r[3] > 1)) for r in data], "id int, a double, b double, c double, d double, y int").coalesce(1)
    return df.withColumn("features", array_to_vector(F.array("a", "b", "c", "d"))).withColumn("y", F.col("y").cast("double")).cache()


def test_all_fits_take_the_steps_of_spark_s(rows):
    sets = [{"layers": [4, 8, 3], "maxIter": 15, "tol": 1e-6}, {"layers": [4, 6, 5, 3], "maxIter": 40, "tol": 1e-2}, {"layers": [4, 3], "maxIter": 200, "tol": 1e-4}]
    made = [MultilayerPerceptronClassifier(labelCol="y", blockSize=64, seed=42, **s) for s in sets]
    half = rows.where("id < 512")
    found = nets.fit_all([rows.repartition(7), half], [(0, made[0]), (0, made[1]), (1, made[2])], "y")
    for own, estimator, of in zip(found, made, (rows, rows, half)):
        theirs = estimator.fit(of)
        assert isinstance(own, MultilayerPerceptronClassificationModel)
        assert np.allclose(own.weights.toArray(), theirs.weights.toArray(), rtol=1e-6, atol=1e-6)


def test_nets_are_trained_and_searched_without_a_fit_by_spark(rows, monkeypatch):
    stages, fits, real = models.feature_stages(["a", "b"], ["d"]), [], MultilayerPerceptronClassifier._fit
    monkeypatch.setattr(MultilayerPerceptronClassifier, "_fit", lambda self, df: fits.append(self.getMaxIter()) or real(self, df))
    df = rows.drop("features").withColumn("fold_id", F.col("id") % 2)
    model = models.train(df, "mlp", "y", stages, {"hidden": (5,), "maxIter": 20})
    assert models.predict(model, df, "mlp").count() == 1024
    found = models.cross_validate(df, "mlp", "y", stages, n=2, overrides={"hidden": ((4,), (6, 4)), "maxIter": (5,), "solver": ("l-bfgs",)}).collect()
    assert len(found) == 4 and all(0 < r["accuracy"] < 1 for r in found)
    assert set(fits) == {0}


def test_labels_without_outputs_are_an_error(rows):
    with pytest.raises(ValueError):
        nets.fit_all([rows], [(0, MultilayerPerceptronClassifier(labelCol="y", layers=[4, 2]))], "y")


def test_gd_is_left_to_spark():
    assert not nets.can_fit(MultilayerPerceptronClassifier(solver="gd")) and nets.can_fit(MultilayerPerceptronClassifier(solver="l-bfgs", maxIter=3))


def test_areas_and_metrics_by_group(spark):
    rng = random.Random(5)
    data = [(g, rng.choice([None, float("nan")]) if rng.random() < 0.02 else rng.randrange(30) / 7 * (g + 1), int(rng.random() < 0.3), float(rng.randrange(2))) for g in range(3) for _ in range(400)]
    data += [(3, 0.5, 1, 1.0), (4, 0.5, 1, 1.0), (4, 0.5, 0, 1.0), (5, None, 1, 0.0), (5, None, 0, 0.0)]
    df = spark.createDataFrame(data, "g int, s double, y int, p double").repartition(3)
    together = {r["g"]: r for r in curves.areas(df, "y", "s", "g")}
    found = evaluation.classification_metrics_by(df, "g", "y", "p", "s")
    assert set(found) == set(range(6)) and set(together) == set(range(5))
    for g in range(6):
        one = df.where(F.col("g") == g)
        auc, ap = curves.roc_auc(one, "y", "s").first()[0], curves.average_precision(one, "y", "s").first()[0]
        assert (together[g]["auc"] if g in together else None) == pytest.approx(auc) and (together[g]["average_precision"] if g in together else None) == pytest.approx(ap)
        both = len({r["y"] for r in one.collect()}) == 2
        assert found[g]["auROC"] == (pytest.approx(auc) if both else None)
        hits = [r["y"] == r["p"] for r in one.collect()]
        assert found[g]["accuracy"] == pytest.approx(sum(hits) / len(hits))
    parts = evaluation.regression_metrics_by(df, "g", "y", "p")
    assert parts[0] == pytest.approx(evaluation.regression_metrics(df.where("g = 0"), "y", "p"))
