"""Linear models of many fits at once against Spark's own, and searches without a fit by Spark."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from panelwright.ml import linear, models, nets


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = [(i, (a := rng.gauss(0, 1)), rng.gauss(2, 3), (d := rng.randrange(3)), int(rng.random() < 1 / (1 + np.exp(1 - a - d))), rng.choice([1.0, 3.0])) for i in range(900)]
    df = spark.createDataFrame(data, "id int, a double, b double, d int, y int, w double").repartition(4)
    return df.withColumn("features", array_to_vector(F.array("a", "b", *[(F.col("d") == k).cast("double") for k in range(3)], F.lit(0.0)))).cache()


@pytest.mark.parametrize("kind,make,sets", [
    ("lr", LogisticRegression, [
        {"regParam": 0.001, "elasticNetParam": 0.75, "maxIter": 10, "tol": 0.01, "fitIntercept": False, "standardization": False},
        {"regParam": 0.05, "elasticNetParam": 0.1, "maxIter": 1000, "tol": 1e-5, "fitIntercept": False},
        {"regParam": 0.02, "elasticNetParam": 0.75, "maxIter": 50, "tol": 0.01, "standardization": False},
        {"regParam": 0.5, "elasticNetParam": 0.0, "maxIter": 10, "tol": 1e-4}, {"regParam": 0.0, "elasticNetParam": 0.5, "maxIter": 60, "tol": 1e-6, "standardization": False},
    ]),
    ("svm", LinearSVC, [
        {"regParam": 0.01, "maxIter": 200, "tol": 0.01, "fitIntercept": False}, {"regParam": 0.01, "maxIter": 200, "tol": 0.001},
        {"regParam": 0.1, "maxIter": 50, "tol": 0.01, "standardization": False}, {"regParam": 0.01, "maxIter": 3, "tol": 0.01, "fitIntercept": False},
    ]),
])
def test_all_fits_take_the_steps_of_spark_s(rows, kind, make, sets):
    made, half = [make(labelCol="y", weightCol="w", **s) for s in sets], rows.where("id % 2 = 0")
    found = linear.fit_all(kind, [rows, half], [(k, e) for k in (0, 1) for e in made], "y", "w")
    for at, (of, estimator) in enumerate((of, e) for of in (rows, half) for e in made):
        theirs = estimator.fit(of)
        assert np.allclose(found[at], [*theirs.coefficients.toArray(), theirs.intercept], rtol=1e-6, atol=1e-7), (kind, at, found[at], theirs.coefficients, theirs.intercept)


@pytest.mark.parametrize("family,make,more", [("lr", LogisticRegression, {}), ("svm", LinearSVC, {"regParam": (0.01, 0.1)})])
def test_a_search_has_the_metrics_of_spark_s_fits(rows, monkeypatch, family, make, more):
    df, stages, real, fits = rows.drop("features").withColumn("fold_id", F.col("id") % 3), models.feature_stages(["a", "b"], categorical=["d"]), make._fit, []
    monkeypatch.setattr(make, "_fit", lambda self, x: fits.append(1) or real(self, x))
    search = {"n": 3, "weight": "w", "overrides": {"maxIter": (20, 40), **more}}
    own = models.cross_validate(df, family, "y", stages, **search).collect()
    assert not fits
    monkeypatch.setattr(models.linear, "can_fit", lambda e: False)
    theirs = models.cross_validate(df, family, "y", stages, **search).collect()
    assert len(fits) == len(own) == len(theirs) == 9
    for a, b in zip(own, theirs):
        for name in a.asDict():
            assert a[name] == (pytest.approx(b[name], abs=1e-6) if isinstance(b[name], float) else b[name]), name


def test_one_class_is_left_to_spark_and_bad_weights_are_an_error(rows):
    assert linear.fit_all("lr", [rows.where("y = 1")], [(0, LogisticRegression(labelCol="y"))], "y", None) == [None]
    with pytest.raises(Exception, match="weights"):
        linear.fit_all("svm", [rows.withColumn("w", F.lit(-1.0))], [(0, LinearSVC(labelCol="y"))], "y", "w")


def test_fits_at_one_place_are_evaluated_once_and_tables_give_the_loss():
    rng = np.random.default_rng(5)
    x, y = np.column_stack([np.eye(3)[rng.integers(0, 3, 500)], rng.choice(rng.normal(size=20), 500), rng.choice([0.5, 2.0], 500)]), rng.integers(0, 3, 500).astype(np.int16)
    for classes, hidden in ((3, (6,)), (2, (6,)), (2, (6, 4)), (2, ()), (3, (6, 4))):
        layers, labels = [5, *hidden, classes], np.minimum(y, classes - 1).astype(np.int16)
        rows, w = nets._Rows([nets._pack(x[i : i + 200], labels[i : i + 200]) for i in range(0, 500, 200)]), rng.normal(size=sum((a + 1) * b for a, b in zip(layers, layers[1:])))
        assert rows.few
        value = rows.loss({0: w}, [layers])[0]
        p = nets.outputs(w, layers, x)
        assert value[0] == pytest.approx(-np.log(p[np.arange(500), labels]).sum())
        for at in range(0, len(w), 5):
            step = np.zeros(len(w))
            step[at] = 1e-5
            assert value[1 + at] == pytest.approx((rows.loss({0: w + step}, [layers])[0][0] - rows.loss({0: w - step}, [layers])[0][0]) / 2e-5, abs=1e-4)
        rows.few, rows.whole = False, None
        assert np.allclose(rows.loss({0: w}, [layers])[0], value)
