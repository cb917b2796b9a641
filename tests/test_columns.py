"""Trees from the values of columns, without vectors row by row, against the same trees from vectors."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from panelwright.ml import cells, encode, evaluation, models
from panelwright.plans import modelling


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [(i, round(rng.random(), 2), rng.randrange(40) / 4, rng.randrange(2), rng.choice(["a", "b", "b", "c", None]), rng.randrange(90)) for i in range(1200)]
    data = [(*r, int(rng.random() < (0.9 if (r[1] > 0.6) != (r[4] == "b") else 0.2))) for r in data]
    df = spark.createDataFrame([(*r, 3.0 if r[-1] else 1.0) for r in data], "id int, x double, z double, b int, s string, age int, y int, w double")
    return df.withColumn("day", F.date_sub(F.lit("2024-03-31").cast("date"), F.col("age"))).repartition(3).cache()


STAGES = {"continuous": ["x", "z"], "binary": ["b"], "categorical": ["s"]}


@pytest.mark.parametrize("family,make,params", [
    ("gbt", GBTClassifier, {"maxIter": 4, "maxDepth": 4, "subsamplingRate": 0.7, "maxBins": 16, "featureSubsetStrategy": "sqrt"}),
    ("rf", RandomForestClassifier, {"numTrees": 6, "maxDepth": 6, "maxBins": 16}),
])
def test_columns_give_the_cells_and_trees_that_vectors_give(rows, family, make, params):
    stages, df = models.feature_stages(**STAGES), rows.withColumn("y", rows["y"].cast("double"))
    estimator = make(labelCol="y", featuresCol="features", weightCol="w", seed=3, **params)
    prepared, own = cells.fit_columns(df, stages, estimator, family, "y", "w")
    theirs = Pipeline(stages=stages).fit(df)
    by_rows = cells.fit(theirs.transform(df), estimator, family, "y", "w")
    assert own.inputs and by_rows.inputs is None and len(own.trees) == len(by_rows.trees)
    assert own.trees == by_rows.trees and np.array_equal(own.featureImportances.toArray(), by_rows.featureImportances.toArray())
    # others than those of the fit: a value between, one beyond all, a label that is not known
    more = df.unionByName(df.limit(50).withColumns({"x": F.col("x") + 0.005, "z": F.col("z") * 3, "s": F.lit("new"), "id": F.col("id") + 10_000}))
    a, b = (p.transform(more).select("id", "features") for p in (prepared, theirs))
    assert all(np.allclose(x["features"].toArray(), y["features"].toArray(), rtol=1e-12) for x, y in zip(a.orderBy("id").collect(), b.orderBy("id").collect()))
    a, b = (m.transform(theirs.transform(more)).orderBy("id").collect() for m in (own, by_rows))
    assert len(a) == 1250 and all(x["rawPrediction"] == y["rawPrediction"] and x["prediction"] == y["prediction"] and x["probability"] == y["probability"] for x, y in zip(a, b))


def test_rows_that_columns_cannot_tell_are_left_to_vectors(rows):
    stages = models.feature_stages(**STAGES)
    estimator = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=2)
    missing = rows.withColumn("x", F.when(F.col("id") > 5, F.col("x")))
    assert cells.fit_columns(missing, stages, estimator, "rf", "y", "w") is None
    assert cells.columns_of(stages[:-1], "features") is None
    model = models.train(missing, "rf", "y", stages, {"numTrees": 2}, "w")
    assert isinstance(model.stages[-1], cells.CellModel) and model.stages[-1].inputs is None


def test_boosting_does_without_folds_and_a_checkpoint(rows, monkeypatch):
    def refused(*rest):
        raise AssertionError("asked for folds")

    seen = []
    monkeypatch.setattr(modelling, "materialise", refused)
    monkeypatch.setattr(encode, "temporal_folds", refused)
    monkeypatch.setattr(modelling, "_rows", lambda spark, d: rows.select(F.col("id").alias("row_id"), F.col("day").alias("date"), F.col("y").alias("label"), F.lit(1).alias("fold_id"), F.col("x").alias("hours"), F.col("z").alias("rate"), "age", F.col("s").alias("dow")))
    monkeypatch.setattr(modelling.runs, "run_model", lambda df, *rest, **more: seen.append(df) or {"performance": df})
    modelling.QUERIES["train_gbt"](rows.sparkSession, "")
    monkeypatch.undo()
    theirs = encode.temporal_folds(rows, "day", "y", "id")
    wanted = {r["id"]: (r["is_test"], r["days_from_reference"]) for r in theirs.collect()}
    assert {r["row_id"]: (r["is_test"], r["days_from_reference"]) for r in seen[0].collect()} == wanted


def test_metrics_from_counts_of_scores(rows, monkeypatch):
    pred = rows.select((F.col("id") % 2).alias("of"), F.when(F.col("id") > 3, F.col("y")).alias("y"), (F.col("x") > 0.6).cast("double").alias("prediction"), (F.col("x") * 10).cast("int").cast("double").alias("score"))
    pred = pred.unionByName(pred.where("y = 1").withColumn("of", F.lit(2)))  # one class only
    a = evaluation.few_scores_metrics_by(pred, "of", "y", "prediction", "score")
    b = evaluation.classification_metrics_by(pred, "of", "y", "prediction", "score")
    assert set(a) == set(b) == {0, 1, 2} and b[2]["auROC"] is None
    assert all(a[g][k] == b[g][k] if b[g][k] is None else abs(a[g][k] - b[g][k]) < 1e-12 for g in b for k in b[g])
    monkeypatch.setattr(evaluation, "MOST_SCORES", 3)
    assert evaluation.few_scores_metrics_by(pred, "of", "y", "prediction", "score") is None


def test_what_is_left_of_siblings_and_the_leaves_of_cells():
    rng = np.random.default_rng(4)
    bins = rng.integers(0, [[12], [9], [2]], (3, 700)).astype(np.uint8)
    bins[2] = bins[2] * (bins[0] > 3)
    raw, sizes = rng.integers(0, 4, 700), [12, 9, 2]
    y = np.round(rng.normal(size=700) + (bins[0] > 6) * (bins[1] > 3), 3)
    stats = [raw * 1.7, raw * 1.7 * y, raw * 1.7 * y * y]
    own = cells._grow(cells.groups(bins, sizes), sizes, raw, stats, bins, "variance", 6, 3, 2, 0.0, np.random.default_rng(1), True)
    inner = own["feature"] >= 0
    assert inner.sum() > 20
    at = np.zeros(700, np.int64)  # the sums of each node again, from its own cells
    for n in np.flatnonzero(inner):
        assert np.allclose(own["sums"][n], [s[at == n].sum() for s in stats])
        here = at == n
        at[here] = own["left"][n] + (bins[own["feature"][n], here] > own["bin"][n])
    assert np.array_equal(at, own["leaf"])
    assert np.allclose(cells._Ensemble([cells._packed(own, "variance")], [1.0]).sums(bins.T)[:, 0], own["sums"][at, 1] / own["sums"][at, 0])
