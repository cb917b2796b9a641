"""Trees over cells against Spark's own trees over rows."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

from panelwright.ml import cells, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(i, x := rng.random(), z := rng.randrange(40) / 4, b := rng.randrange(2), int(rng.random() < (0.9 if (x > 0.6) != (z > 5) and b else 0.2))) for i in range(1500)]
    return spark.createDataFrame([(*r, 3.0 if r[-1] else 1.0) for r in data], "id int, x double, z double, b int, y int, w double").repartition(3).cache()


def _scores(model, rows, family):
    return {r["id"]: (r["score"], r["prediction"]) for r in models.predict(model, rows, family).select("id", "score", "prediction").collect()}


@pytest.mark.parametrize("family,make,params", [
    ("gbt", GBTClassifier, {"maxIter": 5, "maxDepth": 4, "minInstancesPerNode": 5, "stepSize": 0.3, "featureSubsetStrategy": "all"}),
    ("rf", RandomForestClassifier, {"numTrees": 1, "maxDepth": 5, "minInstancesPerNode": 10, "bootstrap": False, "featureSubsetStrategy": "all", "impurity": "gini"}),
])
def test_nothing_drawn_is_what_spark_grows(rows, family, make, params):
    stages = models.feature_stages(["x", "z"], binary=["b"])
    model = models.train(rows, family, "y", stages, params, "w")
    assert isinstance(model.stages[-1], cells.CellModel)
    theirs = Pipeline(stages=[*stages, make(labelCol="y", featuresCol="features", weightCol="w", **params)]).fit(rows.withColumn("y", rows["y"].cast("double")))
    a, b = _scores(model, rows, family), _scores(theirs, rows, family)
    assert len(a) == 1500 and all(abs(a[i][0] - b[i][0]) < 1e-9 and a[i][1] == b[i][1] for i in a)
    assert np.allclose(model.stages[-1].featureImportances.toArray(), theirs.stages[-1].featureImportances.toArray())


def test_copies_of_rows_are_cells_and_a_forest_is_as_good_as_spark_s(rows, monkeypatch):
    params, stages, got = {"numTrees": 30, "maxDepth": 6, "subsamplingRate": 0.7, "minInstancesPerNode": 10}, models.feature_stages(["x", "z"]), []
    doubled = rows.unionByName(rows)
    for own in (True, False):
        if not own:
            monkeypatch.setattr(cells, "fit", lambda *rest: None)
        got.append(models.metrics(models.predict(models.train(doubled, "rf", "y", stages, params, "w"), rows, "rf"), "rf", "y"))
    assert abs(got[0]["auROC"] - got[1]["auROC"]) < 0.02 and abs(got[0]["accuracy"] - got[1]["accuracy"]) < 0.05


def test_too_many_cells_are_left_to_spark(rows, monkeypatch):
    monkeypatch.setattr(cells, "MOST_CELLS", 10)
    model = models.train(rows, "rf", "y", models.feature_stages(["x", "z"]), {"numTrees": 2}, "w")
    assert not isinstance(model.stages[-1], cells.CellModel)


def test_features_counted_together_and_cells_of_equal_bins_grow_the_same_tree():
    rng = np.random.default_rng(3)
    category = rng.integers(0, 5, 400)
    bins = np.vstack([*(np.eye(5, dtype=np.uint8)[category].T), rng.integers(0, 30, 400), rng.integers(0, 25, 400)]).astype(np.uint8)
    sizes, raw, label = [2] * 5 + [30, 25], rng.integers(0, 4, 400), rng.integers(0, 2, 400)
    together = cells.groups(bins, sizes)
    assert sorted(map(len, (g[0] for g in together))) == [1, 1, 5]
    assert all((values[place].T == bins[features]).all() for features, values, place in together)
    own = cells.grow(bins, sizes, raw, raw * 2.0, label, "gini", 2, 6, 7, 2, 0.0, np.random.default_rng(1))
    twice = np.repeat(bins, 2, axis=1)  # each cell once for either label
    of = np.tile([0, 1], 400)
    mixed = np.where(of == np.repeat(label, 2), np.repeat(raw, 2), 0)
    start = np.arange(0, 800, 2)
    stats = [np.add.reduceat(np.where(of == k, mixed * 2.0, 0.0), start) for k in range(2)]
    merged = cells._grow(together, sizes, np.add.reduceat(mixed, start), stats, twice[:, start], "gini", 6, 7, 2, 0.0, np.random.default_rng(1))
    apart = cells._grow([([f], np.arange(n)[:, None], bins[f].astype(int)) for f, n in enumerate(sizes)], sizes, raw, [np.where(label == k, raw * 2.0, 0.0) for k in range(2)], bins, "gini", 6, 7, 2, 0.0, np.random.default_rng(1))
    for name in own:
        assert np.array_equal(own[name], merged[name]) and np.array_equal(own[name], apart[name])


def test_rows_are_passed_to_python_once_and_not_shuffled_for_weights(rows, monkeypatch):
    from panelwright.ml import weights

    size = "spark.sql.autoBroadcastJoinThreshold"
    spark, before, seen = rows.sparkSession, rows.sparkSession.conf.get(size), rows.sparkSession.sparkContext.accumulator(0)
    spark.conf.set(size, "-1")
    try:
        plan = weights.inverse_class_frequency(rows.drop("w"), "y")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(size, before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    real = cells._blocks

    def counted(batches):
        def each():
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return real(each())

    monkeypatch.setattr(cells, "_blocks", counted)
    model = models.train(rows, "rf", "y", models.feature_stages(["x", "z"], binary=["b"]), {"numTrees": 3, "maxDepth": 3}, "w")
    assert isinstance(model.stages[-1], cells.CellModel) and seen.value == 1500


def test_keys_too_long_for_a_number_are_counted_alike(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([tuple(float(rng.randrange(40)) for _ in range(14)) + (rng.randrange(2),) for _ in range(300)], ", ".join(f"c{i} double" for i in range(14)) + ", y int")
    params = {"numTrees": 1, "maxDepth": 4, "bootstrap": False, "featureSubsetStrategy": "all"}
    stages = models.feature_stages(binary=[f"c{i}" for i in range(14)])
    model = models.train(df, "rf", "y", stages, params)
    theirs = Pipeline(stages=[*stages, RandomForestClassifier(labelCol="y", featuresCol="features", **params)]).fit(df.withColumn("y", df["y"].cast("double")))
    assert isinstance(model.stages[-1], cells.CellModel)
    assert np.allclose(model.stages[-1].featureImportances.toArray(), theirs.stages[-1].featureImportances.toArray())
