"""One harness for all estimators: cross-validate, train, evaluate.

A family says how to make an estimator from parameters, what parameters there are, and what it gives out; everything
else is shared.  Scaling and encoding are fitted on the training folds only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.ml import cells, evaluation, linear, nets, spaces
from panelwright.ml.tuning import METRICS, random_search, space_size

@dataclass(frozen=True)
class Family:
    """``share``: the part of the space a search draws from; ``score``: the column the positive class is scored by."""

    name: str
    make: Callable[..., Estimator]
    space: dict[str, Sequence]
    share: float
    classifier: bool = True
    score: str | None = "probability"
    weights: bool = True


FAMILIES: dict[str, Family] = {f.name: f for f in (
    Family("lr", C.LogisticRegression, spaces.LOGISTIC_REGRESSION, 0.10),
    Family("gbt", C.GBTClassifier, spaces.GRADIENT_BOOSTED_TREES, 0.20),
    Family("gbt_regression", R.GBTRegressor, spaces.GRADIENT_BOOSTED_TREES, 0.20, classifier=False, score=None),
    Family("rf", C.RandomForestClassifier, spaces.RANDOM_FOREST, 0.10),
    Family("rf_regression", R.RandomForestRegressor, spaces.RANDOM_FOREST_REGRESSION, 0.25, classifier=False, score=None),
    Family("mlp", C.MultilayerPerceptronClassifier, spaces.MULTILAYER_PERCEPTRON, 0.30, weights=False),
    Family("glm", R.GeneralizedLinearRegression, spaces.GENERALIZED_LINEAR_REGRESSION, 0.20, classifier=False, score=None),
    Family("svm", C.LinearSVC, spaces.SUPPORT_VECTOR_MACHINE, 0.45, score="rawPrediction"),
    Family("linear", R.LinearRegression, spaces.LINEAR_REGRESSION, 0.10, classifier=False, score=None),
)}


def feature_stages(continuous: Sequence[str] = (), binary: Sequence[str] = (), categorical: Sequence[str] = (), out: str = "features") -> list:
    """Categorical columns indexed and one-hot encoded, continuous ones scaled, binary ones as they are, in this order.
    The names of the vector's parts are in its column metadata.  Rows with nulls in a number are skipped by the fit and
    by the transform; nothing given is a ValueError."""
    if not (continuous or binary or categorical):
        raise ValueError("no features given")
    stages, parts = [], []
    if categorical:
        stages += [StringIndexer(inputCols=list(categorical), outputCols=[f"_{c}_index" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"_{c}_index" for c in categorical], outputCols=[f"_{c}_hot" for c in categorical], handleInvalid="keep")]
        parts += [f"_{c}_hot" for c in categorical]
    if continuous:
        stages += [VectorAssembler(inputCols=list(continuous), outputCol="_numbers", handleInvalid="skip"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True)]
        parts.append("_scaled")
    if binary:
        stages.append(VectorAssembler(inputCols=list(binary), outputCol="_flags", handleInvalid="skip"))
        parts.append("_flags")
    return [*stages, VectorAssembler(inputCols=parts, outputCol=out)]


def _estimator(family: str, target: str, params: dict, weight: str | None, seed: int, features: str, width: int = 0, classes: int = 2) -> Estimator:
    fam = FAMILIES[family]
    settings = dict(params)
    if family == "mlp":
        settings["layers"] = [width, *settings.pop("hidden", (16,)), max(classes, 2)]
    if family == "glm" and settings.get("family") != "tweedie":
        settings.pop("variancePower", None)
        settings.pop("linkPower", None)
    estimator = fam.make(labelCol=target, featuresCol=features, **settings)
    if estimator.hasParam("seed") and family != "glm":
        estimator.setParams(seed=seed)
    if weight and fam.weights:
        estimator.setParams(weightCol=weight)
    return estimator


def _shape(ready: DataFrame, family: str, target: str, features: str) -> dict[str, int]:
    """Inputs and classes of a net."""
    if family != "mlp":
        return {}
    return {"width": len(ready.select(features).first()[0]), "classes": int(ready.agg(F.max(F.col(target).cast("int"))).first()[0]) + 1}


def train(df: DataFrame, family: str, target: str, stages: Sequence, params: dict, weight: str | None = None, seed: int = 42, features: str = "features") -> PipelineModel:
    """Stages and estimator fitted together; the list of stages is left as it is.  Forests and boosted trees of classes are
    grown from counts of all rows by bins (:mod:`panelwright.ml.cells`), or by Spark where these would be too many; nets are
    fitted by :mod:`panelwright.ml.nets`."""
    df = df.withColumn(target, F.col(target).cast("double"))
    if family in ("rf", "gbt"):
        estimator = _estimator(family, target, params, weight, seed, features)
        prepared, model = cells.fit_columns(df, stages, estimator, family, target, weight, features) or (None, None)
        if prepared is None:
            prepared = Pipeline(stages=list(stages)).fit(df)
            model = cells.fit(prepared.transform(df), estimator, family, target, weight, features)
        return PipelineModel([*prepared.stages, model or estimator.fit(prepared.transform(df))])
    if family == "mlp":
        prepared = Pipeline(stages=list(stages)).fit(df)
        ready = prepared.transform(df)
        estimator = _estimator(family, target, params, weight, seed, features, **_shape(ready, family, target, features))
        model = nets.fit_all([ready], [(0, estimator)], target, features)[0] if nets.can_fit(estimator) else estimator.fit(ready)
        return PipelineModel([*prepared.stages, model])
    return Pipeline(stages=[*stages, _estimator(family, target, params, weight, seed, features)]).fit(df)


def predict(model: PipelineModel, df: DataFrame, family: str) -> DataFrame:
    """``df`` with ``prediction`` and, for classifiers, ``score`` of class 1 (probability, or the decision value)."""
    fam = FAMILIES[family]
    if isinstance(model.stages[-1], cells.CellModel):
        return model.stages[-1].scored(PipelineModel(model.stages[:-1]).transform(df))
    out = model.transform(df)
    return out if fam.score is None else out.withColumn("score", vector_to_array(fam.score)[1])


def metrics_by(pred: DataFrame, by: str, family: str, target: str) -> dict[int, dict[str, float | None]]:
    """Metrics of the predictions of each of ``by``, which are made once, however many passes the metrics take."""
    fam = FAMILIES[family]
    few = evaluation.few_scores_metrics_by(pred, by, target, "prediction", "score") if family in ("rf", "gbt") else None
    if few is not None:
        return few
    kept = pred.select(by, target, "prediction", *(["score"] if fam.score else [])).persist()
    try:
        return evaluation.classification_metrics_by(kept, by, target, "prediction", "score" if fam.score else None) if fam.classifier else evaluation.regression_metrics_by(kept, by, target, "prediction")
    finally:
        kept.unpersist()


def metrics(pred: DataFrame, family: str, target: str) -> dict[str, float | None]:
    found = metrics_by(pred.withColumn("_of", F.lit(0)), "_of", family, target)
    return found.get(0) or dict.fromkeys(METRICS)


def _together(family: str, frames: list[DataFrame], fits: dict[int, tuple[int, Estimator]], target: str, weight: str | None) -> dict[int, Callable[[np.ndarray], tuple]]:
    """Of the fits that can be made side by side in one stage what gives predictions and scores of rows of features."""
    kind = {"mlp": nets, "lr": linear, "svm": linear}.get(family)
    fits = {i: (k, e) for i, (k, e) in fits.items() if kind and kind.can_fit(e)}
    if not fits:
        return {}
    given, out = list(fits.values()), {}
    found = nets.weights_all(frames, given, target) if family == "mlp" else linear.fit_all(family, frames, given, target, weight)
    for (i, (_, e)), w in zip(fits.items(), found):
        if w is not None:
            out[i] = partial(_net_scores, w, list(e.getOrDefault("layers"))) if family == "mlp" else partial(_linear_scores, family, w, e.getOrDefault("threshold"))
    return out


def _net_scores(w: np.ndarray, layers: list[int], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = nets.outputs(w, layers, x)
    return p.argmax(axis=1).astype(float), p[:, 1]


def _linear_scores(family: str, w: np.ndarray, threshold: float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = x @ w[:-1] + w[-1]
    if family == "svm":
        return (m > threshold).astype(float), m
    with np.errstate(over="ignore", divide="ignore"):
        return (m > (np.log(threshold / (1 - threshold)) if threshold < 1 else np.inf)).astype(float), 1 / (1 + np.exp(-m))


def _scored(test: DataFrame, target: str, scores: dict[int, Callable[[np.ndarray], tuple]]) -> DataFrame:
    """``_of``, target, prediction and score of every row by each of ``scores``, in one pass over the rows."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for i, f in scores.items():
                    said, value = f(x)
                    yield pa.record_batch([pa.array(np.full(len(x), i, np.int32)), batch.column(1), pa.array(said), pa.array(value)], ["_of", target, "prediction", "score"])

    return test.select(vector_to_array("features").alias("x"), F.col(target).cast("double").alias(target)).mapInArrow(score, f"_of int, `{target}` double, prediction double, score double")


def cross_validate(
    df: DataFrame, family: str, target: str, stages: Sequence, fold: str = "fold_id", weight: str | None = None, n: int = 50, overrides: dict[str, Sequence] | None = None, seed: int = 42, parallelism: int = 4,
) -> DataFrame:
    """One row per parameter set and fold: parameters (text), fold and all metrics.  The number of sets is at most ``n``
    and the family's share of its space.  Fits run side by side; a fold without training or test rows is left out."""
    fam = FAMILIES[family]
    unknown = set(overrides or {}) - set(fam.space)
    if unknown:
        raise ValueError(f"{family} has no parameters {sorted(unknown)}")
    space = {**fam.space, **(overrides or {})}
    combos = random_search(space, min(n, max(1, int(space_size(space) * fam.share))), seed)
    df = df.cache()
    folds = sorted(r[0] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().collect())
    ready: dict[int, tuple[PipelineModel, DataFrame, dict[str, int]]] = {}

    def prepare(k: int) -> None:  # what does not depend on the parameters, once a fold
        training, test = df.where(F.col(fold) != k).withColumn(target, F.col(target).cast("double")), df.where(F.col(fold) == k)
        if not (training.isEmpty() or test.isEmpty()):
            prepared = Pipeline(stages=list(stages)).fit(training)
            rows = prepared.transform(training)
            ready[k] = prepared, rows, _shape(rows, family, target, "features")

    def one(job: tuple[dict, int]) -> Model:
        combo, k = job
        estimator = _estimator(family, target, combo, weight, seed, "features", **ready[k][2])
        own = cells.fit(ready[k][1], estimator, family, target, weight) if family in ("rf", "gbt") else None
        return own or estimator.fit(ready[k][1])

    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(prepare, folds))
        folds = [k for k in folds if k in ready]
        jobs = [(c, k) for c in combos for k in folds]
        made: dict[int, Model] = {}
        own = _together(family, [ready[k][1] for k in folds], {i: (folds.index(k), _estimator(family, target, c, weight, seed, "features", **ready[k][2])) for i, (c, k) in enumerate(jobs)}, target, weight)
        rest = [i for i in range(len(jobs)) if i not in own]
        made |= dict(zip(rest, pool.map(one, [jobs[i] for i in rest])))
    pred = None
    for k in folds:
        test = ready[k][0].transform(df.where(F.col(fold) == k))
        tested = [_scored(test, target, {i: own[i] for i in own if jobs[i][1] == k})] if own else []
        for i in (i for i in rest if jobs[i][1] == k):
            scored = predict(PipelineModel([made[i]]), test, family)
            tested.append(scored.select(F.lit(i).alias("_of"), F.col(target), "prediction", *(["score"] if fam.score else [])))
        for one_part in tested:
            pred = one_part if pred is None else pred.unionByName(one_part)
    measured = metrics_by(pred, "_of", family, target) if jobs else {}
    rows = [{**{p: json.dumps(v) if isinstance(v, tuple) else str(v) for p, v in combo.items()}, "fold": k, **measured.get(i, {})} for i, (combo, k) in enumerate(jobs)]
    df.unpersist()
    schema = ", ".join([*(f"{p} string" for p in space), "fold int", *(f"{m} double" for m in ("auROC", "auPR", "accuracy", "precision", "recall", "f1", "rmse", "mae", "r2"))])
    names = [x.split()[0] for x in schema.split(", ")]
    return df.sparkSession.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)


def importances(model: PipelineModel, pred: DataFrame, features: str = "features") -> DataFrame:
    """feature, importance in falling order, named by the vector's own metadata."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    attrs = pred.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name") for group in attrs.values() for a in group}
    rows = sorted(((names.get(i) or f"feature_{i}", float(v)) for i, v in enumerate(values)), key=lambda r: (-r[1], r[0]))
    return pred.sparkSession.createDataFrame(rows, "feature string, importance double")


def evaluate(model: PipelineModel, test: DataFrame, family: str, target: str, params: dict, parts: Sequence[str] | None = None) -> dict[str, DataFrame | None]:
    """``performance`` (one row), ``predictions``, ``class_metrics``, ``confusion`` and ``importances`` (else None); only
    ``parts``, if they are named, as some take passes over the predictions before anybody reads them."""
    pred = predict(model, test, family)
    fam = FAMILIES[family]

    def performance() -> DataFrame:
        row = {**{p: str(v) for p, v in params.items()}, **metrics(pred, family, target)}
        return test.sparkSession.createDataFrame(pa.table({k: pa.array([v], pa.string() if k in params else pa.float64()) for k, v in row.items()}))  # without a Python worker

    made = {
        "performance": performance, "predictions": lambda: pred,
        "class_metrics": lambda: evaluation.class_metrics(pred, target, "prediction") if fam.classifier else None,
        "confusion": lambda: evaluation.confusion_pivot(pred, target, "prediction") if fam.classifier else None,
        "importances": lambda: importances(model, pred) if hasattr(model.stages[-1], "featureImportances") else None,
    }
    return {k: f() for k, f in made.items() if parts is None or k in parts}


def select_features(df: DataFrame, columns: Sequence[str], target: str, weight: str | None = None, classifier: bool = True, n: int = 60, trees: int = 200, depth: int = 10, seed: int = 42) -> tuple[list[str], DataFrame]:
    """The ``n`` most important columns of a forest, and feature, importance, importance_pct, rank, cumulative_pct (both
    parts of 1), selected.  Nulls in numbers are taken as 0."""
    if not columns:
        raise ValueError("no features given")
    stages = [VectorAssembler(inputCols=list(columns), outputCol="features")]
    model = train(df.fillna(0, list(columns)), "rf" if classifier else "rf_regression", target, stages, {"numTrees": trees, "maxDepth": depth}, weight, seed)
    values = sorted(zip(columns, model.stages[-1].featureImportances.toArray().tolist()), key=lambda r: (-r[1], r[0]))
    whole, run, rows = sum(v for _, v in values) or 1.0, 0.0, []
    for rank, (name, v) in enumerate(values, 1):
        run += v
        rows.append((name, float(v), v / whole, rank, run / whole, "✓" if rank <= n else ""))
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double, importance_pct double, rank int, cumulative_pct double, selected string")
    return [r[0] for r in rows[:n]], table


def keep_columns(df: DataFrame, selected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The kept and then the selected columns that exist, each once, in the order given."""
    return df.select(*dict.fromkeys(c for c in [*keep, *selected] if c in df.columns))
