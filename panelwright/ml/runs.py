"""A whole model run: search, choose, train on all training rows, evaluate on the holdout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.ml import encode, models, tuning, weights
from panelwright.operators import curves


def prepare_training(df: DataFrame, day: str, label: str, key: str, drop: Sequence[str] = (), k: int = 3, holdout_days: int = 30) -> DataFrame:
    """Rows with ``weight`` (inverse class frequency) and folds in time; columns that would give the answer away are
    dropped, rows without label too."""
    rows = df.drop(*drop).where(F.col(label).isNotNull())
    return encode.temporal_folds(weights.add_weights(rows, "inverse_class_frequency", label=label), day, label, key, k, holdout_days)


def reduce_features(df: DataFrame, target: str, columns: Sequence[str], categorical: Sequence[str], keep: Sequence[str], n: int = 135, weight: str | None = "weight", **forest) -> dict[str, DataFrame]:
    """``encoded`` rows, the ``mapping`` of categories, ``importances`` of all encoded columns and ``reduced`` rows with
    the kept and the ``n`` best columns."""
    mapping = encode.category_mapping(df, list(categorical))
    encoded = encode.one_hot(df, mapping)
    inputs = [c for c in columns if c not in categorical] + [r["encoded_feature"] for r in mapping.collect()]
    chosen, table = models.select_features(encoded, inputs, target, weight, n=n, **forest)
    return {"encoded": encoded, "mapping": mapping, "importances": table, "reduced": models.keep_columns(encoded, chosen, keep)}


def run_model(
    df: DataFrame, family: str, target: str, stages: Sequence, key: str, params: dict | None = None, n: int = 4, metric: str | None = None, weight: str | None = "weight", seed: int = 42, parts: Sequence[str] | None = None, **search,
) -> dict[str, DataFrame | None]:
    """Over rows of :func:`prepare_training`: ``search`` results (unless ``params`` are given), ``performance``,
    ``predictions``, ``class_metrics``, ``confusion``, ``importances`` and, for classifiers, ``pr_curve``,
    ``roc_curve``, ``lift`` and ``threshold_counts`` of the holdout, by score, not by hard prediction.
    ``parts``: the names of those that are wanted, if not all."""
    training, holdout = df.where("is_test = 0"), df.where("is_test = 1")
    out: dict[str, DataFrame | None] = {"search": None}
    if params is None:
        out["search"] = models.cross_validate(training, family, target, stages, weight=weight, n=n, seed=seed, **search)
        space = models.FAMILIES[family].space | search.get("overrides", {})
        best = tuning.best_parameters(out["search"], models.FAMILIES[family].classifier, metric)["parameters"]
        params = {p: next(v for v in space[p] if str(v) == str(best[p]) or str(list(v) if isinstance(v, tuple) else v) == str(best[p])) for p in space}
    model = models.train(training, family, target, stages, params, weight, seed)
    out |= models.evaluate(model, holdout, family, target, params, parts)
    if models.FAMILIES[family].classifier:
        pred = models.predict(model, holdout, family)
        made = {
            "pr_curve": lambda: curves.pr_curve(pred, target, "score"), "roc_curve": lambda: curves.roc_curve(pred, target, "score"),
            "lift": lambda: curves.lift_chart(pred, target, "score", key), "threshold_counts": lambda: curves.confusion(pred, target, "score"),
        }
        out |= {k: f() for k, f in made.items() if parts is None or k in parts}
    return out
