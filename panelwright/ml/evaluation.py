"""Metrics of predictions, each from one aggregate."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.curves import areas


def label_counts(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """actual, predicted, n: all that class metrics need, one row per pair of classes."""
    return pred.where(F.col(label).isNotNull() & F.col(prediction).isNotNull()).groupBy(F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """class_label, precision, recall, f1 for every actual class; 0 where there is nothing to divide by."""
    c = label_counts(pred, label, prediction)
    both = c.select(F.inline(F.array(F.struct(F.col("actual").alias("class_label"), F.col("n").alias("a"), F.lit(0).cast("long").alias("p")), F.struct(F.col("predicted").alias("class_label"), F.lit(0).cast("long").alias("a"), F.col("n").alias("p")))), )
    hits = c.where("actual = predicted").select(F.col("actual").alias("class_label"), F.col("n").alias("hit"))
    one = both.groupBy("class_label").agg(F.sum("a").alias("a"), F.sum("p").alias("p")).join(hits, "class_label", "left").where("a > 0")
    share = lambda x, y: F.coalesce(x / F.nullif(y.cast("double"), F.lit(0.0)), F.lit(0.0))
    hit = F.coalesce("hit", F.lit(0))
    precision, recall = share(hit, F.col("p")), share(hit, F.col("a"))
    return one.select("class_label", precision.alias("precision"), recall.alias("recall"), share(2 * precision * recall, precision + recall).alias("f1"))


def confusion_pivot(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row per actual class, one column per predicted class, zeros filled in."""
    c = label_counts(pred, label, prediction)
    return c.groupBy("actual").pivot("predicted").sum("n").fillna(0).withColumnRenamed("actual", label)


MOST_SCORES = 200_000


def few_scores_metrics_by(pred: DataFrame, by: str, label: str, prediction: str, score: str) -> dict[int, dict[str, float | None]] | None:
    """:func:`classification_metrics_by` from rows counted by score in one pass, as trees give few different ones; None if they are many."""
    y, s = F.col(label).cast("double"), F.col(score).cast("double")
    counts = pred.where(F.col(label).isNotNull()).groupBy(by, y.alias("y"), F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted"), s.alias("score")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_SCORES + 1).toArrow()
    if counts.num_rows > MOST_SCORES:
        return None
    counts = counts.to_pandas()
    known = counts[counts["predicted"].notna()].groupby([by, "actual", "predicted"], as_index=False)["n"].sum().astype(int)
    under = {}
    for g, rows in counts[counts["score"].notna()].groupby(by):
        points = pd.DataFrame({"score": rows["score"], "pos": rows["n"].where(rows["y"] == 1, 0), "neg": rows["n"].where(rows["y"] != 1, 0)}).groupby("score").sum().sort_index(ascending=False)
        pos, neg = points["pos"].to_numpy(float), points["neg"].to_numpy(float)
        tp, fp = pos.cumsum(), neg.cumsum()
        if len(tp) and tp[-1] and fp[-1]:
            precision, before = tp / (tp + fp), (tp - pos) + (fp - neg)
            prior = np.where(before > 0, (tp - pos) / np.maximum(before, 1), precision)
            under[g] = {"auc": float((neg * (tp - pos / 2)).sum() / (tp[-1] * fp[-1])), "average_precision": float((pos * (precision + prior) / 2).sum() / tp[-1])}
    return _told(known.to_dict("records"), by, lambda: under)


def classification_metrics_by(pred: DataFrame, by: str, label: str, prediction: str, score: str | None) -> dict[int, dict[str, float | None]]:
    """For each value of ``by``: accuracy, weighted precision, recall and f1; auROC and auPR if there is a score and both
    classes occur."""
    known = pred.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    counts = known.groupBy(by, F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per pair of classes
    return _told(counts, by, lambda: {r[by]: r for r in areas(pred, label, score, by)} if score else {})


def _told(counts: list, by: str, areas_by: Callable[[], dict]) -> dict[int, dict[str, float | None]]:
    """Metrics of rows counted by pair of classes; areas are asked for if both classes occur."""
    both = {g for g in {r[by] for r in counts} if len({r["actual"] for r in counts if r[by] == g}) == 2}
    under, found = areas_by() if both else {}, {}
    for g in {r[by] for r in counts}:
        rows = [r for r in counts if r[by] == g]
        n = sum(r["n"] for r in rows)
        out: dict[str, float | None] = dict.fromkeys(("auROC", "auPR", "accuracy", "precision", "recall", "f1", "rmse", "mae", "r2"))
        weighted = [0.0, 0.0, 0.0]
        for c in {r["actual"] for r in rows}:
            hit = sum(r["n"] for r in rows if r["actual"] == r["predicted"] == c)
            a, p = sum(r["n"] for r in rows if r["actual"] == c), sum(r["n"] for r in rows if r["predicted"] == c)
            precision, recall = hit / p if p else 0.0, hit / a
            f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
            weighted = [w + a / n * x for w, x in zip(weighted, (precision, recall, f1))]
        out |= {"accuracy": sum(r["n"] for r in rows if r["actual"] == r["predicted"]) / n, "precision": weighted[0], "recall": weighted[1], "f1": weighted[2]}
        if g in both and g in under:
            out["auROC"], out["auPR"] = under[g]["auc"], under[g]["average_precision"]
        found[g] = out
    return found


def classification_metrics(pred: DataFrame, label: str, prediction: str, score: str | None) -> dict[str, float | None]:
    found = classification_metrics_by(pred.withColumn("_of", F.lit(0)), "_of", label, prediction, score)
    return found.get(0) or dict.fromkeys(("auROC", "auPR", "accuracy", "precision", "recall", "f1", "rmse", "mae", "r2"))


def regression_metrics_by(pred: DataFrame, by: str, label: str, prediction: str) -> dict[int, dict[str, float | None]]:
    y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction)
    found = {}
    for r in pred.groupBy(by).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum(e * e).alias("rss"), (F.sum(y * y) - F.count(y) * F.avg(y) * F.avg(y)).alias("tss")).collect():
        out: dict[str, float | None] = dict.fromkeys(("auROC", "auPR", "accuracy", "precision", "recall", "f1"))
        found[r[by]] = out | {"rmse": None if r["mse"] is None else r["mse"] ** 0.5, "mae": r["mae"], "r2": None if not r["tss"] else 1 - r["rss"] / r["tss"]}
    return found


def regression_metrics(pred: DataFrame, label: str, prediction: str) -> dict[str, float | None]:
    found = regression_metrics_by(pred.withColumn("_of", F.lit(0)), "_of", label, prediction)
    return found.get(0) or dict.fromkeys(("auROC", "auPR", "accuracy", "precision", "recall", "f1", "rmse", "mae", "r2"))
