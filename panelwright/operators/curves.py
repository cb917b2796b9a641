"""Evaluation curves of scored rows.  Equal scores are one point: rows are counted per score before anything is
accumulated, so the curve's size is the number of different scores and no window spans all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from panelwright.operators.ranking import row_numbers, running_sums


def _per_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """``score, pos, neg``; rows without label or score take no part."""
    rows = df.select(F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("label")).where("score is not null and not isnan(score) and label is not null")
    return rows.groupBy("score").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("neg"))


def _with_totals(curve: DataFrame) -> DataFrame:
    totals = curve.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    all_pos, all_neg = totals.first() or (0, 0)
    return curve.withColumns({"all_pos": F.lit(int(all_pos or 0)), "all_neg": F.lit(int(all_neg or 0))})


def _share(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """precision, recall, threshold and the precision of no skill, one point per score; recall is null without positives."""
    c = running_sums(_with_totals(_per_score(df, label, score)), "score", ["pos", "neg"])
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return c.select(_share(tp, tp + fp).alias("precision"), _share(tp, F.col("all_pos")).alias("recall"), F.col("score").alias("threshold"), _share(F.col("all_pos"), F.col("all_pos") + F.col("all_neg")).alias("no_skill_precision"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row ``auc``: the chance that a positive scores above a negative, ties half; null with one class only."""
    c = running_sums(_with_totals(_per_score(df, label, score)), "score", ["pos", "neg"])
    wins = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    return c.agg(_share(wins, F.first("all_pos").cast("double") * F.first("all_neg")).alias("auc"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """fpr, tpr, threshold (null at the ends 0,0 and 1,1) and the area under the curve on every row."""
    c = running_sums(_with_totals(_per_score(df, label, score)), "score", ["pos", "neg"])
    points = c.select(_share(F.col("cum_neg"), F.col("all_neg")).alias("fpr"), _share(F.col("cum_pos"), F.col("all_pos")).alias("tpr"), F.col("score").alias("threshold"))
    ends = df.sparkSession.createDataFrame([(0.0, 0.0, None), (1.0, 1.0, None)], "fpr double, tpr double, threshold double")
    auc = roc_auc(df, label, score).first()["auc"]
    return points.unionByName(ends).withColumn("auc", F.lit(auc).cast("double"))


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """actual, predicted, count: the four cells, also the empty ones, from one scan."""
    a, p = F.col(label) == 1, F.col(score) >= threshold
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    cells = [(1, 1, a & p), (1, 0, a & ~p), (0, 1, ~a & p), (0, 0, ~a & ~p)]
    one = known.agg(*[F.count_if(c).alias(f"c{i}{j}") for i, j, c in cells])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("actual"), F.lit(j).alias("predicted"), F.col(f"c{i}{j}").alias("count")) for i, j, _ in cells])))


def lift_chart(df: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """Per percentile of rows in falling order of score (then of the unique numeric ``key``): share of positives caught
    by the model, at random and at best, and the lift."""
    rows = df.select(F.col(key).alias("key"), F.col(score).cast("double").alias("score"), (F.col(label) == 1).cast("int").alias("y")).where("score is not null and not isnan(score) and y is not null")
    before = running_sums(rows.groupBy("score").agg(F.count(F.lit(1)).alias("n")), "score", ["n"]).select("score", (F.col("cum_n") - F.col("n")).alias("before"))
    total, positives = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    total, positives = int(total or 0), int(positives or 0)
    ranked = row_numbers(rows, ["score"], "key", "in_score").join(before, "score")
    binned = ranked.groupBy(((F.col("before") + F.col("in_score")) * 100 / F.lit(max(total, 1))).cast("int").alias("percentile")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    w = Window.partitionBy(F.lit(0)).orderBy("percentile").rowsBetween(Window.unboundedPreceding, 0)  # 101 rows
    seen, caught = 100.0 * F.sum("n").over(w) / F.lit(max(total, 1)), 100.0 * F.sum("y").over(w) / F.nullif(F.lit(float(positives)), F.lit(0.0))
    rate = 100.0 * positives / max(total, 1)
    best = F.least(F.col("percentile") / F.lit(rate) * 100.0, F.lit(100.0)) if rate else F.lit(100.0)
    return binned.select("percentile", caught.alias("model_cumulative_gain"), seen.alias("random_gain"), best.alias("perfect_gain"), (caught / seen).alias("lift"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the precision-recall curve by trapezia over recall, from recall 0 at the first precision."""
    c = running_sums(_with_totals(_per_score(df, label, score)), "score", ["pos", "neg"])
    precision = _share(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    pos0, neg0 = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    prior = F.coalesce(_share(pos0, pos0 + neg0), precision)
    return c.agg(F.sum(_share(F.col("pos"), F.col("all_pos")) * (precision + prior) / 2).alias("average_precision"))


def areas(df: DataFrame, label: str, score: str, by: str) -> list[Row]:
    """``by``, auc, average_precision, one row for each value of ``by``, of which there are few: what :func:`roc_auc` and
    :func:`average_precision` say of its rows."""
    rows = df.select(F.col(by), F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("label")).where("score is not null and not isnan(score) and label is not null")
    points = rows.groupBy(by, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")).persist()
    try:
        c = running_sums(points, "score", ["pos", "neg"], by=[by])
        tp, fp = F.col("cum_pos"), F.col("cum_neg")
        pos0, neg0 = tp - F.col("pos"), fp - F.col("neg")
        precision = _share(tp, tp + fp)
        prior = F.coalesce(_share(pos0, pos0 + neg0), precision)
        wins = F.sum(F.col("neg") * (tp - F.col("pos") / 2.0))
        return c.groupBy(by).agg(_share(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"), _share(F.sum(F.col("pos") * (precision + prior) / 2), F.sum("pos")).alias("average_precision")).collect()
    finally:
        points.unpersist()


def calibration(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """bin (1..bins over the scores' range), rows, mean score, share of positives."""
    rows = df.select(F.col(score).cast("double").alias("s"), (F.col(label) == 1).cast("int").alias("y")).where("s is not null and not isnan(s) and y is not null")
    lo, hi = rows.agg(F.min("s"), F.max("s")).first()
    at = F.least(F.floor((F.col("s") - F.lit(lo)) / F.lit((hi - lo) / bins)) + 1, F.lit(bins)) if lo is not None and hi > lo else F.lit(1)
    return rows.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean_score"), F.avg("y").alias("positive_share"))
