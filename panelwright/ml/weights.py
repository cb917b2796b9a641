"""Row weights for training, as column expressions and counts per class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _per_class(df: DataFrame, label: str, weight, out: str) -> DataFrame:
    """``weight(n rows, classes, rows of the class)``; counts per class are few rows.  A null label has null weight."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    few = counts.limit(65_537).toArrow()
    if few.num_rows <= 65_536:  # counted once; the rows stay where they are
        counts = df.sparkSession.createDataFrame(few)
        total, classes = sum(few["_n"].to_pylist()), few.num_rows
    else:
        total, classes = counts.agg(F.sum("_n"), F.count(F.lit(1))).first()
    per = counts.where(F.col(label).isNotNull()).select(label, weight(F.lit(float(total or 0)), F.lit(float(classes or 1)), F.col("_n")).alias(out))
    if few.num_rows <= 65_536:
        per = F.broadcast(per)
    return df.join(per, label, "left").select(*df.columns, out)


def inverse_class_frequency(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    return _per_class(df, label, lambda n, k, c: n / c, out)


def balanced(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    return _per_class(df, label, lambda n, k, c: n / (k * c), out)


def custom(df: DataFrame, label: str, weights: dict, out: str = "weight") -> DataFrame:
    """The weight given for a label; 1 for one that is not given, or null.  Labels that are numbers are compared as
    numbers (1, 1.0, "1"), others as text."""
    number = dict(df.dtypes)[label] in ("tinyint", "smallint", "int", "bigint", "float", "double") or dict(df.dtypes)[label].startswith("decimal")
    value: Column = F.lit(1.0)
    for k, v in weights.items():
        same = F.col(label).cast("double") == float(k) if number else F.col(label).cast("string") == str(k)
        value = F.when(same, F.lit(float(v))).otherwise(value)
    return df.withColumn(out, value)


def focal_loss(df: DataFrame, label: str, prediction: str, probability: str, gamma: float = 2.0, out: str = "weight") -> DataFrame:
    """(1 - probability of the true class) ** gamma; the probability is that of the prediction, or an array by class."""
    if dict(df.dtypes)[probability].startswith("array"):
        true = F.try_element_at(F.col(probability), F.col(label).cast("int") + 1)
    else:
        true = F.when(F.col(label) == F.col(prediction), F.col(probability)).otherwise(1 - F.col(probability))
    return df.withColumn(out, F.pow(1 - true, F.lit(gamma)))


def time_based(df: DataFrame, day: str, decay_days: float = 30.0, out: str = "weight") -> DataFrame:
    """exp(-age / decay_days), the age counted from the latest day of the table."""
    return df.withColumn(out, _decay(df, day, decay_days))


def _decay(df: DataFrame, day: str, decay_days: float) -> Column:
    latest = df.agg(F.max(day)).first()[0]
    return F.exp(-F.datediff(F.lit(latest).cast("date"), F.col(day)) / F.lit(float(decay_days)))


def _factor(features: Sequence[tuple[str, float]], by: float) -> Column:
    out = F.lit(1.0)
    for name, threshold in features:
        out = out * F.when(F.col(name) > threshold, by).otherwise(1.0)
    return out


def feature_based(df: DataFrame, features: Sequence[tuple[str, float]], out: str = "weight") -> DataFrame:
    return df.withColumn(out, _factor(features, 2.0))


def quantile_based(df: DataFrame, label: str, buckets: int = 4, out: str = "weight") -> DataFrame:
    """n / (buckets * rows in the label's quantile bucket); equal quantiles are one border.  A label that is not a
    floating number is weighted by class instead."""
    if dict(df.dtypes)[label] not in ("float", "double"):
        return inverse_class_frequency(df, label, out)
    cuts = sorted({float(x) for x in df.agg(F.percentile_approx(label, [i / buckets for i in range(1, buckets)], 100_000)).first()[0] or []})
    at = F.lit(len(cuts))
    for i, c in reversed(list(enumerate(cuts))):
        at = F.when(F.col(label) < c, i).otherwise(at)
    tagged = df.withColumn("_bucket", F.when(F.col(label).isNotNull(), at))
    n = df.count()
    counts = tagged.groupBy("_bucket").agg((F.lit(float(n)) / (buckets * F.count(F.lit(1)))).alias(out)).where("_bucket is not null")
    return tagged.join(counts, "_bucket", "left").select(*df.columns, out)


def combined(df: DataFrame, label: str, day: str | None = None, features: Sequence[tuple[str, float]] = (), multipliers: dict | None = None, decay_days: float = 30.0, out: str = "weight") -> DataFrame:
    base = inverse_class_frequency(df, label, "_class")
    more = custom(base, label, multipliers or {"": 1.0}, "_more") if multipliers else base.withColumn("_more", F.lit(1.0))
    decay = F.lit(1.0) if day is None else _decay(df, day, decay_days)
    return more.withColumn(out, F.col("_class") * decay * _factor(features, 1.5) * F.col("_more")).drop("_class", "_more")


STRATEGIES = {
    "inverse_class_frequency": inverse_class_frequency, "balanced": balanced, "custom": custom, "focal_loss": focal_loss,
    "time_based": time_based, "feature_based": feature_based, "quantile_based": quantile_based, "combined": combined,
}


def add_weights(df: DataFrame, strategy: str, **settings) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](df, **settings)
