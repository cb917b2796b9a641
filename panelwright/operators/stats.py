"""Statistics of columns and of two samples."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.ranking import running_sums


def correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """left, right, correlation: all pairs from one scan; rows where either is null or NaN are left out of a pair.  A
    constant column gives null."""
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for p in pairs for c in p}
    one = df.agg(*[F.corr(F.when(clean[b].isNotNull(), clean[a]), F.when(clean[a].isNotNull(), clean[b])).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])))
    return long.withColumn("correlation", F.when(~F.isnan("correlation"), F.col("correlation")))


def high_correlations(df: DataFrame, columns: Sequence[str], least: float) -> DataFrame:
    """Pairs of columns whose correlation is beyond ``least`` either way; each pair once."""
    return correlations(df, list(combinations(columns, 2))).where(F.abs("correlation") > least)


def histogram(df: DataFrame, value: str, by: str, bins: int) -> DataFrame:
    """by, bin, n, density: equal bins over the range of all values (one row per group and bin, empty ones missing)."""
    rows = df.select(F.col(by), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    lo, hi = rows.agg(F.min("_v"), F.max("_v")).first()
    width = (hi - lo) / bins if lo is not None and hi > lo else 1.0
    at = F.least(F.floor((F.col("_v") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = rows.groupBy(by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    whole = counted.groupBy(by).agg(F.sum("n").alias("_all"))
    return counted.join(whole, by).select(by, "bin", "n", (F.col("n") / F.col("_all") / F.lit(width)).alias("density"))


def _two_samples(df: DataFrame, value: str, group: Column) -> DataFrame:
    rows = df.select(F.col(value).cast("double").alias("v"), group.cast("int").alias("g")).where("v is not null and not isnan(v) and g is not null")
    return running_sums(rows.groupBy("v").agg(F.sum("g").alias("a"), F.sum(1 - F.col("g")).alias("b")), "v", ["a", "b"], descending=False)


def mann_whitney_u(df: DataFrame, value: str, group: Column) -> DataFrame:
    """n1, n2, u of the rows where ``group`` holds, by average ranks: values are counted, then ranks come from running
    sums of the counts."""
    c = _two_samples(df, value, group)
    u = F.sum(F.col("a") * (F.col("cum_b") - F.col("b") / 2.0))
    return c.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), u.alias("u"))


def ks_2samp(df: DataFrame, value: str, group: Column) -> DataFrame:
    """n1, n2, statistic: the greatest distance of both distribution functions."""
    c = _two_samples(df, value, group)
    n1, n2 = c.agg(F.sum("a"), F.sum("b")).first()
    gap = F.abs(F.col("cum_a") / F.lit(float(n1 or 1)) - F.col("cum_b") / F.lit(float(n2 or 1)))
    return c.agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.max(gap).alias("statistic"))


def two_sample_p_values(df: DataFrame, value: str, group: Column) -> DataFrame:
    """One row: u and its two-sided p (normal approximation with ties and continuity), the distance of the
    distributions and its p (limit of Kolmogorov's distribution).  Null where a sample is empty.  The driver gets four sums."""
    c = _two_samples(df, value, group)
    t = F.col("a") + F.col("b")
    u, ks = mann_whitney_u(df, value, group).first(), ks_2samp(df, value, group).first()
    ties = c.agg(F.sum(t.cast("double") * t * t - t)).first()[0]
    n1, n2, out = int(u["n1"] or 0), int(u["n2"] or 0), [None, None, None, None]
    if n1 and n2:
        n = n1 + n2
        spread = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) if n > 1 else 0.0
        z = max(abs(float(u["u"]) - n1 * n2 / 2) - 0.5, 0.0) / spread if spread else 0.0
        x = math.sqrt(n1 * n2 / n) * float(ks["statistic"])
        far = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)) if x > 0.2 else 1.0
        out = [float(u["u"]), math.erfc(z / math.sqrt(2)), float(ks["statistic"]), min(max(far, 0.0), 1.0)]
    return df.sparkSession.createDataFrame([tuple(out)], "u double, u_p double, distance double, distance_p double")


def rates_by_category(df: DataFrame, category: str, target: Column, k: int | None = None) -> DataFrame:
    """category, rate, n: mean of the target per category; the k highest rates if asked for."""
    out = df.groupBy(category).agg(F.avg(target.cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))
    return out if k is None else out.orderBy(F.desc("rate"), F.desc("n"), category).limit(k)
