"""Row numbers and running sums over whole tables without one task that sees everything.

Both work in two levels: buckets of the order's key are summed and accumulated (few rows), and only within a bucket
are rows put in order; a row's place is the bucket's offset and its place in the bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def _bucketed(df: DataFrame, key: str, buckets: int, descending: bool = False) -> DataFrame:
    """``_b``: which of the ranges of about equally many keys a row lies in; not-a-numbers come first or last as they
    sort, nulls last.  Borders are taken from a quantile sketch, so ranges stay even however the keys are skewed."""
    number = df.withColumn("_key", F.col(key).cast("double"))
    borders = sorted(set(number.approxQuantile("_key", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))))
    splits = [-math.inf, *[x for x in borders if math.isfinite(x)], math.inf]
    if len(splits) > 2:
        placed = Bucketizer(splits=splits, inputCol="_key", outputCol="_b", handleInvalid="keep").transform(number)
    else:
        placed = number.withColumn("_b", F.when(F.isnan("_key"), 1.0).otherwise(0.0))
    at = F.col("_b").cast("int")
    at = F.lit(buckets) - at if descending else at
    return placed.withColumn("_b", F.when(F.col(key).isNull(), buckets + 1).otherwise(at)).drop("_key")


def row_numbers(df: DataFrame, by: Sequence[str], key: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """``out``: 1, 2, ... within each group in the order of the numeric, unique ``key``."""
    df = _bucketed(df, key, buckets)
    sums = df.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_b").alias("_ob"), before.alias("_before"))
    same = F.col("_b") == F.col("_ob")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    placed = df.withColumn(out, F.row_number().over(Window.partitionBy(*by, "_b").orderBy(key))).join(offsets, same)
    return placed.withColumn(out, F.col(out) + F.col("_before")).drop("_b", "_ob", "_before", *[f"_by{i}" for i in range(len(by))])


def running_sums(df: DataFrame, key: str, sums: Sequence[str], descending: bool = True, buckets: int = BUCKETS, by: Sequence[str] = ()) -> DataFrame:
    """``cum_{c}`` for each of ``sums``: its total over all rows up to this one in the order of the numeric, unique
    ``key``; within each group of ``by``, if that is given (few groups, none null)."""
    df = _bucketed(df, key, buckets, descending)
    order = F.desc(key) if descending else F.asc(key)
    totals = df.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])  # at most buckets + 2 rows a group
    run = Window.partitionBy(*by or [F.lit(0)]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(run), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({f"cum_{c}": F.sum(c).over(inside) for c in sums}).join(F.broadcast(totals), [*by, "_b"])
    return out.withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"_o_{c}") for c in sums}).drop("_b", *[f"_o_{c}" for c in sums])
