"""Column profile of a table in one pass for all columns, plus one for outliers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCURACY = 100_000
LEVELS = [(95, "VERY_HIGH"), (80, "HIGH"), (50, "MEDIUM"), (10, "LOW")]


def _fences(df: DataFrame, columns: list[tuple[int, str]]) -> DataFrame:
    """``i, q1, q3, m``: quartiles (by a sketch of ACCURACY, exact for that many values) and mean of numeric columns."""
    if not columns:
        return df.sparkSession.createDataFrame([], "i int, q1 double, q3 double, m double")
    value = {i: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for i, c in columns}
    one = df.agg(*[F.percentile_approx(v, [0.25, 0.75], ACCURACY).alias(f"q{i}") for i, v in value.items()], *[F.avg(v).alias(f"m{i}") for i, v in value.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.get(f"q{i}", F.lit(0)).alias("q1"), F.get(f"q{i}", F.lit(1)).alias("q3"), F.col(f"m{i}").alias("m")) for i in value])))


def profile(df: DataFrame, dataset: str) -> DataFrame:
    """One row per column: counts, distinct values, ranges, moments, outliers by quartile fences, average length, most
    frequent value, flags.  Null counts as a distinct value and can be most frequent; the mode of several equally
    frequent values is the smallest text; floating values keep Spark's text form.  An empty table gives zeros.

    Every statistic of every column comes from one aggregate of the long form ``(column, value)``: distinct counts
    and the mode are taken from the counts per value, so a frequent value is one row after the map side.
    """
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column_name"), F.col(f"`{f.name}`").cast("string").alias("v"), (F.col(f"`{f.name}`").cast("double") if f.name in numeric else F.lit(None).cast("double")).alias("x"))
        for i, f in enumerate(df.schema) if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    ]))
    counts = df.select(cells.alias("c")).select("c.*").groupBy("i", "column_name", "v", "x").agg(F.count(F.lit(1)).alias("n"))
    real = F.when(~F.isnan("x"), F.col("x"))
    weighted = lambda c: F.sum(c * F.col("n"))
    fence = _fences(df, [(i, f.name) for i, f in enumerate(df.schema) if f.name in numeric])
    held = F.when(real.isNotNull(), F.col("n"))
    stats = counts.join(F.broadcast(fence), "i", "left").groupBy("i", "column_name").agg(  # one row per column
        F.sum("n").alias("total_rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"), F.count(F.lit(1)).alias("distinct_count"),
        F.min(real).alias("lo"), F.max(real).alias("hi"), F.max("m").alias("mean"), weighted((real - F.col("m")) * (real - F.col("m"))).alias("sq"), F.sum(held).alias("k"),
        weighted(F.when((real < F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) | (real > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))), 1).otherwise(0)).alias("outliers"),
        (weighted(F.length("v")) / F.nullif(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).cast("double"), F.lit(0.0))).alias("avg_length"),
        F.max("n").alias("mode_count"), F.min_by("v", F.struct(-F.col("n"), F.col("v").isNotNull(), "v")).alias("mode_value"),
    )
    total = F.col("total_rows")
    pct = lambda c: F.coalesce(F.round(100.0 * c / F.nullif(total.cast("double"), F.lit(0.0)), 2), F.lit(0.0))
    is_number, is_text = F.col("column_name").isin(*numeric, ""), F.col("column_name").isin(*texts, "")
    spread = F.sqrt(F.col("sq") / F.nullif((F.col("k") - 1).cast("double"), F.lit(0.0)))
    share = pct(F.col("distinct_count"))
    level: Column = F.lit("VERY_LOW")
    for least, name in LEVELS[::-1]:
        level = F.when(share >= least, name).otherwise(level)
    kinds = F.create_map(*[x for f in df.schema for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    nulls = total - F.col("non_null")
    return stats.select(
        F.lit(dataset).alias("dataset"), "column_name", kinds[F.col("column_name")].alias("data_type"), "total_rows", F.lit(len(df.columns)).alias("total_columns"), "non_null", nulls.alias("null_count"), pct(nulls).alias("null_pct"),
        "distinct_count", share.alias("distinct_pct"), level.alias("cardinality"), F.when(is_number, F.col("lo")).alias("min_value"), F.when(is_number, F.col("hi")).alias("max_value"),
        F.when(is_number, F.round("mean", 4)).alias("mean_value"), F.when(is_number, F.round(spread, 4)).alias("std_value"), F.when(is_number, F.col("outliers")).alias("outlier_count"),
        F.when(is_number, pct(F.col("outliers"))).alias("outlier_pct"), F.when(is_text, F.round("avg_length", 2)).alias("avg_length"), F.substring("mode_value", 1, 50).alias("mode_value"), "mode_count",
        yes(nulls > 0).alias("has_nulls"), yes(is_number & (F.col("outliers") > 0)).alias("has_outliers"), yes(share > 80).alias("high_cardinality"), yes(F.col("distinct_count") == total).alias("potential_unique_key"),
    )


def profile_all(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """The profiles of several tables, in order of table and column."""
    return reduce(DataFrame.unionByName, [profile(df, name) for name, df in tables.items()]).orderBy("dataset", "column_name")
