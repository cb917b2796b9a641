"""Categorical columns as numbers, and stratified folds in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.ranking import row_numbers


def detect_categories(df: DataFrame, columns: Sequence[str], most: int = 50) -> list[str]:
    """Text columns, and whole-number columns of at most ``most`` different values (counted in one scan)."""
    texts = [f.name for f in df.schema if f.name in columns and isinstance(f.dataType, T.StringType)]
    whole = [f.name for f in df.schema if f.name in columns and isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType))]
    few = df.agg(*[F.countDistinct(c).alias(c) for c in whole]).first().asDict() if whole else {}
    return [c for c in columns if c in texts or few.get(c, most + 1) <= most]


def category_mapping(df: DataFrame, columns: Sequence[str], most: int = 500) -> DataFrame:
    """original_feature, encoded_feature, encoding_index, category_value, total_encoded_features: values by falling
    frequency, then by name.  More than ``most`` values of a column are an error, so the mapping stays small."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]))
    counts = df.select(cells.alias("x")).select("x.*").where("v is not null").groupBy("c", "v").count().orderBy("c", F.desc("count"), "v").limit(most * len(columns) + 1).collect()
    rows: list[tuple] = []
    for c in columns:
        values = [r["v"] for r in counts if r["c"] == c]
        if len(values) > most or len(counts) > most * len(columns):
            raise ValueError(f"{c} has more than {most} values")
        rows += [(c, f"{c}_cat{i}", i, v, len(values)) for i, v in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, "original_feature string, encoded_feature string, encoding_index int, category_value string, total_encoded_features int")


def one_hot(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """0/1 columns by the mapping, in place of the originals; unknown and null values are 0 everywhere."""
    rules = mapping.collect()
    out = {r["encoded_feature"]: F.coalesce((F.col(r["original_feature"]).cast("string") == r["category_value"]).cast("double"), F.lit(0.0)) for r in rules}
    return df.withColumns(out).drop(*{r["original_feature"] for r in rules})


def label_encode(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """``{column}_index`` by the mapping; unknown and null values get the index after the last."""
    out: dict = {}
    for r in mapping.collect():
        c = r["original_feature"]
        out[c] = F.when(F.col(c).cast("string") == r["category_value"], float(r["encoding_index"])).otherwise(out.get(c, F.lit(float(r["total_encoded_features"]))))
    return df.withColumns({f"{c}_index": v for c, v in out.items()}).drop(*out)


def _days(df: DataFrame, day: str) -> tuple:
    lo, hi = df.agg(F.min(day), F.max(day)).first()
    return ("1970-01-01", "1970-01-01") if hi is None else (lo, hi)


def _held_out(df: DataFrame, day: str, hi, holdout_days: int) -> tuple[DataFrame, Column]:
    age = F.datediff(F.lit(hi).cast("date"), F.col(day))
    return df.withColumns({"days_from_reference": age, "is_test": F.when(age < holdout_days, 1).otherwise(0)}), age


def holdout(df: DataFrame, day: str, holdout_days: int = 30) -> DataFrame:
    """``days_from_reference`` and ``is_test`` as :func:`temporal_folds` gives them, where no folds are asked for: rows stay where they are."""
    return _held_out(df, day, _days(df, day)[1], holdout_days)[0]


def temporal_folds(df: DataFrame, day: str, label: str, key: str, k: int = 3, holdout_days: int = 30, bins: int = 4) -> DataFrame:
    """``days_from_reference`` (from the latest day), ``is_test`` (the last ``holdout_days``), ``timestamp_bin`` (equal
    stretches of the time before), ``strat_group`` (bin and label), ``fold_id`` (1..k, dealt out in turn within a
    group by the unique numeric ``key``; null for the holdout) and ``recency_weight`` 4, 2, 1 within 7, 30, 90 days."""
    lo, hi = _days(df, day)
    df, age = _held_out(df, day, hi, holdout_days)
    span = F.greatest(F.datediff(F.lit(hi).cast("date"), F.lit(lo).cast("date")) - holdout_days + 1, F.lit(1))
    since = F.datediff(F.col(day), F.lit(lo).cast("date"))
    df = df.withColumn("timestamp_bin", F.when(F.col("is_test") == 0, F.least(F.floor(since * bins / span), F.lit(bins - 1)).cast("int")))
    df = df.withColumn("strat_group", F.concat_ws("_", F.coalesce("timestamp_bin", F.lit(-1)), F.coalesce(F.col(label).cast("string"), F.lit("null"))))
    df = row_numbers(df, ["strat_group"], key, "_at")
    weight = F.when(age <= 7, 4.0).when(age <= 30, 2.0).otherwise(1.0)
    return df.withColumns({"fold_id": F.when(F.col("is_test") == 0, (F.col("_at") - 1) % k + 1).cast("int"), "recency_weight": weight}).drop("_at")
