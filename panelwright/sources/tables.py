"""Reading and writing of named Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One named table of a folder; columns and filters are pushed into the scan by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_tables(tables: dict[str, DataFrame], folder: str, mode: str = "overwrite") -> None:
    """A multi-output sink: every DataFrame under its own name."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}.parquet")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal relation with an explicit schema."""
    return spark.createDataFrame(rows, schema)
