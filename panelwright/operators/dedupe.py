"""One row per key, always the same one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], latest_by: Sequence[str]) -> DataFrame:
    """The row greatest in ``latest_by`` (nulls lowest; make it total) of every key.

    An aggregate, not a window: copies are combined before the shuffle, so a key with a third of all rows is as
    cheap as any other.  Rows with null keys form groups of their own, as in GROUP BY.
    """
    rest = [c for c in df.columns if c not in keys and c not in latest_by]
    best = F.max_by(F.struct(*rest, *[F.col(c).alias(f"_k{i}") for i, c in enumerate(latest_by)]) if rest else F.struct(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(latest_by)]), F.struct(*latest_by))
    out = df.groupBy(*keys).agg(best.alias("_b"))
    place = {c: f"_b._k{i}" for i, c in enumerate(latest_by)} | {c: f"_b.{c}" for c in rest} | {c: c for c in keys}
    return out.select(*[F.col(place[c]).alias(c) for c in df.columns])


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    """Rows of rank at most ``k``; Spark prunes each task's groups to k rows before the shuffle."""
    from panelwright.operators.frames import ordered

    return df.withColumn(rank, F.row_number().over(ordered(by, order))).where(F.col(rank) <= k)
