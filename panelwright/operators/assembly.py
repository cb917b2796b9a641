"""Putting the daily facts together from their parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def assemble_days(spine: DataFrame, parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """``spine`` with the columns of every part that has a row for the key; every row of the spine stays, once.

    Parts must have one row per key (ValueError names columns that would clash).  All joins have the same keys, so the
    spine is shuffled once and the joins are merged on that partitioning.
    """
    seen = set(spine.columns)
    for name, part in parts.items():
        clash = sorted((set(part.columns) - set(keys)) & seen)
        if clash:
            raise ValueError(f"{name} brings columns that are there already: {', '.join(clash)}")
        seen |= set(part.columns)
    return reduce(lambda df, part: df.join(part, keys, "left"), parts.values(), spine)
