"""Streaks, and how long something is ago."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.frames import future, history, ordered


def streaks(df: DataFrame, by: Sequence[str], day: str, active: Column, out: str, gaps_break: bool = True) -> DataFrame:
    """``out``: on an active row the number of active rows on end up to it, on others 0.  With ``gaps_break`` a missing
    calendar day ends the streak.  One row per group and day is expected."""
    w = ordered(by, [day])
    on = F.coalesce(active, F.lit(False))
    begins = ~F.coalesce(F.lag(on).over(w), F.lit(False))
    if gaps_break:
        begins = begins | (F.datediff(F.col(day), F.lag(day).over(w)) > 1)
    df = df.withColumns({"_on": on, "_begins": begins})
    df = df.withColumn("_island", F.sum(F.when(F.col("_begins") & F.col("_on"), 1).otherwise(0)).over(w.rowsBetween(-(1 << 31) + 1, 0)))
    inside = ordered([*by, "_island"], [day]).rowsBetween(-(1 << 31) + 1, 0)
    return df.withColumn(out, F.when(F.col("_on"), F.sum(F.col("_on").cast("int")).over(inside)).otherwise(0).cast("int")).drop("_on", "_begins", "_island")


def days_since_last(by: Sequence[str], day: str, condition: Column, default: int = 0, ignore_nulls: bool = True, today_counts: bool = True) -> Column:
    """Days since the last earlier row that meets the condition; 0 where today's does (if ``today_counts``); the
    default where none did.  ``ignore_nulls=False`` looks at the row before only."""
    last = F.last(F.when(condition, F.col(day)), ignorenulls=ignore_nulls).over(history(by, [day]))
    ago = F.coalesce(F.datediff(F.col(day), last), F.lit(default))
    return F.when(F.coalesce(condition, F.lit(False)), 0).otherwise(ago) if today_counts else ago


def days_until_next(by: Sequence[str], day: str, condition: Column, default: int, ignore_nulls: bool = True) -> Column:
    """Days until the next later row that meets the condition."""
    following = F.first(F.when(condition, F.col(day)), ignorenulls=ignore_nulls).over(future(by, [day]))
    return F.coalesce(F.datediff(following, F.col(day)), F.lit(default))
