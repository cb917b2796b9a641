"""Plain imputation: from coarser groups, from neighbours in time, from the first of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.frames import ordered
from panelwright.operators.joins import join_spreading_nulls


def hierarchical_fill(df: DataFrame, value: str, levels: Sequence[Sequence[str]], default: float, out: str, only: Column | None = None, lookup: dict[str, str] | None = None) -> DataFrame:
    """``out``: the value, else the average of the finest level (group of columns) that has one, else the default.
    ``only`` says which rows may be filled; ``lookup`` names, for a level's column, the column a row is looked up by
    instead.  A level is aggregated before it is joined, so hot groups are no matter;
    rows with a null in a level's columns get nothing from it."""
    filled, source = df, []
    for i, level in enumerate(levels):
        known = df.where(" and ".join(f"`{c}` is not null" for c in [*level, value]))
        means = known.groupBy(*level).agg(F.avg(value).alias(f"_avg{i}"))
        by = [(lookup or {}).get(c, c) for c in level]
        filled = join_spreading_nulls(filled, means.toDF(*by, f"_avg{i}"), by)
        source.append(F.col(f"_avg{i}"))
    best = F.coalesce(F.col(value), *source, F.lit(default))
    best = best if only is None else F.when(F.coalesce(only, F.lit(False)), best).otherwise(F.col(value))
    return filled.withColumn(out, best).select(*df.columns, *([out] if out not in df.columns else []))


def categorise_days(days: DataFrame, shifts: DataFrame, swipes: DataFrame) -> DataFrame:
    """``days`` (member, day, shift, dur, vac, unpaid, noshow, sick; one or more rows a day) with ``category``, ``work``
    and ``firstSwipe``.  ``shifts``: member, day of real shifts; ``swipes``: member, day, at of clock-ins.

    real_shift: a shift exists for the member and day, whatever else is said; else planned_absence: vacation or unpaid;
    else expected_work: both flags are known to be off, and the day has a no-show, sick time, a shift or a swipe; else
    other_days.  Expected work is complete with shift and duration, needs_filling without one of them but with a
    swipe, else incomplete.  Both lookups are one row per member and day before they are joined.
    """
    key = ["member", "day"]
    real = shifts.select(*key).where("member is not null and day is not null").distinct().withColumn("_real", F.lit(True))
    first = swipes.where("member is not null and day is not null").groupBy(*key).agg(F.min("at").alias("firstSwipe"))
    joined = days.join(real, key, "left").join(first, key, "left")
    swiped = F.col("firstSwipe").isNotNull()
    off = (F.col("vac") != 1) & (F.col("unpaid") != 1)  # null, so false, where a flag is unknown
    expected = off & (F.coalesce(F.col("noshow") == 1, F.lit(False)) | F.coalesce(F.col("sick") == 1, F.lit(False)) | F.col("shift").isNotNull() | swiped)
    category = F.when(F.col("_real"), "real_shift").when((F.col("vac") == 1) | (F.col("unpaid") == 1), "planned_absence").when(expected, "expected_work").otherwise("other_days")
    known = F.col("shift").isNotNull() & F.col("dur").isNotNull()
    work = F.when(F.col("category") == "expected_work", F.when(known, "complete").when(swiped, "needs_filling").otherwise("incomplete"))
    return joined.withColumn("category", category).withColumn("work", work).drop("_real")


def infer_shifts(days: DataFrame, shift_of: Column, default: float = 8.5) -> DataFrame:
    """Of :func:`categorise_days`: ``shift`` and ``hours`` as they are to be used.  Days that need filling get the shift
    ``shift_of`` (from their first swipe) if they have none, and the average length of that shift on that day in their department and
    site, else in their site, else the default.  Planned absence has neither; all other days stay as they are."""
    needs = F.coalesce(F.col("work") == "needs_filling", F.lit(False))
    updated = F.when(needs, F.coalesce("shift", shift_of)).otherwise(F.col("shift"))
    given = days.withColumn("_shift", updated)
    levels = [["dept", "loc", "shift", "day"], ["loc", "shift", "day"]]
    out = hierarchical_fill(given, "dur", levels, default, "_hours", only=needs, lookup={"shift": "_shift"})
    away = F.col("category") == "planned_absence"
    return out.withColumns({"shift": F.when(~away, F.col("_shift")), "hours": F.when(~away, F.col("_hours"))}).drop("_shift", "_hours")


def neighbours(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], value: str, steps: int = 2) -> DataFrame:
    """``_prev1.., _next1..``: the value up to ``steps`` rows before and after within the group, whatever its size.

    ``bucket`` (not falling along ``order``) cuts a group; neighbours are sought within the bucket.  A bucket's first
    and last rows find the rest among the edge rows of all buckets of the group, which follow one another there.
    """
    held = F.struct(F.lit(True).alias("there"), F.col(value).alias("v"))
    inside, down = ordered([*by, "_bucket"], order), ordered([*by, "_bucket"], [F.desc(c) for c in order])
    df = df.withColumns({"_bucket": bucket, "_held": held})
    near = {f"_{n}{k}": f(F.col("_held"), k).over(inside) for k in range(1, steps + 1) for n, f in (("prev", F.lag), ("next", F.lead))}
    edge = (F.row_number().over(inside) <= steps) | (F.row_number().over(down) <= steps)
    df = df.withColumns({**near, "_lane": F.when(~edge, F.col("_bucket"))})
    along = ordered([*by, "_lane"], order)
    far = {c: F.coalesce(F.col(c), F.when(F.col("_lane").isNull(), f(F.col("_held"), k).over(along))) for k in range(1, steps + 1) for c, f in ((f"_prev{k}", F.lag), (f"_next{k}", F.lead))}
    df = df.withColumns(far)
    return df.withColumns({c: F.col(f"{c}.v") for c in near}).drop("_bucket", "_held", "_lane")


def neighbour_repair(df: DataFrame, by: Sequence[str], bucket: Column, order: Sequence[str], value: str, low: float, high: float, default: float, out: str) -> DataFrame:
    """``out``: values outside low..high become the mean of both neighbours, else the one there is, else the same two
    steps away, else the default.  Neighbours are raw values; null stays null."""
    p1, n1, p2, n2 = (F.col(c) for c in ("_prev1", "_next1", "_prev2", "_next2"))
    repaired = F.coalesce((p1 + n1) / 2, p1, n1, (p2 + n2) / 2, p2, n2, F.lit(default))
    fixed = F.when((F.col(value) < low) | (F.col(value) > high), repaired).otherwise(F.col(value))
    return neighbours(df, by, bucket, order, value).withColumn(out, fixed).drop("_prev1", "_next1", "_prev2", "_next2")


def group_first_fill(df: DataFrame, value: str, group: Sequence[str], default: str, out: str) -> DataFrame:
    """The value, else the smallest of its group (deterministic, unlike "any"), else the default."""
    least = df.where(f"`{value}` is not null").groupBy(*group).agg(F.min(value).alias("_least"))
    return join_spreading_nulls(df, least, list(group)).withColumn(out, F.coalesce(value, "_least", F.lit(default))).drop("_least")
