"""Matching records by nearest time.

Method: the right side's times become nearest-neighbour intervals: the stretch of time in which a record is the
nearest one, bounded by the midpoints to its neighbours and by the tolerance.  These intervals are disjoint, so the
range join of the left times needs no pairs: per entity and time bucket, intervals and left times are merged in
order of time, and the last interval begun is the only one that can hold the time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_intervals(right: DataFrame, tolerance: int, bucket: int) -> DataFrame:
    """``entity, t, id`` → ``entity, bucket, lo, hi, t, id``: in bucket ``bucket`` the whole numbers lo..hi are nearer
    to t than to any other t of the entity, or as near and t is the earlier.  Repeated t: the smallest id.

    A record is looked at in its bucket and in every bucket less than twice the tolerance away, where it can still
    bound a neighbour's interval; so buckets need nothing from one another.
    """
    reach = F.lit(2 * tolerance)
    of = lambda c: F.floor(c / F.lit(bucket)).cast("long")
    spread = right.withColumn("bucket", F.explode(F.sequence(of(F.col("t") - reach), of(F.col("t") + reach))))
    points = spread.groupBy("entity", "bucket", "t").agg(F.min("id").alias("id"))
    w = Window.partitionBy("entity", "bucket").orderBy("t")
    points = points.withColumns({"prior": F.lag("t").over(w), "next": F.lead("t").over(w)})
    mid = lambda a, b: a + F.shiftright(b - a, 1)  # floor of the midpoint
    lo = F.greatest(F.col("t") - tolerance, F.col("bucket") * bucket, F.coalesce(mid(F.col("prior"), F.col("t")) + 1, F.col("t") - tolerance))
    hi = F.least(F.col("t") + tolerance, (F.col("bucket") + 1) * bucket - 1, F.coalesce(mid(F.col("t"), F.col("next")), F.col("t") + tolerance))
    return points.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").select("entity", "bucket", "lo", "hi", "t", "id")


def match_nearest_time(
    left: DataFrame, right: DataFrame,
    left_id: str, left_entity: str | Column, left_time: str | Column,
    right_id: str, right_entity: str | Column, right_time: str | Column,
    tolerance_seconds: float, bucket_hours: int = 12,
) -> DataFrame:
    """``left_id, right_id, distance_us`` for every left row: the right row of the same entity whose time is nearest,
    at most ``tolerance_seconds`` before or after; of equally near ones the earlier, then the one with the smaller
    id.  Left rows without such a partner (also those with null entity or time) come out with nulls.

    Repeated left rows are matched each by itself.  Right rows with null entity, time or id match nothing.  Ids are
    numbers; further columns, also of the same names on both sides, are not looked at.  Empty sides give no match.

    Shuffles: right times by entity and bucket, then intervals and left times by entity and bucket.  A hot entity
    is cut into buckets; within a bucket the work is one sort, which spills.  A bucket is at least four tolerances
    long, so a right time is in one bucket or two, whatever the tolerance is.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    unit = lambda c: F.unix_micros(as_col(c).cast("timestamp"))
    tolerance = int(round(tolerance_seconds * 1_000_000))
    bucket = max(bucket_hours * 3_600_000_000, 4 * tolerance, 1)
    right = right.select(as_col(right_entity).alias("entity"), unit(right_time).alias("t"), F.col(right_id).cast("long").alias("id"))
    intervals = nearest_intervals(right.where("entity is not null and t is not null and id is not null"), tolerance, bucket)
    left = left.select(as_col(left_entity).alias("entity"), unit(left_time).alias("at"), F.col(left_id).cast("long").alias("left"))
    index = intervals.select("entity", "bucket", F.col("lo").alias("at"), F.lit(None).cast("long").alias("left"), F.struct("hi", "t", "id").alias("interval"))
    # A left row that can match nothing is spread by its id instead of meeting the others at null.
    placed = F.col("entity").isNotNull() & F.col("at").isNotNull()
    probes = left.select(
        F.when(placed, F.col("entity")).alias("entity"), F.when(placed, F.floor(F.col("at") / F.lit(bucket)).cast("long")).otherwise(F.col("left")).alias("bucket"),
        F.when(placed, F.col("at")).alias("at"), "left", F.lit(None).cast("struct<hi:bigint,t:bigint,id:bigint>").alias("interval"),
    )
    in_time = Window.partitionBy("entity", "bucket").orderBy("at", F.col("left").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    probes = index.unionByName(probes).withColumn("last", F.last("interval", ignorenulls=True).over(in_time)).where("interval is null")
    hit = (F.col("at") <= F.col("last.hi")) & F.col("entity").isNotNull()
    return probes.select(
        F.col("left").alias(left_id), F.when(hit, F.col("last.id")).alias(right_id), F.when(hit, F.abs(F.col("at") - F.col("last.t"))).alias("distance_us"),
    )
