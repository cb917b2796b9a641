"""Joins in time: as-of, interval-nearest, sequence pairing, precedence.

None of them makes pairs within an entity and filters them: each is a sort by time within entity and time bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.blocks import numbers, whole_groups


HOT_ROWS = 200_000  # rows of one key that are too many for one task
MOST_HOT = 1 << 16


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str],
    tie: Sequence[str] = (), forward_fallback: bool = False, bucket: int = 64,
) -> DataFrame:
    """``left`` with ``values`` of the right row of equal ``by`` that is latest at or before the left time; with
    ``forward_fallback`` the earliest later one where there is none.  Times are dates or whole numbers.

    Of right rows at one time the one greatest in ``tie`` is taken, before left rows at that time are served.  Left
    rows without partner, with null time or null keys keep nulls.  A long-lived key is cut into buckets of time; what
    a bucket inherits comes from the last (first) right row of the buckets before (after), one small row each.  Buckets
    in which left rows pile up are spread over more tasks, and only their right rows copied as often.
    """
    number = lambda df, c: F.unix_date(c).cast("long") if dict(df.dtypes)[c] == "date" else F.col(c).cast("long")
    group = [*by, "_b", "_salt"]
    back, ahead = Window.partitionBy(*group).orderBy("_t", "_side"), Window.partitionBy(*group).orderBy(F.col("_t").desc(), F.col("_side").desc())
    pick = F.struct(F.lit(True).alias("_hit"), *values)
    rows = right.select(*by, number(right, right_time).alias("_t"), F.struct(*tie).alias("_tie") if tie else F.lit(0).alias("_tie"), pick.alias("_v")).where("_t is not null")
    rows = rows.groupBy(*by, "_t").agg(F.max_by("_v", "_tie").alias("_v")).withColumn("_b", F.floor(F.col("_t") / bucket).cast("long"))
    wanted = left.withColumn("_t", number(left, left_time)).withColumn("_b", F.floor(F.col("_t") / bucket).cast("long"))
    ends = rows.groupBy(*by, "_b").agg(F.max_by("_v", "_t").alias("_last"), F.min_by("_v", "_t").alias("_first"))
    stops = ends.unionByName(wanted.select(*by, "_b").where("_b is not null").distinct().withColumns({"_last": F.lit(None).cast(ends.schema["_last"].dataType), "_first": F.lit(None).cast(ends.schema["_first"].dataType)}))
    stops = stops.groupBy(*by, "_b").agg(F.first("_last", ignorenulls=True).alias("_last"), F.first("_first", ignorenulls=True).alias("_first"))
    chain = Window.partitionBy(*by).orderBy("_b")
    stops = stops.withColumn("_in", F.last("_last", ignorenulls=True).over(chain.rowsBetween(Window.unboundedPreceding, -1)))
    stops = stops.withColumn("_out", F.first("_first", ignorenulls=True).over(chain.rowsBetween(1, Window.unboundedFollowing)))
    row = F.struct(*[F.col(c) for c in left.columns])
    kind_row, kind_v = wanted.select(row.alias("r")).schema["r"].dataType, rows.schema["_v"].dataType
    none_row, none_v = F.lit(None).cast(kind_row).alias("_row"), F.lit(None).cast(kind_v).alias("_v")
    edge = lambda side: F.lit(side).alias("_side")
    parts = [
        rows.select(*by, "_b", "_t", edge(1), "_v", none_row),
        stops.where("_in is not null").select(*by, "_b", (F.col("_b") * bucket - 1).alias("_t"), edge(0), F.col("_in").alias("_v"), none_row),
    ]
    if forward_fallback:
        parts.append(stops.where("_out is not null").select(*by, "_b", ((F.col("_b") + 1) * bucket).alias("_t"), edge(3), F.col("_out").alias("_v"), none_row))
    swept = parts[0]
    for p in parts[1:]:
        swept = swept.unionByName(p)
    asked = wanted.select(*by, "_b", "_t", edge(2), none_v, row.alias("_row"))
    heavy = heavy_keys(wanted, [*by, "_b"])
    swept = with_salt(swept, [*by, "_b"], heavy, copy=True).unionByName(with_salt(asked, [*by, "_b"], heavy, copy=False))
    hit = F.last("_v", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    if forward_fallback:
        hit = F.coalesce(hit, F.last("_v", ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    placed = F.col("_t").isNotNull()
    for c in by:
        placed = placed & F.col(c).isNotNull()
    return swept.withColumn("_hit", F.when(placed, hit)).where("_row is not null").select("_row.*", *[F.col(f"_hit.{v}").alias(v) for v in values])


def heavy_keys(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, _copies``: the keys with more than HOT_ROWS rows, the heaviest MOST_HOT of them, and by how many tasks each
    is to be shared so that none has more; keys beyond those have less than a MOST_HOT-th of all rows.  Counted
    on the map side, so a hot key is one row a task; small enough to broadcast."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS)
    return counts.orderBy(F.desc("_n")).limit(MOST_HOT).select(*by, F.least(F.ceil(F.col("_n") / HOT_ROWS), F.lit(4096)).cast("int").alias("_copies"))


def with_salt(df: DataFrame, by: Sequence[str], heavy: DataFrame, copy: bool) -> DataFrame:
    """``df`` with ``_salt``: rows of a heavy key spread by a hash, or, with ``copy``, repeated for every salt; 0 elsewhere."""
    names = [f"_h{i}" for i in range(len(by))]
    same = F.lit(True)
    for c, h in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(h))
    tagged = df.join(F.broadcast(heavy.toDF(*names, "_copies")), same, "left")
    copies = F.coalesce("_copies", F.lit(1))
    salt = F.explode(F.sequence(F.lit(0), copies - 1)) if copy else F.pmod(F.xxhash64(*df.columns), copies).cast("int")
    return tagged.withColumn("_salt", salt).drop(*names, "_copies")


def salted_lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``df`` LEFT JOIN ``table`` on ``key``, where the table has each key once and the rows may pile up on one key
    (null included): the rows of heavy keys are spread over as many tasks as their number asks for, and only the
    table's rows of those keys are copied as often."""
    heavy = heavy_keys(df, [key])
    spread, copies = with_salt(df, [key], heavy, copy=False), with_salt(table, [key], heavy, copy=True)
    return spread.join(copies, [key, "_salt"], "left").drop("_salt")


def join_spreading_nulls(df: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` LEFT JOIN ``table`` on ``by``; rows with a null there match nothing and are spread instead of meeting in one task."""
    missing = F.lit(False)
    for c in by:
        missing = missing | F.col(c).isNull()
    spread = df.withColumn("_null", F.when(missing, F.pmod(F.xxhash64(*df.columns), F.lit(1024)) + 1).otherwise(0).cast("int"))
    return spread.join(table.withColumn("_null", F.lit(0)), [*by, "_null"], "left").drop("_null")


def _first_at_or_below(tree: np.ndarray, leaves: int, begin: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For every query the first leaf >= begin whose value is <= limit, or ``leaves``; all queries climb and descend
    the min-tree together."""
    node = begin + leaves
    ends = begin >= leaves
    node[ends] = 2 * leaves - 1
    found = ~ends & (tree[node] <= limit)
    active = ~ends & ~found
    while active.any():  # climb until the right sibling's subtree has a value low enough
        idx = np.flatnonzero(active)
        n = node[idx]
        root = n <= 1
        active[idx[root]] = False
        idx, n = idx[~root], n[~root]
        left = (n & 1) == 0
        sibling = n + 1
        good = left & (tree[np.where(left, sibling, n)] <= limit[idx])
        found[idx[good]] = True
        active[idx[good]] = False
        node[idx] = np.where(good, sibling, n >> 1)
    idx = np.flatnonzero(found)
    while len(idx):
        inner = node[idx] < leaves
        idx = idx[inner]
        if not len(idx):
            break
        child = node[idx] * 2
        node[idx] = np.where(tree[child] <= limit[idx], child, child + 1)
    return np.where(found, node - leaves, leaves)


def nearest_holding(t: np.ndarray, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """For every time the index of the interval lo..hi that holds it and whose anchor (within lo..hi) is nearest,
    or -1; intervals come sorted by anchor, of equally near ones the first is taken."""
    k = len(anchor)
    if not k:
        return np.full(len(t), -1)
    leaves = 1 << max(k - 1, 1).bit_length()

    def min_tree(values: np.ndarray) -> np.ndarray:
        tree = np.full(2 * leaves, np.iinfo(np.int64).max)
        tree[leaves : leaves + k] = values
        level = leaves
        while level > 1:
            half = level // 2
            tree[half:level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level = half
        return tree

    at = np.searchsorted(anchor, t, side="left")  # anchors from here on are at or after t: lo must be at or before
    later = _first_at_or_below(min_tree(lo), leaves, at.astype(np.int64), t)
    back = _first_at_or_below(min_tree(-hi[::-1]), leaves, (k - at).astype(np.int64), -t)
    earlier = k - 1 - back
    has_l, has_e = later < k, (back < k)
    gap_l = np.where(has_l, anchor[np.minimum(later, k - 1)] - t, np.iinfo(np.int64).max)
    gap_e = np.where(has_e, t - anchor[np.maximum(earlier, 0)], np.iinfo(np.int64).max)
    # the first of several intervals with the earlier anchor
    same = np.searchsorted(anchor, anchor[np.maximum(earlier, 0)], side="left")
    fits = hi[np.minimum(same, k - 1)] >= t
    earlier = np.where(has_e & fits, same, earlier)
    return np.where(gap_e <= gap_l, np.where(has_e, earlier, -1), later)


def _nearest_worker(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All groups of a piece are searched at once: their times are laid end to end, each group in a stretch of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ("entity", "bucket")):
            is_point = numbers(rows, "point").astype(bool)
            valid = ~is_point | np.asarray(pc.is_valid(rows.column("at")).to_numpy() & pc.is_valid(rows.column("entity")).to_numpy())
            at, lo, hi, ident, bucket = (np.where(valid, numbers(rows, c).astype(np.int64), 0) for c in ("at", "lo", "hi", "id", "bucket"))
            lo, hi = np.where(is_point, at, lo), np.where(is_point, at, hi)
            base = bucket * width
            at_, lo, hi = at - base, lo - base, hi - base
            most = int(max(np.abs(at_).max(), np.abs(lo).max(), np.abs(hi).max())) + 1
            stretch = 2 * most + 1
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
            right, gap = np.zeros(rows.num_rows, np.int64), np.full(rows.num_rows, -1, np.int64)
            step = max(1, (1 << 61) // stretch)
            for first in range(0, len(starts), step):
                inside = (group >= first) & (group < first + step)
                offset = (group - first) * stretch + most
                p, s = np.flatnonzero(inside & is_point & valid), np.flatnonzero(inside & ~is_point)
                if len(p) and len(s):
                    hit = nearest_holding((at_ + offset)[p], (lo + offset)[s], (hi + offset)[s], (at_ + offset)[s])
                    found = hit >= 0
                    right[p[found]] = ident[s[hit[found]]]
                    gap[p[found]] = np.abs(at[p[found]] - at[s[hit[found]]])
            points = np.flatnonzero(is_point)
            if len(points):
                r, g = right[points], gap[points]
                out = rows.select(["id", "entity", "at"]).take(pa.array(points)).combine_chunks()
                out = out.append_column("_right", pa.array(r, mask=g < 0)).append_column("distance_us", pa.array(g, mask=g < 0))
                yield from out.to_batches()

    return run


def interval_nearest_join(
    points: DataFrame, point_id: str, entity: str, time: str, intervals: DataFrame, interval_id: str, lo: Column, hi: Column, anchor: Column,
    bucket_hours: int = 24,
) -> DataFrame:
    """``point_id, entity, time, interval_id, distance_us`` for every point (time in microseconds): of the intervals of the same ``entity`` (a column of
    both sides) with lo <= time <= hi the one whose ``anchor`` is nearest; of equally near ones the earlier anchor,
    then the smaller id.  The anchor must lie within lo..hi.  Points without interval come out with nulls, points
    with null entity or time too; ids are whole numbers.

    An interval is copied into the time buckets it meets; a bucket is searched with a tree over the sorted anchors.
    """
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    width = bucket_hours * 3_600_000_000
    of = lambda c: F.floor(c / F.lit(width)).cast("long")
    spans = intervals.select(F.col(entity).alias("entity"), F.col(interval_id).cast("long").alias("id"), us(lo).alias("lo"), us(hi).alias("hi"), us(anchor).alias("at"))
    spans = spans.where("entity is not null and id is not null and lo <= at and at <= hi").withColumn("bucket", F.explode(F.sequence(of(F.col("lo")), of(F.col("hi")))))
    at = us(F.col(time))
    where = points.select(F.col(entity).alias("entity"), F.col(point_id).cast("long").alias("id"), at.alias("at"))
    # A point that can match nothing is spread by its id instead of meeting the others at null.
    bucket = F.when(F.col("entity").isNotNull() & F.col("at").isNotNull(), of(F.col("at"))).otherwise(F.col("id"))
    where = where.select("entity", bucket.alias("bucket"), F.lit(True).alias("point"), "at", F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"), "id")
    merged = spans.select("entity", "bucket", F.lit(False).alias("point"), "at", "lo", "hi", "id").unionByName(where)
    merged = merged.repartition("entity", "bucket").sortWithinPartitions("entity", "bucket", "at", "id")
    kind = merged.schema["entity"].dataType.simpleString()
    out = merged.mapInArrow(_nearest_worker(width), f"id long, entity {kind}, at long, _right long, distance_us long")
    return out.select(F.col("id").alias(point_id), F.col("entity").alias(entity), F.col("at").alias(time), F.col("_right").alias(interval_id), "distance_us")


def pair_sequences(
    opens: DataFrame, closes: DataFrame, by: Sequence[str], time: str, least_seconds: int, most_seconds: int
) -> DataFrame:
    """``by, open_at, close_at``: per group the first opening event that has a closing one ``least..most`` seconds
    later, with the nearest such closing.  Works on distinct times of a small group (an entity's day), joined on the
    group and on a time bucket of ``most`` seconds, so no opening meets closings further away than two buckets."""
    us = lambda: F.unix_seconds(F.col(time).cast("timestamp"))
    a = opens.select(*by, F.col(time).alias("open_at"), us().alias("_o")).distinct().withColumn("_b", F.explode(F.array(F.floor(F.col("_o") / most_seconds), F.floor(F.col("_o") / most_seconds) + 1)))
    b = closes.select(*by, F.col(time).alias("close_at"), us().alias("_c")).distinct().withColumn("_b", F.floor(F.col("_c") / most_seconds))
    gap = F.col("_c") - F.col("_o")
    fits = a.join(b, [*by, "_b"]).where((gap >= least_seconds) & (gap <= most_seconds))
    return fits.groupBy(*by).agg(F.min_by(F.struct("open_at", "close_at"), F.struct("_o", "_c")).alias("p")).select(*by, "p.*")


def prefer(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of ``first``, and those of ``second`` whose keys do not occur there."""
    return first.unionByName(second.join(first.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)
