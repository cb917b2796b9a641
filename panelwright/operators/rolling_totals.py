"""Rolling totals over trailing periods, days without activity included.

Method: entities are packed by days into dense blocks (rows: entity and time tile, columns: the tile's days after
a halo of preceding days) and multiplied by one banded window operator per period.  The tile splits long-lived
entities; the halo makes every tile independent of the others, so nothing has to be carried from task to task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.blocks import numbers, whole_groups


def banded_operator(tile: int, halo: int, windows: Sequence[int]) -> np.ndarray:
    """(halo + tile) x (windows * tile): column j of window w sums the w days before day j of the tile."""
    day = np.arange(halo + tile)[:, None]
    at = np.arange(tile)[None, :] + halo
    return np.concatenate([((day >= at - w) & (day < at)).astype(np.float64) for w in windows], axis=1)


def _packer(tile: int, windows: tuple[int, ...], carried: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    halo = max(windows)
    width = halo + tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = banded_operator(tile, halo, windows)
        for rows, starts in whole_groups(batches, ("entity", "tile")):
            n = len(starts)
            owner = np.repeat(np.arange(n), np.diff(np.append(starts, rows.num_rows)))
            is_span = numbers(rows, "span").astype(bool)
            lo, hi = np.full(n, 1, np.int64), np.full(n, 0, np.int64)  # a group without its span row lies outside it
            lo[owner[is_span]] = numbers(rows, "lo")[is_span]
            hi[owner[is_span]] = numbers(rows, "hi")[is_span]
            first = numbers(rows, "tile").astype(np.int64)[starts] * tile
            data = ~is_span
            who, at = owner[data], numbers(rows, "day").astype(np.int64)[data] - first[owner[data]] + halo
            block = np.bincount(who * width + at, weights=numbers(rows, "value")[data], minlength=n * width).reshape(n, width)
            totals = (block @ band).reshape(n, len(windows), tile)
            days = first[:, None] + np.arange(tile)[None, :]
            keep = (days >= lo[:, None]) & (days <= hi[:, None])
            if not keep.any():
                continue
            of, _ = np.nonzero(keep)
            out = {"entity": rows.column("entity").combine_chunks().take(pa.array(starts[of])), "day": pa.array(days[keep].astype(np.int32))}
            for k, w in enumerate(windows):
                total = totals[:, k, :][keep]
                out[f"total_{w}d"] = pa.array(total)
                out[f"average_{w}d"] = pa.array(total / w)
            if carried:
                own = at >= halo
                value = np.full(n * tile, np.nan)
                value[who[own] * tile + at[own] - halo] = numbers(rows, "carried", np.nan)[data][own]
                value = value.reshape(n, tile)[keep]
                out["carried"] = pa.array(value, mask=np.isnan(value))
            arrays = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out.values()]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x for x in arrays], list(out))

    return run


def rolling_totals(
    df: DataFrame,
    entity: str | Column,
    day: str | Column,
    value: str | Column,
    windows: Sequence[int] = (7, 30),
    latest_by: Sequence[str] = (),
    carried: str | Column | None = None,
    tile_days: int = 128,
) -> DataFrame:
    """For every entity and every calendar day from its first to its last row: totals and averages of ``value``
    over the days before, the day itself left out.

    Result: ``entity, day, total_{w}d, average_{w}d`` for each w of ``windows`` (and ``carried``, the value of the
    given numeric column on that day, null without a row).  The average is over the calendar days of the period,
    days without a row and days before the first row counting 0.

    Several rows of one entity and day: with ``latest_by`` only the row greatest in these columns counts (nulls
    lowest), without it all add up (``carried`` is then their maximum).  A null value counts 0, NaN too; rows
    without entity or day are no case; an empty table gives an empty result.  Other columns are not looked at.

    Shuffles: one pre-aggregated by entity and day, a thin one of each entity's first and last day, and one by
    entity and tile.  No group is larger than tile + halo rows, whatever an entity holds.
    """
    windows = tuple(sorted(set(int(w) for w in windows)))
    if not windows or windows[0] < 1:
        raise ValueError("windows must be positive numbers of days")
    tile, halo = max(tile_days, windows[-1]), windows[-1]
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    number = as_col(value).cast("double")
    clean = F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(number)
    carry = (F.lit(None) if carried is None else as_col(carried)).cast("double")
    at = as_col(day).cast("date")
    rows = df.select(
        as_col(entity).cast("string").alias("entity"), F.unix_date(at).alias("day"), clean.alias("value"), carry.alias("carried"),
        F.struct(*[F.col(c) for c in latest_by]).alias("rank") if latest_by else F.lit(0).alias("rank"),
    ).where(F.col("entity").isNotNull() & F.col("day").isNotNull())
    if latest_by:
        best = F.max(F.struct("rank", "value", "carried"))
        daily = rows.groupBy("entity", "day").agg(best.alias("b")).select("entity", "day", "b.value", "b.carried")
    else:
        daily = rows.groupBy("entity", "day").agg(F.sum("value").alias("value"), F.max("carried").alias("carried"))
    own = F.floor(F.col("day") / F.lit(tile)).cast("int")
    into = F.pmod(F.col("day"), F.lit(tile))
    placed = daily.select(
        "entity", F.explode(F.when(into >= tile - halo, F.array(own, own + 1)).otherwise(F.array(own))).alias("tile"),
        F.lit(False).alias("span"), "day", "value", "carried", F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"),
    )
    spans = rows.groupBy("entity").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    spans = spans.select(
        "entity", F.explode(F.sequence(F.floor(F.col("lo") / tile).cast("int"), F.floor(F.col("hi") / tile).cast("int"))).alias("tile"),
        F.lit(True).alias("span"), F.lit(None).cast("int").alias("day"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("carried"), "lo", "hi",
    )
    schema = "entity string, day int, " + ", ".join(f"total_{w}d double, average_{w}d double" for w in windows) + (", carried double" if carried is not None else "")
    packed = placed.unionByName(spans).repartition("entity", "tile").sortWithinPartitions("entity", "tile")
    return packed.mapInArrow(_packer(tile, windows, carried is not None), schema).withColumn("day", F.date_from_unix_date("day"))
