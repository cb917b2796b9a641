"""Overlapping and gapped time intervals: continuous periods and the gaps between them.

Method: time is cut into exact units (microseconds) and shards.  The set units of an entity in a shard are kept as
a compressed bitmap, that is as its sorted runs of set bits.  Bitmaps are built beside the scan, united per entity
and shard, and their set runs and clear runs read off.  A run that reaches the edge of its shard is tied to its
neighbour through the (at most four) runs at the edges of each shard, so no task ever needs all rows of an entity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.blocks import codes, whole_groups

DAY_US = 86_400_000_000
LOCAL_ROWS = 400_000  # rows of a task that are united at once, before they are shuffled
PERIOD, GAP, EDGE = 0, 1, 2


def united(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open runs sorted by (group, start): which row opens a run, and the end of the run so far.

    ``group`` counts up from 0; starts and ends are offsets below 2**42.  Runs that touch are one run.
    """
    base = group.astype(np.int64) << 42
    reach = np.maximum.accumulate(base + end)
    opens = np.ones(len(start), bool)
    opens[1:] = (base + start)[1:] > reach[:-1]
    return opens, reach - base


def _local_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Beside the scan: some hundred thousand rows of a task become one bitmap per entity, shard and label."""

    def unite(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        keys = [codes(t, k) for k in ("entity", "shard", "label")]
        start, end = t.column("start").to_numpy(), t.column("end").to_numpy()
        order = np.lexsort((start, *keys[::-1]))
        change = np.zeros(len(order), bool)
        for k in keys:
            change[1:] |= k[order][1:] != k[order][:-1]
        opens, reach = united(np.cumsum(change), start[order], end[order])
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(order)) - 1
        out = t.take(pa.array(order[first])).set_column(t.schema.get_field_index("end"), "end", pa.array(reach[last]))
        yield from out.combine_chunks().to_batches()

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= LOCAL_ROWS:
            yield from unite(held)
            held, n = [], 0
    if held:
        yield from unite(held)


_RUNS = "entity string, lane int, kind int, start long, end long, before_start long, common boolean, labels array<long>, emits boolean, link boolean"
_FOUND = "entity string, kind int, start long, end long, before_start long, common boolean, labels array<long>"


def _pairs(run: np.ndarray, label: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The different (run, label) as sorted numbers: run in the upper half, label (days, shifted) in the lower."""
    return np.unique((run[known].astype(np.int64) << 32) | (label[known] + (1 << 31)))


def _shares(pairs: np.ndarray, n: int) -> np.ndarray:
    """Whether each of ``n`` runs has a label that the run after it has too."""
    after = pairs + (1 << 32)
    at = np.searchsorted(pairs, after)
    hit = np.append(pairs, -1)[np.minimum(at, len(pairs))] == after
    out = np.zeros(n, bool)
    out[pairs[hit] >> 32] = True
    return out


def _lists(pairs: np.ndarray, n: int, of: np.ndarray) -> pa.Array:
    """The labels of the runs ``of`` (some of 0 .. n - 1, rising)."""
    wanted = np.zeros(n, bool)
    wanted[of] = True
    mine = pairs[wanted[pairs >> 32]]
    sizes = np.bincount(mine >> 32, minlength=n)[of]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array((mine & 0xFFFFFFFF) - (1 << 31), pa.int64()))


def _runs(want: frozenset[int], length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by entity, shard and start: set runs and clear runs of the united bitmaps.  What is certain
    within a shard comes out as PERIOD or GAP; the runs a neighbouring shard may go on with, and those a gap at
    them needs, as EDGE.  Only the last two runs, and a batch, are held back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in _then_none(batches):
            if batch is not None and not batch.num_rows:
                continue
            if batch is None and held is None:
                return
            new_rows = 0 if batch is None else batch.num_rows
            if new_rows:
                t = pa.Table.from_batches([batch])
                entity = t.column("entity").combine_chunks()
                entity = pa.concat_arrays(entity.chunks) if isinstance(entity, pa.ChunkedArray) else entity
                shard, start, end = (t.column(c).to_numpy() for c in ("shard", "start", "end"))
                column = t.column("label")
                known = ~np.asarray(column.is_null())
                label = column.fill_null(0).to_numpy()
                code = codes(t, "entity")
                change = np.ones(new_rows, bool)
                change[1:] = (code[1:] != code[:-1]) | (shard[1:] != shard[:-1])
            if held is not None:  # the two runs held back come first, as rows
                back = len(held["start"])
                if new_rows:
                    goes_on = held["entity"] == entity[0].as_py() and held["shard"] == int(shard[0])
                    change[0] = not goes_on
                    entity = pa.concat_arrays([pa.array([held["entity"]] * back, pa.string()), entity])
                    shard, change = np.append(np.full(back, held["shard"], np.int32), shard), np.concatenate([[True], np.zeros(back - 1, bool), change])
                    start, end, label, known = (np.append(held[k], x) for k, x in (("start", start), ("end", end), ("label", label), ("known", known)))
                else:
                    entity, shard, change = pa.array([held["entity"]] * back, pa.string()), np.full(back, held["shard"], np.int32), np.append(True, np.zeros(back - 1, bool))
                    start, end, label, known = (held[k] for k in ("start", "end", "label", "known"))
            group = np.cumsum(change) - 1
            opens, reach = united(group, start, end)
            first = np.flatnonzero(opens)
            r_start, r_end, r_group = start[first], reach[np.append(first[1:], len(start)) - 1], group[first]
            n = len(first)
            pairs = _pairs(np.cumsum(opens) - 1, label, known)
            common = _shares(pairs, n)
            size = np.bincount(r_group)
            index = np.arange(n) - np.append(0, np.cumsum(size)[:-1])[r_group]
            left_open = r_start[np.append(0, np.cumsum(size)[:-1])] == 0  # of each group's first run
            if held is not None:  # runs of its group that have come out before
                index = index + np.where(r_group == 0, held["emitted"], 0)
                if held["emitted"]:
                    left_open[0] = held["left_open"]
            total = size + np.where(np.arange(len(size)) == 0, held["emitted"] if held is not None else 0, 0)
            n_of = total[r_group]
            whole = batch is None  # whether the last group has ended
            right_open = r_end[np.cumsum(size) - 1] == length
            g_last = len(size) - 1
            done = np.ones(n, bool)
            if not whole:
                done[max(n - 2, n - size[g_last]) :] = False
                n_of = np.where(r_group == g_last, np.int64(1) << 40, n_of)  # not known yet
            by_left = (index == 0) & left_open[r_group]
            to_last = index + 1 == n_of - 1
            before_open = by_left | (to_last & right_open[r_group])  # the gap after it is no certain one
            has_next = np.append(r_group[1:] == r_group[:-1], False)
            origin = shard[first].astype(np.int64) * length
            a_start, a_end = r_start + origin, r_end + origin

            def rows(kind: int, at: np.ndarray, lane: bool, **cols: pa.Array | np.ndarray) -> pa.RecordBatch:
                k = len(at)
                given = {
                    "entity": entity.take(pa.array(first[at])), "lane": pa.array(shard[first[at]], pa.int32()) if lane else pa.nulls(k, pa.int32()), "kind": pa.array(np.full(k, kind, np.int32)),
                    "before_start": pa.nulls(k, pa.int64()), "common": pa.nulls(k, pa.bool_()), "labels": pa.nulls(k, pa.list_(pa.int64())), "emits": pa.nulls(k, pa.bool_()), "link": pa.nulls(k, pa.bool_()), **cols,
                }
                names = ["entity", "lane", "kind", "start", "end", "before_start", "common", "labels", "emits", "link"]
                return pa.RecordBatch.from_arrays([x if isinstance(x := given[c], pa.Array) else pa.array(x) for c in names], names)

            closed = (r_start > 0) & (r_end < length)
            if PERIOD in want:
                at = np.flatnonzero(done & closed)
                if len(at):
                    yield rows(PERIOD, at, True, start=a_start[at], end=a_end[at], labels=_lists(pairs, n, at))
            if GAP in want:
                at = np.flatnonzero(done & has_next & ~before_open)
                if len(at):
                    yield rows(GAP, at, True, start=a_end[at], end=a_start[at + 1], before_start=a_start[at], common=common[at])
            second, second_last = (index == 1) & left_open[r_group], (index == n_of - 2) & right_open[r_group]
            at_end = index == n_of - 1
            at = np.flatnonzero(done & ((index == 0) | at_end | second | second_last))
            if len(at):
                yield rows(EDGE, at, False, start=a_start[at], end=a_end[at], labels=_lists(pairs, n, at), emits=~closed[at], link=((index == 0) | second | (at_end & right_open[r_group]))[at])
            if whole:
                return
            keep = np.flatnonzero(~done)
            of_run = np.cumsum(opens) - 1
            mine = pairs[(pairs >> 32) >= keep[0]]
            bare = np.setdiff1d(keep, mine >> 32)  # without label
            run = np.concatenate([mine >> 32, bare])
            order = np.argsort(run, kind="stable")
            run = run[order]
            held = {
                "entity": entity[int(np.flatnonzero(of_run == keep[0])[0])].as_py(), "shard": int(shard[-1]), "start": r_start[run], "end": r_end[run],
                "label": np.concatenate([(mine & 0xFFFFFFFF) - (1 << 31), np.zeros(len(bare), np.int64)])[order], "known": np.concatenate([np.ones(len(mine), bool), np.zeros(len(bare), bool)])[order],
                "emitted": int(index[keep[0]]), "left_open": bool(left_open[g_last]),
            }

    return work


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _across(want: frozenset[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows of :func:`_runs` sorted by entity, lane and start: what is certain goes through; edge runs that touch
    become one period, and gaps between periods of different shards are read off."""
    names = ["entity", "kind", "start", "end", "before_start", "common", "labels"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_groups(batches, ("entity", "lane")):
            kind = t.column("kind").to_numpy()
            certain = t.filter(pa.array(kind != EDGE)).select(names).combine_chunks()
            yield from certain.to_batches()
            t = t.filter(pa.array(kind == EDGE)).combine_chunks()
            if not t.num_rows:
                continue
            entity = t.column("entity").combine_chunks()
            entity = pa.concat_arrays(entity.chunks) if isinstance(entity, pa.ChunkedArray) else entity
            start, end = t.column("start").to_numpy(), t.column("end").to_numpy()
            emits, link = (np.asarray(t.column(c)) for c in ("emits", "link"))
            code = codes(t, "entity")
            same = np.append(False, code[1:] == code[:-1])
            fresh = ~(same & link & np.append(False, start[1:] == end[:-1]))
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(start)) - 1
            n = len(first)
            period = np.cumsum(fresh) - 1
            lists = t.column("labels").combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            pairs = _pairs(np.repeat(period, sizes), lists.flatten().to_numpy(), np.ones(int(sizes.sum()), bool))

            def rows(kind: int, at: np.ndarray, **cols: pa.Array | np.ndarray) -> pa.RecordBatch:
                k = len(at)
                given = {"entity": entity.take(pa.array(first[at])), "kind": pa.array(np.full(k, kind, np.int32)), "before_start": pa.nulls(k, pa.int64()), "common": pa.nulls(k, pa.bool_()), "labels": pa.nulls(k, pa.list_(pa.int64())), **cols}
                return pa.RecordBatch.from_arrays([x if isinstance(x := given[c], pa.Array) else pa.array(x) for c in names], names)

            if PERIOD in want:
                at = np.flatnonzero(np.logical_or.reduceat(emits, first))
                if len(at):
                    yield rows(PERIOD, at, start=start[first[at]], end=end[last[at]], labels=_lists(pairs, n, at))
            if GAP in want:
                at = np.flatnonzero(np.append((same & link)[first[1:]], False))  # the period after it follows directly
                if len(at):
                    yield rows(GAP, at, start=end[last[at]], end=start[first[at + 1]], before_start=start[first[at]], common=_shares(pairs, n)[at])

    return work


def periods_and_gaps(
    df: DataFrame, entity: str | Column, start: str | Column, end: str | Column, label: str | Column | None = None, shard_days: int = 28
) -> dict[str, DataFrame]:
    """Continuous periods of each entity's intervals, the gaps between them, and the labels each period holds.

    ``start`` and ``end`` are timestamps (half-open; intervals that touch are continuous), ``label`` any date.
    Result, times as microseconds since 1970; each of the three is a plan of its own:
      ``periods`` entity, period_start, period_end;
      ``gaps``    entity, gap_start, gap_end, before_start (the start of the period before the gap), common (whether
                  the periods before and after it hold a common label);
      ``labels``  entity, period_start, label (days since 1970; once per period and non-null label).

    Rows without entity, start or end, or with an end not after the start, take no part.  Repeated rows change
    nothing; an empty table gives empty results; other columns are not looked at.  An interval is cut at the
    shards it crosses, so its cost grows with its length in shards (at most 50 days long).

    Shuffles: the bitmaps by entity and shard; what was read off them by entity and shard again, only the edge
    runs (two a shard, mostly) by entity.  Bitmaps are built beside the scan over LOCAL_ROWS rows at once, so of a hot
    entity a task sends no more than its runs per shard and label, however many rows it has; a task that unites
    them streams, and holds two runs.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    unit = lambda c: F.unix_micros(as_col(c).cast("timestamp"))
    length = min(shard_days, 50) * DAY_US
    rows = df.select(
        as_col(entity).cast("string").alias("entity"), unit(start).alias("s"), unit(end).alias("e"),
        (F.lit(None).cast("long") if label is None else F.unix_date(as_col(label).cast("date")).cast("long")).alias("label"),
    ).where(F.col("entity").isNotNull() & (F.col("e") > F.col("s")))
    shard_of = lambda c: F.floor(c / F.lit(length)).cast("int")
    pieces = rows.withColumn("shard", F.explode(F.sequence(shard_of(F.col("s")), shard_of(F.col("e") - 1))))
    origin = F.col("shard").cast("long") * length
    pieces = pieces.select(
        "entity", "shard", "label", F.greatest(F.col("s") - origin, F.lit(0).cast("long")).alias("start"), F.least(F.col("e") - origin, F.lit(length)).alias("end")
    )

    def found(*kinds: int) -> DataFrame:
        bitmaps = pieces.mapInArrow(_local_bitmaps, pieces.schema).repartition("entity", "shard").sortWithinPartitions("entity", "shard", "start")
        runs = bitmaps.mapInArrow(_runs(frozenset(kinds), length), _RUNS).repartition("entity", "lane").sortWithinPartitions("entity", "lane", "start")
        return runs.mapInArrow(_across(frozenset(kinds)), _FOUND)

    periods = found(PERIOD)
    return {
        "periods": periods.select("entity", F.col("start").alias("period_start"), F.col("end").alias("period_end")),
        "gaps": found(GAP).select("entity", F.col("start").alias("gap_start"), F.col("end").alias("gap_end"), "before_start", "common"),
        "labels": periods.select("entity", F.col("start").alias("period_start"), F.explode("labels").alias("label")),
    }


def gaps_within_label(found: dict[str, DataFrame]) -> DataFrame:
    """Of :func:`periods_and_gaps`: the gaps whose periods before and after hold a common label."""
    return found["gaps"].where("common").drop("common")
