"""Repeated consecutive events in sequences: each run of like events becomes one event with count and duration.

Method: optimal segmentation.  The cost of a run is the sum of squared deviations of its events from their mean,
over all (weighted) features; each further run costs a penalty.  The cheapest segmentation of an entity's sequence
is found by dynamic programming over its positions, and a beginning that can never become best again is pruned
(its cost so far, without penalty, exceeds the best cost of the whole).  All entities of a batch go through the
recursion together, as one ragged table of the beginnings still alive.

Two neighbours whose weighted difference is above ``2 * sqrt(2 * penalty)`` are in different runs of every cheapest
segmentation: one of them is further than half of that from the mean of a run with both, and to cut it out saves more
than the two runs more cost.  So a sequence falls into stretches between such steps, which are segmented apart and
exactly.  Equal neighbours are one event that counts several times: no cheapest segmentation parts them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.blocks import numbers, whole_groups


def segment(values: np.ndarray, length: np.ndarray, penalty: float, times: np.ndarray | None = None) -> list[np.ndarray]:
    """``values`` (sequences, longest, features), of which the first ``length`` positions count, each as often as
    ``times`` says: for every sequence the first positions of the runs of its cheapest segmentation.  Of equally cheap
    ones the longer last run."""
    n, longest, _ = values.shape
    times = np.ones((n, longest)) if times is None else times
    sums = np.concatenate([np.zeros((n, 1, values.shape[2])), np.cumsum(values * times[:, :, None], axis=1)], axis=1)
    squares = np.concatenate([np.zeros((n, 1)), np.cumsum((values**2).sum(axis=2) * times, axis=1)], axis=1)
    counts = np.concatenate([np.zeros((n, 1)), np.cumsum(times, axis=1)], axis=1)
    best = np.full((n, longest + 1), np.inf)
    best[:, 0] = -penalty
    back = np.zeros((n, longest + 1), np.int64)
    owner, begin = np.arange(n), np.zeros(n, np.int64)  # sorted by owner, then by beginning
    for t in range(1, longest + 1):
        live = length[owner] >= t
        owner, begin = owner[live], begin[live]
        if not len(owner):
            break
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        who = owner[first]
        total = sums[owner, t] - sums[owner, begin]
        spread = np.maximum(squares[owner, t] - squares[owner, begin] - (total**2).sum(axis=1) / (counts[owner, t] - counts[owner, begin]), 0.0)
        cost = best[owner, begin] + spread
        least = np.minimum.reduceat(cost, first)
        size = np.diff(np.append(first, len(owner)))
        is_best = np.flatnonzero(cost <= np.repeat(least, size) + 1e-9)
        pick = is_best[np.unique(owner[is_best], return_index=True)[1]]
        best[who, t], back[who, t] = cost[pick] + penalty, begin[pick]
        keep = cost <= np.repeat(best[who, t], size) + 1e-9
        owner, begin = np.append(owner[keep], who), np.append(begin[keep], np.full(len(who), t))
        order = np.argsort(owner, kind="stable")
        owner, begin = owner[order], begin[order]
    out = []
    for i in range(n):
        cuts, t = [], int(length[i])
        while t > 0:
            t = int(back[i, t])
            cuts.append(t)
        out.append(np.array(cuts[::-1], np.int64))
    return out


def _steps(x: np.ndarray, penalty: float) -> np.ndarray:
    """Where an event is too far from the one before to share a run with it."""
    return np.append(True, ((x[1:] - x[:-1]) ** 2).sum(axis=1) > 8 * penalty * (1 + 1e-9))


def _first_of_runs(x: np.ndarray, times: np.ndarray, fresh: np.ndarray, penalty: float, left: np.ndarray | None = None) -> np.ndarray:
    """The first events of the runs; ``fresh``: where stretches begin.  Stretches of which the events are ``left`` are
    only taken apart into events of equal values."""
    pieces = np.flatnonzero(fresh | np.append(True, (x[1:] != x[:-1]).any(axis=1)))
    times = np.add.reduceat(times, pieces)
    starts = np.flatnonzero(fresh[pieces])
    length = np.diff(np.append(starts, len(pieces)))
    is_first = np.ones(len(pieces), bool)
    todo = (length > 1) & (True if left is None else ~left[pieces[starts]])
    bits = np.frexp(length.astype(float))[1]  # stretches of like length together, so that no more than half is padding
    for b in np.unique(bits[todo]):
        which = np.flatnonzero(todo & (bits == b))
        at = starts[which][:, None] + np.arange(length[which].max())
        real = np.arange(at.shape[1]) < length[which][:, None]
        at = np.where(real, at, starts[which][:, None])
        values = x[pieces[at]]
        found = segment(values - values[:, :1], length[which], penalty, np.where(real, times[at], 0.0))
        is_first[at[real]] = False
        is_first[np.concatenate([c + starts[i] for c, i in zip(found, which)])] = True
    return pieces[is_first]


def _segmenter(tile: int, n_features: int, scale: tuple[float, ...], penalty: float, absent: tuple[float, ...] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by entity, tile and position → one row per run of the stretches that end within the tile, and one
    per event (equal neighbours are one) of the stretches at its edges, which may go on: ``edge`` 1 at the first, 2 at the last, 3 at both."""
    weight = np.array(scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ("entity", "tile")):
            pos = numbers(rows, "pos").astype(np.int64)
            x = np.stack([numbers(rows, f"f{k}", np.nan) for k in range(n_features)], axis=1)
            seen = np.ones(len(pos), np.int64)
            ends = np.append(starts[1:], len(pos))
            if absent is not None:  # positions without a row, between the entity's first and last, are events of their own
                edge = numbers(rows, "tile").astype(np.int64)[starts] * tile
                lo, hi = (numbers(rows, c).astype(np.int64)[starts] for c in ("lo", "hi"))  # of the span row, the first of its tile
                lo, hi = np.maximum(lo, edge), np.minimum(hi, edge + tile - 1)
                span = hi - lo + 1
                offset = np.append(0, np.cumsum(span))
                data = np.ones(len(pos), bool)
                data[starts] = False
                first_row = np.repeat(np.arange(len(starts)), ends - starts)[data]
                at = offset[first_row] + pos[data] - lo[first_row]
                full = np.tile(np.array(absent), (offset[-1], 1))
                full[at] = np.where(np.isnan(x[data]), np.array(absent), x[data])
                seen = np.zeros(offset[-1], np.int64)
                seen[at] = 1
                owner = np.repeat(np.arange(len(starts)), span)
                pos, x, begins = np.arange(offset[-1]) - offset[owner] + lo[owner], full, offset[:-1]
            else:
                x, begins = np.nan_to_num(x), starts
                owner = np.repeat(np.arange(len(starts)), ends - starts)
            x = x * weight
            fresh = _steps(x, penalty)
            fresh[begins] = True
            stretch = np.cumsum(fresh) - 1
            at_edge = np.zeros(stretch[-1] + 1, np.int64)
            at_edge[stretch[begins]] += 1
            at_edge[stretch[np.append(begins[1:], len(pos)) - 1]] += 2
            edge = at_edge[stretch]
            cut = _first_of_runs(x, np.ones(len(pos)), fresh, penalty, edge > 0)
            last = np.append(cut[1:], len(pos)) - 1
            size = last - cut + 1
            entity = rows.column("entity").combine_chunks().take(pa.array(starts[owner[cut]]))
            entity = pa.concat_arrays(entity.chunks) if isinstance(entity, pa.ChunkedArray) else entity
            no = numbers(rows, "tile").astype(np.int64)[starts[owner[cut]]]
            out = {
                "entity": entity, "lane": pa.array(no, mask=edge[cut] > 0), "tile": pa.array(no), "edge": pa.array(edge[cut]), "first_pos": pa.array(pos[cut]), "last_pos": pa.array(pos[last]),
                "size": pa.array(size), "n": pa.array(np.add.reduceat(seen, cut)),
            }
            for k in range(n_features):
                out[f"v{k}"] = pa.array(np.where(edge[cut] > 0, x[cut, k], np.add.reduceat(x[:, k], cut) / size))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def _joiner(n_features: int, scale: tuple[float, ...], penalty: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of :func:`_segmenter` sorted by entity, lane and position → runs; the stretches at edges are put together
    over all tiles they reach and segmented as one."""
    weight = np.array(scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ("entity", "lane")):
            x = np.stack([numbers(rows, f"v{k}") for k in range(n_features)], axis=1)
            tile, edge, size = (numbers(rows, c).astype(np.int64) for c in ("tile", "edge", "size"))
            done = edge == 0
            fresh = _steps(x, penalty) | done | np.append(True, (tile[1:] == tile[:-1]) & (edge[1:] != edge[:-1]))
            fresh[starts] = True
            cut = _first_of_runs(x, size.astype(float), fresh, penalty)
            last = np.append(cut[1:], len(size)) - 1
            entity = rows.column("entity").combine_chunks().take(pa.array(cut))
            entity = pa.concat_arrays(entity.chunks) if isinstance(entity, pa.ChunkedArray) else entity
            total = np.add.reduceat(size, cut)
            out = {
                "entity": entity, "run_start": pa.array(numbers(rows, "first_pos").astype(np.int64)[cut]), "run_end": pa.array(numbers(rows, "last_pos").astype(np.int64)[last]),
                "n_events": pa.array(np.add.reduceat(numbers(rows, "n").astype(np.int64), cut)),
            }
            for k in range(n_features):
                out[f"v{k}"] = pa.array(np.add.reduceat(x[:, k] * size, cut) / total / weight[k])
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def collapse_runs(
    df: DataFrame, entity: str | Column, position: str | Column, features: dict[str, tuple[str | Column, float]],
    penalty: float = 1.0, absent: dict[str, float] | None = None, latest_by: Sequence[str] = (), tile: int = 64,
) -> DataFrame:
    """One row per run: ``entity, run_start, run_end`` (first and last position), ``n_events`` (rows in it),
    ``duration`` (positions from first to last), and ``mean_{feature}``.

    ``position`` is a whole number (a day, a step); events follow one another in its order.  ``features`` maps a
    name to a numeric column and its weight: two events whose weighted features differ by more than
    ``2 * sqrt(2 * penalty)`` never share a run.  With ``absent`` a position without a row, between the entity's first and last row, is an
    event with these values, else events are neighbours whatever lies between.

    Rows with null entity or position are no events; a null or NaN feature has the value of ``absent`` (else 0);
    of rows that repeat an entity and position the one greatest in ``latest_by`` counts, or without it the greatest values; an empty table gives no runs.

    The runs are the cheapest segmentation of the whole sequence, whatever ``tile`` is.  Sequences are cut into tiles of
    ``tile`` positions; stretches that end within a tile are segmented there, the others as a whole, over the tiles they
    reach.  So a long sequence is many tasks, and only the events of the stretches at edges (two a tile) meet by entity;
    a stretch without a large step is segmented by one task, however long it is.
    """
    names = list(features)
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    value = {n: as_col(c).cast("double") for n, (c, _) in features.items()}
    rank = F.struct(*latest_by) if latest_by else F.lit(0)
    events = df.select(as_col(entity).cast("string").alias("entity"), as_col(position).cast("long").alias("pos"), rank.alias("rank"), *[F.when(~F.isnan(value[n]), value[n]).alias(f"f{k}") for k, n in enumerate(names)])
    events = rows = events.where("entity is not null and pos is not null").withColumn("tile", F.floor(F.col("pos") / tile).cast("long"))
    fs = [f"f{k}" for k in range(len(names))]
    if latest_by:
        events = events.groupBy("entity", "tile", "pos").agg(F.max(F.struct("rank", *fs)).alias("b")).select("entity", "tile", "pos", *[f"b.{f}" for f in fs])
    else:
        events = events.groupBy("entity", "tile", "pos").agg(*[F.max(f).alias(f) for f in fs])
    schema = "entity string, lane long, tile long, edge long, first_pos long, last_pos long, size long, n long, " + ", ".join(f"v{k} double" for k in range(len(names)))
    scale = tuple(float(w) for _, w in features.values())
    if absent is not None:  # a row per entity and tile, without position, so that tiles are filled up to their edges; it is sorted first
        none = F.lit(None)
        spans = rows.groupBy("entity").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
        spans = spans.select("entity", F.explode(F.sequence(F.floor(F.col("lo") / tile).cast("long"), F.floor(F.col("hi") / tile).cast("long"))).alias("tile"), none.cast("long").alias("pos"), *[none.cast("double").alias(f) for f in fs], "lo", "hi")
        events = events.withColumns({"lo": none.cast("long"), "hi": none.cast("long")}).unionByName(spans)
    work = _segmenter(tile, len(names), scale, float(penalty), None if absent is None else tuple(float(absent[n]) for n in names))
    pieces = events.repartition("entity", "tile").sortWithinPartitions("entity", "tile", "pos").mapInArrow(work, schema)

    # What is done keeps to the lane of its tile, so that only stretches at edges meet by entity.
    schema = "entity string, run_start long, run_end long, n_events long, " + ", ".join(f"v{k} double" for k in range(len(names)))
    runs = pieces.repartition("entity", "lane").sortWithinPartitions("entity", "lane", "first_pos").mapInArrow(_joiner(len(names), scale, float(penalty)), schema)
    return runs.select("entity", "run_start", "run_end", "n_events", (F.col("run_end") - F.col("run_start") + 1).alias("duration"), *[F.col(f"v{k}").alias(f"mean_{n}") for k, n in enumerate(names)])
