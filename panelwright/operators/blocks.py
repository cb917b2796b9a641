"""Shared parts of the operators that work on sorted Arrow streams: rows come partitioned and sorted by a key,
and are handed on in pieces made of whole groups, so a task never holds more than a batch and one group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def numbers(table: pa.Table, name: str, fill: float | int = 0) -> np.ndarray:
    col = table.column(name)
    if col.null_count:
        col = col.fill_null(fill)
    return col.to_numpy()


def codes(table: pa.Table, name: str) -> np.ndarray:
    """A column as numbers that differ where its values differ (within this table)."""
    col = table.column(name).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if pa.types.is_integer(col.type) and not col.null_count:
        return col.to_numpy(zero_copy_only=False)
    return col.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for key in keys:
        c = codes(table, key)
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the first row of each group; the input is sorted by ``keys``."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        piece = pa.Table.from_batches([batch])
        piece = piece if held is None else pa.concat_tables([held, piece])
        starts = group_starts(piece, keys)
        cut = int(starts[-1])
        if cut:
            yield piece.slice(0, cut), starts[:-1]
        held = piece.slice(cut)
    if held is not None:
        yield held, np.zeros(1, np.int64)
