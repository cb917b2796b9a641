"""Filling fixed-capacity containers with items.

Method: best-fit decreasing.  The open bins stand in a segment tree over remaining capacities; the tightest bin
that still takes an item is found by one descent, so an item costs the logarithm of the capacity.  Items are packed
in shards of some ten thousand, each by one task; a shard wastes about one bin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import materialise

SHARD_ITEMS = 50_000


class OpenBins:
    """Open bins by remaining capacity 0..capacity; every inner node of the tree counts the bins below it."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << max(capacity, 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, bin_id: int) -> None:
        self.bins[remaining].append(bin_id)
        node = remaining + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def tightest(self, need: int) -> int:
        """The smallest remaining capacity of at least ``need`` that some bin has, or -1."""
        count, node = self.count, need + self.leaves
        if count[node]:
            return need
        while node > 1:  # up to the first subtree to the right that is not empty
            if not node & 1 and count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, remaining: int) -> int:
        node = remaining + self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return self.bins[remaining].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of every item (all at most ``capacity``); equal sizes in the order given."""
    tree, out, opened = OpenBins(capacity), np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        remaining = tree.tightest(size)
        if remaining < 0:
            bin_id, remaining = opened, capacity
            opened += 1
        else:
            bin_id = tree.take(remaining)
        tree.add(remaining - size, bin_id)
        out[i] = bin_id
    return out


def pack_items(df: DataFrame, key: str, size: str, capacity: int, seed: int = 42) -> DataFrame:
    """One row per placed piece: ``key, piece, start, length, shard, bin``.

    An item of at most ``capacity`` is one piece and never divided; a longer one is divided into pieces of
    ``capacity`` and a rest, numbered from 0, with ``start`` counting units from the item's beginning.  ``(shard,
    bin)`` names a container.  A null or negative size counts 0; an item of size 0 is placed like any other.  Rows
    that repeat a key are items of their own; rows with null key too.  An empty table gives no rows.

    Only keys and sizes are shuffled, counted first; the number of shards follows the number of pieces, so no task gets
    more than some SHARD_ITEMS of them.  A shard is packed by itself, which wastes about one container in each.
    """
    kind = df.schema[key].dataType
    units = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    # Rows that repeat key and size are counted first and numbered, so that copies of one row do not meet in a shard,
    # and shards are the same however the rows are stored.
    items = materialise(df.groupBy(F.col(key).alias("key"), units.alias("size")).agg(F.count(F.lit(1)).alias("copies")))
    whole = F.greatest(F.ceil(F.col("size") / F.lit(capacity)), F.lit(1)).cast("long")
    n = items.agg(F.sum(whole * F.col("copies"))).first()[0] or 0
    shards = max(1, -(-int(n) // SHARD_ITEMS))
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), c - 1))
    pieces = items.withColumn("copy", upto(F.col("copies"))).withColumn("piece", upto(whole))
    start = F.col("piece") * capacity
    length = F.least(F.col("size") - start, F.lit(capacity)).cast("long")
    shard = F.pmod(F.xxhash64(F.lit(seed), "key", "size", "copy", "piece"), F.lit(shards)).cast("long")
    pieces = pieces.select("key", "piece", start.alias("start"), length.alias("length"), shard.alias("shard"))

    def pack(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "key", "piece"], ascending=[False, True, True], kind="stable")
        items["bin"] = best_fit_decreasing(items["length"].to_numpy(), capacity)
        return items[["key", "piece", "start", "length", "shard", "bin"]]

    packed = pieces.groupBy("shard").applyInPandas(pack, f"key {kind.simpleString()}, piece long, start long, length long, shard long, bin long")
    return packed.withColumnRenamed("key", key)
