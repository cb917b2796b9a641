"""Splits that keep related records together.

Method: records are gathered into components (all ids of one person, author, source ...).  Components of the same
size and label profile are interchangeable and form a bundle; a min-cost flow sends every bundle's rows to the
splits, under the splits' quotas and with a cost for each row a bundle deviates from its proportional share.  The
flow is rounded to whole components (a second flow over what is left of each bundle, in order of size, so roundings
cancel out; then exchanges of single components while they bring rows or positives nearer to the quotas), and the
members of a bundle are assigned in the order of a hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.components import connected_components
from panelwright.operators.joins import salted_lookup
from panelwright.session import materialise

EXACT = 256  # sizes and label counts up to here make profiles of their own, larger ones by steps of 1/32 (they are placed first)
BUCKETS = 1024  # hash ranges by which a bundle's members are put in order


def quota_flow(supply: np.ndarray, shares: Sequence[float]) -> np.ndarray:
    """Min-cost flow of ``supply[b]`` units from bundles to splits; unit costs: -1 up to the bundle's proportional
    part of a split, +1 beyond; the splits take exactly their quotas.  Successive shortest paths; as there are few
    splits, the shortest path is sought among them, over the cheapest bundle for each step.  Returns whole units."""
    b, s = len(supply), len(shares)
    total = int(supply.sum())
    quota = _whole_parts(total, shares)
    ideal = np.array([[int(x) * f.numerator // f.denominator for f in _fractions(shares)] for x in supply], np.int64).reshape(b, s)
    flow = np.zeros((b, s), np.int64)
    left, room = supply.astype(np.int64).copy(), quota.copy()
    # The first augmentations all follow edges of cost -1 (up to the proportional part), the cheapest there are; in whole
    # numbers, floors of the parts add up to no more than the floor of the quota, so no split is overfull.
    flow += ideal
    left -= ideal.sum(axis=1)
    room -= ideal.sum(axis=0)
    for at in np.flatnonzero(left):
        while left[at] > 0:
            more = np.where(flow < ideal, -1, 1)  # cost of a further unit of a bundle in a split
            less = np.where(flow > ideal, -1, 1)  # cost of taking one away again
            step = np.full((s, s), np.inf)
            via = np.zeros((s, s), np.int64)
            for x in range(s):
                can = np.flatnonzero(flow[:, x] > 0)
                for y in range(s):
                    if x != y and len(can):
                        c = less[can, x] + more[can, y]
                        via[x, y] = can[np.argmin(c)]
                        step[x, y] = c.min()
            dist, prev = more[at].astype(float), [-1] * s
            for _ in range(s - 1):
                for x in range(s):
                    for y in range(s):
                        if dist[x] + step[x, y] < dist[y] - 1e-12:
                            dist[y], prev[y] = dist[x] + step[x, y], x
            open_splits = np.flatnonzero(room > 0)
            end = int(open_splits[np.argmin(dist[open_splits])])
            path, x = [end], end
            while prev[x] >= 0:
                x = prev[x]
                path.append(x)
            amount = int(min(left[at], room[end]))
            for y, x in zip(path, path[1:]):
                amount = min(amount, int(flow[via[x, y], x]))
            if len(path) > 1:
                amount = 1  # costs along a detour change with the first unit
            for y, x in zip(path, path[1:]):
                flow[via[x, y], x] -= amount
                flow[via[x, y], y] += amount
            flow[at, path[-1]] += amount
            left[at] -= amount
            room[end] -= amount
    return flow


def _fractions(shares: Sequence[float]) -> list[Fraction]:
    """The shares as fractions that add up to one exactly."""
    first = [Fraction(float(x)).limit_denominator(1_000_000) for x in shares[:-1]]
    return [*first, max(1 - sum(first), Fraction(0))]


def _whole_parts(total: int, shares: Sequence[float]) -> np.ndarray:
    """Whole numbers that add up to ``total``, nearest to the shares (largest remainders)."""
    exact = [total * f for f in _fractions(shares)]
    parts = [int(x) for x in exact]
    for k in sorted(range(len(parts)), key=lambda k: parts[k] - exact[k])[: max(total - sum(parts), 0)]:
        parts[k] += 1
    return np.array(parts, np.int64)


def whole_components(count: np.ndarray, size: np.ndarray, positives: np.ndarray, flow: np.ndarray, rows_wanted: np.ndarray, positives_wanted: np.ndarray) -> np.ndarray:
    """Components per bundle and split, ``size`` and ``positives`` each; ``flow`` in rows.

    The whole ones of the flow stay where they flow.  What is left of a bundle, some components, flows again, the
    bundles in order of size and label share: each goes to the split that is furthest behind what has flowed to it so
    far, so at any size no split is more than about one component off, and the rows no more than about the largest one.  Then single components
    change splits while that lowers the squared deviations of rows and positives from what is wanted, relative to it.
    """
    b, s = flow.shape
    parts = flow / np.maximum(size, 1)[:, None]
    out = np.floor(parts + 1e-9).astype(np.int64)
    behind = np.zeros(s)
    for i in np.lexsort((positives / np.maximum(size, 1), size)):
        behind += parts[i] - out[i]
        for _ in range(int(count[i] - out[i].sum())):
            k = int(np.argmax(behind))
            out[i, k] += 1
            behind[k] -= 1
    want = np.stack([np.maximum(rows_wanted, 1e-9), np.maximum(positives_wanted, 1e-9)]).astype(float)
    profile = np.stack([size, positives]).astype(float)
    off = np.stack([(out * size[:, None]).sum(axis=0), (out * positives[:, None]).sum(axis=0)]) - want
    weight = np.array([1.0, want[0].sum() / want[1].sum() if positives.sum() else 0.0])
    for _ in range(20 * b + 1000 if s > 1 else 0):
        best, move = -1e-9 * weight[0], None
        for x in range(s):
            have = out[:, x] > 0
            if not have.any():
                continue
            leaves = (weight[:, None] * profile * (profile - 2 * off[:, x : x + 1]) / want[:, x : x + 1]).sum(axis=0)
            for y in range(s):
                if x != y:
                    gain = np.where(have, leaves + (weight[:, None] * profile * (profile + 2 * off[:, y : y + 1]) / want[:, y : y + 1]).sum(axis=0), 0.0)
                    i = int(np.argmin(gain))
                    if gain[i] < best:
                        best, move = gain[i], (i, x, y)
        if move is None:
            break
        i, x, y = move
        out[i, x] -= 1
        out[i, y] += 1
        off[:, x] -= profile[:, i]
        off[:, y] += profile[:, i]
    return out


def plan_bundles(count: np.ndarray, size: np.ndarray, positives: np.ndarray, rows_wanted: np.ndarray, positives_wanted: np.ndarray) -> np.ndarray:
    """The two steps in one: components per bundle and split that bring rows and positives nearest to what is wanted."""
    shares = np.maximum(rows_wanted, 0.0) / max(np.maximum(rows_wanted, 0.0).sum(), 1e-9)
    flow = quota_flow(count * size, [float(x) for x in shares])
    return whole_components(count, size, positives, flow, rows_wanted, positives_wanted)


def _level(c: Column) -> Column:
    """Sizes as levels: exact up to EXACT, then steps of 1/32 of a power of two, so bundles stay few."""
    power = F.floor(F.log2(F.greatest(c, F.lit(1)).cast("double")))
    step = F.greatest(F.pow(F.lit(2.0), power - 5), F.lit(1.0))
    return F.when(c <= EXACT, c.cast("long")).otherwise((F.floor(c / step) * step).cast("long"))


def grouped_splits(
    df: DataFrame, member: str | Column, splits: dict[str, float], label: Column | None = None, fold: str | Column | None = None,
    links: tuple[DataFrame, Column, Column] | None = None, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(``rows``, ``components``).  ``rows`` is ``df`` with ``component`` and ``split``; every row of ``df`` once.
    ``components`` has ``component, n_rows, n_positive, split`` and, if ``fold`` is given, ``n_folds``: 0, 1 or
    2 (two or more) different non-null values of it.

    ``links`` (table, column, column) ties ids together, directly or through others; a component is named by the
    smallest of its ids.  ``label`` true marks a positive row.  Rows whose member is null belong to no one and are
    put by a hash of the whole row.  Repeated rows count as often as they occur; an empty table gives empty results;
    columns of ``df`` named component or split are replaced.

    Sent to the driver: one row per bundle, at most (EXACT + 32 * 64)² and in practice some hundreds, since a
    bundle is a pair of levels; never components.  Components of up to EXACT rows flow with their exact size; larger
    ones are bundled by steps of size, placed first, and the exact rows they took come off the quotas of the others.
    A component larger than a quota goes where it is missed most.
    """
    spark: SparkSession = df.sparkSession
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    names, shares = list(splits), [x / sum(splits.values()) for x in splits.values()]
    tagged = df.drop("component", "split").withColumn("_member", as_col(member))
    if links is not None:
        found = connected_components(links[0].select(links[1].alias("a"), links[2].alias("b")), "a", "b")
        tagged = salted_lookup(tagged, found.select(F.col("id").alias("_member"), F.col("component").alias("_root")), "_member")
        tagged = tagged.withColumn("component", F.coalesce("_root", "_member")).drop("_root")
    else:
        tagged = tagged.withColumn("component", F.col("_member"))
    tagged = tagged.drop("_member")
    positive = F.lit(0) if label is None else F.coalesce(label.cast("int"), F.lit(0))
    spread = [F.min(as_col(fold)).alias("_lo"), F.max(as_col(fold)).alias("_hi")] if fold is not None else []
    groups = tagged.where("component is not null").groupBy("component").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(positive).cast("long").alias("n_positive"), *spread)
    if spread:
        groups = groups.withColumn("n_folds", F.when(F.col("_lo").isNull(), 0).when(F.col("_lo") == F.col("_hi"), 1).otherwise(2)).drop("_lo", "_hi")
    groups = groups.withColumns({"_size": _level(F.col("n_rows")), "_pos": _level(F.col("n_positive")), "_hash": F.xxhash64(F.lit(seed), "component")})
    groups = groups.withColumn("_bucket", F.pmod(F.shiftright("_hash", 20), F.lit(BUCKETS)).cast("int"))
    groups = materialise(groups)

    sizes = groups.groupBy("_size", "_pos", "_bucket").agg(F.count(F.lit(1)).alias("k"), F.sum("n_rows").alias("rows"), F.sum("n_positive").alias("positives"))
    bundles = sizes.groupBy("_size", "_pos").agg(*[F.sum(c).alias(c) for c in ("k", "rows", "positives")]).orderBy("_size", "_pos").collect()
    before = F.sum("k").over(Window.partitionBy("_size", "_pos").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_size", "_pos", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    names_of = F.array(*[F.lit(n) for n in names])

    def place(groups: DataFrame, plan: list[tuple[int, int, list[int]]]) -> DataFrame:
        """The place of a component in its bundle, members in smaller hash ranges, then its rank in its own, says its split."""
        rule = spark.createDataFrame(plan, "_size long, _pos long, _upto array<long>")
        rank = F.row_number().over(Window.partitionBy("_size", "_pos", "_bucket").orderBy("_hash", "component"))
        placed = groups.withColumn("_rank", rank).join(offsets, ["_size", "_pos", "_bucket"]).join(rule, ["_size", "_pos"])
        k = F.size(F.filter("_upto", lambda u: u < F.col("_before") + F.col("_rank")))
        return placed.withColumn("split", F.element_at(names_of, k + 1)).select("component", "n_rows", "n_positive", *(["n_folds"] if spread else []), "split")

    # Bundles of large components are by steps of size: they are placed first, and what they really take comes off the quotas.
    share = np.array(shares)
    rows_wanted, positives_wanted = (share * float(sum(r[c] for r in bundles)) for c in ("rows", "positives"))
    components = None
    for large in (True, False):
        part = [r for r in bundles if (r["_size"] > EXACT) == large]
        if not part and (large or components is not None):
            continue
        count = np.array([r["k"] for r in part], np.int64)
        size, pos = (np.array([-(-int(r[c]) // int(r["k"])) for r in part], np.int64) for c in ("rows", "positives"))
        plan = plan_bundles(count, size, pos, rows_wanted, positives_wanted) if part else np.zeros((0, len(names)), np.int64)
        upto = np.cumsum(plan, axis=1)
        placed = place(groups.where((F.col("_size") > EXACT) if large else (F.col("_size") <= EXACT)), [(int(r["_size"]), int(r["_pos"]), [int(x) for x in u]) for r, u in zip(part, upto)])
        if large:
            placed = materialise(placed)
            for r in placed.groupBy("split").agg(F.sum("n_rows").alias("rows"), F.sum("n_positive").alias("positives")).collect():
                rows_wanted[names.index(r["split"])] -= r["rows"]
                positives_wanted[names.index(r["split"])] -= r["positives"]
        components = placed if components is None else components.unionByName(placed)

    edge = np.cumsum(shares)
    draw = F.pmod(F.xxhash64(F.lit(seed), *df.columns), F.lit(1_000_000)) / 1_000_000
    alone = F.lit(names[-1])
    for n, e in list(zip(names, edge))[-2::-1]:
        alone = F.when(draw < float(e), F.lit(n)).otherwise(alone)
    rows = salted_lookup(tagged, components.select("component", "split"), "component").withColumn("split", F.coalesce("split", alone))
    return rows.select(*[c for c in df.columns if c not in ("component", "split")], "component", "split"), components
