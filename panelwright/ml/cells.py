"""Forests and boosted trees of classes over cells instead of rows.

Trees see a number only by its bin, so rows with equal bins, label and weight (a cell) go the same way in every tree.  All rows
are counted into cells once; trees are grown from the counts as Spark's estimators grow them from rows: the same bins, gains,
limits, leaves and importances.  A row drawn with replacement comes Poisson-many times, so a cell of ``n`` rows is drawn
Poisson(rate * n) times; without replacement Binomial(n, rate): the sums of what Spark draws row by row.  Only the random numbers differ.

Where there are too many cells to keep, or settings that are not here, :func:`fit` returns None and Spark's estimator is used.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_BYTES, MOST_CELLS, MOST_VALUES = 96_000_000, 3_000_000, 500_000
_SETTINGS = {"labelCol", "featuresCol", "weightCol", "seed", "numTrees", "maxIter", "maxDepth", "minInstancesPerNode", "minInfoGain", "maxBins", "featureSubsetStrategy", "subsamplingRate", "impurity", "stepSize", "bootstrap"}


def thresholds(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Where a feature is split: halfway between all its values, if they are no more than ``bins``, else at even strides of the weight."""
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < bins:
        return middle
    stride = weights.sum() / bins
    out, target, count = [], stride, weights[0]
    for i in range(1, len(values)):
        before, count = count, count + weights[i]
        if abs(before - target) < abs(count - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def _binned(rows: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.empty(rows.shape, np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.searchsorted(c, rows[:, f], side="left")
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _impurity(kind: str, s: np.ndarray) -> np.ndarray:
    """Of sums by class, or for ``variance`` of weight, sum and sum of squares; the last axis holds them."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if kind == "variance":
            return np.where(s[..., 0] > 0, (s[..., 2] - s[..., 1] * s[..., 1] / s[..., 0]) / s[..., 0], 0.0)
        p = s / s.sum(axis=-1, keepdims=True)
        return np.nan_to_num(1 - (p * p).sum(axis=-1) if kind == "gini" else -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=-1))


def grow(bins: np.ndarray, sizes: list[int], raw: np.ndarray, weight: np.ndarray, y: np.ndarray, kind: str, classes: int, depth: int, subset: int, least: int, gain: float, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One tree over cells: ``bins`` has a row per feature, ``raw`` the number of rows drawn and ``weight`` their weight.  Arrays
    by node: feature (-1: leaf), bin, left (right is the next), sums, gain."""
    return _grow(groups(bins, sizes), sizes, raw, [weight, weight * y, weight * y * y] if kind == "variance" else [np.where(y == k, weight, 0.0) for k in range(classes)], bins, kind, depth, subset, least, gain, rng)


def groups(bins: np.ndarray, sizes: list[int]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """Features that take at most 64 values together, as the one-hot columns of a category do: the features, what of them each place
    has, and the places of the cells."""
    out: list[tuple[list[int], np.ndarray, np.ndarray]] = []
    for f in sorted((f for f, size in enumerate(sizes) if size > 1), key=lambda f: (sizes[f], f)):
        if out:
            features, values, place = out[-1]
            both, new = np.unique(place * sizes[f] + bins[f], return_inverse=True)
            if len(both) <= 64:
                out[-1] = [*features, f], np.column_stack([values[both // sizes[f]], both % sizes[f]]), new.ravel()
                continue
        out.append(([f], np.arange(sizes[f])[:, None], bins[f].astype(np.int64)))
    return out


def _grow(together: list[tuple], sizes: list[int], raw: np.ndarray, stats: list[np.ndarray], bins: np.ndarray, kind: str, depth: int, subset: int, least: int, gain: float, rng: np.random.Generator, every: bool = False) -> dict[str, np.ndarray]:
    """:func:`grow` from sums by cell, of which a cell may have rows of many labels.  With ``every`` also ``leaf``, the node that each cell
    comes to, drawn or not."""
    at = np.arange(len(raw)) if every else np.flatnonzero(raw)
    node, width = np.zeros(len(at), np.int64), len(stats)
    given = [s[at] for s in (raw.astype(float), *stats)]
    within, part = [], {}  # of each group which places lie in each bin of its features, and where a feature's bins are
    for g, (features, values, _) in enumerate(together):
        within.append(None if len(features) == 1 else np.hstack([values[:, [j]] == np.arange(sizes[f]) for j, f in enumerate(features)]).astype(float))
        for f, end in zip(features, np.cumsum([sizes[f] for f in features])):
            part[f] = g, end - sizes[f], end

    def added(c: np.ndarray, places: np.ndarray) -> np.ndarray:  # one after another, as rounding decides between equal splits
        c = np.ascontiguousarray(np.moveaxis(c, 0, -1))
        return np.moveaxis(np.stack([c[:, p > 0].sum(axis=1) for p in places.T], axis=1), -1, 0)

    total = np.array([[s.sum() for s in given[1:]]])
    of = (lambda s: s[..., 0]) if kind == "variance" else (lambda s: s.sum(axis=-1))
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("feature", "bin", "left", "sums", "gain")}
    leaf = np.zeros(len(at), np.int64)
    first, level = 0, 0  # number of the first node of this level
    above: dict[int, np.ndarray] = {}  # counts of the parents, two siblings after another
    open_ = np.array([level < depth and _impurity(kind, total)[0] > 0])
    while len(total):
        m = len(total)
        feature, cut, best, lefts = np.full(m, -1, np.int16), np.zeros(m, np.uint8), np.full(m, -np.inf), np.zeros((m, width))
        found: dict[int, np.ndarray] = {}
        live = np.flatnonzero(open_)
        if len(live):
            chosen = np.ones((m, len(sizes)), bool)
            if subset < len(sizes):
                chosen[:] = False
                np.put_along_axis(chosen, np.argpartition(rng.random((m, len(sizes))), subset - 1, axis=1)[:, :subset], True, axis=1)
            chosen &= open_[:, None]
            used = chosen.any(axis=0)

            def counted(counts: np.ndarray, nodes: np.ndarray, g: list[int]) -> Iterator[tuple[int, np.ndarray]]:
                place = np.full(m, -1, np.int64)
                place[nodes] = np.arange(len(nodes))
                mine = np.flatnonzero(counts[node]) if len(nodes) < m else slice(None)
                where, cells, own = place[node[mine]], at[mine], [s[mine] for s in given]
                for i in g:
                    n = len(together[i][1])
                    key = where * n + together[i][2][cells]
                    yield i, np.stack([np.bincount(key, s, len(nodes) * n) for s in own]).reshape(1 + width, len(nodes), n)

            wanted = [g for g, (features, _, _) in enumerate(together) if used[features].any()]
            if above:  # of siblings the one of fewer cells is counted, the other has what is left
                n = np.bincount(node, minlength=m).reshape(-1, 2)
                there = open_.reshape(-1, 2).any(axis=1)
                less = np.column_stack([n[:, 0] <= n[:, 1], n[:, 0] > n[:, 1]])
                own = (less & there[:, None]).ravel()
                pair, side = np.flatnonzero(there), less[there].argmin(axis=1)  # of the one that is not counted
                to = np.cumsum(there) - 1
                to = 2 * to[live // 2] + live % 2
                for g, c in counted(own, np.flatnonzero(own), [g for g in wanted if g in above]):
                    both, i = np.empty((1 + width, 2 * len(pair), c.shape[2])), 2 * np.arange(len(pair))
                    rest = above[g][:, pair] - c
                    both[:, i + side], both[:, i + 1 - side] = rest * (rest[0] > 0), c  # no rows, no sums: equal splits stay equal
                    found[g] = both[:, to]
            found |= counted(open_, live, [g for g in wanted if g not in found])
            by_bin = {g: c if within[g] is None else c @ within[g] if kind == "variance" else added(c, within[g]) for g, c in found.items()}
            place = np.full(m, -1, np.int64)
            place[live] = np.arange(len(live))
            whole = _impurity(kind, total)
            batches: list[list[int]] = []
            for f in (f for f, size in enumerate(sizes) if size > 1 and used[f]):
                if batches and sum(sizes[x] for x in [*batches[-1], f]) * len(live) <= 200_000:
                    batches[-1].append(f)
                else:
                    batches.append([f])
            for batch in batches:
                nodes = np.flatnonzero(chosen[:, batch].any(axis=1))
                some = [by_bin[part[f][0]][:, :, part[f][1] : part[f][2]].cumsum(axis=2) for f in batch]
                counts = np.concatenate(some, axis=2) if len(some) > 1 else some[0]
                counts = np.moveaxis(counts if len(nodes) == len(live) else counts[:, place[nodes]], 0, -1)
                whose = np.repeat(batch, [sizes[f] for f in batch])
                bin_ = np.concatenate([np.arange(sizes[f]) for f in batch])
                sums, rows = counts[..., 1:], counts[..., 0]
                right, all_ = total[nodes][:, None, :] - sums, rows[:, -1:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = whole[nodes][:, None] - (of(sums) * _impurity(kind, sums) + of(right) * _impurity(kind, right)) / of(total[nodes])[:, None]
                g = np.where(chosen[np.ix_(nodes, whose)] & (rows >= least) & (all_ - rows >= least) & (g >= gain), g, -np.inf)
                k = g.argmax(axis=1)
                row = np.arange(len(nodes))
                g = g[row, k]
                won = g > best[nodes]
                to, k = nodes[won], k[won]
                best[to], feature[to], cut[to], lefts[to] = g[won], whose[k], bin_[k], sums[row[won], k]
            feature[~(best > 0)] = -1
        split = np.flatnonzero(feature >= 0)
        left = np.full(m, -1, np.int64)
        left[split] = first + m + 2 * np.arange(len(split))
        for name, value in (("feature", feature), ("bin", cut), ("left", left), ("sums", total), ("gain", best)):
            out[name].append(value)
        kept = feature[node] >= 0
        if every:
            leaf[at[~kept]] = first + node[~kept]
        if not kept.all():
            at, node, given = at[kept], node[kept], [s[kept] for s in given]
        node = left[node] - first - m + (bins[feature[node], at] > cut[node])
        above = {}
        if kind == "variance" and len(split) and len(live) * sum(len(v) for _, v, _ in together) * (1 + width) <= 4_000_000:
            above = {g: c[:, place[split]] for g, c in found.items()}
        both = np.stack([lefts[split], total[split] - lefts[split]], axis=1).reshape(-1, width)
        first, level, total = first + m, level + 1, both
        open_ = (level < depth) & (np.abs(_impurity(kind, total)) >= 2.220446049250313e-16) if len(total) else np.zeros(0, bool)
    tree = _pruned({k: np.concatenate(v) for k, v in out.items()}, kind)
    return tree | {"leaf": _shown(tree)[leaf]} if every else tree


def _shown(tree: dict[str, np.ndarray]) -> np.ndarray:
    """Of each node the one that says what it says: itself, or what above it has become a leaf."""
    shown = np.arange(len(tree["feature"]))
    for p in np.flatnonzero((tree["feature"] < 0) & (tree["left"] >= 0)):  # parents come before their children
        shown[tree["left"][p] : tree["left"][p] + 2] = shown[p]
    return shown


def _pruned(tree: dict[str, np.ndarray], kind: str) -> dict[str, np.ndarray]:
    """Two leaves that say the same become one, as in Spark."""
    said = tree["sums"].argmax(axis=1) if kind != "variance" else tree["sums"][:, 1] / tree["sums"][:, 0]
    feature, left = tree["feature"], tree["left"]
    inner = np.flatnonzero(feature >= 0)
    while len(inner):  # parents of two leaves, again and again
        a = left[inner]
        same = inner[(feature[a] < 0) & (feature[a + 1] < 0) & (said[a] == said[a + 1])]
        if not len(same):
            break
        feature[same] = -1
        inner = np.setdiff1d(inner, same)
    return tree


def _importance(tree: dict[str, np.ndarray], kind: str, width: int) -> np.ndarray:
    inner = tree["feature"] >= 0
    s = tree["sums"][inner]
    return np.bincount(tree["feature"][inner], tree["gain"][inner] * (s[:, 0] if kind == "variance" else s.sum(axis=1)), width)


def _packed(tree: dict[str, np.ndarray], kind: str) -> bytes:
    """What predictions need, without what hangs under pruned nodes: values of leaves by their place, which ``left`` has there."""
    feature, left = tree["feature"], tree["left"]
    lives = np.zeros(len(feature), bool)
    lives[0], level = True, np.zeros(1, np.int64)
    while len(level := level[feature[level] >= 0]):
        level = np.concatenate([left[level], left[level] + 1])
        lives[level] = True
    place = np.cumsum(lives) - 1
    feature, cut, sums = feature[lives], tree["bin"][lives], tree["sums"][lives]
    left = place[left[lives]].astype(np.int32)
    leaf = np.flatnonzero(feature < 0)
    values = sums[leaf][:, 1:2] / sums[leaf][:, :1] if kind == "variance" else sums[leaf] / sums[leaf].sum(axis=1, keepdims=True)
    left[leaf] = np.arange(len(leaf))
    return zlib.compress(pickle.dumps((feature, cut, left, values)), 1)


def _leaves(tree: tuple, rows: np.ndarray) -> np.ndarray:
    """The leaf values of rows of bins."""
    feature, cut, left, values = tree
    node = np.zeros(len(rows), np.int64)
    at = np.arange(len(rows))
    while True:
        f = feature[node[at]]
        at, f = at[f >= 0], f[f >= 0]
        if not len(at):
            return values[left[node]]
        here = node[at]
        node[at] = left[here] + (rows[at, f] > cut[here])


def _forest(cells: tuple, settings: dict, trees: list[int]) -> list[tuple[bytes, np.ndarray]]:
    bins, sizes, count, weight, label, start = cells
    out, together = [], groups(bins, sizes)
    for t in trees:
        rng = np.random.default_rng([settings["seed"] % 2**32, t])
        rate = settings["subsamplingRate"]
        raw = rng.poisson(rate * count) if settings["bootstrap"] else rng.binomial(count, rate) if rate < 1 else count
        if not raw.any():
            raise ValueError("no rows were drawn")
        stats = [np.add.reduceat(np.where(label == k, raw * weight, 0.0), start) for k in range(settings["classes"])]
        tree = _grow(together, sizes, np.add.reduceat(raw, start), stats, bins, settings["impurity"], settings["maxDepth"], settings["subset"], settings["minInstancesPerNode"], settings["minInfoGain"], rng)
        out.append((_packed(tree, settings["impurity"]), _importance(tree, settings["impurity"], len(sizes))))
    return out


def _sums(start: np.ndarray, length: int) -> Callable[[np.ndarray], np.ndarray]:
    """What sums values from each of ``start`` to the next."""
    times = np.diff(np.append(start, length))
    second = np.where(times > 1, start + 1, length)
    return (lambda s: s[start] + np.append(s, 0.0)[second]) if times.max() <= 2 else (lambda s: np.add.reduceat(s, start))


def _boosted(cells: tuple, settings: dict) -> list[tuple[bytes, np.ndarray]]:
    bins, sizes, count, weight, label, start = cells
    y, said, out = 2.0 * label - 1, np.zeros(len(start)), []
    together, times = groups(bins, sizes), np.diff(np.append(start, len(label)))
    summed = _sums(start, len(label))

    def draw(t: int) -> tuple[np.random.Generator, np.ndarray]:
        rng = np.random.default_rng([settings["seed"] % 2**32, t])
        return rng, rng.binomial(count, settings["subsamplingRate"]) if settings["subsamplingRate"] < 1 else count

    with ThreadPoolExecutor(1) as pool:  # the rows of the next tree are drawn while one is grown
        coming = pool.submit(draw, 0)
        for t in range(settings["maxIter"]):
            rng, raw = coming.result()
            if t + 1 < settings["maxIter"]:
                coming = pool.submit(draw, t + 1)
            with np.errstate(over="ignore"):
                wanted = 4 * y / (1 + np.exp(2 * y * np.repeat(said, times))) if t else y
            drawn = raw * weight
            given = drawn * wanted
            stats = [summed(s) for s in (drawn, given, given * wanted)]
            tree = _grow(together, sizes, summed(raw), stats, bins, "variance", settings["maxDepth"], settings["subset"], settings["minInstancesPerNode"], settings["minInfoGain"], rng, True)
            value = tree["sums"][:, 1] / np.where(tree["sums"][:, 0] > 0, tree["sums"][:, 0], 1.0)
            said += (settings["stepSize"] if t else 1.0) * value[tree["leaf"]]
            out.append((_packed(tree, "variance"), _importance(tree, "variance", len(sizes))))
    return out


def _subset(strategy: str, width: int, trees: int) -> int:
    if strategy == "auto":
        strategy = "sqrt" if trees > 1 else "all"
    if strategy in ("all", "sqrt", "log2", "onethird"):
        return {"all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width))), "onethird": math.ceil(width / 3)}[strategy]
    return min(int(strategy), width) if strategy.isdigit() and int(strategy) > 0 else math.ceil(float(strategy) * width)


class _Ensemble:
    """All trees side by side: a step down is taken in all of them at once, and a leaf leads to itself."""

    def __init__(self, trees: list[bytes], weights: list[float]):
        feature, cut, left, value, roots, at = [], [], [], [], [], 0
        for w, packed in zip(weights, trees):
            f, c, to, values = pickle.loads(zlib.decompress(packed))
            leaf, own, place = f < 0, np.zeros((len(f), values.shape[1])), np.arange(len(f))
            own[leaf] = w * values[to[leaf]]
            for kept, x in ((feature, np.where(leaf, 0, f)), (cut, np.where(leaf, 255, c)), (left, np.where(leaf, place, to) + at), (value, own)):
                kept.append(x)
            roots.append(at)
            at += len(f)
        self.feature, self.cut, self.left, self.value, self.roots = (np.concatenate(feature).astype(np.intp), np.concatenate(cut).astype(np.uint8), np.concatenate(left).astype(np.intp), np.concatenate(value), np.array(roots, np.intp))

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """Weighted leaf values of rows of bins, summed over the trees in their order."""
        out, step = np.empty((len(rows), self.value.shape[1])), max(1, 2_000_000 // len(self.roots))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            node, at = np.repeat(self.roots[:, None], len(some), axis=1), np.arange(len(some))[None, :]
            while True:
                new = self.left[node] + (some[at, self.feature[node]] > self.cut[node])
                if (new == node).all():
                    break
                node = new
            for k in range(out.shape[1]):
                out[i : i + step, k] = self.value[node, k].sum(axis=0)
        return out


class Inputs:
    """How the bins of all features come from the columns that the stages make them of.  ``known`` has of each column its labels, or
    mean, scale and limits of its bins; ``bins`` the bins of its features by code."""

    def __init__(self, columns: list[str], known: list[dict | tuple], bins: list[np.ndarray]):
        self.columns, self.known, self.bins = columns, known, bins
        self.sizes = [len(b) for b in bins]

    def codes(self, f: int, values: np.ndarray) -> np.ndarray:
        """Of numbers the bin, of texts the place of the label; others and nulls come after the last."""
        known = self.known[f]
        if isinstance(known, dict):
            return np.fromiter((known.get(v, len(known)) for v in values), np.int64, len(values))
        mean, scale, cuts = known
        return np.searchsorted(cuts, (values.astype(float) - mean) * scale + 0.0, side="left")

    def keys(self, values: Sequence[np.ndarray]) -> np.ndarray:
        """Rows of values as the codes of all columns in one number each."""
        out = np.zeros(len(values[0]), np.int64)
        for f, size in enumerate(self.sizes):
            out = out * size + self.codes(f, values[f])
        return out

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Rows of bins of such numbers."""
        out = []
        for size, bins in zip(self.sizes[::-1], self.bins[::-1]):
            keys, code = np.divmod(keys, size)
            out.append(bins[code])
        return np.hstack(out[::-1])


class CellModel(Model):
    """Trees over bins; gives the columns that Spark's models give.  ``inputs``: the columns the features are made of, if it is known."""

    def __init__(self, features: str, cuts: list[np.ndarray], trees: list[bytes], weights: list[float], boosted: bool, importance: np.ndarray, classes: int, inputs: Inputs | None = None):
        super().__init__()
        self.features, self.cuts, self.trees, self.weights, self.boosted, self.classes, self.inputs = features, cuts, trees, weights, boosted, classes, inputs
        self.featureImportances = DenseVector(importance)

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._told(df)

    def scored(self, df: DataFrame) -> DataFrame:
        """With ``score``, the probability of class 1, which does not go through a vector."""
        return self._told(df, True)

    def _told(self, df: DataFrame, score: bool = False) -> DataFrame:
        cuts, weights, inputs = self.cuts, self.weights, self.inputs
        outs = [f"c{k}" for k in range(1 if self.boosted else self.classes)]
        held = df.sparkSession.sparkContext.broadcast(self.trees)

        def raw(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            trees, known, values = None, {}, np.empty((0, len(outs)))
            for batch in batches:
                batch = batch if isinstance(batch, tuple) else (batch,)
                if not len(batch[0]):
                    yield pd.DataFrame({c: pd.Series([], dtype=float) for c in outs})
                    continue
                trees = trees or _Ensemble(held.value, weights)
                if inputs:
                    keys, first, which = np.unique(inputs.keys([c.to_numpy() for c in batch]), return_index=True, return_inverse=True)
                    names = keys.tolist()
                else:
                    rows = _binned(np.stack(batch[0].to_list()), cuts)
                    keys, first, which = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
                    names = [k.tobytes() for k in keys]
                if len(known) > 200_000:
                    known, values = {}, values[:0]
                new = [i for i, k in enumerate(names) if k not in known]
                if new:
                    known.update(zip([names[i] for i in new], range(len(values), len(values) + len(new))))
                    values = np.concatenate([values, trees.sums(inputs.rows(keys[new]) if inputs else rows[first[new]])])
                yield pd.DataFrame(values[[known[k] for k in names]][which.ravel()], columns=outs)

        given = [F.col(c) if isinstance(k, dict) else F.col(c).cast("double") for c, k in zip(inputs.columns, inputs.known)] if inputs else [vector_to_array(self.features)]
        out = df.withColumn("_sums", F.pandas_udf(raw, ", ".join(f"{c} double" for c in outs))(*given))  # of an iterator of series
        sums = [F.col("_sums")[c] for c in outs]
        if self.boosted:
            values, one = [-sums[0], sums[0]], 1 / (1 + F.exp(-2 * sums[0]))
            shares, said = [1 - one, one], (sums[0] > 0).cast("double")
        else:
            values, whole = sums, sum(sums[1:], F.lit(0.0) + sums[0])
            shares = [x / whole for x in sums]
            said = (F.array_position(F.array(*sums), F.greatest(*sums)) - 1).cast("double")
        return out.withColumns({"rawPrediction": array_to_vector(F.array(*values)), "probability": array_to_vector(F.array(*shares)), "prediction": said, **({"score": shares[1]} if score else {})}).drop("_sums")


def _distinct(column: pa.Array | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column and the place of each row in them; null texts are None."""
    found = (pa.array(column) if isinstance(column, np.ndarray) else column).dictionary_encode()
    values, of = found.dictionary.to_numpy(zero_copy_only=False), found.indices
    if of.null_count:
        values, of = np.append(values, None), of.fill_null(len(values))
    return values, of.to_numpy().astype(np.uint8 if len(values) <= 256 else np.uint16 if len(values) <= 65536 else np.uint32)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in blocks: columns, labels and weights as places in their own values.  The columns are the parts of an array, or come one by one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        *given, y, w = batch.columns
        y, w = y.to_numpy(zero_copy_only=False), w.to_numpy(zero_copy_only=False)
        bad = int((~(np.isfinite(y) & (y >= 0) & (y == np.floor(y)) & (w >= 0))).sum())
        if pa.types.is_list(given[0].type):
            widths = np.diff(given[0].offsets.to_numpy()) if not given[0].null_count else np.array([-1])
            width = int(widths[0]) if (widths == widths[0]).all() else -1
            given = list((_matrix(given[0], width) + 0.0).T) if width > 0 and not bad else []
        else:
            width = len(given)
            given = [c if pa.types.is_string(c.type) else c.to_numpy(zero_copy_only=False) + 0.0 for c in given]
        columns = [_distinct(np.ascontiguousarray(c) if isinstance(c, np.ndarray) else c) for c in (*given, y, w)] if given and not bad else []
        yield pa.record_batch([pa.array([v], t) for v, t in ((len(y), pa.int64()), (width, pa.int32()), (bad, pa.int64()), (0.0 if bad else float(y.max()), pa.float64()), (pickle.dumps(columns, 5), pa.binary()))], ["n", "width", "bad", "top", "block"])


def columns_of(stages: Sequence, features: str) -> list[tuple[str, str]] | None:
    """Of stages as :func:`panelwright.ml.models.feature_stages` gives them the columns behind the parts of the vector, in order, each
    ``hot``, ``scaled`` or ``plain``; None of any other stages."""
    made: dict[str, list[tuple[str, str]]] = {}
    for s in stages:
        get = lambda name: s.getOrDefault(name)  # noqa: B023, E731
        if isinstance(s, StringIndexer) and s.isSet("inputCols") and get("handleInvalid") == "keep" and get("stringOrderType") == "frequencyDesc":
            made |= {o: [(c, "index")] for c, o in zip(get("inputCols"), get("outputCols"))}
        elif isinstance(s, OneHotEncoder) and s.isSet("inputCols") and get("handleInvalid") == "keep" and get("dropLast"):
            if any([k for _, k in made.get(c, [])] != ["index"] for c in get("inputCols")):
                return None
            made |= {o: [(made[c][0][0], "hot")] for c, o in zip(get("inputCols"), get("outputCols"))}
        elif isinstance(s, VectorAssembler):
            made[get("outputCol")] = [x for c in get("inputCols") for x in made.get(c, [(c, "plain")])]
        elif isinstance(s, StandardScaler) and get("withMean") and get("withStd") and all(k == "plain" for _, k in made.get(get("inputCol"), [("", "")])):
            made[get("outputCol")] = [(c, "scaled") for c, _ in made[get("inputCol")]]
        else:
            return None
    found = made.get(features)
    return found if found and all(k != "index" for _, k in found) and len({c for c, _ in found}) == len(found) else None


def _cells(blocks: DataFrame, family: str, bins: int) -> tuple | None:
    """The cells of the rows in ``blocks``, the limits of the bins, the greatest label and the number of features; None where trees cannot be grown from cells."""
    n, width, narrow, bad, top = blocks.agg(F.sum("n"), F.max("width"), F.min("width"), F.sum("bad"), F.max("top")).first()
    if not n or bad or width != narrow or width < 1 or (family == "gbt" and top > 1) or top > 100:
        return None

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple]] = [[] for _ in range(width)]

        def merged(f: int) -> tuple[np.ndarray, np.ndarray]:
            values, of = np.unique(np.concatenate([v for v, _ in kept[f]]), return_inverse=True)
            return values, np.bincount(of.ravel(), np.concatenate([w for _, w in kept[f]]))

        for batch in batches:
            for block in batch.column(0).to_pylist():
                columns = pickle.loads(block)
                w = columns[-1][0][columns[-1][1]]
                for f, (values, of) in enumerate(columns[:width]):
                    kept[f].append((values, np.bincount(of, w, len(values))))
                    if sum(len(v) for v, _ in kept[f]) > 400_000:
                        kept[f] = [merged(f)]
                        if len(kept[f][0][0]) > 200_000:
                            values, w2 = kept[f].pop()
                            yield pa.record_batch([pa.array(np.full(len(values), f, np.int32)), pa.array(values), pa.array(w2)], ["f", "v", "w"])
        for f in range(width):
            if kept[f]:
                values, w = merged(f)
                yield pa.record_batch([pa.array(np.full(len(values), f, np.int32)), pa.array(values), pa.array(w)], ["f", "v", "w"])

    held = blocks.select("block")
    values = held.mapInArrow(seen, "f int, v double, w double").groupBy("f", "v").agg(F.sum("w").alias("w")).limit(MOST_VALUES + 1).toPandas().sort_values(["f", "v"])
    if len(values) > MOST_VALUES or values["v"].isna().any() or not np.isfinite(values["v"]).all():
        return None
    most = min(bins, n)
    cuts = [thresholds(v["v"].to_numpy(), v["w"].to_numpy(), most) for _, v in values.groupby("f")]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, known = [], 0

        def counted() -> pa.RecordBatch:
            bins, y, w = (np.concatenate(part) for part in zip(*rows))
            weights, of = np.unique(w, return_inverse=True)
            sizes = [*(len(c) + 1 for c in cuts), int(top) + 1, len(weights)]
            if math.prod(sizes) < 2**62:
                key = np.zeros(len(y), np.int64)
                for size, column in zip(sizes, (*bins.T, y.astype(np.int64), of.ravel())):
                    key = key * size + column
            else:
                key = np.ascontiguousarray(np.column_stack([bins, np.column_stack([y, w]).view(np.uint8)])).view(f"V{width + 16}").ravel()
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            return pa.record_batch([pa.array([r.tobytes() for r in bins[first]], pa.binary()), pa.array(y[first]), pa.array(w[first]), pa.array(count)], ["x", "y", "w", "n"])

        for batch in batches:
            for block in batch.column(0).to_pylist():
                columns = pickle.loads(block)
                of = columns[-1][1]
                packed = np.empty((len(of), width), np.uint8)
                for f, (values, place) in enumerate(columns[:width]):
                    packed[:, f] = np.searchsorted(cuts[f], values, side="left").astype(np.uint8)[place]
                rows.append((packed, *(v[p] for v, p in columns[width:])))
                known += len(of)
                if known > 1_000_000:
                    yield counted()
                    rows, known = [], 0
        if rows:
            yield counted()

    most_cells = min(MOST_CELLS, MOST_BYTES // width)
    got = held.mapInArrow(binned, "x binary, y double, w double, n long").groupBy("x", "y", "w").agg(F.sum("n").alias("n")).limit(most_cells + 1).toArrow()
    if got.num_rows > most_cells:
        return None
    got = got.sort_by([(c, "ascending") for c in ("x", "y", "w")])
    table = np.frombuffer(b"".join(got["x"].to_pylist()), np.uint8).reshape(-1, width)
    start = np.flatnonzero(np.append(True, (table[1:] != table[:-1]).any(axis=1)))  # where cells of other bins begin
    return (np.ascontiguousarray(table[start].T), [len(c) + 1 for c in cuts], got["n"].to_numpy(), got["w"].to_numpy(), got["y"].to_numpy().astype(np.int64), start), cuts, top, width


def _prepared(df: DataFrame, stages: Sequence, labels: dict[str, list[str]], spread: dict[str, tuple[float, float]], parts: list[tuple[str, str]]) -> PipelineModel:
    """``stages`` fitted to two rows that have the mean and the deviation of each number, and to the labels of each text."""
    two = {c: [labels[c][0]] * 2 if k == "hot" else [spread[c][0] - spread[c][1] / math.sqrt(2), spread[c][0] + spread[c][1] / math.sqrt(2)] for c, k in parts}
    known = [StringIndexerModel.from_arrays_of_labels([labels[c] for c in s.getInputCols()], s.getInputCols(), s.getOutputCols(), "keep") if isinstance(s, StringIndexer) else s for s in stages]
    return Pipeline(stages=known).fit(df.sparkSession.createDataFrame(pa.table(two)).coalesce(1))


def _column_cells(df: DataFrame, blocks: DataFrame, stages: Sequence, parts: list[tuple[str, str]], family: str, bins: int) -> tuple | None:
    """Stages fitted to the rows in ``blocks``, and as :func:`_cells` what trees need, with :class:`Inputs`; None where features cannot be told by column."""
    width = len(parts)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = [{} for _ in range(width + 2)]  # of each value rows and weight
        for batch in batches:
            for block in batch.column(0).to_pylist():
                columns = pickle.loads(block)
                if not columns:
                    yield pa.record_batch([pa.array(x, t) for x, t in (([-1], pa.int32()), ([0.0], pa.float64()), ([None], pa.string()), ([1], pa.int64()), ([0.0], pa.float64()))], names)
                    continue
                w = columns[-1][0][columns[-1][1]]
                for own, (values, of) in zip(kept, columns):
                    for v, n, s in zip(values.tolist(), np.bincount(of, minlength=len(values)).tolist(), np.bincount(of, w, len(values)).tolist()):
                        n0, s0 = own.get(v, (0, 0.0))
                        own[v] = n0 + n, s0 + s
                if sum(map(len, kept)) > MOST_VALUES:  # too many anyway
                    yield pa.record_batch([pa.array(x, t) for x, t in (([-1], pa.int32()), ([0.0], pa.float64()), ([None], pa.string()), ([1], pa.int64()), ([0.0], pa.float64()))], names)
                    return
        for f, own in enumerate(kept):
            text = f < width and parts[f][1] == "hot"
            nothing = [None] * len(own)
            yield pa.record_batch([pa.array(np.full(len(own), f, np.int32)), pa.array(nothing if text else list(own), pa.float64()), pa.array(list(own) if text else nothing, pa.string()), pa.array([n for n, _ in own.values()], pa.int64()), pa.array([s for _, s in own.values()], pa.float64())], names)

    names = ["f", "v", "t", "n", "w"]
    held = blocks.select("block")
    found = held.mapInArrow(seen, "f int, v double, t string, n long, w double").groupBy("f", "v", "t").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).limit(MOST_VALUES + 1).toArrow().to_pandas()
    if not len(found) or len(found) > MOST_VALUES or (found["f"] < 0).any():
        return None
    by = {f: x.sort_values(["v"]) for f, x in found.groupby("f")}
    n, top = int(by[width]["n"].sum()), by[width]["v"].max()
    if (family == "gbt" and top > 1) or top > 100:
        return None
    labels: dict[str, list[str]] = {}
    spread: dict[str, tuple[float, float]] = {}
    for f, (c, kind) in enumerate(parts):
        x = by[f]
        if kind == "hot":
            x = x[x["t"].notna()].sort_values(["n", "t"], ascending=[False, True])
            labels[c] = x["t"].tolist()
            if not labels[c]:
                return None
        else:
            v, k = x["v"].to_numpy(), x["n"].to_numpy()
            if not np.isfinite(v).all():
                return None
            mean = float((v * k).sum() / n)
            spread[c] = mean, math.sqrt(float((k * (v - mean) ** 2).sum()) / max(n - 1, 1))
    prepared = _prepared(df, stages, labels, spread, parts)
    scaled = {c: (m, 1 / s if s else 0.0) for stage, model in zip(stages, prepared.stages) if isinstance(stage, StandardScaler) for c, m, s in zip([c for c, k in parts if k == "scaled"], model.mean.toArray().tolist(), model.std.toArray().tolist())}
    most, cuts, known, tables = min(bins, n), [], [], []
    for f, (c, kind) in enumerate(parts):
        x = by[f]
        if kind == "hot":  # a part for each label, and one for what has none
            weight = dict(zip(x["t"].where(x["t"].notna(), None), x["w"]))
            shares = [weight[v] for v in labels[c]] + [weight.get(None, 0.0)]
            whole, rows = float(x["w"].sum()), dict(zip(x["t"].where(x["t"].notna(), None), x["n"]))
            of = [rows[v] for v in labels[c]] + [rows.get(None, 0)]
            for k, s in zip(of, shares):
                both = [(v, u) for v, u, there in ((0.0, whole - s, n - k), (1.0, s, k)) if there]
                cuts.append(thresholds(np.array([v for v, _ in both]), np.array([u for _, u in both]), most))
            own = cuts[-len(of) :]
            known.append({v: i for i, v in enumerate(labels[c])})
            tables.append(np.column_stack([np.searchsorted(t, np.eye(len(of))[:, i], side="left") for i, t in enumerate(own)]).astype(np.uint8))
        else:
            mean, scale = scaled.get(c, (0.0, 1.0))
            cuts.append(thresholds((x["v"].to_numpy() - mean) * scale + 0.0, x["w"].to_numpy(), most))
            known.append((mean, scale, cuts[-1]))
            tables.append(np.arange(len(cuts[-1]) + 1, dtype=np.uint8)[:, None])
    inputs = Inputs([c for c, _ in parts], known, tables)
    weights = by[width + 1]["v"].to_numpy()
    if math.prod([*inputs.sizes, int(top) + 1, len(weights)]) >= 2**62:
        return None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, of = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            return keys, np.bincount(of.ravel(), np.concatenate([c for _, c in kept])).astype(np.int64)

        for batch in batches:
            for block in batch.column(0).to_pylist():
                columns = pickle.loads(block)
                key = np.zeros(len(columns[-1][1]), np.int64)
                for f, (values, of) in enumerate(columns):
                    code = inputs.codes(f, values) if f < width else values.astype(np.int64) if f == width else np.searchsorted(weights, values)
                    key = key * (inputs.sizes[f] if f < width else int(top) + 1 if f == width else len(weights)) + code[of]
                kept.append((key, np.ones(len(key))))
                rows += len(key)
                if rows > 1_000_000:
                    kept, rows = [merged()], 0
        if kept:
            yield pa.record_batch([pa.array(x) for x in merged()], ["k", "n"])

    most_cells = min(MOST_CELLS, MOST_BYTES // sum(t.shape[1] for t in tables))
    got = held.mapInArrow(counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).limit(most_cells + 1).toArrow()
    if got.num_rows > most_cells:
        return prepared, None
    key, which = np.divmod(got["k"].to_numpy(), len(weights))
    key, y = np.divmod(key, int(top) + 1)
    rows = inputs.rows(key)
    order = np.lexsort([which, y, *rows.T[::-1]])
    rows, y, w, count = rows[order], y[order], weights[which[order]], got["n"].to_numpy()[order]
    start = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))  # where cells of other bins begin
    return prepared, ((np.ascontiguousarray(rows[start].T), [len(c) + 1 for c in cuts], count, w, y.astype(np.int64), start), cuts, top, rows.shape[1], inputs)


def _settled(estimator: Estimator) -> bool:
    return not {p.name for p in estimator.params if estimator.isSet(p)} - _SETTINGS and 2 <= estimator.getOrDefault("maxBins") <= 256


def _kept(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(_blocks, "n long, width int, bad long, top double, block binary").persist(StorageLevel.MEMORY_AND_DISK)


def fit_columns(df: DataFrame, stages: Sequence, estimator: Estimator, family: str, target: str, weight: str | None, features: str = "features") -> tuple[PipelineModel, CellModel | None] | None:
    """``stages`` fitted, and the model of ``estimator`` over what they make of ``df``, without making it row by row: its features are told by
    the values of the columns.  No model where there are too many cells; None where the columns do not tell."""
    parts, types = columns_of(stages, features), {f.name: f.dataType for f in df.schema}
    if not parts or not _settled(estimator) or not all(isinstance(types.get(c), T.StringType if k == "hot" else T.NumericType) for c, k in parts):
        return None
    columns = [(F.col(c) if k == "hot" else F.col(c).cast("double")).alias(f"c{i}") for i, (c, k) in enumerate(parts)]
    blocks = _kept(df.select(*columns, F.col(target).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")))
    try:
        found = _column_cells(df, blocks, stages, parts, family, estimator.getOrDefault("maxBins"))
    finally:
        blocks.unpersist()
    if not found or not found[1]:
        return found
    return found[0], _grown(df, estimator, family, features, *found[1])


def fit(df: DataFrame, estimator: Estimator, family: str, target: str, weight: str | None, features: str = "features") -> CellModel | None:
    """The model of ``estimator`` over rows with ``features``; None where it has to be Spark's own."""
    nominal = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal")
    if nominal or not _settled(estimator):
        return None
    rows = df.select(vector_to_array(features).alias("x"), F.col(target).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    blocks = _kept(rows)
    try:
        cells = _cells(blocks, family, estimator.getOrDefault("maxBins"))
    finally:
        blocks.unpersist()
    return None if cells is None else _grown(df, estimator, family, features, *cells)


def _grown(df: DataFrame, estimator: Estimator, family: str, features: str, cells: tuple, cuts: list[np.ndarray], top: float, width: int, inputs: Inputs | None = None) -> CellModel:
    """The trees of ``estimator`` over cells."""
    get = lambda name: estimator.getOrDefault(name)
    settings = {p: get(p) for p in _SETTINGS & {p.name for p in estimator.params if estimator.hasDefault(p) or estimator.isSet(p)}}
    trees = get("numTrees") if family == "rf" else 1
    settings |= {"classes": max(int(top) + 1, 2), "subset": _subset(get("featureSubsetStrategy").lower(), width, trees)}
    sc = df.sparkSession.sparkContext
    at = sc.broadcast(cells)
    try:
        if family == "rf":
            grown = sc.parallelize(range(trees), min(trees, 4 * sc.defaultParallelism)).mapPartitions(lambda own: _forest(at.value, settings, list(own))).collect()
            importance = sum(i / i.sum() if i.sum() else i for _, i in grown)
            weights = [1.0] * trees
        else:
            grown = sc.parallelize([0], 1).flatMap(lambda _: _boosted(at.value, settings)).collect()
            weights = [1.0] + [settings["stepSize"]] * (len(grown) - 1)
            importance = sum(w * i for w, (_, i) in zip([1.0] * len(grown), grown))
    finally:
        at.unpersist()
    return CellModel(features, cuts, [t for t, _ in grown], weights, family == "gbt", importance / (importance.sum() or 1.0), settings["classes"], inputs)
