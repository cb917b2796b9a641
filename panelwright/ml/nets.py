"""Multilayer perceptrons of many fits at once.

Spark's estimator runs a job for every step of every fit.  Here the rows of all fits are packed once into blocks, and one
stage of tasks that run side by side (a barrier) takes all steps of all fits: each task has some of the blocks, sums up loss and
gradient over them (some thousand numbers a fit), gets the sum over all tasks and goes on as they do.  The first task adds up; the
others are connected to it, as Spark's own exchange between such tasks takes a second each time.  The steps are those of Spark's ``l-bfgs``: the same layers, start, corrections, line search and limits.  The loss is the mean over all rows; Spark's is the
mean of the means of its blocks, so rows of blocks that are not full count more there, which depends on how rows lie in partitions.
"""

from __future__ import annotations

import math
import pickle
import secrets
import socket
from collections.abc import Callable, Generator, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import RDD, BarrierTaskContext, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTINGS = {"labelCol", "featuresCol", "layers", "maxIter", "tol", "blockSize", "solver", "stepSize", "seed"}
_CORRECTIONS, _MEMORY, _TRIES = 10, 20, 10
_TASKS, _ROWS, _WAIT = 64, 4096, 900  # at most so many tasks; rows in a block; seconds until a task that does not answer is given up
_TOGETHER, _KEPT = 1024, 128_000_000  # values of columns that are put together; bytes of rows that a task keeps as they are


class _Stuck(Exception):
    """No step that lowers the loss was found."""


def steps(x: np.ndarray, most: int, tolerance: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """L-BFGS as in Breeze, which Spark uses: yields where loss and gradient are wanted, returns the weights found."""
    value, grad = yield x
    first, seen, pairs, failed, at = value, [math.inf], [], False, 0
    while True:
        if at >= most or (len(seen) >= 2 and abs(value - max(seen)) <= tolerance * abs(first)) or np.linalg.norm(grad) <= max(tolerance * abs(value), 1e-8):
            return x
        try:
            direction = _direction(grad, pairs)
            t, value2, grad2 = yield from _search(x, value, grad, direction, 1.0 if at else 1.0 / np.linalg.norm(direction))
            if t * np.linalg.norm(grad) < 1e-10:
                raise _Stuck
        except _Stuck:
            if failed:
                return x
            failed, pairs = True, []
            continue
        new = x + direction * t
        pairs = [(new - x, grad2 - grad), *pairs][:_CORRECTIONS]
        x, value, grad, failed, at = new, value2, grad2, False, at + 1
        seen = [*seen, value][-_MEMORY:]


def _direction(grad: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out, parts = grad.copy(), []
    for s, y in pairs:
        rho = s @ y
        a = (s @ out) / rho if rho else math.nan
        if math.isnan(a):
            raise _Stuck
        out -= a * y
        parts.append((a, rho))
    if pairs:
        s, y = pairs[0]
        if not s @ y >= 0:
            raise _Stuck
        out *= (s @ y) / (y @ y)
    for (s, y), (a, rho) in zip(reversed(pairs), reversed(parts)):
        out += (a - (y @ out) / rho) * s
    return -out


def _between(a: tuple, b: tuple) -> float:
    """The minimum of the cubic through two points (place, value, slope), kept off their ends."""
    (l, fl, dl), (r, fr, dr) = sorted((a[:3], b[:3]))
    with np.errstate(invalid="ignore", divide="ignore"):
        d1 = dl + dr - 3 * (fl - fr) / (l - r)
        d2 = np.sqrt(np.float64(d1 * d1 - dl * dr))
        t = r - (r - l) * (dr + d2 - d1) / (dr - dl + 2 * d2)
    lo, hi = l + 0.1 * (r - l), l + 0.9 * (r - l)
    return lo if t < lo else hi if t > hi else float(t)


def _search(x: np.ndarray, value: float, grad: np.ndarray, direction: np.ndarray, t: float) -> Generator:
    """A step within the strong Wolfe conditions: its length, and loss and gradient there."""
    slope = float(grad @ direction)
    if slope > 0:
        raise _Stuck
    low, zoom = (0.0, value, slope, None), None
    for i in range(_TRIES):
        f, g = yield x + direction * t
        here = (t, f, float(g @ direction), g)
        if not math.isfinite(f):
            t /= 2
            continue
        if f > value + 1e-4 * t * slope or (f >= low[1] and i > 0):
            zoom = low, here
            break
        if abs(here[2]) <= 0.9 * abs(slope):
            return t, f, g
        if here[2] >= 0:
            zoom = here, low
            break
        low, t = here, t * 1.5
    if zoom:
        low, high = zoom
        for _ in range(_TRIES):
            t = _between(low, high)
            f, g = yield x + direction * t
            here = (t, f, float(g @ direction), g)
            if f > value + 1e-4 * t * slope or f >= low[1]:
                high = here
            else:
                if abs(here[2]) <= 0.9 * abs(slope):
                    return t, f, g
                if here[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = here
    raise _Stuck


def _pack(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> bytes:
    """A block of rows: columns and weights as places in their own values."""
    columns = []
    for c in (*x.T, *([] if w is None else [w])):
        values, at = np.unique(c, return_inverse=True)
        columns.append((values, at.astype(np.uint8 if len(values) <= 256 else np.uint16 if len(values) <= 65536 else np.uint32)))
    return pickle.dumps((columns, y, w is not None), 5)


class _Rows:
    """The rows of a task and a frame, their columns put together to few groups, of which a row has a place in each: ``tables``
    have the parts of rows by place.  The last column is ones."""

    def __init__(self, blocks: list[bytes]):
        parts = [pickle.loads(b) for b in blocks]
        self.y = np.concatenate([y for _, y, _ in parts])
        columns = []
        self.w = np.concatenate([values[at] for values, at in (c.pop() for c, _, _ in parts)]) if parts[0][2] else None
        for i in range(len(parts[0][0])):
            values = np.unique(np.concatenate([c[i][0] for c, _, _ in parts]))
            columns.append((len(values), i, values, np.concatenate([np.searchsorted(values, c[i][0])[c[i][1]] for c, _, _ in parts])))
        self.width = len(columns) + 1
        self.columns, self.tables, self.places = [[self.width - 1]], [np.ones((1, 1))], [np.zeros(len(self.y), np.int64)]
        for n, i, values, at in sorted(columns, key=lambda c: c[:2]):
            both, place = np.unique(self.places[-1] * n + at, return_inverse=True)
            if len(both) <= _TOGETHER:
                self.tables[-1] = np.column_stack([self.tables[-1][both // n], values[both % n]])
                self.columns[-1].append(i)
                self.places[-1] = place.ravel()
            else:
                self.tables.append(values[:, None])
                self.columns.append([i])
                self.places.append(at)
        self.places = [p.astype(np.uint16 if len(t) <= 65536 else np.uint32) for p, t in zip(self.places, self.tables)]
        self.few = sum(map(len, self.tables)) <= len(self.y) / 2
        self.whole = self._rows(self.places) if 8 * self.width * len(self.y) <= _KEPT else None

    def _rows(self, places: list[np.ndarray]) -> np.ndarray:
        x = np.empty((len(places[0]), self.width))
        for columns, table, place in zip(self.columns, self.tables, places):
            for i, values in zip(columns, table.T):
                x[:, i] = values[place]
        return x

    def chunks(self, size: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Rows, labels and places, so many at a time."""
        for at in range(0, len(self.y), size):
            places = [p[at : at + size].astype(np.intp) for p in self.places]
            yield self._rows(places) if self.whole is None else self.whole[at : at + size], self.y[at : at + size], places

    def powers(self, p: np.ndarray) -> list[np.ndarray] | None:
        """exp(-z) of the parts that the groups have in the first layer's z, by place; None where the product of a row's parts may not be a number."""
        if not self.few:
            return None
        parts = [table @ p[columns] for columns, table in zip(self.columns, self.tables)]
        return [np.exp(-z) for z in parts] if sum(np.abs(z).max() for z in parts) < 600 else None

    def loss(self, wanted: dict[int, np.ndarray], layers: list[list[int]]) -> dict[int, np.ndarray]:
        """For each of the weights what :func:`loss` says of the rows."""
        heads = {i: self.powers(_split(w, layers[i])[0]) if len(layers[i]) > 2 else None for i, w in wanted.items()}
        sums, kept = {i: np.zeros(1 + len(w)) for i, w in wanted.items()}, {}
        for x, y, places in self.chunks():
            for i, w in wanted.items():
                sums[i] += loss(w, layers[i], x, y, heads[i], places, kept)
        return sums


def _split(w: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    """Of each layer inputs and then bias by outputs, which is how Spark keeps them."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append(w[at : at + (a + 1) * b].reshape(a + 1, b))
        at += (a + 1) * b
    return out


def loss(w: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, powers: list[np.ndarray] | None = None, places: list[np.ndarray] | None = None, kept: dict | None = None) -> np.ndarray:
    """The sum of the cross entropy over the rows ``x``, which end with a one, and then of its gradient.

    With ``powers`` (see :class:`_Rows`) the exponentials of the first layer are products of those of its parts, which are looked up.
    ``kept`` keeps arrays from call to call.
    """
    parts, last, n, a, outs = _split(w, layers), len(layers) - 2, len(y), [x], []
    for i, p in enumerate(parts[:-1]):
        if (i, n, layers[i + 1]) not in (kept := {} if kept is None else kept):
            kept[i, n, layers[i + 1]] = np.empty((2, n, layers[i + 1]))
        s, other = kept[i, n, layers[i + 1]]
        if i == 0 and powers:
            np.take(powers[0], places[0], axis=0, out=s, mode="clip")
            for power, place in zip(powers[1:], places[1:]):
                np.take(power, place, axis=0, out=other, mode="clip")
                np.multiply(s, other, out=s)
        else:
            np.matmul(a[-1], p if i == 0 else p[:-1], out=s)
            if i:
                s += p[-1]
            np.negative(s, out=s)
            with np.errstate(over="ignore"):
                np.exp(s, out=s)
        s += 1
        np.reciprocal(s, out=s)
        a.append(s)
        outs.append(other)
    of = [p if i == 0 else p[:-1] for i, p in enumerate(parts)]
    if layers[-1] == 2:  # the outputs' slopes are opposite: one number a row
        apart, sign = of[-1][:, 1] - of[-1][:, 0], np.where(y == 1, 1.0, -1.0)
        m = a[-1] @ apart
        if last:
            m += parts[-1][-1, 1] - parts[-1][-1, 0]
        m *= sign
        e = np.exp(-np.abs(m))
        total = float((np.log1p(e) - np.minimum(m, 0)).sum())
        g = np.where(m > 0, e, 1.0) / (1 + e) * -sign
        s = a[-1].T @ g
        s = np.append(s, g.sum()) if last else s
        out, back = np.stack([-s, s], axis=1), None
    else:
        z = a[-1] @ of[-1]
        if last:
            z += parts[-1][-1]
        z -= z.max(axis=1, keepdims=True)
        rows = np.arange(n)
        mine = z[rows, y]
        np.exp(z, out=z)
        whole = z.sum(axis=1)
        total = float((np.log(whole) - mine).sum())
        z /= whole[:, None]
        z[rows, y] -= 1
        out = np.vstack([a[-1].T @ z, z.sum(axis=0)]) if last else a[-1].T @ z
        back = z
    sums = [out]
    for i in range(last, 0, -1):
        slope = outs[i - 1]
        np.multiply(a[i], a[i], out=slope)
        np.subtract(a[i], slope, out=slope)
        if back is not None:
            back = np.multiply(slope, back @ of[i].T, out=slope)
            own = a[i - 1].T @ back
        elif i > 1:
            back = np.multiply(slope, np.outer(g, apart), out=slope)
            own = a[i - 1].T @ back
        else:
            own = ((x * g[:, None]).T @ slope) * apart
        sums.append(own if i == 1 else np.vstack([own, back.sum(axis=0)]))
    sums.reverse()
    return np.concatenate([[total], *[s.ravel() for s in sums]])


def _read(link: socket.socket, n: int) -> bytes:
    out = bytearray(n)
    view, at = memoryview(out), 0
    while at < n:
        got = link.recv_into(view[at:])
        if not got:
            raise ConnectionError("a task of this fit has ended")
        at += got
    return bytes(out)


class _Sum:
    """Sums over all tasks of a barrier stage, the same in each: in the order of the tasks, made by the first."""

    def __init__(self, context: BarrierTaskContext):
        tasks, self.own, self.links = context.getTaskInfos(), context.partitionId(), []
        self.tasks = len(tasks)
        host = tasks[0].address.rpartition(":")[0].strip("[]")
        server = socket.create_server(("", 0)) if not self.own else None
        port, token = context.allGather(f"{server.getsockname()[1]} {secrets.token_hex(16)}" if server else "")[0].split()
        if server is None:
            self.links = [socket.create_connection((host, int(port)), _WAIT)]
            self.links[0].sendall(token.encode() + self.own.to_bytes(4, "big"))
        else:
            server.settimeout(_WAIT)
            known: dict[int, socket.socket] = {}
            while len(known) < len(tasks) - 1:
                link, _ = server.accept()
                link.settimeout(_WAIT)
                try:
                    said = _read(link, len(token) + 4)
                except OSError:
                    continue
                if secrets.compare_digest(said[:-4], token.encode()):
                    known[int.from_bytes(said[-4:], "big")] = link
            server.close()
            self.links = [known[i] for i in sorted(known)]
        for link in self.links:
            link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def __call__(self, own: np.ndarray) -> np.ndarray:
        if self.own:
            self.links[0].sendall(own.tobytes())
            return np.frombuffer(_read(self.links[0], own.nbytes))
        for link in self.links:
            own = own + np.frombuffer(_read(link, own.nbytes))
        for link in self.links:
            link.sendall(own.tobytes())
        return own

    def each(self, own: np.ndarray) -> np.ndarray:
        """The number of each task."""
        out = np.zeros(self.tasks)
        out[self.own] = own[0]
        return self(out)

    def close(self) -> None:
        for link in self.links:
            link.close()


def can_fit(estimator: Estimator) -> bool:
    given = {p.name for p in estimator.params if estimator.isSet(p)}
    return not given - _SETTINGS and estimator.getOrDefault("solver") == "l-bfgs"


class _Packed:
    """Blocks of the rows of some frames, kept for a stage of side by side tasks.  ``sizes``: rows and greatest label by frame."""

    def __init__(self, held: RDD):
        self.held = held
        self.sizes = held.map(lambda b: (b[0], (b[1], b[2]))).reduceByKey(lambda a, b: (a[0] + b[0], max(a[1], b[1]))).collectAsMap()

    def climb(self, begin: Callable, of: list[int], name: Callable, evaluate: Callable, fits: int) -> list[np.ndarray | None]:
        """Where the walks of all fits end.  ``begin`` makes them of a task's rows by frame and :class:`_Sum`, and what the sums over all
        rows are divided by; ``of`` are the frames of the fits, and fits of one frame and ``name`` that are at one place are evaluated once."""

        def walk(own: Iterator[tuple]) -> Iterator[list[np.ndarray | None]]:
            context, mine = BarrierTaskContext.get(), {}
            for k, _, _, block in own:
                mine.setdefault(k, []).append(block)
            mine = {k: _Rows(blocks) for k, blocks in mine.items()}
            total = _Sum(context)
            walks, counts = begin(mine, total)
            wanted, found = {i: next(w) for i, w in enumerate(walks) if w is not None}, {}
            while wanted:
                once: dict[tuple, int] = {}  # fits that differ in their limits only go the same way until one of them ends
                same = {i: once.setdefault((of[i], name(i), w.tobytes()), i) for i, w in wanted.items()}
                sums = {i: np.zeros(1 + len(wanted[i])) for i in once.values()}
                for k, rows in mine.items():
                    asked = {i: wanted[i] for i in sums if of[i] == k}
                    for i, more in evaluate(rows, asked).items() if asked else ():
                        sums[i] += more
                whole, at, means = total(np.concatenate(list(sums.values()))), 0, {}
                for i, own_sums in sums.items():
                    means[i] = whole[at : at + len(own_sums)] / counts[i]
                    at += len(own_sums)
                for i, first in same.items():
                    try:
                        wanted[i] = walks[i].send((float(means[first][0]), means[first][1:]))
                    except StopIteration as end:
                        found[i] = end.value
                        del wanted[i]
            total.close()
            if context.partitionId() == 0:
                yield [found.get(i) for i in range(fits)]

        return self.held.barrier().mapPartitions(walk).collect()[0]


@contextmanager
def packed(frames: list[DataFrame], target: str, features: str, weight: str | float | None = None) -> Iterator[_Packed]:
    sc = frames[0].sparkSession.sparkContext

    def blocks_of(k: int, df: DataFrame) -> DataFrame:
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                if not (np.isfinite(y).all() and (y == np.floor(y)).all() and y.min() >= 0 and y.max() < 2**15):
                    raise ValueError("labels have to be 0, 1, 2 ...")
                if not (np.isfinite(w).all() and w.min() >= 0):
                    raise ValueError("weights have to be 0 or more")
                y = y.astype(np.int16)
                cut = [slice(i, i + _ROWS) for i in range(0, len(y), _ROWS)]
                columns = [[k] * len(cut), [len(y[c]) for c in cut], [int(y[c].max()) for c in cut], [_pack(x[c], y[c], None if weight is None else w[c]) for c in cut]]
                yield pa.record_batch([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["k", "n", "top", "block"])

        w = F.col(weight).cast("double") if isinstance(weight, str) else F.lit(1.0)
        return df.select(vector_to_array(features).alias("x"), F.col(target).cast("double").alias("y"), w.alias("w")).mapInArrow(pack, "k int, n long, top int, block binary")

    blocks = blocks_of(0, frames[0])
    for k, df in enumerate(frames[1:], 1):
        blocks = blocks.unionByName(blocks_of(k, df))
    held = blocks.repartition(min(sc.defaultParallelism, _TASKS)).rdd.map(lambda r: (r["k"], r["n"], r["top"], bytes(r["block"]))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield _Packed(held)
    finally:
        held.unpersist()


def weights_all(frames: list[DataFrame], fits: list[tuple[int, Estimator]], target: str, features: str = "features") -> list[np.ndarray]:
    """The weights of each of ``fits``: the place of its rows in ``frames``, and its estimator.  ValueError for a label that the layers do not have."""
    spark = frames[0].sparkSession
    with packed(frames, target, features) as held:
        layers = [list(e.getOrDefault("layers")) for _, e in fits]
        for (k, _), shape in zip(fits, layers):
            if k not in held.sizes:
                raise ValueError("no rows to fit to")
            if held.sizes[k][1] >= shape[-1]:
                raise ValueError(f"a label of {held.sizes[k][1]} needs more than {shape[-1]} outputs")
        of, limits = [k for k, _ in fits], [(e.getOrDefault("maxIter"), e.getOrDefault("tol")) for _, e in fits]
        known: dict[tuple, np.ndarray] = {}
        for (_, e), shape in zip(fits, layers):
            if (key := (e.getOrDefault("seed"), *shape)) not in known:
                known[key] = _model(spark, e, shape, None, target, features).weights.toArray()
        starts = [known[e.getOrDefault("seed"), *shape] for (_, e), shape in zip(fits, layers)]
        counts = [held.sizes[k][0] for k in of]

        def evaluate(rows: _Rows, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
            return rows.loss(wanted, layers)

        return held.climb(lambda *_: ([steps(x, *limit) for x, limit in zip(starts, limits)], counts), of, lambda i: tuple(layers[i]), evaluate, len(fits))


def fit_all(frames: list[DataFrame], fits: list[tuple[int, Estimator]], target: str, features: str = "features") -> list[Model]:
    """Spark's models with the weights of :func:`weights_all`."""
    found = weights_all(frames, fits, target, features)
    return [_model(frames[0].sparkSession, e, list(e.getOrDefault("layers")), w, target, features) for (_, e), w in zip(fits, found)]


def outputs(w: np.ndarray, layers: list[int], x: np.ndarray) -> np.ndarray:
    """Probabilities by row and class."""
    parts = _split(w, layers)
    with np.errstate(over="ignore"):
        for i, p in enumerate(parts):
            z = x @ p[:-1] + p[-1]
            x = 1 / (1 + np.exp(-z)) if i < len(parts) - 1 else z
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _model(spark: SparkSession, estimator: Estimator, layers: list[int], w: np.ndarray | None, target: str, features: str) -> Model:
    """Spark's model with these weights, or those it starts with: its estimator takes no step; one row of zeros is enough for that."""
    one = spark.createDataFrame([(0.0, Vectors.dense([0.0] * layers[0]))], [target, features])
    given = {} if w is None else {estimator.getParam("initialWeights"): Vectors.dense(w.tolist())}
    return estimator.copy({estimator.getParam("maxIter"): 0, **given}).fit(one)
