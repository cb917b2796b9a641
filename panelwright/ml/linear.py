"""Logistic regressions and linear support vector machines of many fits at once, in one stage as the nets are.

The loss over all rows, its weights, scaling, penalties, start and steps are those of Spark's estimators (``l-bfgs``, with a penalty
of absolute values or for the hinge loss ``OWL-QN``, as in Breeze); here a round of all fits is one pass of each task over its rows.
"""

from __future__ import annotations

import math
from collections.abc import Generator

import numpy as np
from pyspark.ml import Estimator
from pyspark.sql import DataFrame

from panelwright.ml import nets

_SETTINGS = {"labelCol", "featuresCol", "weightCol", "regParam", "elasticNetParam", "maxIter", "tol", "fitIntercept", "standardization", "threshold", "aggregationDepth"}


def corner_steps(x: np.ndarray, most: int, tolerance: float, l1: np.ndarray) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """OWL-QN: as :func:`nets.steps`, with a penalty ``l1`` of absolute values, kept in one orthant a step."""
    value, grad = yield x
    whole, slope = _adjusted(x, value, grad, l1)
    first, seen, pairs, failed, at = whole, [math.inf], [], False, 0
    while True:
        if at >= most or (len(seen) >= 2 and abs(whole - max(seen)) <= tolerance * abs(first)) or np.linalg.norm(slope) <= max(tolerance * abs(whole), 1e-8):
            return x
        try:
            direction = nets._direction(slope, pairs)
            direction = np.where(direction * slope < 0, direction, 0.0)
            orthant = np.where(x != 0, np.sign(x), -np.sign(slope))
            new, value2, grad2 = yield from _backtrack(x, value, whole, float(slope @ direction), direction, orthant, l1, 0.1 if at < 1 else 0.5, 1.0 if at else 0.5 / np.linalg.norm(grad))
        except nets._Stuck:
            if failed:
                return x
            failed, pairs = True, []
            continue
        pairs = [(new - x, grad2 - grad), *pairs][: nets._CORRECTIONS]
        x, value, grad, failed, at = new, value2, grad2, False, at + 1
        whole, slope = _adjusted(x, value, grad, l1)
        seen = [*seen, value][-nets._MEMORY :]


def _adjusted(x: np.ndarray, value: float, grad: np.ndarray, l1: np.ndarray) -> tuple[float, np.ndarray]:
    up, down = grad + l1, grad - l1
    at_zero = np.where(down > 0, down, np.where(up < 0, up, 0.0))
    return value + float(np.abs(l1 * x).sum()), np.where(l1 == 0, grad, np.where(x == 0, at_zero, grad + np.sign(x) * l1))


def _backtrack(x: np.ndarray, value: float, whole: float, slope: float, direction: np.ndarray, orthant: np.ndarray, l1: np.ndarray, shrink: float, t: float) -> Generator:
    """Breeze's line search; of the first length it knows the slope only, and takes the value at the start for its own."""
    told = value
    for i in range(20):
        new = x + direction * t
        new = np.where(np.sign(new) == np.sign(orthant), new, 0.0)
        raw, grad = yield new
        there, adjusted = _adjusted(new, raw, grad, l1)
        here = float(adjusted @ direction)
        told = there if i else told
        by = shrink if told > whole + t * slope * 1e-4 else 2.1 if here < 0.9 * slope else shrink if here > -0.9 * slope else 1.0
        if by == 1 or i == 19:
            return new, raw, grad
        t *= by
        if not 1e-10 <= t <= 1e10:
            raise nets._Stuck
    raise nets._Stuck


def can_fit(estimator: Estimator) -> bool:
    given = {p.name for p in estimator.params if estimator.isSet(p)}
    return not given - _SETTINGS


def sums(kind: str, rows: nets._Rows, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each of the coefficients (the last is the intercept) the loss over the rows and its gradient."""
    c, out = np.column_stack(list(wanted.values())), np.zeros((len(wanted), 1 + rows.width))
    at = 0
    for x, y, _ in rows.chunks(4096):
        w, y = rows.w[at : at + len(y), None], y[:, None].astype(float)
        at += len(y)
        m = x @ c
        if kind == "lr":
            e = np.exp(-np.abs(m))
            out[:, 0] += (w * (np.log1p(e) + np.maximum(m, 0) - y * m)).sum(axis=0)
            by = w * (np.where(m > 0, 1.0, e) / (1 + e) - y)
        else:
            sign = 2 * y - 1
            gap = 1 - sign * m
            out[:, 0] += (w * np.maximum(gap, 0)).sum(axis=0)
            by = np.where(gap > 0, -sign * w, 0.0)
        out[:, 1:] += by.T @ x
    return dict(zip(wanted, out))


def _moments(mine: dict[int, nets._Rows], frames: int, total: nets._Sum) -> list[tuple]:
    """Of each frame: weight, that of the rows of class 1, means and deviations of its columns."""
    parts = []
    for k in range(frames):
        r = mine.get(k)
        parts.append([0.0] * 3 if r is None else [r.w.sum(), (r.w * r.w).sum(), r.w[r.y == 1].sum()])
    width = max([r.width for r in mine.values()], default=0)
    width = int(max(total.each(np.array([float(width)]))))

    def over(f) -> np.ndarray:
        out = np.zeros((frames, width))
        for k, r in mine.items():
            at = 0
            for x, _, _ in r.chunks(4096):
                out[k] += r.w[at : at + len(x)] @ f(x, k)
                at += len(x)
        return total(out.ravel()).reshape(frames, width)

    weights = total(np.array(parts).ravel()).reshape(frames, 3)
    with np.errstate(invalid="ignore", divide="ignore"):
        means = over(lambda x, k: x) / weights[:, :1]
        spread = over(lambda x, k: (x - means[k]) ** 2)
        std = np.sqrt(np.nan_to_num(spread / (weights[:, :1] - weights[:, 1:2] / weights[:, :1])))
    return [(weights[k, 0], weights[k, 2], means[k, :-1], std[k, :-1]) for k in range(frames)]


def _walk(kind: str, settings: dict, whole: float, ones: float, mean: np.ndarray, std: np.ndarray) -> Generator:
    """Coefficients of columns as they are; inside, steps are taken for scaled ones."""
    n, fit = len(mean), settings["fitIntercept"]
    inverse = np.divide(1.0, std, out=np.zeros(n), where=std != 0)
    centre = mean * inverse if fit else np.zeros(n)
    share = settings["elasticNetParam"] if kind == "lr" else 0.0
    l2, l1 = settings["regParam"] * (1 - share), settings["regParam"] * share
    per = np.ones(n) if settings["standardization"] else inverse
    penalty = np.append(l1 * per, [0.0] * fit)
    start = np.append(np.zeros(n), [math.log(ones / (whole - ones)) if kind == "lr" else 0.0] * fit)
    plain = kind == "lr" and not l1
    walk = nets.steps(start, settings["maxIter"], settings["tol"]) if plain else corner_steps(start, settings["maxIter"], settings["tol"], penalty)

    def seen(w: np.ndarray) -> np.ndarray:
        return np.append(w[:n] * inverse, (w[n] if fit else 0.0) - centre @ w[:n])

    w = next(walk)
    while True:
        got = yield seen(w)
        value, grad = got[0], np.append(got[1][:n] * inverse - centre * got[1][n], [got[1][n]] * fit)
        value, grad[:n] = value + 0.5 * l2 * float((w[:n] ** 2 * per**2).sum()), grad[:n] + l2 * w[:n] * per**2
        try:
            w = walk.send((value, grad))
        except StopIteration as end:
            return seen(end.value)


def fit_all(kind: str, frames: list[DataFrame], fits: list[tuple[int, Estimator]], target: str, weight: str | None, features: str = "features") -> list[np.ndarray | None]:
    """Coefficients and intercept of each fit; None for one to rows of one class, which is left to Spark."""
    settings = [{p: e.getOrDefault(p) for p in ("regParam", "maxIter", "tol", "fitIntercept", "standardization", *(["elasticNetParam"] if kind == "lr" else []))} for _, e in fits]
    of, count = [k for k, _ in fits], len(frames)

    def begin(mine: dict[int, nets._Rows], total: nets._Sum) -> tuple[list, list[float]]:
        known = _moments(mine, count, total)
        return [_walk(kind, s, *known[k]) if 0 < known[k][1] < known[k][0] else None for k, s in zip(of, settings)], [known[k][0] for k in of]

    with nets.packed(frames, target, features, weight or 1.0) as held:
        for k, (_, top) in held.sizes.items():
            if top > 1:
                return [None] * len(fits)
        return held.climb(begin, of, lambda i: kind, lambda rows, wanted: sums(kind, rows, wanted), len(fits))
