"""Random search over parameter spaces, and the choice of the best."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("auROC", "auPR", "accuracy", "precision", "recall", "f1", "rmse", "mae", "r2")
PRIORITY = {True: ("auPR", "auROC", "f1", "accuracy", "precision", "recall"), False: ("rmse", "mae", "r2")}
LOWER_IS_BETTER = ("rmse", "mae")


def space_size(space: dict[str, Sequence]) -> int:
    return math.prod(len(v) for v in space.values())


def random_search(space: dict[str, Sequence], n: int = 50, seed: int = 42) -> list[dict]:
    """``n`` different combinations (all, if there are fewer), the same for the same seed: a draw of numbers without
    repetition from 0..size-1, each read as digits of mixed base."""
    size = space_size(space)
    out = []
    for at in random.Random(seed).sample(range(size), min(n, size)):
        combo = {}
        for name, values in space.items():
            at, digit = divmod(at, len(values))
            combo[name] = values[digit]
        out.append(combo)
    return out


def best_parameters(results: DataFrame, classifier: bool = True, metric: str | None = None, fold: str = "fold") -> dict:
    """The parameter set with the best mean of ``metric`` over its folds; if that is NaN or null everywhere, of the next
    metric by priority.  Columns that are neither metric nor fold are parameters; of equally good sets the first in
    the order of the parameters' text.  ValueError if no metric has a value."""
    priority = list(PRIORITY[classifier])
    names = ([metric] if metric else []) + [m for m in priority if m != metric]
    params = [c for c in results.columns if c not in METRICS and c not in (fold, "fold_id")]
    present = [m for m in METRICS if m in results.columns]
    value = {m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")) for m in present}
    sums = [x for m in present for x in (F.avg(value[m]).alias(f"{m}_mean"), F.stddev(value[m]).alias(f"{m}_std"))]
    rows = [r.asDict() for r in results.groupBy(*params).agg(*sums).collect()]  # one row per parameter set
    for m in names:
        valid = [r for r in rows if r.get(f"{m}_mean") is not None]
        if valid:
            sign = 1 if m in LOWER_IS_BETTER else -1
            best = min(valid, key=lambda r: (sign * r[f"{m}_mean"], str([r[p] for p in params])))
            chosen = {p: best[p] == "True" if best[p] in ("True", "False") else best[p] for p in params}
            scores = {k: v for k, v in best.items() if k not in params}
            return {"parameters": chosen, "metrics": scores, "metric": m, "asked_for": metric or names[0], "direction": "minimize" if sign == 1 else "maximize", "score": best[f"{m}_mean"]}
    raise ValueError("no metric has a value in any parameter set")
