import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators.rolling_totals import banded_operator, rolling_totals

D0 = dt.date(2024, 1, 1)


def brute(rows, windows):
    days = {}
    for e, d, v in rows:
        if e is not None and d is not None:
            days.setdefault(e, {}).setdefault(d, 0.0)
            days[e][d] += v if v is not None and v == v else 0.0
    out = {}
    for e, by in days.items():
        d = min(by)
        while d <= max(by):
            out[e, d] = tuple(sum(by.get(d - dt.timedelta(k), 0.0) for k in range(1, w + 1)) for w in windows)
            d += dt.timedelta(1)
    return out


def run(spark, rows, windows=(7, 30), **kw):
    df = spark.createDataFrame(rows, "e string, d date, v double")
    return {(r["entity"], r["day"]): tuple(r[f"total_{w}d"] for w in windows) for r in rolling_totals(df, "e", "d", "v", windows, **kw).collect()}


def test_band():
    b = banded_operator(3, 2, [2])
    assert b.tolist() == [[1, 0, 0], [1, 1, 0], [0, 1, 1], [0, 0, 1], [0, 0, 0]]


@pytest.mark.parametrize("tile", [30, 41, 128])
def test_against_brute_force(spark, tile):
    rng = random.Random(tile)
    rows = [(rng.choice("abc"), D0 + dt.timedelta(rng.randrange(400)), float(rng.randrange(5))) for _ in range(300)]
    rows += [("far", D0, 1.0), ("far", D0 + dt.timedelta(300), 2.0), ("old", dt.date(1969, 12, 1), 1.0), ("old", dt.date(1970, 1, 20), 1.0)]
    assert run(spark, rows, tile_days=tile) == brute(rows, (7, 30))


def test_nulls_repeats_and_empty(spark):
    rows = [("a", D0, 1.0), ("a", D0, 1.0), ("a", D0 + dt.timedelta(1), None), ("a", D0 + dt.timedelta(2), float("nan")), (None, D0, 5.0), ("a", None, 5.0), ("", D0, 3.0)]
    assert run(spark, rows) == brute(rows, (7, 30))
    assert run(spark, []) == {}


def test_latest_row_counts_and_carried_value(spark):
    rows = [("a", D0, 1, 10, 0, 7), ("a", D0, 1, 11, 1, 8), ("a", D0, None, 99, 1, 9), ("a", D0 + dt.timedelta(2), 1, 1, 0, None)]
    df = spark.createDataFrame(rows, "entity string, day date, loaded int, id int, value int, carried int").withColumn("tile", F.lit("x"))
    out = {r["day"]: (r["total_7d"], r["average_7d"], r["carried"]) for r in rolling_totals(df, "entity", "day", "value", [7], latest_by=["loaded", "id"], carried="carried").collect()}
    assert out == {D0: (0, 0, 8), D0 + dt.timedelta(1): (1, 1 / 7, None), D0 + dt.timedelta(2): (1, 1 / 7, None)}


def test_windows_must_be_positive(spark):
    with pytest.raises(ValueError):
        rolling_totals(spark.createDataFrame([], "e string, d date, v double"), "e", "d", "v", [0])


def test_blocks_are_independent_of_batching():
    import pyarrow as pa

    from panelwright.operators.blocks import whole_groups

    rows = pa.table({"k": ["a"] * 5 + ["b"] * 3 + [None] * 2, "n": list(range(10))})
    for size in (1, 2, 3, 10):
        groups = []
        for t, starts in whole_groups(rows.to_batches(max_chunksize=size), ["k"]):
            ends = np.append(starts[1:], t.num_rows)
            groups += [t.column("n").to_pylist()[a:b] for a, b in zip(starts, ends)]
        assert groups == [[0, 1, 2, 3, 4], [5, 6, 7], [8, 9]]
