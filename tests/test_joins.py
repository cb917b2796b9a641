import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators.dedupe import latest_per_key
from panelwright.operators import joins
from panelwright.operators.joins import asof_join, interval_nearest_join, nearest_holding, pair_sequences, prefer, salted_lookup

T0 = dt.datetime(2024, 1, 1)
M = dt.timedelta(minutes=1)


@pytest.mark.parametrize("fallback,hot", [(False, 200_000), (True, 200_000), (True, 4)])
def test_asof(spark, monkeypatch, fallback, hot):
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    rng = random.Random(1)
    right = [(rng.choice("ab"), rng.randrange(-300, 600), rng.randrange(99)) for _ in range(25)] + [("a", None, 1), (None, 5, 1)]
    left = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-400, 700, 7)])) for i in range(200)]
    ldf, rdf = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, u int, v int")
    got = {r["id"]: r["v"] for r in asof_join(ldf, rdf, ["k"], "t", "u", ["v"], tie=["v"], forward_fallback=fallback).collect()}
    want = {}
    for i, k, t in left:
        cand = [(u, v) for kk, u, v in right if kk == k and k is not None and u is not None]
        back = [c for c in cand if t is not None and c[0] <= t]
        ahead = [c for c in cand if t is not None and c[0] > t]
        best = max(back) if back else None
        if best is None and fallback and ahead:
            u = min(ahead)[0]
            best = max(c for c in ahead if c[0] == u)
        want[i] = best[1] if best else None
    assert got == want


def test_nearest_holding_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(60):
        k = int(rng.integers(0, 30))
        anchor = np.sort(rng.integers(0, 60, k))
        lo, hi = anchor - rng.integers(0, 15, k), anchor + rng.integers(0, 15, k)
        t = rng.integers(-20, 80, 40)
        got = nearest_holding(t, lo, hi, anchor)
        for q, g in zip(t, got):
            fits = [j for j in range(k) if lo[j] <= q <= hi[j]]
            if not fits:
                assert g == -1
            else:
                best = min(abs(anchor[j] - q) for j in fits)
                assert g >= 0 and lo[g] <= q <= hi[g] and abs(anchor[g] - q) == best
                assert anchor[g] == min(anchor[j] for j in fits if abs(anchor[j] - q) == best)


def test_interval_nearest_bounds_are_inclusive(spark):
    points = spark.createDataFrame([(1, "a", T0), (2, "a", T0 + 360 * M), (3, "a", T0 + 361 * M), (4, "a", T0 - 1080 * M), (5, "a", T0 - 1081 * M), (6, None, T0), (7, "a", None), (8, "b", T0)], "id long, e string, at timestamp_ntz")
    spans = spark.createDataFrame([(10, "a", T0), (11, None, T0), (12, "b", None)], "sid long, e string, s timestamp_ntz")
    hours = lambda n: F.make_dt_interval(hours=F.lit(n))
    out = interval_nearest_join(points, "id", "e", "at", spans, "sid", F.col("s") - hours(18), F.col("s") + hours(6), F.col("s"))
    assert {r["id"]: r["sid"] for r in out.collect()} == {1: 10, 2: 10, 3: None, 4: 10, 5: None, 6: None, 7: None, 8: None}


@pytest.mark.parametrize("gap,fits", [(299, False), (300, True), (7200, True), (7201, False)])
def test_pairs(spark, gap, fits):
    a = spark.createDataFrame([("k", T0)], "k string, at timestamp_ntz")
    b = spark.createDataFrame([("k", T0 + dt.timedelta(seconds=gap)), ("k", T0 - M)], "k string, at timestamp_ntz")
    assert pair_sequences(a, b, ["k"], "at", 300, 7200).count() == int(fits)


def test_prefer_and_latest(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, prefer(a, b, ["k"]).collect())) == [(1, "a"), (2, "b")]
    rows = spark.createDataFrame([(1, None, "x"), (1, 3, "y"), (1, 3, "z"), (None, 1, "n")], "k int, t int, v string")
    assert sorted(map(tuple, latest_per_key(rows, ["k"], ["t", "v"]).fillna(-1).collect())) == [(-1, 1, "n"), (1, 3, "z")]


@pytest.mark.parametrize("hot", [3, 200_000])
def test_salted_lookup_is_a_left_join(spark, monkeypatch, hot):
    monkeypatch.setattr(joins, "HOT_ROWS", hot)
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2]) for i in range(40)], "i int, k string")
    table = spark.createDataFrame([("a", 1), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, salted_lookup(rows, table, "k").select("i", "k", "v").collect()), key=str) == sorted(map(tuple, rows.join(table, "k", "left").select("i", "k", "v").collect()), key=str)
