import datetime as dt
import random

import pytest

from panelwright.operators import intervals
from panelwright.operators.intervals import gaps_within_label, periods_and_gaps

T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)
US = dt.timedelta(microseconds=1)


def us(t):
    return (t - dt.datetime(1970, 1, 1)) // US


def brute(rows):
    by = {}
    for e, s, t, w in rows:
        if e is not None and s is not None and t is not None and t > s:
            by.setdefault(e, []).append((s, t, w))
    periods, gaps, cases = set(), set(), set()
    for e, xs in by.items():
        merged = []
        for s, t, w in sorted(xs, key=lambda x: x[:2]):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
                merged[-1][2].add(w)
            else:
                merged.append([s, t, {w}])
        periods |= {(e, us(a), us(b)) for a, b, _ in merged}
        for x, y in zip(merged, merged[1:]):
            gaps.add((e, us(x[1]), us(y[0])))
            if (x[2] & y[2]) - {None}:
                cases.add((e, us(x[1]), us(y[0])))
    return periods, gaps, cases


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "entity string, start timestamp_ntz, end timestamp_ntz, label date")
    found = periods_and_gaps(df, "entity", "start", "end", "label", **kw)
    periods = [(r["entity"], r["period_start"], r["period_end"]) for r in found["periods"].collect()]
    gaps = [(r["entity"], r["gap_start"], r["gap_end"]) for r in found["gaps"].collect()]
    cases = [(r["entity"], r["gap_start"], r["gap_end"]) for r in gaps_within_label(found).collect()]
    assert len(set(periods)) == len(periods) and len(set(gaps)) == len(gaps) and len(set(cases)) == len(cases)
    return set(periods), set(gaps), set(cases)


@pytest.mark.parametrize("days", [1, 2, 7])
def test_against_brute_force(spark, days):
    rng = random.Random(days)
    rows = []
    for _ in range(250):
        s = T0 + H * rng.randrange(24 * 40) + dt.timedelta(minutes=rng.choice([0, 0, 30]))
        rows.append((rng.choice("abcd"), s, s + H * rng.choice([1, 2, 8, 8, 30, 200]) * rng.choice([1, 1, 1, -1]), rng.choice([None, s.date(), (s - H * 6).date()])))
    rows += rows[:30]
    assert run(spark, rows, shard_days=days) == brute(rows)


def test_touching_at_a_shard_edge_and_one_microsecond_apart(spark):
    edge = dt.datetime(1970, 1, 1) + dt.timedelta(days=7 * 2817)
    w = edge.date()
    rows = [("a", edge - H, edge, w), ("a", edge, edge + H, w), ("b", edge - H, edge, w), ("b", edge + US, edge + H, w), ("c", edge - 24 * 30 * H, edge + 24 * 30 * H, w), ("c", edge + 24 * 31 * H, edge + 24 * 32 * H, w)]
    assert run(spark, rows) == brute(rows)


def test_nulls_unusable_ends_and_empty(spark):
    rows = [(None, T0, T0 + H, None), ("a", None, T0, None), ("a", T0, None, None), ("a", T0, T0, None), ("a", T0 + H, T0, None)]
    assert run(spark, rows) == (set(), set(), set())
    assert run(spark, []) == (set(), set(), set())
    assert run(spark, [*rows, ("a", T0, T0 + H, None), ("a", T0 + 2 * H, T0 + 3 * H, None)])[2] == set()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 400])
def test_runs_are_independent_of_batching(size):
    """Both steps at once, fed by batches of any size, against the union of all rows."""
    import pyarrow as pa

    rng = random.Random(size)
    day = 24 * 3_600_000_000
    rows = [(rng.choice("ab"), s := rng.randrange(60), s + rng.choice([1, 1, 2, 3, 25]), rng.choice([None, None, 1, 2])) for _ in range(90)]
    pieces = []
    for e, s, t, w in rows:  # shards of ten units
        pieces += [(e, k, w, max(s - 10 * k, 0), min(t - 10 * k, 10)) for k in range(s // 10, (t - 1) // 10 + 1)]
    pieces.sort(key=lambda r: (r[0], r[1], r[3]))
    kinds = frozenset((intervals.PERIOD, intervals.GAP))
    t = pa.table([pa.array(c, k) for c, k in zip(zip(*pieces), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["entity", "shard", "label", "start", "end"])
    runs = pa.Table.from_batches(list(intervals._runs(kinds, 10)(iter(t.to_batches(max_chunksize=size)))))
    runs = runs.sort_by([("entity", "ascending"), ("lane", "ascending"), ("start", "ascending")])
    out = pa.Table.from_batches(list(intervals._across(kinds)(iter(runs.to_batches(max_chunksize=size))))).to_pylist()
    times = [(e, T0 + s * US * day, T0 + t * US * day, w) for e, s, t, w in rows]
    periods, gaps, cases = brute(times)
    at = lambda x: us(T0 + x * US * day)
    assert sorted((r["entity"], at(r["start"]), at(r["end"])) for r in out if r["kind"] == intervals.PERIOD) == sorted(periods)
    assert sorted((r["entity"], at(r["start"]), at(r["end"])) for r in out if r["kind"] == intervals.GAP) == sorted(gaps)
    assert {(r["entity"], at(r["start"]), at(r["end"])) for r in out if r["common"]} == cases
    labels = {(r["entity"], r["start"], w) for r in out for w in r["labels"] or []}
    assert labels == {(e, p, w) for e, s, _, w in rows if w for (x, a, b) in periods if x == e for p in [next(r["start"] for r in out if r["kind"] == 0 and r["entity"] == e and at(r["start"]) == a)] if a <= at(s) < b}


def test_a_hot_entity_is_compressed_before_the_shuffle(spark):
    import pyarrow as pa

    rng = random.Random(1)
    rows = [("hot", s := T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 40)), s + 8 * H, s.date()) for _ in range(20000)]
    t = pa.table({"entity": ["hot"] * 20000, "shard": pa.array([0] * 20000, pa.int32()), "label": [(r[3] - T0.date()).days for r in rows], "start": [(r[1] - T0) // US for r in rows], "end": [(r[2] - T0) // US for r in rows]})
    united = pa.Table.from_batches(list(intervals._local_bitmaps(iter(t.to_batches(max_chunksize=1000)))))
    assert united.num_rows <= 2 * 40
    assert run(spark, rows[:500]) == brute(rows[:500])
