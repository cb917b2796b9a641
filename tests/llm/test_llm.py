import datetime as dt
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import components, mixture, packing, quality, runs, splits, tokens
from panelwright.llm.components import connected_components
from panelwright.llm.nearest_time import match_nearest_time

T0 = dt.datetime(2024, 1, 1)
S = dt.timedelta(seconds=1)


# --- splits -------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("one_task", [0, 100_000])
def test_components_of_chains_stars_and_loops(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    star = [("hub", f"s{i}") for i in range(60)]
    links = [*chain, *chain[:9], *star, ("s1", "hub"), ("x", "x"), (None, "y"), ("z", None)]
    random.Random(1).shuffle(links)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()}
    assert {got[f"c{i:03}"] for i in range(121)} == {"c000"} and {got[f"s{i}"] for i in range(60)} | {got["hub"]} == {"hub"}
    assert "x" not in got and "y" not in got
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


@pytest.mark.parametrize("one_task", [0, 100_000])
def test_long_chains_of_ids_settle(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    ids = [f"{i:03d}" for i in range(400)]
    random.Random(5).shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:])), "a string, b string").coalesce(1)
    got = {r["id"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    assert got == dict.fromkeys(ids, "000")


def test_flow_meets_quotas_at_least_cost():
    rng = np.random.default_rng(0)
    for _ in range(50):
        supply = rng.integers(1, 60, rng.integers(1, 8))
        shares = rng.dirichlet([3, 1, 1])
        flow = splits.quota_flow(supply, shares)
        assert (flow >= 0).all() and (flow.sum(axis=1) == supply).all()
        assert (flow.sum(axis=0) == splits._whole_parts(int(supply.sum()), shares)).all()
        assert (np.abs(flow - supply[:, None] * shares) < len(shares)).all()


@pytest.mark.parametrize("seed", [0, 1])
def test_whole_components_keep_the_quotas_of_the_flow(seed):
    rng = np.random.default_rng(seed)
    profiles = sorted({(s := int(rng.integers(1, 256)), int(rng.integers(0, s + 1))) for _ in range(3000)})
    size, pos = (np.array([p[k] for p in profiles]) for k in (0, 1))
    count = rng.integers(1, 50, len(size))
    share = np.array([0.8, 0.1, 0.1])
    rows, positives = share * (count * size).sum(), share * (count * pos).sum()
    out = splits.plan_bundles(count, size, pos, rows, positives)
    assert (out.sum(axis=1) == count).all() and (out >= 0).all()
    assert np.abs((out * size[:, None]).sum(axis=0) - rows).max() <= size.max()
    assert np.abs((out * pos[:, None]).sum(axis=0) - positives).max() <= size.max()


def test_large_components_count_with_their_exact_size(spark):
    rng = random.Random(3)
    rows, i = [], 0
    for m in range(60):
        for _ in range(rng.choice([257, 300, 311, 403, 5, 9, 1])):
            rows.append((i, f"m{m}", None, None))
            i += 1
    out, comps = split_rows(spark, rows)
    assert len(out) == len(rows) and len(comps) == 60
    sizes = {s: sum(c["n_rows"] for c in comps if c["split"] == s) for s in ("train", "val", "test")}
    assert all(abs(sizes[s] - q * len(rows)) <= 403 for s, q in (("train", 0.8), ("val", 0.1), ("test", 0.1)))


def split_rows(spark, rows, links=(), **kw):
    df = spark.createDataFrame(rows, "id long, who string, fold int, y int")
    ldf = spark.createDataFrame(list(links), "p string, q string")
    out, comps = splits.grouped_splits(df, "who", {"train": 0.8, "val": 0.1, "test": 0.1}, label=F.col("y") == 1, fold="fold", links=(ldf, F.col("p"), F.col("q")), **kw)
    return [r.asDict() for r in out.collect()], [r.asDict() for r in comps.collect()]


def test_related_rows_stay_together_and_shares_hold(spark):
    rng = random.Random(7)
    rows = [(i, f"m{min(int(rng.expovariate(0.02)), 299)}", rng.choice([1, 2, 3, None]), int(rng.random() < 0.05)) for i in range(3000)]
    links = [(f"m{i}", f"m{i + 100}") for i in range(0, 80, 2)] + [("m1", "m3"), ("m3", "m5")]
    out, comps = split_rows(spark, rows, links)
    assert len(out) == len(rows) and {r["id"] for r in out} == {r[0] for r in rows}
    by = {}
    for r in out:
        by.setdefault(r["component"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    root = {r["who"]: r["component"] for r in out}
    assert all(root[a] == root[b] for a, b in links if a in root and b in root) and root.get("m1") == root.get("m5")
    size = {s: sum(r["split"] == s for r in out) / len(out) for s in ("train", "val", "test")}
    assert abs(size["train"] - 0.8) < 0.02 and abs(size["val"] - 0.1) < 0.02
    folds = {}
    for r in out:
        folds.setdefault(r["component"], set()).add(r["fold"])
    assert {c["component"] for c in comps if c["n_folds"] > 1} == {c for c, f in folds.items() if len(f - {None}) > 1}
    again, _ = split_rows(spark, rows[::-1], links)
    assert {r["id"]: r["split"] for r in again} == {r["id"]: r["split"] for r in out}


def test_one_member_with_a_third_of_all_rows_null_members_and_empty(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"m{i % 50}" if i % 7 else None, None, None) for i in range(900)]
    out, comps = split_rows(spark, rows)
    assert len(out) == 900 and all(r["split"] for r in out)
    assert next(c for c in comps if c["component"] == "hot")["split"] == "train"
    assert split_rows(spark, []) == ([], [])


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "a", "old", "old")], "id int, who string, split string, component string")
    out, _ = splits.grouped_splits(df, "who", {"train": 1.0})
    assert out.columns == ["id", "who", "component", "split"] and out.first()["split"] == "train"


# --- nearest in time ----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("hours", [3, 400])
def test_a_right_time_is_in_few_buckets_whatever_the_tolerance(spark, hours):
    t0 = dt.datetime(2024, 1, 1)
    right = spark.createDataFrame([(i, "e", t0 + dt.timedelta(hours=7 * i)) for i in range(60)], "id long, e string, t timestamp_ntz")
    left = spark.createDataFrame([(i, "e", t0 + dt.timedelta(hours=5 * i - 20, minutes=1)) for i in range(100)], "x long, e string, t timestamp_ntz")
    out = {r["x"]: r["id"] for r in match_nearest_time(left, right, "x", "e", "t", "id", "e", "t", hours * 3600).collect()}
    at = lambda i: 5 * i - 20 + 1 / 60
    near = {i: min(range(60), key=lambda k: (abs(at(i) - 7 * k), k)) for i in range(100)}
    assert out == {i: (k if abs(at(i) - 7 * k) <= hours else None) for i, k in near.items()}


@pytest.mark.parametrize("bucket", [3, 12])
def test_nearest_against_brute_force(spark, bucket):
    rng = random.Random(bucket)
    pick = lambda: T0 + S * rng.randrange(0, 86400 * 2, 60)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, pick(), pick(), pick()])) for i in range(300)]
    right = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, pick(), pick(), pick()])) for i in range(1000, 1120)]
    right += [(2000 + i, k, t) for i, (_, k, t) in enumerate(right[:20])] + [(None, "a", T0)]
    df = lambda rows: spark.createDataFrame(rows, "id long, entity string, bucket timestamp_ntz")
    out = match_nearest_time(df(left).withColumnRenamed("id", "x"), df(right), "x", "entity", "bucket", "id", "entity", "bucket", 5400, bucket_hours=bucket).collect()
    got = {r["x"]: r["id"] for r in out}
    assert len(out) == len(left)
    for i, k, t in left:
        fits = [(abs(u - t), u, j) for j, kk, u in right if j is not None and kk == k and k and t and u and abs(u - t) <= 5400 * S]
        assert got[i] == (min(fits)[2] if fits else None)


def test_nearest_at_midpoint_and_at_tolerance(spark):
    left = [(1, "a", T0 + 60 * S), (2, "a", T0 + 61 * S), (3, "a", T0 - 90 * S), (4, "a", T0 - 91 * S)]
    right = [(8, "a", T0), (9, "a", T0 + 120 * S), (7, "a", T0)]
    df = lambda rows: spark.createDataFrame(rows, "id long, e string, t timestamp_ntz")
    out = match_nearest_time(df(left).withColumnRenamed("id", "x"), df(right), "x", "e", "t", "id", "e", "t", 90)
    assert {r["x"]: r["id"] for r in out.collect()} == {1: 7, 2: 9, 3: 7, 4: None}
    assert match_nearest_time(df([]).withColumnRenamed("id", "x"), df(right), "x", "e", "t", "id", "e", "t", 90).count() == 0
    assert match_nearest_time(df(left).withColumnRenamed("id", "x"), df([]), "x", "e", "t", "id", "e", "t", 90).where("id is null").count() == 4


# --- runs ---------------------------------------------------------------------------------------------------------

def best_cost(x, penalty):
    best = [-penalty]
    for t in range(1, len(x) + 1):
        best.append(min(best[s] + ((x[s:t] - x[s:t].mean(axis=0)) ** 2).sum() for s in range(t)) + penalty)
    return best[-1]


def test_segmentation_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = rng.integers(0, 25, 6)
        block = rng.integers(0, 3, (6, 25, 2)) * rng.choice([0.5, 1.0, 2.0])
        for x, n, cuts in zip(block, lengths, runs.segment(block.astype(float), lengths, 1.0)):
            parts = [x[a:b] for a, b in zip(cuts, [*cuts[1:], n])]
            cost = sum(((p - p.mean(axis=0)) ** 2).sum() for p in parts) + max(len(parts) - 1, 0)
            assert cost == pytest.approx(best_cost(x[:n], 1.0) if n else 0)


def test_exact_runs_over_tiles(spark):
    rng = random.Random(9)
    rows = [(k, d, int(rng.random() < 0.8)) for k in "ab" for d in rng.sample(range(-40, 200), 170)] + [("whole", d, 1) for d in range(300)]
    df = spark.createDataFrame(rows, "entity string, tile int, pos int")
    out = runs.collapse_runs(df, "entity", "tile", {"on": ("pos", 3.0)}, absent={"on": 0.0}, tile=16)
    got = {(r["entity"], r["run_start"], r["run_end"]) for r in out.where("mean_on = 1").collect()}
    want, on = set(), {}
    for k, d, y in rows:
        if y:
            on.setdefault(k, set()).add(d)
    for k, days in on.items():
        for d in days:
            if d - 1 not in days:
                e = d
                while e + 1 in days:
                    e += 1
                want.add((k, d, e))
    assert got == want


def test_positions_without_a_row_are_events_at_tile_edges_too(spark):
    rng = random.Random(3)
    days = {"edges": [*range(5, 14), *range(17, 30), *range(34, 62)], "long": [3, 4, 5, 70, 71, 150], "random": sorted(rng.sample(range(-60, 120), 90))}
    rows = [(k, d, 9.0) for k, on in days.items() for d in on]
    out = runs.collapse_runs(spark.createDataFrame(rows, "e string, i int, v double"), "e", "i", {"v": ("v", 1.0)}, penalty=2.0, absent={"v": 0.0}, tile=16).collect()
    got = sorted((r["entity"], r["run_start"], r["run_end"], r["n_events"], r["mean_v"]) for r in out)
    want = []
    for k, on in days.items():
        x = np.zeros((1, on[-1] - on[0] + 1, 1))
        x[0, np.array(on) - on[0]] = 9.0
        cuts = [*runs.segment(x, np.array([x.shape[1]]), 2.0)[0], x.shape[1]]
        want += [(k, int(on[0] + a), int(on[0] + b - 1), int((x[0, a:b] > 0).sum()), float(x[0, a:b].mean())) for a, b in zip(cuts, cuts[1:])]
    assert got == sorted(want)


@pytest.mark.parametrize("absent", [None, {"v": 0.0}])
def test_runs_over_tile_edges_are_those_of_the_whole_sequence(spark, absent):
    rng = random.Random(11)
    stairs = {d: 8 + 0.25 * (d // 8) for d in range(96)}
    near = {d: rng.gauss(6, 1.2) for d in range(-30, 90)}
    mixed = {d: rng.choice([8.0, 8.0, 8.5, rng.uniform(3, 11)]) for d in range(150) if rng.random() < 0.8}
    series = {"stairs": stairs, "near": near, "mixed": mixed}
    df = spark.createDataFrame([(k, d, v) for k, x in series.items() for d, v in x.items()], "e string, i int, v double")
    out = runs.collapse_runs(df, "e", "i", {"v": ("v", 1.0)}, penalty=2.0, absent=absent, tile=8).collect()
    for k, x in series.items():
        days = sorted(x) if absent is None else range(min(x), max(x) + 1)
        values = np.array([[[x.get(d, 0.0)] for d in days]])
        cuts = [*runs.segment(values, np.array([len(days)]), 2.0)[0], len(days)]
        want = [(days[a], days[b - 1], pytest.approx(values[0, a:b].mean())) for a, b in zip(cuts, cuts[1:])]
        got = sorted((r["run_start"], r["run_end"], r["mean_v"]) for r in out if r["entity"] == k)
        assert got == want
        parts = [values[0, a:b] for a, b in zip(cuts, cuts[1:])]
        assert sum(((q - q.mean(axis=0)) ** 2).sum() for q in parts) + 2.0 * (len(parts) - 1) == pytest.approx(best_cost(values[0], 2.0))


def test_near_identical_events_collapse_and_distant_ones_do_not(spark):
    rows = [("a", i, v) for i, v in enumerate([5.0, 5.1, 4.9, 9.0, 9.1, 5.0])]
    out = runs.collapse_runs(spark.createDataFrame(rows, "e string, i int, v double"), "e", "i", {"v": ("v", 1.0)}, penalty=0.5).orderBy("run_start").collect()
    assert [(r["run_start"], r["run_end"], r["n_events"]) for r in out] == [(0, 2, 3), (3, 4, 2), (5, 5, 1)]
    assert out[0]["mean_v"] == pytest.approx(5.0)


def test_runs_of_nulls_repeats_and_empty(spark):
    schema = "e string, i int, v double, loaded int"
    rows = [("a", 1, 1.0, 1), ("a", 1, 0.0, 2), ("a", 2, None, 1), (None, 1, 1.0, 1), ("a", None, 1.0, 1), ("a", 3, float("nan"), None)]
    df = spark.createDataFrame(rows, schema)
    out = runs.collapse_runs(df, "e", "i", {"v": ("v", 3.0)}, absent={"v": 0.0}, latest_by=["loaded"]).collect()
    assert [(r["run_start"], r["run_end"], r["n_events"], r["mean_v"]) for r in out] == [(1, 3, 3, 0.0)]
    assert runs.collapse_runs(spark.createDataFrame([], schema), "e", "i", {"v": ("v", 3.0)}).count() == 0


# --- containers ---------------------------------------------------------------------------------------------------

def test_tree_finds_the_tightest_bin():
    rng = random.Random(2)
    tree, held = packing.OpenBins(50), []
    for i in range(2000):
        need = rng.randrange(51)
        fits = [r for r in held if r >= need]
        assert tree.tightest(need) == (min(fits) if fits else -1)
        if fits and rng.random() < 0.5:
            tree.take(min(fits))
            held.remove(min(fits))
        else:
            r = rng.randrange(51)
            tree.add(r, i)
            held.append(r)


def naive(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= s]
        if fits:
            i = min(fits, key=lambda i: bins[i])
            bins[i] -= s
        else:
            bins.append(capacity - s)
    return len(bins)


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 7, 40, 64, 100, 101, 350, None, -3])) for i in range(400)] + [(None, 5), (1, 40)]
    df = spark.createDataFrame(rows, "doc long, n int")
    out = packing.pack_items(df, "doc", "n", 100).collect()
    load, pieces = {}, {}
    for r in out:
        load[r["shard"], r["bin"]] = load.get((r["shard"], r["bin"]), 0) + r["length"]
        pieces.setdefault(r["doc"], []).append((r["piece"], r["start"], r["length"]))
    assert max(load.values()) <= 100
    sizes = [max(n or 0, 0) for _, n in rows]
    flat = [x for n in sizes for x in [100] * (n // 100) + ([n % 100] if n % 100 or n == 0 else [])]
    assert sorted(r["length"] for r in out) == sorted(flat) and len(load) == naive(flat, 100)
    for doc, n in rows:
        if doc not in (None, 1) and (n or 0) <= 100:
            assert len(pieces[doc]) == 1
    assert packing.pack_items(df.limit(0), "doc", "n", 100).count() == 0


def test_shards_hold_all_items(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 100)
    df = spark.range(1000).select("id", (F.col("id") % 90 + 1).alias("n"))
    out = packing.pack_items(df, "id", "n", 100)
    assert out.count() == 1000 and out.select("shard").distinct().count() == 10
    assert out.groupBy("shard", "bin").agg(F.sum("length").alias("x")).where("x > 100").count() == 0


# --- mixtures and tokens ------------------------------------------------------------------------------------------

def test_budgets_go_to_siblings_before_others():
    a, b, c, d = (mixture.Leaf(("p", lang, name), w, s) for lang, name, w, s in (("en", "a", 0.25, 5), ("en", "b", 0.25, 1000), ("de", "c", 0.25, 1000), ("de", "d", 0.25, 1000)))
    mixture.allocate([a, b, c, d], 100)
    assert [x.budget for x in (a, b, c, d)] == pytest.approx([5, 45, 25, 25])
    b.supply = 10
    mixture.allocate([a, b, c, d], 100)
    assert [x.budget for x in (a, b, c, d)] == pytest.approx([5, 10, 42.5, 42.5])
    c.supply = d.supply = 1
    mixture.allocate([a, b, c, d], 100)
    assert [x.budget for x in (a, b, c, d)] == pytest.approx([5, 10, 1, 1])


def test_mixture_meets_budgets(spark):
    rng = random.Random(6)
    rows = [(i, "big" if i % 3 else rng.choice(["small", "tiny", None, "stray"]), rng.choice([0, 10, 50, None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, leaf string, n int")
    targets = [(("x", "en"), "big", 0.5, 2), (("x", "en"), "small", 0.3, 3), (("x", "de"), "tiny", 0.1, 1), (("x", "de"), "absent", 0.1, 5)]
    uses, report = mixture.mix_sources(df, "key", "leaf", "n", targets)
    used = {r["key"]: (r["leaf"], r["uses"]) for r in uses.collect()}
    have = {name: sum(n or 0 for _, s, n in rows if s == name) for name in ("big", "small", "tiny", "absent")}
    size, of = sum(n or 0 for *_, n in rows), {i: n or 0 for i, _, n in rows}
    for r in report.collect():
        name = r["leaf"]
        drawn = sum(of[k] * u for k, (leaf, u) in used.items() if leaf == name)
        repeats = next(t[3] for t in targets if t[1] == name)
        assert r["drawn_tokens"] == drawn and r["available_tokens"] == have[name] * repeats and r["short"] == (have[name] * repeats < size * r["target_share"])
        assert all(u <= repeats for leaf, u in used.values() if leaf == name)
    total = sum(of[k] * u for k, (_, u) in used.items())
    assert total == min(size, sum(have[t[1]] * t[3] for t in targets))  # every size here is a multiple of ten
    assert not {leaf for leaf, _ in used.values()} & {None, "stray"}
    again = {r["key"]: (r["leaf"], r["uses"]) for r in mixture.mix_sources(df.repartition(7), "key", "leaf", "n", targets)[0].collect()}
    assert again == used
    empty = mixture.mix_sources(df.limit(0), "key", "leaf", "n", targets)
    assert empty[0].count() == 0 and empty[1].count() == 4
    with pytest.raises(ValueError):
        mixture.mix_sources(df, "key", "leaf", "n", targets + targets[:1])


@pytest.mark.parametrize("sizes", [[1000] * 8 + [1] * 3000, [700, 900] * 6 + [64, 64, 3, 2] * 4])
def test_what_a_prefix_leaves_is_filled(spark, sizes):
    """A long record that does not fit is passed over; small ones fill its place, however many it takes."""
    df = spark.createDataFrame([(i, x, "ab"[i % 2], "en" if i % 3 else None) for i, x in enumerate(sizes)], "key long, n long, leaf string, lang string")
    targets = [(("x",), "a", 0.5, 1), (("x",), "b", 0.5, 1)]
    size = sum(sizes) // 3
    uses, report = mixture.mix_sources(df, "key", "leaf", "n", targets, total=size, level="lang")
    used = {r["key"] for r in uses.collect()}
    left = size - sum(sizes[i] for i in used)
    assert 0 <= left < min(x for i, x in enumerate(sizes) if i not in used)
    assert report.count() == 4 and report.where("short").count() == 0 and uses.where("uses <> 1").count() == 0


def test_rest_goes_to_siblings_before_others():
    leaves = [mixture.Leaf(("p", lang, name), 0.25, 100, left=left) for lang, name, left in (("en", "a", 7), ("en", "b", 5), ("de", "c", 9))]
    loose = {("p", "en", "b"): [(12, 1, 1), (4, 2, 2)], ("p", "de", "c"): [(10, 3, 3)]}
    # b takes 4 of its own; 7 + 1 fit nothing of a and b; with 9 more the 12 of b fits before the 10 of c.
    assert mixture.fill_rest(leaves, loose) == [2, 1] and sum(x.left for x in leaves) == 5


def test_token_counts_of_pieces_are_exact(spark, monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice(["word", " word", "  ", "\n\n", "!?", " 123", "ünï", "日本", "\t", "a'll"]) for _ in range(4000))
    whole = tokens._counter(tokens.VOCABULARY)
    a = whole(text)
    rows = [(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "x" * 50_000, "x"), (5, "<|endoftext|>", "x")]
    df = spark.createDataFrame(rows, "id int, text string, n_tokens string")
    out = {r["id"]: r["n_tokens"] for r in tokens.with_token_counts(df, "text", ["id"]).collect()}
    assert out[1] == a and out[2] == 0 and out[3] == 0 and out[4] > 1000 and out[5] > 1
    import tiktoken

    monkeypatch.setattr(tokens, "PIECE", 100)
    vars(tiktoken).pop("_loaded_coders")
    assert tokens._counter(tokens.VOCABULARY)(text) == a
    vars(tiktoken).pop("_loaded_coders")


def test_pieces_joined_are_the_text(spark):
    rng = random.Random(11)
    text = "".join(rng.choice(["word", " word", "\n\n", "!?", " 123", "ünï", "日本", "🙂", " "]) for _ in range(3000))
    rows = [(1, text), (2, None), (3, ""), (4, "short"), (1, "日" * 900)]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("piece", F.lit("clash"))
    out = sorted(tokens.piece_contents(df, "id", "text", 100).collect(), key=lambda r: (r["id"], r["piece"]))
    assert {r["id"] for r in out} == {1}
    one = sorted(tokens.piece_contents(df.where("id = 1 and text like '%word%'"), "id", "text", 100).collect(), key=lambda r: r["piece"])
    assert b"".join(bytes(r["content"]) for r in one) == text.encode() and [r["n_tokens"] for r in one[:-1]] == [100] * (len(one) - 1) and 0 < one[-1]["n_tokens"] <= 100
    counted = tokens.with_token_counts(df.where("id = 1 and text like '%word%'"), "text", ["id"]).first()["n_tokens"]
    assert sum(r["n_tokens"] for r in one) == counted
    assert tokens.piece_contents(df.limit(0), "id", "text", 100).count() == 0


# --- quality ------------------------------------------------------------------------------------------------------

COMMON = {"en": frozenset("the a of to and in is it that for was on are with as i you not be this have from or by but we so when if will can".split()), "de": frozenset("der die das und ist in zu den nicht von mit es sich auf für ein eine ich auch wenn".split())}
PROSE = "The valve was loose when we came in, so I closed it by hand.\nIt is not that hard, and you can do this with a small wrench if you have one.\n"


PROFILES = quality.Profiles(quality.Languages(COMMON))


def kind(text):
    return quality.describe([text], PROFILES)[0][-1]


@pytest.mark.parametrize("text,want", [
    (PROSE, "prose"), ("Yes.", "prose"), ("Wenn die Tür klemmt, ist es nicht schlimm und ich warte auf den Sommer.", "prose"), ("Thanks, that worked!", "prose"),
    ("i think it was the pump and not the hose so we can wait for a while", "prose"), ("Это не так сложно, как кажется, если делать всё по порядку.", "prose"),
    ("- red paint\n- long nails\n- two brushes\n- wall plugs", "list"), ("1. red paint\n2. long nails\n3. brushes", "list"), ("hammer, red paint, long nails, brushes, wall plugs, old rope, grey tape, saw blade", "list"),
    ("http://a.example/x\nhttps://b.example/y\nhttp://c.example/z", "list"), ("| a | b |\n|---|---|\n| 1 | 2.5 |\n| 3 | 4.5 |", "table"), ("item,qty,price\nbolt,3,4.50\nnut,12,0.75\nnail,7,1.10", "table"),
    ("name      qty     price\nbolt      3       4.50\nnut       12      0.75", "table"), ("buy cheap now buy cheap now!!! BUY CHEAP NOW buy cheap now buy cheap now", "junk"),
    ("xq zvkw pltr qqj wxz kvjq zzx hjkl qwrt pxcv bnmz lkjh", "junk"), ("#@!$%^&*()_+ ~~~ <>?:{}| @@##$$ %%^^ &&**", "junk"),
    ("Ã¤ Ã¼ÃŸ â€Ã¤ ¿ xÃŸÂ Ã¼ ÃŸâ€ ¿ x\ufffdÃ¤Â ÃŸ", "junk"), ("El señor dijo que FranÃ§ois no está en la casa y que vuelva mañana.", "prose"),
    ("```\nfor x in rows:\n    total += x[1]\nprint(total)\n```", "code"), ("", "empty"), (None, "empty"), (" \n\t", "empty"),
])
def test_structures(text, want):
    assert kind(text) == want


@pytest.mark.parametrize("text,want", [
    ("def f(x):\n    return x + 1\n\nprint(f(3))", "code"), ("SELECT name, count(*) FROM users\nWHERE age > 30\nGROUP BY name;", "code"), ("$ sudo apt install foo\n$ foo --version\n$ cat /etc/foo.conf", "code"),
    ("const x = require('fs');\nfunction read(path) {\n  return x.readFileSync(path);\n}\nconsole.log(read('a.txt'));", "code"), ("Best deals online buy watches bags shoes great price free shipping order today. " * 6, "junk"),
    ("Click here to win a free phone! " * 8, "junk"), ("Open settings, click network, select wifi, enter password.", "prose"), ("Remove screws, lift cover, disconnect battery, replace fuse.", "prose"), ("ok thx will try", "prose"),
    ('{"id": 1, "name": "bolt", "price": 3.5}\n{"id": 2, "name": "nut", "price": 0.7}\n{"id": 3, "name": "nail", "price": 0.1}', "junk"), ("Home | About | Products | Contact | Login | Cart", "list"),
    ('Traceback (most recent call last):\n  File "a.py", line 3, in <module>\n    main()\n  File "a.py", line 9, in main\nZeroDivisionError: division by zero', "junk"),
    ("2024-01-03 10:22:01 ERROR worker 3 failed\n2024-01-03 10:22:05 INFO retry 1\n2024-01-03 10:22:09 ERROR worker 3 failed", "junk"), ("Det fungerar inte alls, jag har provat allt.", "prose"),
    ("It was wet again so I closed it. It was wet again so I closed it.", "prose"),
])
def test_forms_the_data_do_not_have(text, want):
    assert kind(text) == want


def test_links_beside_sentences():
    assert kind("http://a.example/b\nhttp://c.example/d") == "list" and kind("http://a.example/b") == "prose"
    assert kind(PROSE + "See http://docs.example/a/very/long/address/" + "x" * 200) == "prose"


def test_statistics(spark):
    df = spark.createDataFrame([(1, "One two three.\nfour - five"), (2, None), (3, " \r\n"), (4, "...")], "id int, text string")
    out = {r["id"]: r for r in quality.text_quality(df, "id", "text", {"en": ["one", "two"], "xx": []}, structure=False).collect()}
    assert out[1]["n_words"] == 5 and out[1]["mean_word_length"] == pytest.approx(19 / 5) and out[1]["lines_ending_in_punctuation"] == 0.5
    assert out[1]["common_word_share"] == pytest.approx(0.4) and out[1]["symbol_ratio"] == pytest.approx(2 / 21)
    assert all(tuple(out[i])[1:] == (0, 0.0, 0.0, 0.0, 0.0) for i in (2, 3)) and out[4]["symbol_ratio"] == 1.0 and out[4]["lines_ending_in_punctuation"] == 1.0


def test_profiles_are_fitted_to_prose_of_a_language():
    texts = [f"The valve {i} was loose when we came in, so I closed it by hand." for i in range(30)] + ["- a\n- b"] * 30
    fitted = quality.fit_profiles(texts, COMMON)
    assert fitted.kinds[len(quality.PROFILES) :] == ["prose"] and fitted.languages.used["en"]["the"] > fitted.languages.used["en"]["of"] == 0.0
    assert fitted.table[-1][: len(quality.WORDS)].sum() == pytest.approx(1) and quality.fit_profiles([], {}).kinds == [k for k, *_ in quality.PROFILES]
    # Both languages have as many of the words; the one that uses them as often as this text is nearer.
    both = quality.Languages({"a": frozenset(["la", "de", "un"]), "b": frozenset(["la", "de", "es"])}, {"a": {"la": 0.3, "de": 0.05, "un": 0.1}, "b": {"la": 0.05, "de": 0.3, "es": 0.1}})
    assert both.nearest(Counter({"la": 3, "de": 1, "casa": 6}), 10) == ("a", 4) and both.nearest(Counter({"de": 3, "la": 1, "casa": 6}), 10) == ("b", 4)


def test_quality_of_odd_rows(spark):
    rows = [(1, PROSE * 3000), (2, "a" * 300_000), (3, None), (4, ""), (5, "\x00퟿"), (5, PROSE), (None, PROSE)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("structure", F.lit("clash"))
    out = quality.text_quality(df, "doc_id", "text", {k: sorted(v) for k, v in COMMON.items()})
    got = out.collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["structure"] for r in got if r["doc_id"] in (1, 3)} == {1: "prose", 3: "empty"}
    assert quality.text_quality(df.limit(0), "doc_id", "text", {}).count() == 0


def test_nearest_profile_is_that_of_least_divergence():
    for text in (PROSE, "- a\n- b\n- c", "xq zvkw 0000 !!!!"):
        form, part = next(quality.stretches(text))
        own = quality.measure(part, form, PROFILES.languages)[0]
        k = len(quality.WORDS)
        d = [quality.divergence(own[:k], row[:k]) + quality.divergence(own[k:], row[k:]) if kind != "code" else 9.0 for kind, row in zip(PROFILES.kinds, PROFILES.table.tolist())]
        assert PROFILES.nearest([form], np.array([own])) == [PROFILES.kinds[d.index(min(d))]]


def test_divergence():
    assert quality.divergence([1, 0], [0, 1]) == pytest.approx(1) and quality.divergence([0.5, 0.5], [0.5, 0.5]) == 0


def test_profiles_are_fitted_to_all_documents(spark):
    """The last of 2,300 documents count as much as the first; batches and files change nothing."""
    texts = [f"the house of the man is {w} and it was in the {w} by the road to the town" for w in ("old", "new")] * 1140 + [None, ""] + ["when will you come with us and where are we to go from here"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(5)
    fitted, whole = quality.fit_documents(df, "text", COMMON), quality.fit_profiles(texts, COMMON)
    assert (fitted.table == whole.table).all() and fitted.kinds == whole.kinds and fitted.languages.used == whole.languages.used
    out = {r["id"]: tuple(r)[1:] for r in quality.text_quality(df, "id", "text", COMMON, counts=False).collect()}
    assert [out[i] for i in range(len(texts))] == quality.describe(texts, whole)
