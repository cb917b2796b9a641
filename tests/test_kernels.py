import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelwright.functions.ids import canonical_id, canonical_name
from panelwright.ml import encode, models, tuning, weights
from panelwright.operators import clocking, curves
from panelwright.operators.groups import trailing_distinct, trailing_group_stats
from panelwright.operators.impute import neighbour_repair, neighbours
from panelwright.operators.islands import days_since_last, streaks
from panelwright.operators.profile import profile
from panelwright.operators.ranking import row_numbers, running_sums

D0 = dt.date(2024, 1, 1)
day = lambda n: D0 + dt.timedelta(n)


def test_ids(spark):
    given = ["MM001234567", "mm 001234567", " Mm-001234567 ", "1234567", "", "  ", None, "X-9", "MM1234567890"]
    df = spark.createDataFrame([(g,) for g in given], "i string")
    assert [r[0] for r in df.select(canonical_id("i")).collect()] == ["MM001234567"] * 4 + [None] * 3 + ["X9", "MM1234567890"]
    names = spark.createDataFrame([("Ask_pile ",), ("ask-pile",), ("_",), (None,)], "s string")
    assert [r[0] for r in names.select(canonical_name("s")).collect()] == ["askpile", "askpile", None, None]


def test_streaks_restart_after_gap_or_idle_day(spark):
    rows = [("a", day(0), True), ("a", day(1), True), ("a", day(3), True), ("a", day(4), None), ("a", day(5), True), ("b", day(0), False)]
    df = spark.createDataFrame(rows, "member string, day date, on boolean")
    out = {(r["member"], r["day"]): r["n"] for r in streaks(df, ["member"], "day", F.col("on"), "n").collect()}
    assert [out["a", day(i)] for i in (0, 1, 3, 4, 5)] == [1, 2, 1, 0, 1] and out["b", day(0)] == 0


def test_days_since_both_readings(spark):
    df = spark.createDataFrame([("a", day(0), True), ("a", day(1), False), ("a", day(2), False)], "member string, day date, on boolean")
    got = df.select("day", days_since_last(["member"], "day", F.col("on"), 99).alias("x"), days_since_last(["member"], "day", F.col("on"), 99, ignore_nulls=False).alias("y")).orderBy("day").collect()
    assert [(r["x"], r["y"]) for r in got] == [(0, 0), (1, 1), (2, 99)]


@pytest.mark.parametrize("width", [1, 2, 100])
def test_neighbour_repair(spark, width):
    rows = [("a", 1, 20.0), ("a", 2, 8.0), ("a", 3, 1.9), ("a", 4, 6.0), ("b", 1, 99.0), ("c", 1, None), ("d", 1, 2.0), ("d", 2, 16.0)]
    df = neighbour_repair(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], F.floor(F.col("i") / width), ["i"], "v", 2, 16, 8.5, "r")
    assert {(r["k"], r["i"]): r["r"] for r in df.collect()} == {("a", 1): 8.0, ("a", 2): 8.0, ("a", 3): 7.0, ("a", 4): 6.0, ("b", 1): 8.5, ("c", 1): None, ("d", 1): 2.0, ("d", 2): 16.0}


@pytest.mark.parametrize("width", [3, 8])
def test_neighbours_over_buckets(spark, width):
    rng = random.Random(width)
    at = sorted(rng.sample(range(200), 60))
    df = spark.createDataFrame([("a", t, rng.choice([None, float(t)])) for t in at], "k string, t int, v double")
    value = {r["t"]: r["v"] for r in df.collect()}
    for r in neighbours(df, ["k"], F.floor(F.col("t") / width), ["t"], "v").collect():
        i = at.index(r["t"])
        for k in (1, 2):
            assert r[f"_prev{k}"] == (value[at[i - k]] if i >= k else None) and r[f"_next{k}"] == (value[at[i + k]] if i + k < len(at) else None)


def test_shift_of_hour(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h),) for h in (0, 9, 10, 17, 18, 23)] + [(None,)], "t timestamp_ntz")
    assert [r[0] for r in df.select(clocking.shift_of_hour(F.col("t"))).collect()] == ["First", "First", "Second", "Second", "Third", "Third", None]


def test_synthetic_shift_over_month_end(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 31), "Third"), ("a", dt.date(2024, 1, 30), "Second"), ("a", dt.date(2024, 1, 29), None)], "member string, workDate date, shift string")
    ends = {r["workDate"].day: r["end"] for r in clocking.synthetic_schedule(df).collect()}
    assert ends == {31: dt.datetime(2024, 2, 1, 8), 30: dt.datetime(2024, 1, 31)}


def test_group_stats_and_distinct_members(spark):
    rng = random.Random(2)
    rows = [(rng.choice("gh"), day(rng.randrange(60)), rng.choice("mnopq"), rng.choice([None, 0.0, 1.0])) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, day date, member string, x double")
    stats = trailing_group_stats(df, ["g"], "day", {"x": F.col("x")}, (7,)).collect()
    team = {(r["g"], r["day"]): r["n"] for r in trailing_distinct(df, ["g"], "day", "member", 7, "n").collect()}
    assert len(stats) == len({r[:2] for r in rows})
    for r in stats:
        inside = [x for x in rows if x[0] == r["g"] and 1 <= (r["day"] - x[1]).days <= 7]
        known = [x[3] for x in inside if x[3] is not None]
        assert r["rows_7d"] == len(inside) and r["x_sum_7d"] == sum(known) and team[r["g"], r["day"]] == len({x[2] for x in inside})
        assert r["x_avg_7d"] == pytest.approx(sum(known) / len(known)) if known else r["x_avg_7d"] is None


def test_row_numbers_and_running_sums(spark):
    rng = random.Random(3)
    rows = [(i * 7 - 300, rng.choice(["a", "b", None]), rng.randrange(5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, g string, v int")
    got = {r["k"]: r["n"] for r in row_numbers(df, ["g"], "k", "n", buckets=8).collect()}
    assert got == {k: sum(1 for a, b, _ in rows if b == g and a <= k) for k, g, _ in rows}
    sums = {r["k"]: r["cum_v"] for r in running_sums(df, "k", ["v"], buckets=8).collect()}
    assert sums == {k: sum(v for a, _, v in rows if a >= k) for k, _, _ in rows}


def test_ranges_of_skewed_keys_are_even(spark):
    """A rare positive class gives scores near 0; no range may hold most of them."""
    from panelwright.operators.ranking import _bucketed

    df = spark.range(20000).select((F.pow(F.rand(1), 12) + F.col("id") * 1e-12).alias("k"))
    sizes = [r["count"] for r in _bucketed(df, "k", 64).groupBy("_b").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 20000 / 64
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-1.0,), (2.0,)], "k double")
    assert [r["k"] for r in row_numbers(odd, [], "k", "n").orderBy("n").where("k is not null and not isnan(k)").collect()] == [-1.0, 2.0, float("inf")]


def test_curves_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0), (None, 1), (0.2, None)])], "id int, s double, y int")
    assert curves.roc_auc(df, "y", "s").first()[0] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    recall = [r["recall"] for r in curves.pr_curve(df, "y", "s").orderBy(F.desc("threshold")).collect()]
    assert recall == sorted(recall) and recall[-1] == 1.0
    ones = df.where("y = 1")
    assert curves.roc_auc(ones, "y", "s").first()[0] is None and curves.lift_chart(ones, "y", "s", "id").count() > 0
    empty = df.limit(0)
    assert curves.pr_curve(empty, "y", "s").count() == 0 and curves.confusion(empty, "y", "s").count() == 4


def test_weights(spark):
    df = spark.createDataFrame([(1, 0, [0.9, 0.1]), (2, 0, [0.5, 0.5]), (3, 1, [0.2, 0.8]), (4, None, [0.5, 0.5])], "id int, y int, p array<double>")
    assert {r["id"]: r["weight"] for r in weights.add_weights(df, "inverse_class_frequency", label="y").collect()} == {1: 2.0, 2: 2.0, 3: 4.0, 4: None}
    focal = {r["id"]: r["weight"] for r in weights.add_weights(df, "focal_loss", label="y", prediction="y", probability="p").collect()}
    assert focal[1] == pytest.approx(0.01) and focal[3] == pytest.approx(0.04) and focal[4] is None
    same = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0), (4, 9.0)], "id int, y double")
    assert weights.add_weights(same, "quantile_based", label="y").where("weight is null").count() == 0
    with pytest.raises(ValueError):
        weights.add_weights(df, "no such", label="y")


def test_encoding(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id int, c string")
    mapping = encode.category_mapping(df, ["c"])
    hot = {r["id"]: (r["c_cat0"], r["c_cat1"]) for r in encode.one_hot(spark.createDataFrame([(1, "x"), (2, "new"), (3, None)], "id int, c string"), mapping).collect()}
    assert hot == {1: (1.0, 0.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}
    many = spark.createDataFrame([(i, i % 3) for i in range(60)], "a int, b int")
    assert encode.detect_categories(many, ["a", "b"], 50) == ["b"]
    with pytest.raises(ValueError):
        encode.category_mapping(many, ["a"], most=10)


def test_random_search_and_best(spark):
    space = {"a": (1, 2, 3), "b": (True, False)}
    assert tuning.random_search(space, 4) == tuning.random_search(space, 4)
    assert len({tuple(c.items()) for c in tuning.random_search(space, 99)}) == 6
    rows = [("True", 1, float("nan"), 3.0), ("False", 1, float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "fitIntercept string, fold_id int, rmse double, mae double")
    best = tuning.best_parameters(df, classifier=False)
    assert best["metric"] == "mae" and best["parameters"] == {"fitIntercept": False} and best["direction"] == "minimize"
    with pytest.raises(ValueError):
        tuning.best_parameters(df.drop("mae"), classifier=False)


def test_profile_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a" * 80, float("nan")), (None, "a" * 80, 1.0), (None, None, 1.0)], "n int, s string, x double")
    out = {r["column_name"]: r for r in profile(df, "t").collect()}
    assert out["n"]["null_pct"] == 100.0 and out["s"]["mode_value"] == "a" * 50 and out["x"]["distinct_count"] == 2 and out["s"]["avg_length"] == 80.0
    assert profile(df.limit(0), "t").count() == 0


@pytest.mark.parametrize("family", ["lr", "svm", "mlp", "rf", "gbt", "linear", "glm", "rf_regression", "gbt_regression"])
def test_models_learn(spark, family):
    rng = random.Random(1)
    rows = [(x := rng.random(), rng.random(), float(x > 0.5), 1.0 + 3 * x) for _ in range(400)]
    df = spark.createDataFrame(rows, "x double, z double, y double, t double").repartition(2).cache()
    classify = models.FAMILIES[family].classifier
    small = {"lr": {"maxIter": 20}, "svm": {"maxIter": 20}, "mlp": {"hidden": (4,), "maxIter": 60}, "rf": {"numTrees": 5}, "gbt": {"maxIter": 3}, "rf_regression": {"numTrees": 5}, "gbt_regression": {"maxIter": 3}}.get(family, {})
    target = "y" if classify else "t"
    stages = models.feature_stages(["x", "z"])
    model = models.train(df, family, target, stages, small)
    assert len(stages) == 3
    got = models.metrics(models.predict(model, df, family), family, target)
    assert got["auROC"] > 0.95 and got["auPR"] > 0.9 if classify else got["r2"] > 0.9


def test_feature_selection_and_names(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.random(), x := rng.random(), float(x > 0.5), rng.choice("pq")) for _ in range(300)], "noise double, signal double, y double, c string")
    chosen, table = models.select_features(df, ["noise", "signal"], "y", n=1, trees=5, depth=3)
    assert chosen == ["signal"] and table.where("selected = '✓'").count() == 1
    out = models.evaluate(models.train(df, "rf", "y", models.feature_stages(["signal"], categorical=["c"]), {"numTrees": 3}), df, "rf", "y", {"numTrees": 3})
    assert out["importances"].first()["feature"].startswith("_scaled") and out["confusion"].count() == 2


def test_every_kind_of_anomaly_has_its_weight(spark):
    from panelwright.operators.clocking import day_metrics

    t = lambda h: None if h is None else dt.datetime(2024, 3, 4) + dt.timedelta(hours=h)
    cases = {  # clock-in, clock-out, meal-in, meal-out
        ("extreme_long_shift", 5): (6, 23, 12, 12.5), ("missing_clockout", 4): (8, None, None, None), ("very_short_shift", 2): (8, 8.2, None, None), ("excessive_meal_break", 2): (8, 16, 11, 13.5),
        ("missing_clockin", 4): (None, 16, None, None), ("meal_without_full_shift", 3): (None, None, 12, 12.5), ("incomplete_meal_break", 1): (8, 13, 11, None), ("no_meal_break_full_day", 2): (8, 15, None, None), ("normal", 0): (8, 12, None, None),
    }
    rows = [(f"m{i}", dt.date(2024, 3, 4), *map(t, c)) for i, c in enumerate(cases.values())]
    days = spark.createDataFrame(rows, "member string, workDate date, clockIn timestamp_ntz, clockOut timestamp_ntz, mealIn timestamp_ntz, mealOut timestamp_ntz")
    plan = spark.createDataFrame([], "member string, workDate date, start timestamp_ntz, end timestamp_ntz")
    out = {r["member"]: (r["anomalyType"], r["anomalySeverity"]) for r in day_metrics(days, plan).collect()}
    assert [out[f"m{i}"] for i in range(len(cases))] == list(cases)


def test_meals_go_to_the_last_clock_in_and_to_pairs_without_one_last(spark):
    from panelwright.operators.clocking import attach_meals

    t = lambda d, h: None if h is None else dt.datetime(2024, 3, d) + dt.timedelta(hours=h)
    pairs = spark.createDataFrame(
        [("a", dt.date(2024, 3, 4), t(4, 8), t(4, 16)), ("a", dt.date(2024, 3, 5), None, t(5, 15)), ("a", dt.date(2024, 3, 9), None, t(9, 15)), ("a", dt.date(2024, 3, 6), t(6, 8), None), ("b", dt.date(2024, 3, 4), None, t(4, 1))],
        "member string, workDate date, clockIn timestamp_ntz, clockOut timestamp_ntz",
    )
    at = {1: ("a", t(4, 12)), 2: ("a", t(1, 12)), 3: ("a", t(6, 23)), 4: ("a", t(7, 12)), 5: ("a", t(10, 12)), 6: ("b", t(4, 2)), 7: ("c", t(4, 2)), 8: (None, t(4, 12)), 9: ("a", None)}
    meals = spark.createDataFrame([(k, *v) for k, v in at.items()], "event_id long, member string, at timestamp_ntz")
    out = sorted((r["member"], r["at"], r["workDate"].day) for r in attach_meals(meals, pairs).collect())
    assert sorted(r["event_id"] for r in attach_meals(meals, pairs).collect()) == [1, 2, 3, 4]
    assert out == [("a", t(1, 12), 5), ("a", t(4, 12), 4), ("a", t(6, 23), 6), ("a", t(7, 12), 9)]


def test_categories_of_days(spark):
    from panelwright.operators.impute import categorise_days, infer_shifts

    d = dt.date(2024, 3, 4)
    rows = {  # shift, dur, vac, unpaid, noshow, sick
        "real": (None, None, 1, 0, 0, 0), "away": ("First", 8.0, 0, 1, 0, 0), "done": ("First", 7.0, 0, 0, 0, 0), "fill": (None, 9.0, 0, 0, 0, 0), "length": ("First", None, 0, 0, 0, 0), "sick": (None, None, 0, 0, 0, 1),
        "absent": (None, None, 0, 0, 1, 0), "free": (None, None, 0, 0, 0, 0), "unknown": ("First", 8.0, None, 0, 0, 0),
    }
    days = spark.createDataFrame([(k, d, "D", "L", *v) for k, v in rows.items()], "member string, day date, dept string, loc string, shift string, dur double, vac int, unpaid int, noshow int, sick int")
    shifts = spark.createDataFrame([("real", d), ("real", d), (None, d)], "member string, day date")
    swipes = spark.createDataFrame([(m, d, dt.datetime(2024, 3, 4, h)) for m in ("fill", "length") for h in (15, 21)], "member string, day date, at timestamp_ntz")
    done = categorise_days(days, shifts, swipes)
    out = {r["member"]: (r["category"], r["work"]) for r in done.collect()}
    assert out == {
        "real": ("real_shift", None), "away": ("planned_absence", None), "done": ("expected_work", "complete"), "fill": ("expected_work", "needs_filling"), "length": ("expected_work", "needs_filling"),
        "sick": ("expected_work", "incomplete"), "absent": ("expected_work", "incomplete"), "free": ("other_days", None), "unknown": ("other_days", None),
    }
    got = {r["member"]: (r["shift"], r["hours"]) for r in infer_shifts(done, F.when(F.hour("firstSwipe") < 17, "Second")).collect()}
    assert got["fill"] == ("Second", 9.0) and got["away"] == (None, None) and got["sick"] == (None, None) and got["unknown"] == ("First", 8.0)
    assert got["length"] == ("First", (8.0 + 7.0 + 8.0) / 3)  # of that shift in its department and site


def test_custom_weights_compare_numbers_as_numbers(spark):
    df = spark.createDataFrame([(1.0, "x"), (0.0, "y"), (None, None)], "a double, b string")
    assert [r["weight"] for r in weights.custom(df, "a", {1: 8.0, "0": 2.0}).collect()] == [8.0, 2.0, 1.0]
    assert [r["weight"] for r in weights.custom(df, "b", {"x": 3.0}).collect()] == [3.0, 1.0, 1.0]


def test_p_values_of_two_samples(spark):
    from panelwright.operators import stats

    rows = [(float(i), True) for i in (1, 2, 3, 4, 5, 6, 7, 8)] + [(float(i), False) for i in (5, 6, 7, 8, 9, 10, 11, 12)]
    df = spark.createDataFrame(rows, "v double, g boolean")
    r = stats.two_sample_p_values(df, "v", F.col("g")).first()
    # By hand: U = 8, mean 32, variance 64 / 12 * (17 - 24 / 240); distance 0.5.
    z = (24 - 0.5) / (64 / 12 * (17 - 24 / 240)) ** 0.5
    assert r["u"] == 8.0 and r["u_p"] == pytest.approx(math.erfc(z / 2**0.5)) and r["distance"] == 0.5 and 0.2 < r["distance_p"] < 0.3
    assert stats.two_sample_p_values(df.where("g"), "v", F.col("g")).first()["u_p"] is None
