import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import fill
from panelwright.operators.fill import Field, Tie, apply_fills, propagate_fills



def fields():
    return [Field("site", F.col("site"), "category"), Field("hours", F.col("hours"), "number")]


def ties():
    return [Tie("who", (F.col("who"),), 2.0, ("site", "hours")), Tie("team", (F.col("team"),), 1.0, ("site", "hours"))]


SCHEMA = "id long, who string, team string, site string, hours double"


def fills(spark, rows, **kw):
    out = propagate_fills(spark.createDataFrame(rows, SCHEMA), "id", fields(), ties(), **kw).collect()
    assert len({(r["id"], r["field"]) for r in out}) == len(out)
    return {(r["id"], r["field"]): (r["value"] if r["field"] == "site" else r["number"], r["method"]) for r in out}


def test_from_own_group_then_further_then_overall(spark):
    rows = [(1, "a", "t", "X", 8.0), (2, "a", "t", None, None), (3, "b", "t", None, 6.0), (4, "c", None, None, None), (5, None, None, "Y", float("nan")), (6, "z", "u", "X", 2.0)]
    out = fills(spark, rows)
    assert out[2, "site"] == ("X", "propagated") and out[3, "site"] == ("X", "propagated")
    assert 7.0 < out[2, "hours"][0] <= 8.0 and out[2, "hours"][1] == "propagated"
    assert out[4, "site"] == ("X", "overall") and out[4, "hours"][1] == "overall" and abs(out[4, "hours"][0] - 16 / 3) < 1e-9
    assert out[5, "hours"][1] == "overall" and (5, "site") not in out and (1, "site") not in out


def test_reaches_over_two_steps_only_with_more_rounds(spark):
    rows = [(1, "a", "t", "X", 1.0), (2, "b", "t", None, 1.0), (3, "b", None, None, 1.0)]
    assert fills(spark, rows, rounds=1)[3, "site"] == ("X", "overall")
    assert fills(spark, rows, rounds=3)[3, "site"] == ("X", "propagated")


def test_equal_shares_take_the_smaller_text(spark):
    rows = [(1, "a", None, "B", 1.0), (2, "a", None, "A", 1.0), (3, "a", None, None, 1.0), (4, "a", None, "Aa", 1.0)]
    assert fills(spark, rows)[3, "site"] == ("A", "propagated")


def test_nothing_observed_empty_and_null_keys(spark):
    assert fills(spark, [(1, "a", "t", None, None)]) == {(1, "site"): (None, "none"), (1, "hours"): (None, "none")}
    assert fills(spark, []) == {}
    assert fills(spark, [(None, "a", "t", None, None), (2, "a", "t", "X", 1.0)]) == {}


def test_absent_by_nature_and_clash_of_names(spark):
    df = spark.createDataFrame([(1, "a", "t", None, None), (2, "a", "t", "X", 4.0)], SCHEMA).withColumns({"field": F.lit("f"), "value": F.lit("v"), "g": F.lit("g"), "share": F.lit(1)})
    given = [fields()[0], dataclasses.replace(fields()[1], applies=F.col("id") != 1)]
    found = propagate_fills(df, "id", given, ties())
    assert [(r["id"], r["field"]) for r in found.collect()] == [(1, "site")]
    out = {r["id"]: r for r in apply_fills(df, "id", given, found).collect()}
    assert out[1]["site"] == "X" and out[1]["site_filled"] and out[1]["hours"] is None and not out[1]["hours_filled"] and out[1]["value"] == "v"
    assert out[2]["site"] == "X" and not out[2]["site_filled"] and len(out) == 2


def test_held_out_accuracy(spark):
    rng, rows, truth = random.Random(5), [], {}
    for i in range(600):
        who = rng.randrange(40)
        site = "ABCDE"[who % 5] if rng.random() < 0.9 else rng.choice("ABCDE")
        if rng.random() < 0.15:
            truth[i] = "ABCDE"[who % 5]
        rows.append((i, str(who), str(who % 5), None if i in truth else site, float(who % 3 + 6)))
    out = fills(spark, rows)
    assert sum(out[i, "site"][0] == t for i, t in truth.items()) / len(truth) > 0.95


def test_rounds_go_on_until_a_long_way_is_gone(spark):
    """A chain of cells, each tied to the next by a group of two: the last hears of the first after many rounds."""
    rows = [(i, f"w{(i + 1) // 2}", f"t{i // 2}", "X" if i == 0 else None, 1.0) for i in range(16)]
    out = fills(spark, rows)
    assert all(out[i, "site"] == ("X", "propagated") for i in range(1, 16))
    assert fills(spark, rows, rounds=3)[15, "site"] == ("X", "overall")


def test_lengths_that_vary_by_chance_are_filled_by_the_overall_mean_and_others_by_their_group(spark):
    """Held-out root mean square error: below that of a constant where groups differ, no worse where they do not."""
    for own in (0.0, 2.0):
        rng, rows, truth = random.Random(9), [], {}
        for i in range(1500):
            who = rng.randrange(60)
            x = 8.5 + own * (who % 3 - 1) + rng.choice([-2.5, -0.5, 0.0, 0.0, 0.5, 3.5])
            if rng.random() < 0.15:
                truth[i] = x
            rows.append((i, str(who), None, "X", None if i in truth else x))
        out = fills(spark, rows)
        rmse = lambda f: (sum((f(i) - t) ** 2 for i, t in truth.items()) / len(truth)) ** 0.5
        mean = sum(r[4] for r in rows if r[4] is not None) / sum(r[4] is not None for r in rows)
        assert own == 0 or rmse(lambda i: out[i, "hours"][0]) < rmse(lambda i: 8.5)
        assert rmse(lambda i: out[i, "hours"][0]) < (1.01 if own == 0 else 0.8) * rmse(lambda i: mean)


@pytest.mark.parametrize("bound", [100, 100_000])
def test_a_hot_group_is_heard_by_all_its_cells(spark, monkeypatch, bound):
    monkeypatch.setattr(fill, "HOT_CELLS", bound)
    rows = [(i, None, "hot", None if i % 2 else "X", 5.0) for i in range(4000)] + [(9000 + i, None, f"t{i}", None, 5.0) for i in range(50)] + [(9100 + i, None, f"t{i}", "Y", 5.0) for i in range(50)]
    out = fills(spark, rows)
    assert all(out[i, "site"] == ("X", "propagated") for i in range(1, 4000, 2)) and all(out[9000 + i, "site"] == ("Y", "propagated") for i in range(50))
