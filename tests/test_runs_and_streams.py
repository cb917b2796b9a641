import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelwright.ml import models, runs
from panelwright.operators.assembly import assemble_days
from panelwright.streaming.windows import sessions, stream_table, tumbling_totals

T0 = dt.datetime(2024, 1, 1)


def test_a_whole_run(spark):
    rng = random.Random(3)
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(i % 90), x := rng.random(), rng.choice("pq"), int(x > 0.6)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, day date, x double, c string, y int").repartition(2)
    ready = runs.prepare_training(df, "day", "y", "id")
    assert ready.where("is_test = 1").count() == 300 and {r[0] for r in ready.where("is_test = 0").select("fold_id").distinct().collect()} == {1, 2, 3}
    reduced = runs.reduce_features(ready, "y", ["x", "c"], ["c"], ["id", "day", "y", "weight", "fold_id", "is_test"], n=1, trees=3, depth=3)
    assert reduced["reduced"].columns == ["id", "day", "y", "weight", "fold_id", "is_test", "x"] and reduced["mapping"].count() == 2
    out = runs.run_model(reduced["reduced"], "lr", "y", models.feature_stages(["x"]), "id", n=2, overrides={"maxIter": (5, 10), "regParam": (0.0,), "aggregationDepth": (2,)})
    assert out["search"].count() == 6 and out["performance"].first()["auROC"] > 0.95
    assert out["lift"].where("percentile = 100").first()["model_cumulative_gain"] == 100.0
    with pytest.raises(ValueError):
        models.cross_validate(df, "lr", "y", [], overrides={"nonsense": (1,)})
    with pytest.raises(ValueError):
        models.feature_stages()


def test_assembly_keeps_the_spine(spark):
    spine = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    part = spark.createDataFrame([("a", 9), ("z", 8)], "k string, w int")
    assert sorted(map(tuple, assemble_days(spine, {"p": part}, ["k"]).collect()), key=str) == [("a", 1, 9), ("b", 2, None)]
    with pytest.raises(ValueError):
        assemble_days(spine, {"p": part.withColumnRenamed("w", "v")}, ["k"])


def test_stream_drops_copies_and_closes_windows(spark, tmp_path):
    rows = [(1, "a", T0), (1, "a", T0), (2, "a", T0 + dt.timedelta(minutes=20)), (3, "a", T0 + dt.timedelta(hours=3)), (4, "a", T0 + dt.timedelta(hours=9))]
    spark.createDataFrame(rows, "id int, k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_table(spark.readStream.schema("id int, k string, ts timestamp").parquet(str(tmp_path / "in")), "ts", "1 hour", ["id"])
    out = tumbling_totals(stream, "ts", "1 hour", ["k"], {"n": F.count(F.lit(1))})
    q = out.writeStream.outputMode("append").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = {(r["window_start"].hour, r["n"]) for r in spark.table("hours").collect()}
        assert got == {(0, 2), (3, 1)}
    finally:
        q.stop()
    batch = spark.createDataFrame(rows[1:], "id int, k string, ts timestamp")
    assert sorted(r["n_events"] for r in sessions(batch, "ts", "1 hour", ["k"]).collect()) == [1, 1, 2]


def test_only_the_parts_asked_for_are_computed(spark, monkeypatch):
    def never(*rest):
        raise AssertionError("computed, but not asked for")

    for name in ("pr_curve", "roc_curve", "lift_chart", "confusion"):
        monkeypatch.setattr(runs.curves, name, never)
    monkeypatch.setattr(models.evaluation, "confusion_pivot", never)
    df = spark.createDataFrame([(i, float(i % 7), int(i % 7 > 3), i % 3 // 2) for i in range(120)], "id long, x double, y int, is_test int")
    out = runs.run_model(df, "lr", "y", models.feature_stages(["x"]), "id", {"maxIter": 5}, weight=None, parts=["performance"])
    assert set(out) == {"search", "performance"} and out["performance"].first()["auROC"] == 1.0
