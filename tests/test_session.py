import gc
import os
import time
import types

import pytest

from panelwright.session import materialise


def test_checkpoints_are_removed_once_nothing_refers_to_them(spark):
    df = materialise(spark.range(10))
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    kept = materialise(spark.range(20))
    mine = set(os.listdir(folder)) - before
    assert mine and kept.count() == 20
    del kept
    for _ in range(50):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
        if not mine & set(os.listdir(folder)):
            break
    assert not mine & set(os.listdir(folder)) and df.count() == 10


def test_a_cluster_without_a_shared_folder_is_an_error():
    sc = types.SimpleNamespace(getCheckpointDir=lambda: None, getConf=dict, master="spark://host:7077")
    df = types.SimpleNamespace(sparkSession=types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda *a: None)))
    with pytest.raises(ValueError):
        materialise(df)
