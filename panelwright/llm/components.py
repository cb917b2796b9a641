"""Connected components of id links, without bringing links to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import materialise

ONE_TASK = 100_000  # different links that one task puts together at once; more take rounds, with the same result


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links in one task: union by the smaller id, with path halving."""
    up: dict = {}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(up.setdefault(u, u)), top(up.setdefault(v, v))
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(x) for x in up], kind)], ["id", "component"])


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``id, component``: every id of a link, with the smallest id it is linked to, directly or through others.

    Each round hands every id the smallest label among its neighbours, hands the id that was its label the same, so
    that whole trees move on, and then takes its label's label, so chains halve.  It goes on until nothing changes:
    labels only fall, so it ends, whatever the links are.  A hub costs one pre-aggregated group.
    Links with a null end and links of an id to itself tie nothing; repeated links and either direction are one.

    Up to ONE_TASK links, which is no more than a few MB, are put together by one task; that spares the rounds.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    once = materialise(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if once.limit(ONE_TASK + 1).count() <= ONE_TASK:
        kind = once.schema["u"].dataType.simpleString()
        return once.coalesce(1).mapInArrow(_put_together, f"id {kind}, component {kind}")
    both = once.unionByName(once.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = materialise(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("low")).select("id", F.least("id", "low").alias("label")))
    while True:
        heard = both.join(labels, F.col("v") == F.col("id")).groupBy(F.col("u").alias("id")).agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "id", "left").select("id", "label", F.least("label", "heard").alias("near"))
        told = nearer.groupBy(F.col("label").alias("id")).agg(F.min("near").alias("told"))
        nearer = nearer.join(told, "id", "left").select("id", "label", F.least("near", "told").alias("near"))
        jump = nearer.select(F.col("id").alias("near"), F.col("near").alias("far"))
        stepped = nearer.join(jump, "near", "left").select("id", F.col("label").alias("was"), F.least("near", F.coalesce("far", "near")).alias("label"))
        stepped = materialise(stepped)
        changed = not stepped.where("label <> was").isEmpty()
        labels = stepped.select("id", "label")
        if not changed:
            return labels.select("id", F.col("label").alias("component"))
