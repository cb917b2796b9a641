"""The same daily kernels over streams: late rows are waited for up to a watermark, copies are dropped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_table(df: DataFrame, time: str, late: str, ids: Sequence[str] = ()) -> DataFrame:
    """A stream with a watermark, without rows whose ``ids`` were seen within it."""
    df = df.withWatermark(time, late)
    return df.dropDuplicatesWithinWatermark(list(ids)) if ids else df


def tumbling_totals(df: DataFrame, time: str, width: str, by: Sequence[str], measures: dict[str, Column], slide: str | None = None) -> DataFrame:
    """``by, window_start, window_end`` and the measures (aggregates) of each window."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = df.groupBy(*by, w.alias("_w")).agg(*[c.alias(n) for n, c in measures.items()])
    return out.select(*by, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *measures)


def sessions(df: DataFrame, time: str, gap: str, by: Sequence[str]) -> DataFrame:
    """``by, session_start, session_end, n_events``: events less than ``gap`` apart are one session."""
    out = df.groupBy(*by, F.session_window(time, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n_events"))
    return out.select(*by, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n_events")
