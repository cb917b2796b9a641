"""Trailing statistics of whole groups by calendar days.

A group (a site, a manager's team) may hold a third of all rows.  It is summed to one row a day first, on the map
side; windows then run over days, and the result is joined back.  Averages and deviations come from sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.frames import ratio, trailing_days


def trailing_group_stats(df: DataFrame, by: Sequence[str], day: str, measures: dict[str, Column], windows: Sequence[int | None]) -> DataFrame:
    """Per group and day with rows: ``{measure}_{sum|avg|std}_{w}d`` and ``rows_{w}d`` over the w calendar days before
    (None: all days before, named ``all``).  avg and std leave nulls out; they are null where nothing is left.  Rows
    with a null group or day form no group."""
    present = F.lit(True)
    for c in [*by, day]:
        present = present & F.col(c).isNotNull()
    df = df.where(present).select(*by, day, *[m.cast("double").alias(f"_{n}") for n, m in measures.items()])
    sums = [F.count(F.lit(1)).alias("_rows")]
    for n in measures:
        sums += [F.coalesce(F.sum(f"_{n}"), F.lit(0.0)).alias(f"_s_{n}"), F.count(f"_{n}").alias(f"_n_{n}"), F.coalesce(F.sum(F.col(f"_{n}") * F.col(f"_{n}")), F.lit(0.0)).alias(f"_q_{n}")]
    daily = df.groupBy(*by, day).agg(*sums)
    out: list[Column] = []
    for w in windows:
        spec, tag = trailing_days(by, day, w), "all" if w is None else f"{w}d"
        over = lambda c, spec=spec: F.coalesce(F.sum(c).over(spec), F.lit(0))
        out.append(over("_rows").cast("long").alias(f"rows_{tag}"))
        for n in measures:
            s, k, q = over(f"_s_{n}"), over(f"_n_{n}"), over(f"_q_{n}")
            out += [s.alias(f"{n}_sum_{tag}"), ratio(s, k, None).alias(f"{n}_avg_{tag}")]
            variance = F.greatest(q - s * s / F.nullif(k.cast("double"), F.lit(0.0)), F.lit(0.0)) / F.nullif((k - 1).cast("double"), F.lit(0.0))
            out.append(F.when(k > 1, F.sqrt(variance)).alias(f"{n}_std_{tag}"))
    return daily.select(*by, day, *out)


def trailing_distinct(df: DataFrame, by: Sequence[str], day: str, member: str, n: int, out: str) -> DataFrame:
    """Exact number of different members in the ``n`` calendar days before each day of the group, without holding
    sets: a member counts from the day after a row of theirs to n days after, so each unbroken presence adds one at
    its beginning and takes one away after its end; a running sum over days gives the number."""
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*by, day, member])).select(*by, member, F.unix_date(day).alias("_d")).distinct()
    w = Window.partitionBy(*by, member).orderBy("_d")
    steps = rows.withColumns({"_p": F.lag("_d").over(w), "_n": F.lead("_d").over(w)})
    begin = F.when(F.col("_p").isNull() | (F.col("_d") - F.col("_p") > n), F.struct((F.col("_d") + 1).alias("_d"), F.lit(1).alias("_x"), F.lit(0).alias("_is")))
    end = F.when(F.col("_n").isNull() | (F.col("_n") - F.col("_d") > n), F.struct((F.col("_d") + n + 1).alias("_d"), F.lit(-1).alias("_x"), F.lit(0).alias("_is")))
    here = F.struct(F.col("_d"), F.lit(0).alias("_x"), F.lit(1).alias("_is"))
    deltas = steps.select(*by, F.inline(F.filter(F.array(begin, end, here), lambda x: x.isNotNull()))).groupBy(*by, "_d").agg(F.sum("_x").alias("_x"), F.max("_is").alias("_is"))
    total = F.sum("_x").over(Window.partitionBy(*by).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
    return deltas.withColumn(out, total).where("_is = 1").select(*by, F.date_from_unix_date("_d").alias(day), F.col(out).cast("long").alias(out))
