"""Feature sets of a daily panel, given as specifications and built in one pass per window spec.

Frames never see the current row unless said.  Every frame is ordered by day, so nothing depends on luck; all frames
of one member share one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.frames import future, history, ordered, ratio, trailing_rows

BY, DAY = ["member"], ["day"]


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def work_rates(windows: Sequence[int] = (7, 14, 30, 90)) -> dict[str, Column]:
    w = {n: trailing_rows(BY, DAY, n) for n in windows}
    return {f"workRate_{n}d": ratio(F.sum(_flag(F.col("worked"))).over(x), F.count(F.lit(1)).over(x)) for n, x in w.items()}


def on_worked_days(metrics: Sequence[str], windows: Sequence[int], kind: str) -> dict[str, Column]:
    """Average or sample deviation of metrics over the worked days among the trailing rows; 0 without any."""
    agg = F.avg if kind == "avg" else F.stddev
    return {f"{kind}_{m}_{n}d": F.coalesce(agg(F.when(F.col("worked"), F.col(m))).over(trailing_rows(BY, DAY, n)), F.lit(0.0)) for m in metrics for n in windows}


def trailing_counts(flags: dict[str, Column], windows: Sequence[int]) -> dict[str, Column]:
    return {f"{name}_{n}d": F.coalesce(F.sum(_flag(c)).over(trailing_rows(BY, DAY, n)), F.lit(0)) for name, c in flags.items() for n in windows}


def same_day_pattern() -> dict[str, Column]:
    """How often the last 30 rows did as the row seven before them did."""
    before = F.lag("worked", 7).over(ordered(BY, DAY))
    return {"_same": _flag(before == F.col("worked"))}


def year_to_date(name: str, flag: Column) -> dict[str, Column]:
    return {name: F.coalesce(F.sum(_flag(flag)).over(history([*BY, "year"], DAY)), F.lit(0))}


def history_rates(prefix: str, event: Column, given: dict[str, Column]) -> dict[str, Column]:
    """For each condition: share of the earlier rows under it on which the event occurred; 0 without any."""
    w = history(BY, DAY)
    return {f"{prefix}_{name}": ratio(F.sum(_flag(event & c)).over(w), F.sum(_flag(c)).over(w)) for name, c in given.items()}


def trailing_ratio(name: str, part: Column, whole: Column, n: int) -> dict[str, Column]:
    w = trailing_rows(BY, DAY, n)
    return {name: ratio(F.sum(_flag(part)).over(w), F.sum(_flag(whole)).over(w))}


def coming_sum(name: str, flag: Column, n: int) -> dict[str, Column]:
    """The current row and the next n - 1."""
    return {name: F.sum(_flag(flag)).over(future(BY, DAY, n, include_current=True))}


def lag_columns(metrics: Sequence[str]) -> dict[str, Column]:
    """Yesterday's values as doubles, 0 where there are none: safe to predict today from."""
    w = ordered(BY, DAY)
    return {f"{m}_lag1": F.coalesce(F.lag(F.col(m).cast("double")).over(w), F.lit(0.0)) for m in metrics}


def lag_statistics(metrics: Sequence[str], windows: Sequence[int] = (7, 30)) -> dict[str, Column]:
    out = {}
    for m in metrics:
        for n in windows:
            w = trailing_rows(BY, DAY, n)
            out[f"avg_{m}_lag1_{n}d"] = F.coalesce(F.avg(f"{m}_lag1").over(w), F.lit(0.0))
            out[f"std_{m}_lag1_{n}d"] = F.coalesce(F.stddev(f"{m}_lag1").over(w), F.lit(0.0))
    return out


def leak_safe(df: DataFrame, same_day: Sequence[str]) -> DataFrame:
    """``df`` without the columns that are known only once the day is over; those it does not have are no matter."""
    return df.drop(*[c for c in same_day if c in df.columns])


def target_leads(flag: str, days: Sequence[int]) -> dict[str, Column]:
    """What happens n rows ahead; null past the end."""
    w = ordered(BY, DAY)
    return {f"{flag}_day{n}_target": F.lead(flag, n).over(w) for n in days}


def clip_tail(df: DataFrame, ended: Column, active: Column, never: str = "2099-12-31") -> DataFrame:
    """Rows up to one day after a member's cutoff: the first ended day, else the last active day, else never.  Two
    aggregates by member, no ordered frame."""
    first, last = F.min(F.when(ended, F.col("day"))), F.max(F.when(active, F.col("day")))
    cut = df.groupBy("member").agg(F.coalesce(first, last, F.lit(never).cast("date")).alias("_cut"))
    return df.join(cut, "member").where(F.col("day") <= F.date_add("_cut", 1)).drop("_cut")
