"""Time-off requests by day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.dedupe import latest_per_key


def request_metrics(df: DataFrame, member: str, day: str, made_at: str, start: str, end: str, hours: str, code: str, codes: dict[str, str], tie: Sequence[str] = ()) -> DataFrame:
    """The latest request of every member and day, with ``firstDayDelta`` (days from request to first day), ``totalDays``,
    ``dayInGroup``, ``totalHours`` of the whole request and a 0/1 flag for each of ``codes`` (flag name -> code).

    A request is known by member and the time it was made; of several rows for a day the one made last counts, then
    the one greatest in ``tie``.  A null code is none of the codes.
    """
    request = Window.partitionBy(member, made_at)
    flags: dict[str, Column] = {name: F.coalesce((F.col(code) == value).cast("int"), F.lit(0)) for name, value in codes.items()}
    rows = df.withColumns({
        "firstDayDelta": F.datediff(start, made_at), "totalDays": F.datediff(end, start) + 1, "dayInGroup": F.datediff(day, start) + 1,
        "totalHours": F.sum(hours).over(request), **flags,
    })
    return latest_per_key(rows, [member, day], [made_at, *tie])
