"""Window frames by name.  Ordered frames always come with a total order, so results do not depend on luck."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Start = Window.unboundedPreceding
End = Window.unboundedFollowing


def ordered(by: Sequence[str | Column], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def trailing_rows(by: Sequence[str], order: Sequence[str], n: int, include_current: bool = False) -> WindowSpec:
    """The ``n`` rows before the current one; or ``n`` rows ending with it."""
    w = ordered(by, order)
    return w.rowsBetween(-(n - 1), 0) if include_current else w.rowsBetween(-n, -1)


def history(by: Sequence[str], order: Sequence[str], include_current: bool = False) -> WindowSpec:
    return ordered(by, order).rowsBetween(Start, 0 if include_current else -1)


def future(by: Sequence[str], order: Sequence[str], n: int | None = None, include_current: bool = False) -> WindowSpec:
    first = 0 if include_current else 1
    return ordered(by, order).rowsBetween(first, End if n is None else first + n - 1)


def trailing_days(by: Sequence[str], day: str, n: int | None) -> WindowSpec:
    """The ``n`` calendar days before the current day (all earlier days for None), whoever's rows they hold."""
    return Window.partitionBy(*by).orderBy(F.unix_date(day)).rangeBetween(Start if n is None else -n, -1)


def rolling(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """All window columns of one pass: Catalyst merges equal specs into one Window over one exchange."""
    return df.withColumns(columns)


def ratio(part: Column, whole: Column, default: float | None = 0.0) -> Column:
    """part / whole, or the default where there is nothing to divide by."""
    r = part / F.nullif(whole.cast("double"), F.lit(0.0))
    return r if default is None else F.coalesce(r, F.lit(default))
