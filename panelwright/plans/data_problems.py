"""The p-queries of the core operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.ids import canonical_id, canonical_id_sql
from panelwright.operators.fill import Field, Tie, apply_fills, propagate_fills
from panelwright.operators.intervals import gaps_within_label, periods_and_gaps
from panelwright.operators.rolling_totals import rolling_totals
from panelwright.sources.tables import table


def _day(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


def _moment(us: str) -> F.Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")


def _no_shows(spark: SparkSession, d: str) -> DataFrame:
    return rolling_totals(
        table(spark, d, "attendance"), canonical_id("maskedMatchId"), "date", (F.col("noShow") == 1).cast("int"), (7, 30),
        latest_by=["loadedAt", "row_id"], carried="noShowCount_7d",
    )


def p1_rolling_no_shows(spark: SparkSession, d: str) -> DataFrame:
    counts = [F.col(f"total_{w}d").cast("long").alias(f"noShows_{w}d") for w in (7, 30)]
    means = [F.round(f"average_{w}d", 6).alias(f"noShowAverage_{w}d") for w in (7, 30)]
    return _no_shows(spark, d).select(F.col("entity").alias("maskedMatchId"), _day("day").alias("date"), *counts, *means)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    wrong = F.col("total_7d") != F.coalesce("carried", F.lit(0.0))
    return _no_shows(spark, d).where(wrong).select(F.col("entity").alias("maskedMatchId"), _day("day").alias("date"))


def _shifts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return periods_and_gaps(table(spark, d, "shift"), canonical_id("maskedMatchId"), "startAtTimestampLocal", "endAtTimestampLocal", "workDate")


def p3_periods(spark: SparkSession, d: str) -> DataFrame:
    periods = _shifts(spark, d)["periods"]
    return periods.select(F.col("entity").alias("maskedMatchId"), _moment("period_start").alias("periodStart"), _moment("period_end").alias("periodEnd"))


def p3_gaps(spark: SparkSession, d: str) -> DataFrame:
    gaps = _shifts(spark, d)["gaps"]
    return gaps.select(F.col("entity").alias("maskedMatchId"), _moment("gap_start").alias("gapStart"), _moment("gap_end").alias("gapEnd"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    gaps = gaps_within_label(_shifts(spark, d))
    return gaps.select(F.col("entity").alias("maskedMatchId"), _moment("gap_start").alias("gapStart"), _moment("gap_end").alias("gapEnd"))


def _bare(c: str) -> F.Column:
    """Without outer blanks of any kind, in upper case."""
    return F.upper(F.btrim(F.col(c), F.lit(" \t\n\r\x0b\x0c\u00a0")))


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, list[Field], list[Tie]]:
    """``facts`` with clean codes beside the given ones, and the graph its fills come from."""
    units = table(spark, d, "org_units")
    sites = units.select(F.col("locationId").alias("_site")).distinct()
    departments = units.select(F.col("department").alias("_department")).distinct()
    facts = table(spark, d, "facts")
    facts = facts.join(sites, _bare("locationId") == F.upper("_site"), "left").join(departments, _bare("department") == F.upper("_department"), "left")
    hours, away = F.col("shiftDurationHrs"), (F.col("isVacationTime") == 1) | (F.col("isUnpaidTime") == 1)
    at_work = ~F.coalesce(away, F.lit(False))
    shift = F.initcap(_bare("shift"))
    facts = facts.withColumns({"_shift": F.when(shift.isin("First", "Second", "Third"), shift), "_hours": F.when((hours > 0) & (hours <= 24), hours), "_member": canonical_id("maskedMatchId")})
    fields = [
        Field("department", F.col("_department"), "category"),
        Field("locationId", F.col("_site"), "category"),
        Field("shift", F.col("_shift"), "category", at_work),
        Field("shiftDurationHrs", F.col("_hours"), "number", at_work),
    ]
    member, manager, site, department, day = (F.col(c) for c in ("_member", "managersMatchValue", "_site", "_department", "date"))
    ties = [
        Tie("member", (member,), 4.0, ("department", "locationId", "shift", "shiftDurationHrs")),
        Tie("manager", (manager,), 1.0, ("department", "locationId")),
        Tie("manager and shift", (manager, F.col("_shift")), 0.5, ("department", "locationId", "shiftDurationHrs")),
        Tie("unit and day", (site, department, day), 0.5, ("shift", "shiftDurationHrs")),
        Tie("member and shift", (member, F.col("_shift")), 4.0, ("shiftDurationHrs",)),
        Tie("member and length", (member, F.round(F.col("_hours") * 2)), 1.0, ("shift",)),
    ]
    return facts, fields, ties


def p6_filled(spark: SparkSession, d: str) -> DataFrame:
    facts, fields, ties = _facts(spark, d)
    out = apply_fills(facts, "row_id", fields, propagate_fills(facts, "row_id", fields, ties))
    return out.withColumn("maskedMatchId", F.col("_member")).drop("_site", "_department", "_shift", "_hours", "_member")


def _fills(spark: SparkSession, d: str) -> DataFrame:
    facts, fields, ties = _facts(spark, d)
    return propagate_fills(facts, "row_id", fields, ties)


def p6_methods(spark: SparkSession, d: str) -> DataFrame:
    """How many cells of each field were filled, and how."""
    return _fills(spark, d).groupBy("field", "method").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("share"), 4).alias("mean_share"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _fills(spark, d).where("filled").select("row_id", "field")


_ID = canonical_id_sql("maskedMatchId")

_P1 = f"""
WITH a AS (SELECT {_ID} AS m, CAST(date AS DATE) AS d, noShow, noShowCount_7d,
    row_number() OVER (PARTITION BY {_ID}, date ORDER BY loadedAt DESC NULLS LAST, row_id DESC) AS rn FROM attendance WHERE date IS NOT NULL),
one AS (SELECT m, d, CASE WHEN noShow = 1 THEN 1 ELSE 0 END AS v, noShowCount_7d AS c FROM a WHERE rn = 1 AND m IS NOT NULL),
span AS (SELECT m, min(d) AS lo, max(d) AS hi FROM one GROUP BY m),
days AS (SELECT m, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
full_days AS (SELECT days.m, days.d, coalesce(v, 0) AS v, coalesce(c, 0) AS c FROM days LEFT JOIN one USING (m, d)),
rolled AS (SELECT m, d, c,
    coalesce(sum(v) OVER (PARTITION BY m ORDER BY d RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS t7,
    coalesce(sum(v) OVER (PARTITION BY m ORDER BY d RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS t30 FROM full_days)
"""

_P3 = f"""
WITH s AS (SELECT {_ID} AS m, startAtTimestampLocal AS s, endAtTimestampLocal AS e, workDate AS w FROM shift WHERE endAtTimestampLocal > startAtTimestampLocal),
o AS (SELECT *, max(e) OVER (PARTITION BY m ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE m IS NOT NULL),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o),
p AS (SELECT m, k, min(s) AS ps, max(e) AS pe FROM n GROUP BY m, k)
"""

def _p6(field: str, missing: str) -> str:
    return f"""SELECT row_id, '{field}' AS "field" FROM facts WHERE {missing}"""


def _trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')"


_AT_WORK = "NOT coalesce(isVacationTime = 1 OR isUnpaidTime = 1, false)"
_P6 = " UNION ALL ".join([
    _p6("department", f"coalesce(upper({_trimmed('department')}) NOT IN (SELECT upper(department) FROM org_units), true)"),
    _p6("locationId", f"coalesce(upper({_trimmed('locationId')}) NOT IN (SELECT upper(locationId) FROM org_units), true)"),
    _p6("shift", f"coalesce(upper({_trimmed('shift')}) NOT IN ('FIRST', 'SECOND', 'THIRD'), true) AND {_AT_WORK}"),
    _p6("shiftDurationHrs", f"NOT coalesce(NOT isnan(shiftDurationHrs) AND shiftDurationHrs > 0 AND shiftDurationHrs <= 24, false) AND {_AT_WORK}"),
])

SQL = {
    "p6_found": _P6,
    "p1_rolling_no_shows": _P1 + """SELECT m AS "maskedMatchId", strftime(d, '%Y-%m-%d') AS "date", CAST(t7 AS BIGINT) AS "noShows_7d", CAST(t30 AS BIGINT) AS "noShows_30d",
        round(t7 / 7.0, 6) AS "noShowAverage_7d", round(t30 / 30.0, 6) AS "noShowAverage_30d" FROM rolled""",
    "p1_found": _P1 + """SELECT m AS "maskedMatchId", strftime(d, '%Y-%m-%d') AS "date" FROM rolled WHERE t7 <> c""",
    "p3_periods": _P3 + """SELECT m AS "maskedMatchId", strftime(ps, '%Y-%m-%d %H:%M:%S') AS "periodStart", strftime(pe, '%Y-%m-%d %H:%M:%S') AS "periodEnd" FROM p""",
    "p3_gaps": _P3 + """SELECT a.m AS "maskedMatchId", strftime(a.pe, '%Y-%m-%d %H:%M:%S') AS "gapStart", strftime(b.ps, '%Y-%m-%d %H:%M:%S') AS "gapEnd" FROM p a JOIN p b ON b.m = a.m AND b.k = a.k + 1""",
    "p3_found": _P3 + """SELECT a.m AS "maskedMatchId", strftime(a.pe, '%Y-%m-%d %H:%M:%S') AS "gapStart", strftime(b.ps, '%Y-%m-%d %H:%M:%S') AS "gapEnd" FROM p a JOIN p b ON b.m = a.m AND b.k = a.k + 1
        WHERE EXISTS (SELECT 1 FROM n x JOIN n y ON x.m = y.m AND x.w = y.w WHERE x.m = a.m AND x.k = a.k AND y.k = b.k)""",
}

QUERIES = {"p1_rolling_no_shows": p1_rolling_no_shows, "p1_found": p1_found, "p3_periods": p3_periods, "p3_gaps": p3_gaps, "p3_found": p3_found, "p6_filled": p6_filled, "p6_methods": p6_methods, "p6_found": p6_found}
