"""The daily panel the feature queries start from: one row per member and day, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.ids import canonical_id, canonical_id_sql
from panelwright.operators.dedupe import latest_per_key
from panelwright.sources.tables import table

KEY = ["member", "day"]


def _clean(c: str) -> F.Column:
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def _number(c: str) -> F.Column:
    return F.when(~F.isnan(c), F.col(c))


def attendance_days(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "attendance").withColumns({"member": canonical_id("maskedMatchId"), "day": F.col("date")}).where("member is not null and day is not null")
    a = latest_per_key(a.select(*KEY, "clockIn", "clockOut", "hoursWorked", "worked", "isSickTime", "noShow", "loadedAt", "row_id"), KEY, ["loadedAt", "row_id"])
    cin, cout = F.col("clockIn"), F.col("clockOut")
    minute = lambda c: F.when(c.isNotNull(), F.hour(c) * 60 + F.minute(c)).otherwise(-1)
    return a.select(
        *KEY, F.coalesce("worked", cin.isNotNull() | cout.isNotNull()).alias("worked"), F.coalesce(_number("hoursWorked"), F.lit(0.0)).alias("hrs"),
        F.coalesce("isSickTime", F.lit(0)).alias("sick"), F.coalesce("noShow", F.lit(0)).alias("noshow"), minute(cin).alias("inMinute"), minute(cout).alias("outMinute"),
        (cin.isNotNull() & cout.isNull()).cast("int").alias("missedOut"), (F.dayofmonth("day").isin(1, 15)).cast("int").alias("holiday"),
        F.dayofweek("day").alias("dow"), F.month("day").alias("month"), F.year("day").alias("year"),
    )


def facts_days(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "facts").withColumns({"member": canonical_id("maskedMatchId"), "day": F.col("date")}).where("member is not null and day is not null")
    f = latest_per_key(f.drop("maskedMatchId", "date"), KEY, ["loadedAt", "row_id"])
    flag = lambda c: F.coalesce(c, F.lit(0))
    return f.select(
        *KEY, _clean("department").alias("dept"), _clean("locationId").alias("loc"), F.initcap(F.trim("shift")).alias("shift"), _number("shiftDurationHrs").alias("dur"), F.col("managersMatchValue").alias("mgr"),
        F.col("hrStatus").alias("status"), flag("isVacationTime").alias("vac"), flag("isSickTime").alias("fsick"), flag("isUnpaidTime").alias("unpaid"), flag("noShow").alias("fnoshow"), F.dayofweek("day").alias("dow"),
    )


_ID = canonical_id_sql("maskedMatchId")

ATTENDANCE = f"""att AS (SELECT member, day, coalesce(worked, ci IS NOT NULL OR co IS NOT NULL) AS worked, CASE WHEN isnan(h) THEN 0.0 ELSE coalesce(h, 0.0) END AS hrs, coalesce(sick, 0) AS sick, coalesce(noshow, 0) AS noshow,
    CASE WHEN ci IS NULL THEN -1 ELSE hour(ci) * 60 + minute(ci) END AS inMinute, CASE WHEN co IS NULL THEN -1 ELSE hour(co) * 60 + minute(co) END AS outMinute, CASE WHEN ci IS NOT NULL AND co IS NULL THEN 1 ELSE 0 END AS missedOut,
    CASE WHEN day(day) IN (1, 15) THEN 1 ELSE 0 END AS holiday, CAST(dayofweek(day) + 1 AS INT) AS dow, CAST(month(day) AS INT) AS month, CAST(year(day) AS INT) AS year
    FROM (SELECT {_ID} AS member, CAST(date AS DATE) AS day, clockIn AS ci, clockOut AS co, hoursWorked AS h, worked, isSickTime AS sick, noShow AS noshow,
        row_number() OVER (PARTITION BY {_ID}, date ORDER BY loadedAt DESC NULLS LAST, row_id DESC) AS rn FROM attendance) WHERE rn = 1 AND member IS NOT NULL AND day IS NOT NULL)"""

FACTS = f"""fct AS (SELECT member, day, nullif(upper(trim(department)), '') AS dept, nullif(upper(trim(locationId)), '') AS loc, upper(left(trim(shift), 1)) || lower(substr(trim(shift), 2)) AS shift, CASE WHEN NOT isnan(dur) THEN dur END AS dur,
    mgr, status, coalesce(vac, 0) AS vac, coalesce(sick, 0) AS fsick, coalesce(unpaid, 0) AS unpaid, coalesce(noshow, 0) AS fnoshow, CAST(dayofweek(day) + 1 AS INT) AS dow
    FROM (SELECT {_ID} AS member, CAST(date AS DATE) AS day, department, locationId, shift, shiftDurationHrs AS dur, managersMatchValue AS mgr, hrStatus AS status, isVacationTime AS vac, isSickTime AS sick, isUnpaidTime AS unpaid, noShow AS noshow,
        row_number() OVER (PARTITION BY {_ID}, date ORDER BY loadedAt DESC NULLS LAST, row_id DESC) AS rn FROM facts) WHERE rn = 1 AND member IS NOT NULL AND day IS NOT NULL)"""
