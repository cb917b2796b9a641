"""Feature queries over the metrics of clocked days, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.operators import features as X
from panelwright.operators.frames import trailing_rows
from panelwright.operators.groups import trailing_group_stats
from panelwright.plans.clocking import CHAIN, metrics
from panelwright.plans.features import _days, _rows
from panelwright.plans.panel import KEY, facts_days

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# Exceptions are told from the clock here: more than 5 minutes after the start, before the end, and time off that was not paid.
LATE_MINUTES = 5.0
TIME_METRICS = ("hoursWorked", "lateArrival", "earlyArrival", "dayDuration", "mealDuration", "clockInMinuteOfDay", "clockOutMinuteOfDay")
LAGGED = (
    "dayDuration", "mealDuration", "mealStartDiff", "hoursWorked", "lateArrival", "clockInConsistency", "earlyArrival", "clockInMinuteOfDay", "clockOutMinuteOfDay",
    "anomalyRate", "leftEarly", "arrivedLate", "shortNotice", "isSick", "isUnpaid",
)
AVERAGED = ("hoursWorked", "dayDuration", "lateArrival", "earlyArrival", "mealDuration", "clockInConsistency", "clockInMinuteOfDay", "clockOutMinuteOfDay", "anomalyRate")
DEVIATING = ("hoursWorked", "dayDuration", "lateArrival", "clockInMinuteOfDay", "clockOutMinuteOfDay")
EXCEPTIONS = ("leftEarly", "arrivedLate", "shortNotice")
# What is known only once the day is over, so nothing to predict it from.
SAME_DAY = ("worked", "clockIn", "clockOut", "mealIn", "mealOut", *LAGGED[:13], "missedClockOut", "clockAnomaly", "anomalyType", "anomalySeverity", "shift", "dur")


def clock_panel(spark: SparkSession, d: str) -> DataFrame:
    """One row per member and clocked day: its metrics, exceptions, and what the facts of the day say."""
    found = metrics(spark, d)
    days = found["days"].withColumnRenamed("workDate", "day")
    ends = found["schedule"].select("member", F.col("workDate").alias("day"), F.col("end").alias("_end"))
    facts = facts_days(spark, d).select(*KEY, "dept", "loc", "shift", "dur", F.col("fsick").alias("isSick"), F.col("unpaid").alias("isUnpaid"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    joined = days.join(ends, KEY, "left").join(facts, KEY, "left")
    return joined.withColumns({
        "worked": F.col("clockIn").isNotNull(), "leftEarly": flag(F.col("clockOut") < F.col("_end")), "arrivedLate": flag(F.col("lateArrival") > LATE_MINUTES),
        "shortNotice": flag(F.col("isUnpaid") == 1), "isSick": F.coalesce("isSick", F.lit(0)), "isUnpaid": F.coalesce("isUnpaid", F.lit(0)),
    }).drop("_end")


_W30 = "(PARTITION BY member ORDER BY workDate ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
_PANEL = CHAIN + f""", d7 AS (SELECT d6.member, d6.workDate AS day, ci IS NOT NULL AS worked, dd AS dayDuration, md AS mealDuration, CASE WHEN mi IS NOT NULL AND ci IS NOT NULL THEN (epoch(mi) - epoch(ci)) / 3600.0 ELSE 0.0 END AS mealStartDiff, hw AS hoursWorked,
    greatest(coalesce((epoch(ci) - epoch(st)) / 60.0, 0.0), 0.0) AS lateArrival, greatest(coalesce((epoch(st) - epoch(ci)) / 60.0, 0.0), 0.0) AS earlyArrival, cim AS clockInMinuteOfDay, com AS clockOutMinuteOfDay,
    coalesce(stddev_samp(cim) OVER {_W30}, 0.0) AS clockInConsistency, sum(CASE WHEN anomalyType <> 'normal' THEN 1.0 ELSE 0.0 END) OVER {_W30} / count(*) OVER {_W30} AS anomalyRate, anomalyType <> 'normal' AS clockAnomaly,
    CASE WHEN anomalyType = 'extreme_long_shift' THEN 5 WHEN anomalyType IN ('missing_clockin', 'missing_clockout') THEN 4 WHEN anomalyType = 'meal_without_full_shift' THEN 3 WHEN anomalyType IN ('no_meal_break_full_day', 'excessive_meal_break', 'very_short_shift') THEN 2 WHEN anomalyType = 'incomplete_meal_break' THEN 1 ELSE 0 END AS anomalySeverity,
    ci IS NOT NULL AND co IS NULL AS missedClockOut, co FROM d6),
p AS (SELECT d7.*, CASE WHEN co < sc."end" THEN 1 ELSE 0 END AS leftEarly, CASE WHEN lateArrival > {LATE_MINUTES} THEN 1 ELSE 0 END AS arrivedLate, coalesce(fct.unpaid, 0) AS shortNotice, coalesce(fct.fsick, 0) AS isSick, coalesce(fct.unpaid, 0) AS isUnpaid, dept, loc
    FROM d7 LEFT JOIN sc ON d7.member = sc.member AND d7.day = sc.workDate LEFT JOIN fct ON d7.member = fct.member AND d7.day = fct.day)
"""


@query(_PANEL + "SELECT member, day, " + ", ".join(f"round(coalesce(avg(CASE WHEN worked THEN {m} END) OVER {_rows(n)}, 0), 8) AS avg_{m}_{n}d" for m in TIME_METRICS for n in (7, 30)) + " FROM p")
def rolling_time_metrics(spark, d):
    c = X.on_worked_days(TIME_METRICS, (7, 30), "avg")
    return clock_panel(spark, d).select(*KEY, *[F.round(v, 8).alias(k) for k, v in c.items()])


@query(_PANEL + "SELECT member, day, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN clockAnomaly THEN 1 ELSE 0 END) OVER {_rows(n)}, 0) AS BIGINT) AS anomalyCount_{n}d, round(coalesce(avg(CASE WHEN clockAnomaly THEN anomalySeverity END) OVER {_rows(n)}, 0), 6) AS anomalySeverity_{n}d_avg" for n in (7, 30)) + f", CAST(coalesce(sum(CASE WHEN missedClockOut THEN 1 ELSE 0 END) OVER {_rows(30)}, 0) AS BIGINT) AS missedClockOutCount_30d FROM p")
def trailing_anomalies(spark, d):
    counts = X.trailing_counts({"anomalyCount": F.col("clockAnomaly")}, (7, 30)) | X.trailing_counts({"missedClockOutCount": F.col("missedClockOut")}, (30,))
    severe = {f"anomalySeverity_{n}d_avg": F.round(F.coalesce(F.avg(F.when(F.col("clockAnomaly"), F.col("anomalySeverity"))).over(trailing_rows(X.BY, X.DAY, n)), F.lit(0.0)), 6) for n in (7, 30)}
    return clock_panel(spark, d).select(*KEY, *[v.alias(k) for k, v in (counts | severe).items()])


_LAG = "(PARTITION BY member ORDER BY day)"


@query(_PANEL + ", l AS (SELECT member, day, isSick, isUnpaid, " + ", ".join(f"coalesce(CAST(lag({m}) OVER {_LAG} AS DOUBLE), 0) AS {m}_lag1" for m in LAGGED) + " FROM p) SELECT member, day, isSick, isUnpaid, " + ", ".join(
    [f"round({m}_lag1, 8) AS {m}_lag1" for m in LAGGED]
    + [f"round(coalesce(avg({m}_lag1) OVER {_rows(n)}, 0), 8) AS avg_{m}_lag1_{n}d" for m in AVERAGED for n in (7, 30)]
    + [f"round(coalesce(stddev_samp({m}_lag1) OVER {_rows(n)}, 0), 5) AS std_{m}_lag1_{n}d" for m in DEVIATING for n in (7, 30)]
    + [f"round({m}_lag1 - coalesce(avg({m}_lag1) OVER {_rows(7)}, 0), 8) AS {m}_deviation_from_avg_7d" for m in ("hoursWorked", "lateArrival")]
    + [f"CAST(coalesce(sum(CASE WHEN lateArrival_lag1 > 0 THEN 1 ELSE 0 END) OVER {_rows(n)}, 0) AS BIGINT) AS lateArrivalDays_{n}d" for n in (7, 30)]
    + [f"coalesce(sum({m}_lag1) OVER {_rows(n)}, 0) AS {m}_count_{n}d" for m in EXCEPTIONS for n in (7, 30)]
) + " FROM l")
def clock_lag_features(spark, d):
    """Yesterday's values, their trailing averages and deviations, late days and exceptions; all that is of the day
    itself is dropped, but for what is known beforehand."""
    p = clock_panel(spark, d).withColumns(X.lag_columns(LAGGED))
    stats = {k: v for k, v in X.lag_statistics(AVERAGED).items() if k.startswith("avg") or k.split("_")[1] in DEVIATING}
    off = {f"{m}_deviation_from_avg_7d": F.col(f"{m}_lag1") - F.col(f"avg_{m}_lag1_7d") for m in ("hoursWorked", "lateArrival")}
    days = X.trailing_counts({"lateArrivalDays": F.col("lateArrival_lag1") > 0}, (7, 30))
    counts = {f"{m}_count_{n}d": F.coalesce(F.sum(f"{m}_lag1").over(trailing_rows(X.BY, X.DAY, n)), F.lit(0.0)) for m in EXCEPTIONS for n in (7, 30)}
    out = X.leak_safe(p.withColumns(stats | days | counts).withColumns(off), SAME_DAY).drop("dept", "loc")
    rounded = {c: F.round(c, 5 if c.startswith("std") else 8) for c in [*stats, *off, *[f"{m}_lag1" for m in LAGGED]]}
    return out.withColumns(rounded)


_WIN = (7, 14, 30, 90)


@query(_PANEL + "SELECT DISTINCT dept, loc, day, " + ", ".join(f"round(coalesce(avg({c}) OVER {_days('dept, loc', n)}, 0), 6) AS {k}_rate_{n}d" for n in _WIN for k, c in (("late", "arrivedLate"), ("early", "leftEarly"))) + " FROM p WHERE dept IS NOT NULL AND loc IS NOT NULL")
def dept_punctuality_rates(spark, d):
    s = trailing_group_stats(clock_panel(spark, d), ["dept", "loc"], "day", {"late": F.col("arrivedLate"), "early": F.col("leftEarly")}, _WIN)
    return s.select("dept", "loc", "day", *[F.round(F.coalesce(f"{k}_avg_{n}d", F.lit(0.0)), 6).alias(f"{k}_rate_{n}d") for n in _WIN for k in ("late", "early")])
