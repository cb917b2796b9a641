"""Queries over clock events and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.ids import canonical_id, canonical_id_sql
from panelwright.operators import clocking as C
from panelwright.operators.joins import prefer
from panelwright.plans.panel import FACTS, facts_days
from panelwright.sources.tables import table

_ID = canonical_id_sql("maskedMatchId")


def swipes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "swipe").select(F.col("swipe_id").alias("event_id"), canonical_id("maskedMatchId").alias("member"), F.col("swipeTimestampLocal").alias("at"), C.event_code().alias("code"))


def shifts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "shift").select("shift_id", canonical_id("maskedMatchId").alias("member"), "workDate", F.col("startAtTimestampLocal").alias("start"), F.col("endAtTimestampLocal").alias("end"))


def real_schedule(spark: SparkSession, d: str) -> DataFrame:
    return C.one_shift_a_day(shifts(spark, d))


def _facts_days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "facts").select(canonical_id("maskedMatchId").alias("member"), F.col("date").alias("workDate"), F.initcap(F.trim("shift")).alias("shift"))


def schedule(spark: SparkSession, d: str) -> DataFrame:
    """One shift a member and day: the real one, else the one made from the shift the day was given."""
    given = facts_days(spark, d).select("member", F.col("day").alias("workDate"), "shift")
    return prefer(real_schedule(spark, d), C.synthetic_schedule(given), C.KEY)


def metrics(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return C.clock_metrics(swipes(spark, d), schedule(spark, d))


def _t(*cols: str) -> list:
    """Times as text, so that both engines show them alike."""
    return [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in cols]


def event_coding(spark, d):
    return swipes(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count("at").alias("timed"))


def shift_bucket(spark, d):
    return shifts(spark, d).select("shift_id", C.shift_of_hour(F.col("start")).alias("shift"), F.round(C.hours_between(F.col("start"), F.col("end")), 6).alias("hours"))


def one_shift_per_day(spark, d):
    return real_schedule(spark, d).select("member", "workDate", *_t("start", "end"))


def synthetic_schedule(spark, d):
    return C.synthetic_schedule(_facts_days(spark, d)).select("member", "workDate", *_t("start", "end"))


def anti_precedence_union(spark, d):
    real = real_schedule(spark, d).withColumn("origin", F.lit("real"))
    synthetic = C.synthetic_schedule(_facts_days(spark, d)).withColumn("origin", F.lit("synthetic"))
    return prefer(real, synthetic, C.KEY).select("member", "workDate", *_t("start", "end"), "origin")


def _matched(spark, d, *codes):
    return C.match_to_shifts(swipes(spark, d).where(F.col("code").isin(*codes)), schedule(spark, d))


def interval_join_nearest_in(spark, d):
    return _matched(spark, d, 1).select("event_id", "member", "workDate", "matched")


def interval_join_nearest_out(spark, d):
    return _matched(spark, d, 4).select("event_id", "member", "workDate", "matched")


def full_outer_envelope(spark, d):
    return C.clock_pairs(_matched(spark, d, 1, 4)).select("member", "workDate", *_t("clockIn", "clockOut"))


def meal_attach_disjunctive(spark, d):
    m = metrics(spark, d)
    both = m["meal_ins"].withColumn("side", F.lit("in")).unionByName(m["meal_outs"].withColumn("side", F.lit("out")))
    return both.groupBy("member", "workDate", "side").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at")).select("member", "workDate", "side", "n", *_t("first_at", "last_at"))


def sequence_pairing(spark, d):
    return metrics(spark, d)["meals"].where("completeness = 3").select("member", "workDate", *_t("mealIn", "mealOut"))


def orphans_anti(spark, d):
    return metrics(spark, d)["meals"].where("completeness < 3").select("member", "workDate", *_t("mealIn", "mealOut"))


def completeness_merge(spark, d):
    return metrics(spark, d)["meals"].groupBy("completeness").agg(F.count(F.lit(1)).alias("days"))


_DAY_COLS = ["dayDuration", "mealDuration", "mealStartDiff", "hoursWorked", "lateArrival", "earlyArrival"]


def anomaly_classify(spark, d):
    return metrics(spark, d)["days"].select("member", "workDate", "anomalyType", "anomalySeverity", "clockAnomaly", "missedClockOut")


def duration_metrics(spark, d):
    return metrics(spark, d)["days"].select("member", "workDate", *[F.round(c, 6).alias(c) for c in _DAY_COLS])


def trailing30_consistency(spark, d):
    return metrics(spark, d)["days"].select("member", "workDate", "clockInMinuteOfDay", "clockOutMinuteOfDay", F.round("clockInConsistency", 5).alias("clockInConsistency"), F.round("anomalyRate", 6).alias("anomalyRate"))


def spine_union_distinct(spark, d):
    return metrics(spark, d)["days"].select("member", "workDate", F.col("clockIn").isNotNull().alias("has_in"), F.col("mealIn").isNotNull().alias("has_meal"))


_SW = f"""sw AS (SELECT swipe_id AS event_id, {_ID} AS member, swipeTimestampLocal AS "at", CASE WHEN payCode = 'CLOCK' AND type = 'SWIPE_IN' THEN 1 WHEN payCode = 'BREAK' AND type = 'TRANSFER_PAY' THEN 2
    WHEN payCode = 'CLOCK' AND type = 'TRANSFER_PAY' THEN 3 WHEN payCode = 'CLOCK' AND type = 'SWIPE_OUT' THEN 4 ELSE 0 END AS code FROM swipe)"""
_SC = f"""sc AS (SELECT member, workDate, s AS "start", e AS "end" FROM (SELECT {_ID} AS member, workDate, startAtTimestampLocal AS s, endAtTimestampLocal AS e,
    row_number() OVER (PARTITION BY {_ID}, workDate ORDER BY startAtTimestampLocal, shift_id) AS rn FROM shift WHERE workDate IS NOT NULL AND endAtTimestampLocal > startAtTimestampLocal) WHERE rn = 1 AND member IS NOT NULL)"""
_SY = f"""sy AS (SELECT DISTINCT member, workDate, workDate + to_hours(f) AS "start", workDate + to_hours(t) AS "end" FROM (SELECT {_ID} AS member, CAST(date AS TIMESTAMP) AS wd, CAST(date AS DATE) AS workDate,
    CASE upper(trim(shift)) WHEN 'FIRST' THEN 3 WHEN 'SECOND' THEN 12 WHEN 'THIRD' THEN 20 END AS f, CASE upper(trim(shift)) WHEN 'FIRST' THEN 15 WHEN 'SECOND' THEN 24 WHEN 'THIRD' THEN 32 END AS t FROM facts) WHERE f IS NOT NULL)"""
_FALL = """CAST("at" AS DATE) - CASE WHEN hour("at") < 6 THEN 1 ELSE 0 END"""
CHAIN = f"""WITH {_SW}, {FACTS}, {_SC.replace('sc AS', 'rs AS', 1)}, gs AS (SELECT member, day AS workDate, CASE shift WHEN 'First' THEN 3 WHEN 'Second' THEN 12 WHEN 'Third' THEN 20 END AS f, CASE shift WHEN 'First' THEN 15 WHEN 'Second' THEN 24 WHEN 'Third' THEN 32 END AS t FROM fct),
sc AS (SELECT member, workDate, "start", "end" FROM rs UNION ALL SELECT member, workDate, workDate + to_hours(f), workDate + to_hours(t) FROM gs WHERE f IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rs WHERE rs.member = gs.member AND rs.workDate = gs.workDate)),
ci AS (SELECT event_id, s.workDate, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(w."at") - epoch_us(s."start")), s."start", s.workDate) AS rn FROM sw w JOIN sc s ON w.member = s.member
    AND w."at" >= s."start" - INTERVAL 18 HOUR AND w."at" <= s."start" + INTERVAL 6 HOUR WHERE code = 1),
ins AS (SELECT w.event_id, member, "at", coalesce(ci.workDate, {_FALL}) AS workDate, ci.workDate IS NOT NULL AS matched FROM sw w LEFT JOIN ci ON w.event_id = ci.event_id AND rn = 1 WHERE code = 1),
co AS (SELECT event_id, s.workDate, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(w."at") - epoch_us(s."end")), s."end", s.workDate) AS rn FROM sw w JOIN sc s ON w.member = s.member
    AND w."at" >= s."start" AND w."at" <= s."end" + INTERVAL 12 HOUR WHERE code = 4),
outs AS (SELECT w.event_id, member, "at", coalesce(co.workDate, {_FALL}) AS workDate, co.workDate IS NOT NULL AS matched FROM sw w LEFT JOIN co ON w.event_id = co.event_id AND rn = 1 WHERE code = 4),
pairs AS (SELECT coalesce(i.member, o.member) AS member, coalesce(i.workDate, o.workDate) AS workDate, clockIn, clockOut FROM (SELECT member, workDate, min("at") AS clockIn FROM ins GROUP BY 1, 2) i
    FULL OUTER JOIN (SELECT member, workDate, max("at") AS clockOut FROM outs GROUP BY 1, 2) o ON i.member = o.member AND i.workDate = o.workDate),
ml AS (SELECT code, w.member, w."at", s.workDate, row_number() OVER (PARTITION BY event_id ORDER BY clockIn IS NULL, clockIn DESC, clockOut, s.workDate) AS rn FROM sw w JOIN pairs s ON w.member = s.member AND (clockIn IS NULL OR w."at" >= clockIn)
    AND w."at" <= coalesce(clockOut, clockIn + INTERVAL 16 HOUR) WHERE code IN (2, 3)),
mi AS (SELECT member, workDate, "at" FROM ml WHERE rn = 1 AND code = 2), mo AS (SELECT member, workDate, "at" FROM ml WHERE rn = 1 AND code = 3),
mp AS (SELECT *, row_number() OVER (PARTITION BY member, workDate ORDER BY mealIn, mealOut) AS rn FROM (SELECT i.member, i.workDate, i."at" AS mealIn, o."at" AS mealOut FROM mi i JOIN mo o ON i.member = o.member AND i.workDate = o.workDate
    WHERE epoch(o."at") - epoch(i."at") BETWEEN 300 AND 7200)),
meals AS (SELECT member, workDate, mealIn, mealOut, completeness FROM (SELECT *, row_number() OVER (PARTITION BY member, workDate ORDER BY completeness DESC) AS r FROM (
    SELECT member, workDate, mealIn, mealOut, 3 AS completeness FROM mp WHERE rn = 1 UNION ALL SELECT member, workDate, min("at"), NULL, 2 FROM mi GROUP BY 1, 2 UNION ALL SELECT member, workDate, NULL, min("at"), 1 FROM mo GROUP BY 1, 2)) WHERE r = 1),
d0 AS (SELECT coalesce(p.member, m.member) AS member, coalesce(p.workDate, m.workDate) AS workDate, clockIn AS ci, CASE WHEN clockIn IS NULL OR clockOut > clockIn THEN clockOut END AS co, mealIn AS mi, mealOut AS mo
    FROM pairs p FULL OUTER JOIN meals m ON p.member = m.member AND p.workDate = m.workDate),
d1 AS (SELECT *, (epoch(co) - epoch(ci)) / 3600.0 AS rw, (epoch(mo) - epoch(mi)) / 3600.0 AS ml FROM d0),
d2 AS (SELECT *, CASE WHEN rw > 16 THEN 'extreme_long_shift' WHEN ci IS NOT NULL AND co IS NULL THEN 'missing_clockout' WHEN rw > 0 AND rw < 0.25 THEN 'very_short_shift' WHEN ml > 2 THEN 'excessive_meal_break'
    WHEN ci IS NULL AND co IS NOT NULL THEN 'missing_clockin' WHEN (mi IS NOT NULL OR mo IS NOT NULL) AND (ci IS NULL OR co IS NULL) THEN 'meal_without_full_shift' WHEN (mi IS NULL) <> (mo IS NULL) THEN 'incomplete_meal_break'
    WHEN rw >= 6 AND mi IS NULL AND mo IS NULL THEN 'no_meal_break_full_day' ELSE 'normal' END AS anomalyType FROM d1),
d3 AS (SELECT * EXCLUDE (co), CASE WHEN anomalyType <> 'extreme_long_shift' THEN co END AS co FROM d2),
d4 AS (SELECT *, CASE WHEN ci IS NOT NULL AND co IS NOT NULL THEN (epoch(co) - epoch(ci)) / 3600.0 WHEN ci IS NOT NULL THEN 8.5 ELSE 0.0 END AS dd FROM d3),
d5 AS (SELECT *, CASE WHEN mi IS NOT NULL AND mo IS NOT NULL THEN ml WHEN mi IS NULL AND mo IS NULL AND dd >= 6 THEN 0.0 WHEN dd >= 5 THEN 0.5 ELSE 0.0 END AS md FROM d4),
d6 AS (SELECT d5.*, sc."start" AS st, CASE WHEN dd = 0 THEN 0.0 WHEN md = 0 AND dd < 0.25 THEN dd WHEN md = 0 THEN greatest(dd - 0.25, 0.0) ELSE greatest(dd - 0.25, dd - md, 0.0) END AS hw,
    CASE WHEN ci IS NULL THEN -1 ELSE hour(ci) * 60 + minute(ci) END AS cim, CASE WHEN co IS NULL THEN -1 ELSE hour(co) * 60 + minute(co) END AS com FROM d5 LEFT JOIN sc ON d5.member = sc.member AND d5.workDate = sc.workDate)
"""


def _ts(*cols: str) -> str:
    return ", ".join(f"""strftime("{c}", '%Y-%m-%d %H:%M:%S') AS "{c}\"""" for c in cols)


SQL = {
    "event_coding": f"WITH {_SW} SELECT code, count(*) AS n, count(\"at\") AS timed FROM sw GROUP BY code",
    "shift_bucket": """SELECT shift_id, CASE WHEN hour(startAtTimestampLocal) <= 9 THEN 'First' WHEN hour(startAtTimestampLocal) <= 17 THEN 'Second' WHEN startAtTimestampLocal IS NOT NULL THEN 'Third' END AS shift,
        round((epoch(endAtTimestampLocal) - epoch(startAtTimestampLocal)) / 3600.0, 6) AS hours FROM shift""",
    "one_shift_per_day": f"WITH {_SC} SELECT member, workDate, {_ts('start', 'end')} FROM sc",
    "synthetic_schedule": f"WITH {_SY} SELECT member, workDate, {_ts('start', 'end')} FROM sy",
    "anti_precedence_union": f"""WITH {_SC}, {_SY} SELECT member, workDate, {_ts('start', 'end')}, 'real' AS origin FROM sc
        UNION ALL SELECT member, workDate, {_ts('start', 'end')}, 'synthetic' FROM sy WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.member = sy.member AND sc.workDate = sy.workDate)""",
    "interval_join_nearest_in": CHAIN + "SELECT event_id, member, workDate, matched FROM ins",
    "interval_join_nearest_out": CHAIN + "SELECT event_id, member, workDate, matched FROM outs",
    "full_outer_envelope": CHAIN + f"SELECT member, workDate, {_ts('clockIn', 'clockOut')} FROM pairs",
    "meal_attach_disjunctive": CHAIN + f"""SELECT member, workDate, side, n, {_ts('first_at', 'last_at')} FROM (SELECT member, workDate, 'in' AS side, count(*) AS n, min("at") AS first_at, max("at") AS last_at FROM mi GROUP BY 1, 2
        UNION ALL SELECT member, workDate, 'out', count(*), min("at"), max("at") FROM mo GROUP BY 1, 2)""",
    "sequence_pairing": CHAIN + f"SELECT member, workDate, {_ts('mealIn', 'mealOut')} FROM meals WHERE completeness = 3",
    "orphans_anti": CHAIN + f"SELECT member, workDate, {_ts('mealIn', 'mealOut')} FROM meals WHERE completeness < 3",
    "completeness_merge": CHAIN + "SELECT completeness, count(*) AS days FROM meals GROUP BY 1",
    "spine_union_distinct": CHAIN + "SELECT member, workDate, ci IS NOT NULL AS has_in, mi IS NOT NULL AS has_meal FROM d0",
    "anomaly_classify": CHAIN + """SELECT member, workDate, anomalyType, CASE WHEN anomalyType = 'extreme_long_shift' THEN 5 WHEN anomalyType IN ('missing_clockin', 'missing_clockout') THEN 4 WHEN anomalyType = 'meal_without_full_shift' THEN 3
        WHEN anomalyType IN ('no_meal_break_full_day', 'excessive_meal_break', 'very_short_shift') THEN 2 WHEN anomalyType = 'incomplete_meal_break' THEN 1 ELSE 0 END AS anomalySeverity, anomalyType <> 'normal' AS clockAnomaly, ci IS NOT NULL AND co IS NULL AS missedClockOut FROM d6""",
    "duration_metrics": CHAIN + """SELECT member, workDate, round(dd, 6) AS dayDuration, round(md, 6) AS mealDuration, round(CASE WHEN mi IS NOT NULL AND ci IS NOT NULL THEN (epoch(mi) - epoch(ci)) / 3600.0 ELSE 0.0 END, 6) AS mealStartDiff,
        round(hw, 6) AS hoursWorked, round(greatest(coalesce((epoch(ci) - epoch(st)) / 60.0, 0.0), 0.0), 6) AS lateArrival, round(greatest(coalesce((epoch(st) - epoch(ci)) / 60.0, 0.0), 0.0), 6) AS earlyArrival FROM d6""",
    "trailing30_consistency": CHAIN + """SELECT member, workDate, CAST(cim AS INT) AS clockInMinuteOfDay, CAST(com AS INT) AS clockOutMinuteOfDay, round(coalesce(stddev_samp(cim) OVER w, 0.0), 5) AS clockInConsistency,
        round(sum(CASE WHEN anomalyType <> 'normal' THEN 1.0 ELSE 0.0 END) OVER w / count(*) OVER w, 6) AS anomalyRate FROM d6 WINDOW w AS (PARTITION BY member ORDER BY workDate ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
}

QUERIES = {f.__name__: f for f in (
    event_coding, shift_bucket, one_shift_per_day, synthetic_schedule, anti_precedence_union, interval_join_nearest_in, interval_join_nearest_out, full_outer_envelope, meal_attach_disjunctive,
    sequence_pairing, orphans_anti, completeness_merge, spine_union_distinct, anomaly_classify, duration_metrics, trailing30_consistency,
)}
