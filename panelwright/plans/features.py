"""Feature queries over the daily panel, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.operators import features as X
from panelwright.operators.frames import ordered, ratio, trailing_days, trailing_rows
from panelwright.operators.groups import trailing_distinct, trailing_group_stats
from panelwright.operators.islands import days_since_last, days_until_next, streaks
from panelwright.plans.panel import ATTENDANCE, FACTS, KEY, attendance_days, facts_days

BY, DAY = X.BY, X.DAY
QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _r(*cols: str, places: int = 6) -> list:
    return [F.round(c, places).alias(c) for c in cols]


def _rows(n: int) -> str:
    return f"(PARTITION BY member ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _days(by: str, n: int | None) -> str:
    lo = "UNBOUNDED" if n is None else f"INTERVAL {n} DAY"
    return f"(PARTITION BY {by} ORDER BY day RANGE BETWEEN {lo} PRECEDING AND INTERVAL 1 DAY PRECEDING)"


_H = "(PARTITION BY member ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_O = "(PARTITION BY member ORDER BY day)"
_A = f"WITH {ATTENDANCE} "
_F = f"WITH {FACTS} "


# --- rows of a member in trailing calendar days, rates and fallbacks ---------------------------------------------

@query(_F + "SELECT member, day, " + ", ".join(f"count(*) OVER {_days('member', n)} AS rows_{n}d" for n in (7, 30, 90)) + "".join(f", count(*) OVER {_days('member', n)} = 0 AS is_new_{n}d" for n in (7, 30)) + " FROM fct")
def rolling_days_range(spark, d):
    f = facts_days(spark, d)
    counts = {f"rows_{n}d": F.count(F.lit(1)).over(trailing_days(BY, "day", n)) for n in (7, 30, 90)}
    return f.select(*KEY, *[c.alias(k) for k, c in counts.items()], *[(counts[f"rows_{n}d"] == 0).alias(f"is_new_{n}d") for n in (7, 30)])


@query(_F + "SELECT member, day, " + ", ".join(f"CAST(coalesce(sum(vac) OVER {_days('member', n)}, 0) AS BIGINT) AS approvals_{n}d, CAST(coalesce(sum(unpaid) OVER {_days('member', n)}, 0) AS BIGINT) AS rejections_{n}d, round(sum(vac) OVER {_days('member', n)} / nullif(sum(vac + unpaid) OVER {_days('member', n)}, 0), 6) AS approval_rate_{n}d" for n in (7, 30, 90)) + " FROM fct")
def approval_rate_null_safe(spark, d):
    s = trailing_group_stats(facts_days(spark, d), BY, "day", {"a": F.col("vac"), "r": F.col("unpaid")}, (7, 30, 90))
    cols = []
    for n in (7, 30, 90):
        a, r = F.col(f"a_sum_{n}d"), F.col(f"r_sum_{n}d")
        cols += [a.cast("long").alias(f"approvals_{n}d"), r.cast("long").alias(f"rejections_{n}d"), F.round(ratio(a, a + r, None), 6).alias(f"approval_rate_{n}d")]
    return s.select(*KEY, *cols)


@query(_F + "SELECT DISTINCT mgr, dept, day, " + ", ".join(f"count(*) OVER {_days('mgr, dept', n)} AS shifts_{n}d, round(coalesce(avg(fnoshow) OVER {_days('mgr, dept', n)}, 0), 6) AS noshow_rate_{n}d, round(coalesce(avg(fsick) OVER {_days('mgr, dept', n)}, 0), 6) AS sick_rate_{n}d, round(coalesce(stddev_samp(fnoshow) OVER {_days('mgr, dept', n)}, 0), 5) AS noshow_std_{n}d" for n in (7, 30, 90)) + " FROM fct WHERE mgr IS NOT NULL AND dept IS NOT NULL")
def manager_team_rates(spark, d):
    s = trailing_group_stats(facts_days(spark, d), ["mgr", "dept"], "day", {"noshow": F.col("fnoshow"), "sick": F.col("fsick")}, (7, 30, 90))
    zero = lambda c, p=6: F.round(F.coalesce(c, F.lit(0.0)), p)
    cols = [x for n in (7, 30, 90) for x in (F.col(f"rows_{n}d").alias(f"shifts_{n}d"), zero(f"noshow_avg_{n}d").alias(f"noshow_rate_{n}d"), zero(f"sick_avg_{n}d").alias(f"sick_rate_{n}d"), zero(f"noshow_std_{n}d", 5).alias(f"noshow_std_{n}d"))]
    return s.select("mgr", "dept", "day", *cols)


@query(_F + "SELECT g.mgr, g.dept, g.day, (SELECT count(DISTINCT x.member) FROM fct x WHERE x.mgr = g.mgr AND x.dept = g.dept AND x.day < g.day AND x.day >= g.day - 30) AS team_size_30d FROM (SELECT DISTINCT mgr, dept, day FROM fct WHERE mgr IS NOT NULL AND dept IS NOT NULL) g")
def team_distinct_window(spark, d):
    return trailing_distinct(facts_days(spark, d), ["mgr", "dept"], "day", "member", 30, "team_size_30d")


@query(_F + f"SELECT member, day, count(*) OVER {_days('member', None)} AS shifts_alltime, CAST(coalesce(sum(vac) OVER {_days('member', None)}, 0) AS BIGINT) AS approvals_alltime, CAST(coalesce(sum(unpaid) OVER {_days('member', None)}, 0) AS BIGINT) AS rejections_alltime FROM fct")
def alltime_history(spark, d):
    s = trailing_group_stats(facts_days(spark, d), BY, "day", {"a": F.col("vac"), "r": F.col("unpaid")}, (None,))
    return s.select(*KEY, F.col("rows_all").alias("shifts_alltime"), F.col("a_sum_all").cast("long").alias("approvals_alltime"), F.col("r_sum_all").cast("long").alias("rejections_alltime"))


_RATES = ", ".join(f"sum(vac) OVER {_days('member', n)} / nullif(sum(vac + unpaid) OVER {_days('member', n)}, 0) AS rate_{n}d" for n in (7, 30, 90))


@query(_F + f", r AS (SELECT *, {_RATES} FROM fct) SELECT member, day, " + ", ".join(f"round(coalesce(rate_{n}d, CASE WHEN mgr IS NOT NULL AND dept IS NOT NULL THEN avg(rate_{n}d) OVER {_days('mgr, dept', n)} END, CASE WHEN dept IS NOT NULL THEN avg(rate_{n}d) OVER {_days('dept', n)} END, 0), 6) AS approval_rate_{n}d" for n in (7, 30, 90)) + " FROM r")
def hierarchical_rate_fallback(spark, d):
    """A member's own rate, else the mean of the manager's team, else of the department, else 0, each over the same days."""
    f, ns = facts_days(spark, d), (7, 30, 90)
    s = trailing_group_stats(f, BY, "day", {"a": F.col("vac"), "w": F.col("vac") + F.col("unpaid")}, ns)
    f = f.join(s.select(*KEY, *[ratio(F.col(f"a_sum_{n}d"), F.col(f"w_sum_{n}d"), None).alias(f"rate_{n}d") for n in ns]), KEY)
    for i, level in enumerate((["mgr", "dept"], ["dept"])):
        means = trailing_group_stats(f, level, "day", {f"rate_{n}d": F.col(f"rate_{n}d") for n in ns}, ns)
        f = f.join(means.select(*level, "day", *[F.col(f"rate_{n}d_avg_{n}d").alias(f"_{i}_{n}") for n in ns]), [*level, "day"], "left")
    return f.select(*KEY, *[F.round(F.coalesce(f"rate_{n}d", f"_0_{n}", f"_1_{n}", F.lit(0.0)), 6).alias(f"approval_rate_{n}d") for n in ns])


_TIME_OFF = ", ".join(f"CAST(sum(vac) OVER {_days('mgr, dept', n)} AS BIGINT) AS a{n}, CAST(sum(unpaid) OVER {_days('mgr, dept', n)} AS BIGINT) AS r{n}" for n in (7, 30, 90))


@query(_F + f", t AS (SELECT DISTINCT mgr, dept, day, {_TIME_OFF} FROM fct WHERE mgr IS NOT NULL AND dept IS NOT NULL) SELECT mgr, dept, day, " + ", ".join(f"coalesce(a{n}, 0) AS approvals_{n}d, coalesce(r{n}, 0) AS rejections_{n}d, round(coalesce(a{n} / nullif(a{n} + r{n}, 0), 0), 6) AS approval_rate_{n}d" for n in (7, 30, 90)) + " FROM t")
def manager_time_off(spark, d):
    """Requests approved (vacation) and rejected (unpaid stands in) in a manager's team, and the share approved; 0 without any."""
    s = trailing_group_stats(facts_days(spark, d), ["mgr", "dept"], "day", {"a": F.col("vac"), "r": F.col("unpaid")}, (7, 30, 90))
    cols = []
    for n in (7, 30, 90):
        a, r = F.col(f"a_sum_{n}d"), F.col(f"r_sum_{n}d")
        cols += [a.cast("long").alias(f"approvals_{n}d"), r.cast("long").alias(f"rejections_{n}d"), F.round(ratio(a, a + r), 6).alias(f"approval_rate_{n}d")]
    return s.select("mgr", "dept", "day", *cols)


@query(_F + ", s AS (SELECT day, dept, loc, count(DISTINCT member) AS department_size FROM fct WHERE dept IS NOT NULL AND loc IS NOT NULL GROUP BY day, dept, loc) SELECT member, fct.day, s.department_size FROM fct LEFT JOIN s ON fct.day = s.day AND fct.dept = s.dept AND fct.loc = s.loc")
def department_size_joined(spark, d):
    f = facts_days(spark, d)
    sizes = f.where("dept is not null and loc is not null").groupBy("day", "dept", "loc").agg(F.countDistinct("member").alias("department_size"))
    return f.join(sizes, ["day", "dept", "loc"], "left").select(*KEY, "department_size")


@query(_F + "SELECT day, dept, loc, count(DISTINCT member) AS department_size FROM fct WHERE dept IS NOT NULL AND loc IS NOT NULL GROUP BY day, dept, loc")
def dept_size_countdistinct(spark, d):
    return facts_days(spark, d).where("dept is not null and loc is not null").groupBy("day", "dept", "loc").agg(F.countDistinct("member").alias("department_size"))


@query(_F + "SELECT DISTINCT dept, loc, day, " + ", ".join(f"round(coalesce(avg({c}) OVER {_days('dept, loc', n)}, 0), 6) AS {k}_rate_{n}d" for n in (7, 14, 30, 90) for k, c in (("noshow", "fnoshow"), ("sick", "fsick"), ("vacation", "vac"))) + "".join(f", round(coalesce(stddev_samp(fnoshow) OVER {_days('dept, loc', n)}, 0), 5) AS noshow_volatility_{n}d" for n in (7, 14, 30, 90)) + " FROM fct WHERE dept IS NOT NULL AND loc IS NOT NULL")
def dept_rates(spark, d):
    ns = (7, 14, 30, 90)
    s = trailing_group_stats(facts_days(spark, d), ["dept", "loc"], "day", {"noshow": F.col("fnoshow"), "sick": F.col("fsick"), "vacation": F.col("vac")}, ns)
    cols = [F.round(F.coalesce(f"{k}_avg_{n}d", F.lit(0.0)), 6).alias(f"{k}_rate_{n}d") for n in ns for k in ("noshow", "sick", "vacation")]
    return s.select("dept", "loc", "day", *cols, *[F.round(F.coalesce(f"noshow_std_{n}d", F.lit(0.0)), 5).alias(f"noshow_volatility_{n}d") for n in ns])


@query(_F + f"SELECT DISTINCT dept, loc, day, dow, round(coalesce(avg(fnoshow) OVER {_days('dept, loc, dow', 30)}, 0), 6) AS noshow_rate_dow_30d FROM fct WHERE dept IS NOT NULL AND loc IS NOT NULL")
def dow_rate(spark, d):
    s = trailing_group_stats(facts_days(spark, d), ["dept", "loc", "dow"], "day", {"noshow": F.col("fnoshow")}, (30,))
    return s.select("dept", "loc", "day", "dow", F.round(F.coalesce("noshow_avg_30d", F.lit(0.0)), 6).alias("noshow_rate_dow_30d"))


# --- attendance of a member ---------------------------------------------------------------------------------------

_ISLAND = f"s AS (SELECT *, CASE WHEN worked AND NOT coalesce(lag(worked) OVER {_O} AND day - lag(day) OVER {_O} = 1, false) THEN 1 ELSE 0 END AS b FROM att), g AS (SELECT *, sum(b) OVER {_O} AS k FROM s)"


@query(f"WITH {ATTENDANCE}, {_ISLAND} SELECT member, day, CAST(CASE WHEN worked THEN sum(CASE WHEN worked THEN 1 ELSE 0 END) OVER (PARTITION BY member, k ORDER BY day) ELSE 0 END AS INT) AS consecutiveDaysWorked FROM g")
def streak_islands(spark, d):
    return streaks(attendance_days(spark, d), BY, "day", F.col("worked"), "consecutiveDaysWorked").select(*KEY, "consecutiveDaysWorked")


@query(_A + f"""SELECT member, day, CAST(CASE WHEN NOT worked THEN 0 ELSE coalesce(day - max(CASE WHEN NOT worked THEN day END) OVER {_H}, 0) END AS INT) AS sinceAbsence, CAST(CASE WHEN worked THEN 0 ELSE coalesce(day - max(CASE WHEN worked THEN day END) OVER {_H}, 0) END AS INT) AS sinceWork,
    CAST(CASE WHEN sick = 1 THEN 0 ELSE coalesce(day - max(CASE WHEN sick = 1 THEN day END) OVER {_H}, 999) END AS INT) AS sinceSick, CAST(CASE WHEN noshow = 1 THEN 0 ELSE coalesce(day - max(CASE WHEN noshow = 1 THEN day END) OVER {_H}, 999) END AS INT) AS sinceNoShow,
    CAST(CASE WHEN NOT worked THEN 0 ELSE coalesce(day - CASE WHEN NOT lag(worked) OVER {_O} THEN lag(day) OVER {_O} END, 0) END AS INT) AS sinceAbsenceAdjacent FROM att""")
def days_since_last_events(spark, d):
    w = F.col("worked")
    return attendance_days(spark, d).select(
        *KEY, days_since_last(BY, "day", ~w).alias("sinceAbsence"), days_since_last(BY, "day", w).alias("sinceWork"), days_since_last(BY, "day", F.col("sick") == 1, 999).alias("sinceSick"),
        days_since_last(BY, "day", F.col("noshow") == 1, 999).alias("sinceNoShow"), days_since_last(BY, "day", ~w, ignore_nulls=False).alias("sinceAbsenceAdjacent"),
    )


@query(_A + "SELECT member, day, " + ", ".join(f"round(coalesce(avg(CASE WHEN worked THEN 1.0 ELSE 0.0 END) OVER {_rows(n)}, 0), 6) AS workRate_{n}d" for n in (7, 14, 30, 90)) + " FROM att")
def rolling_rows_rate(spark, d):
    c = X.work_rates()
    return attendance_days(spark, d).select(*KEY, *[F.round(v, 6).alias(k) for k, v in c.items()])


_M = ("hrs", "inMinute", "outMinute")


@query(_A + "SELECT member, day, " + ", ".join(f"round(coalesce({f}(CASE WHEN worked THEN {m} END) OVER {_rows(n)}, 0), {7 if k == 'avg' else 5}) AS {k}_{m}_{n}d" for k, f in (("avg", "avg"), ("std", "stddev_samp")) for m in _M for n in (7, 30)) + " FROM att")
def rolling_worked_avg_std(spark, d):
    c = X.on_worked_days(_M, (7, 30), "avg") | X.on_worked_days(_M, (7, 30), "std")
    return attendance_days(spark, d).select(*KEY, *[F.round(v, 7 if k.startswith("avg") else 5).alias(k) for k, v in c.items()])


_FLAGS = {"missedOutCount": "missedOut = 1", "longDayCount": "hrs > 12", "sickDays": "sick = 1", "noShowCount": "noshow = 1"}


@query(_A + "SELECT member, day, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END) OVER {_rows(n)}, 0) AS BIGINT) AS {k}_{n}d" for k, c in _FLAGS.items() for n in (7, 30, 90)) + " FROM att")
def trailing_flag_counts(spark, d):
    c = X.trailing_counts({k: F.expr(v) for k, v in _FLAGS.items()}, (7, 30, 90))
    return attendance_days(spark, d).select(*KEY, *[v.alias(k) for k, v in c.items()])


@query(_A + f", p AS (SELECT *, CASE WHEN lag(worked, 7) OVER {_O} = worked THEN 1 ELSE 0 END AS same FROM att) SELECT member, day, dow, CAST(coalesce(sum(same) OVER {_rows(30)}, 0) AS BIGINT) AS sameDayPatternCount_30d, round(coalesce(CAST(sum(CASE WHEN worked AND same = 1 THEN 1 ELSE 0 END) OVER {_rows(30)} AS DOUBLE) / nullif(sum(CASE WHEN worked THEN 1 ELSE 0 END) OVER {_rows(30)}, 0), 0), 6) AS weeklyConsistencyRate_30d FROM p")
def same_day_last_week(spark, d):
    a = attendance_days(spark, d).withColumns(X.same_day_pattern())
    w = trailing_rows(BY, DAY, 30)
    share = X.trailing_ratio("weeklyConsistencyRate_30d", F.col("worked") & (F.col("_same") == 1), F.col("worked"), 30)
    return a.select(*KEY, "dow", F.coalesce(F.sum("_same").over(w), F.lit(0)).alias("sameDayPatternCount_30d"), *[F.round(v, 6).alias(k) for k, v in share.items()])


_UNTIL = "(PARTITION BY member ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
_NEAR = f"n AS (SELECT *, CAST(coalesce(min(CASE WHEN holiday = 1 THEN day END) OVER {_UNTIL} - day, 999) AS INT) AS untilHoliday, CAST(coalesce(day - max(CASE WHEN holiday = 1 THEN day END) OVER {_H}, 999) AS INT) AS sinceHoliday FROM att)"


def _near(spark, d):
    on = F.col("holiday") == 1
    return attendance_days(spark, d).withColumns({"untilHoliday": days_until_next(BY, "day", on, 999), "sinceHoliday": days_since_last(BY, "day", on, 999, today_counts=False)})


@query(f"WITH {ATTENDANCE}, {_NEAR} SELECT member, day, untilHoliday, sinceHoliday, least(untilHoliday, sinceHoliday) AS holidayProximity, untilHoliday = 1 OR sinceHoliday = 1 AS adjacentToHoliday, sick = 1 AND untilHoliday = 1 AS sickBeforeHoliday, sick = 1 AND sinceHoliday = 1 AS sickAfterHoliday FROM n")
def holiday_proximity(spark, d):
    u, s, sick = F.col("untilHoliday"), F.col("sinceHoliday"), F.col("sick") == 1
    return _near(spark, d).select(*KEY, u, s, F.least(u, s).alias("holidayProximity"), ((u == 1) | (s == 1)).alias("adjacentToHoliday"), (sick & (u == 1)).alias("sickBeforeHoliday"), (sick & (s == 1)).alias("sickAfterHoliday"))


_AROUND = f"r AS (SELECT *, coalesce(lead(holiday) OVER {_O}, 0) = 1 AS bef, coalesce(lag(holiday) OVER {_O}, 0) = 1 AS aft FROM att)"
_W30 = "ROWS BETWEEN 29 PRECEDING AND CURRENT ROW"


@query(f"WITH {ATTENDANCE}, {_AROUND} SELECT member, day, round(CASE WHEN bef THEN avg(CASE WHEN worked THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY member, bef ORDER BY day {_W30}) ELSE 0 END, 6) AS absenceRateBeforeHoliday, round(CASE WHEN aft THEN avg(CASE WHEN worked THEN 0.0 ELSE 1.0 END) OVER (PARTITION BY member, aft ORDER BY day {_W30}) ELSE 0 END, 6) AS absenceRateAfterHoliday FROM r")
def absence_around_holiday(spark, d):
    w, out = ordered(BY, DAY), []
    a = attendance_days(spark, d).withColumns({"bef": F.coalesce(F.lead("holiday").over(w), F.lit(0)) == 1, "aft": F.coalesce(F.lag("holiday").over(w), F.lit(0)) == 1})
    for flag, name in (("bef", "absenceRateBeforeHoliday"), ("aft", "absenceRateAfterHoliday")):
        mean = F.avg(F.when(F.col("worked"), 0.0).otherwise(1.0)).over(trailing_rows([*BY, flag], DAY, 30, include_current=True))
        out.append(F.round(F.when(F.col(flag), mean).otherwise(0.0), 6).alias(name))
    return a.select(*KEY, *out)


@query(_A + "SELECT member, day, " + ", ".join(f"CAST(sum(holiday) OVER (PARTITION BY member ORDER BY day ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS BIGINT) AS holidaysNext{n}Days" for n in (7, 14)) + " FROM att")
def forward_window(spark, d):
    c = X.coming_sum("holidaysNext7Days", F.col("holiday") == 1, 7) | X.coming_sum("holidaysNext14Days", F.col("holiday") == 1, 14)
    return attendance_days(spark, d).select(*KEY, *[v.alias(k) for k, v in c.items()])


_YTD = "(PARTITION BY member, year ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(_A + f"SELECT member, day, CAST(coalesce(sum(CASE WHEN sick = 1 THEN 1 ELSE 0 END) OVER {_YTD}, 0) AS BIGINT) AS sickDaysThisYear, CAST(coalesce(sum(CASE WHEN noshow = 1 THEN 1 ELSE 0 END) OVER {_YTD}, 0) AS BIGINT) AS noShowsThisYear FROM att")
def year_to_date(spark, d):
    c = X.year_to_date("sickDaysThisYear", F.col("sick") == 1) | X.year_to_date("noShowsThisYear", F.col("noshow") == 1)
    return attendance_days(spark, d).select(*KEY, *[v.alias(k) for k, v in c.items()])


def _plain_streak(flag: str) -> str:
    return f"(SELECT *, CAST(CASE WHEN {flag} = 1 THEN sum(CASE WHEN {flag} = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY member, k ORDER BY day) ELSE 0 END AS INT) AS streak FROM (SELECT *, sum(CASE WHEN {flag} = 1 THEN 0 ELSE 1 END) OVER {_O} AS k FROM att))"


@query(_A + f"SELECT member, day, streak AS consecutiveSickDays FROM {_plain_streak('sick')}")
def sick_streak(spark, d):
    return streaks(attendance_days(spark, d), BY, "day", F.col("sick") == 1, "consecutiveSickDays", gaps_break=False).select(*KEY, "consecutiveSickDays")


@query(_A + f"SELECT member, day, streak AS noShowStreak, coalesce(max(streak) OVER {_rows(30)}, 0) AS maxNoShowStreak_30d FROM {_plain_streak('noshow')}")
def max_streak_30(spark, d):
    a = streaks(attendance_days(spark, d), BY, "day", F.col("noshow") == 1, "noShowStreak", gaps_break=False)
    return a.select(*KEY, "noShowStreak", F.coalesce(F.max("noShowStreak").over(trailing_rows(BY, DAY, 30)), F.lit(0)).alias("maxNoShowStreak_30d"))


def _hist(event: str, given: str, name: str) -> str:
    return f"round(coalesce(CAST(sum(CASE WHEN {event} AND {given} THEN 1 ELSE 0 END) OVER {_H} AS DOUBLE) / nullif(sum(CASE WHEN {given} THEN 1 ELSE 0 END) OVER {_H}, 0), 0), 6) AS {name}"


@query(_A + "SELECT member, day, " + ", ".join(_hist(f"{e} = 1", f"dow = {k}", f"{n}_day{k}") for e, n in (("sick", "sickRate"), ("noshow", "noShowRate")) for k in range(1, 8)) + " FROM att")
def weekday_history_rate(spark, d):
    given = {f"day{k}": F.col("dow") == k for k in range(1, 8)}
    c = X.history_rates("sickRate", F.col("sick") == 1, given) | X.history_rates("noShowRate", F.col("noshow") == 1, given)
    return attendance_days(spark, d).select(*KEY, *[F.round(v, 6).alias(k) for k, v in c.items()])


@query(_A + "SELECT member, day, " + ", ".join(_hist("noshow = 1", f"month = {k}", f"noShowRate_month{k}") for k in range(1, 13)) + " FROM att")
def month_history_rate(spark, d):
    c = X.history_rates("noShowRate", F.col("noshow") == 1, {f"month{k}": F.col("month") == k for k in range(1, 13)})
    return attendance_days(spark, d).select(*KEY, *[F.round(v, 6).alias(k) for k, v in c.items()])


_AROUND_SQL = ("dow = 6", "dow = 2", "untilHoliday = 1", "sinceHoliday = 1")
_AROUND_NAMES = ("beforeWeekend", "afterWeekend", "beforeHoliday", "afterHoliday")


@query(f"WITH {ATTENDANCE}, {_NEAR} SELECT member, day, " + ", ".join(f"noshow = 1 AND {c} AS noShow_{n}, " + _hist("noshow = 1", c, f"noShowRate_{n}") for c, n in zip(_AROUND_SQL, _AROUND_NAMES)) + " FROM n")
def noshow_around_breaks(spark, d):
    given = {n: F.expr(c) for c, n in zip(_AROUND_SQL, _AROUND_NAMES)}
    c = X.history_rates("noShowRate", F.col("noshow") == 1, given)
    return _near(spark, d).select(*KEY, *[((F.col("noshow") == 1) & v).alias(f"noShow_{k}") for k, v in given.items()], *[F.round(v, 6).alias(k) for k, v in c.items()])


def _tr(part: str, whole: str, n: int, name: str) -> str:
    return f"round(coalesce(CAST(sum(CASE WHEN {part} THEN 1 ELSE 0 END) OVER {_rows(n)} AS DOUBLE) / nullif(sum(CASE WHEN {whole} THEN 1 ELSE 0 END) OVER {_rows(n)}, 0), 0), 6) AS {name}"


@query(_A + "SELECT member, day, " + ", ".join([_tr("noshow = 1", "worked OR noshow <> 0", n, f"noShowRate_{n}d") for n in (30, 90)] + [_tr("sick = 1 AND dow = 6", "dow = 6", 30, "sickBeforeWeekendRate_30d"), _tr("sick = 1 AND dow = 2", "dow = 2", 30, "sickAfterWeekendRate_30d")]) + " FROM att")
def conditional_trailing_rates(spark, d):
    ns, sick = F.col("noshow"), F.col("sick") == 1
    c = X.trailing_ratio("noShowRate_30d", ns == 1, F.col("worked") | (ns != 0), 30) | X.trailing_ratio("noShowRate_90d", ns == 1, F.col("worked") | (ns != 0), 90)
    c |= X.trailing_ratio("sickBeforeWeekendRate_30d", sick & (F.col("dow") == 6), F.col("dow") == 6, 30) | X.trailing_ratio("sickAfterWeekendRate_30d", sick & (F.col("dow") == 2), F.col("dow") == 2, 30)
    return attendance_days(spark, d).select(*KEY, *[F.round(v, 6).alias(k) for k, v in c.items()])


@query(_A + f""", l AS (SELECT *, lag(sick) OVER {_O} AS ps, lead(sick) OVER {_O} AS ns FROM att), t AS (SELECT *, coalesce(ps = 1 AND noshow = 1, false) AS sickThenNoShow, coalesce(noshow = 1 AND ns = 1, false) AS noShowThenSick FROM l)
    SELECT member, day, sickThenNoShow, noShowThenSick, {_tr('sickThenNoShow', 'ps = 1', 30, 'sickToNoShowRate_30d')}, {_tr('noShowThenSick', 'noshow = 1', 30, 'noShowToSickRate_30d')} FROM t""")
def transition_rate(spark, d):
    """A no-show after a day of sick time, and before one.  The second flag looks a row ahead, so on its own row it is
    no feature to predict from; its rate is over the 30 rows before, which it does not reach beyond."""
    w, none = ordered(BY, DAY), F.lit(False)
    a = attendance_days(spark, d).withColumns({"ps": F.lag("sick").over(w), "ns": F.lead("sick").over(w)})
    ns = F.col("noshow") == 1
    a = a.withColumns({"sickThenNoShow": F.coalesce((F.col("ps") == 1) & ns, none), "noShowThenSick": F.coalesce(ns & (F.col("ns") == 1), none)})
    c = X.trailing_ratio("sickToNoShowRate_30d", F.col("sickThenNoShow"), F.coalesce(F.col("ps") == 1, none), 30) | X.trailing_ratio("noShowToSickRate_30d", F.col("noShowThenSick"), ns, 30)
    return a.select(*KEY, "sickThenNoShow", "noShowThenSick", *[F.round(v, 6).alias(k) for k, v in c.items()])


# --- yesterday's values, targets, clipping ------------------------------------------------------------------------

_LAGGED = ("hrs", "inMinute", "outMinute", "sick", "noshow", "missedOut")
_LAG_SQL = "l AS (SELECT member, day, " + ", ".join(f"coalesce(CAST(lag({m}) OVER {_O} AS DOUBLE), 0) AS {m}_lag1" for m in _LAGGED) + " FROM att)"


@query(f"WITH {ATTENDANCE}, {_LAG_SQL} SELECT member, day, " + ", ".join(f"{m}_lag1" for m in _LAGGED) + " FROM l")
def lag1_features(spark, d):
    return attendance_days(spark, d).select(*KEY, *[v.alias(k) for k, v in X.lag_columns(_LAGGED).items()])


@query(f"WITH {ATTENDANCE}, {_LAG_SQL} SELECT member, day, " + ", ".join(f"round(coalesce({f}({m}_lag1) OVER {_rows(n)}, 0), {7 if k == 'avg' else 5}) AS {k}_{m}_lag1_{n}d" for m in ("hrs", "inMinute") for n in (7, 30) for k, f in (("avg", "avg"), ("std", "stddev_samp"))) + f", round(hrs_lag1 - coalesce(avg(hrs_lag1) OVER {_rows(7)}, 0), 7) AS hrs_deviation_7d, CAST(coalesce(sum(CASE WHEN missedOut_lag1 > 0 THEN 1 ELSE 0 END) OVER {_rows(30)}, 0) AS BIGINT) AS missedOutDays_30d FROM l")
def lag_rolling_stats(spark, d):
    a = attendance_days(spark, d).withColumns(X.lag_columns(_LAGGED))
    c = X.lag_statistics(("hrs", "inMinute"))
    off = F.col("hrs_lag1") - c["avg_hrs_lag1_7d"]
    days = X.trailing_counts({"missedOutDays": F.col("missedOut_lag1") > 0}, (30,))
    return a.select(*KEY, *[F.round(v, 7 if k.startswith("avg") else 5).alias(k) for k, v in c.items()], F.round(off, 7).alias("hrs_deviation_7d"), *[v.alias(k) for k, v in days.items()])


@query(_A + "SELECT member, day, " + ", ".join(f"lead(noshow, {n}) OVER {_O} AS noshow_day{n}_target" for n in range(1, 8)) + " FROM att")
def target_leads(spark, d):
    return attendance_days(spark, d).select(*KEY, *[v.alias(k) for k, v in X.target_leads("noshow", range(1, 8)).items()])


@query(f"WITH {FACTS}, c AS (SELECT member, coalesce(min(CASE WHEN status = 'T' THEN day END), max(CASE WHEN dur > 0 THEN day END), DATE '2099-12-31') AS cut FROM fct GROUP BY member) SELECT member, day, status FROM fct JOIN c USING (member) WHERE day <= cut + 1")
def tail_clip(spark, d):
    return X.clip_tail(facts_days(spark, d), F.col("status") == "T", F.col("dur") > 0).select(*KEY, "status")


_WHOLE = ("rolling_rows_rate", "rolling_worked_avg_std", "trailing_flag_counts", "year_to_date", "weekday_history_rate", "month_history_rate", "conditional_trailing_rates", "forward_window", "lag1_features", "target_leads")


@query("SELECT * FROM (" + SQL[_WHOLE[0]] + ") q0 " + " ".join(f"JOIN ({SQL[n]}) q{i} USING (member, day)" for i, n in enumerate(_WHOLE[1:], 1)))
def attendance_feature_set(spark, d):
    """The attendance features in one projection: one exchange by member, and as many windows as there are frames."""
    ns, sick, w = F.col("noshow"), F.col("sick") == 1, F.col("worked")
    six = lambda cols, places=6: {k: F.round(v, places) for k, v in cols.items()}
    c = six(X.work_rates()) | six(X.on_worked_days(_M, (7, 30), "avg"), 7) | six(X.on_worked_days(_M, (7, 30), "std"), 5)
    c |= X.trailing_counts({k: F.expr(v) for k, v in _FLAGS.items()}, (7, 30, 90)) | X.year_to_date("sickDaysThisYear", sick) | X.year_to_date("noShowsThisYear", ns == 1)
    weekdays = {f"day{k}": F.col("dow") == k for k in range(1, 8)}
    c |= six(X.history_rates("sickRate", sick, weekdays) | X.history_rates("noShowRate", ns == 1, weekdays | {f"month{k}": F.col("month") == k for k in range(1, 13)}))
    c |= six(X.trailing_ratio("noShowRate_30d", ns == 1, w | (ns != 0), 30) | X.trailing_ratio("noShowRate_90d", ns == 1, w | (ns != 0), 90))
    c |= six(X.trailing_ratio("sickBeforeWeekendRate_30d", sick & (F.col("dow") == 6), F.col("dow") == 6, 30) | X.trailing_ratio("sickAfterWeekendRate_30d", sick & (F.col("dow") == 2), F.col("dow") == 2, 30))
    c |= X.coming_sum("holidaysNext7Days", F.col("holiday") == 1, 7) | X.coming_sum("holidaysNext14Days", F.col("holiday") == 1, 14) | X.lag_columns(_LAGGED) | X.target_leads("noshow", range(1, 8))
    return attendance_days(spark, d).select(*KEY, *[v.alias(k) for k, v in c.items()])
