"""Profiles, job history, schedules and other relational kernels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwright.functions.ids import canonical_id, canonical_id_sql
from panelwright.operators.assembly import assemble_days
from panelwright.operators.clocking import hours_between
from panelwright.operators.dedupe import latest_per_key, top_k_per_group
from panelwright.operators.groups import trailing_group_stats
from panelwright.operators.impute import categorise_days, group_first_fill, infer_shifts, neighbour_repair
from panelwright.operators.joins import asof_join
from panelwright.operators.profile import profile, profile_all
from panelwright.operators.requests import request_metrics
from panelwright.plans.clocking import shifts
from panelwright.plans.panel import FACTS, KEY, attendance_days, facts_days
from panelwright.plans.panel import ATTENDANCE as ATT
from panelwright.sources.tables import table, values, write_tables

QUERIES, SQL = {}, {}
_ID = canonical_id_sql("maskedMatchId")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _profile_sql(t: str, columns: dict[str, str]) -> str:
    """columns: name -> i(nteger), d(ouble), s(tring) or t(ime)."""
    parts = []
    for c, k in columns.items():
        number = k in "id"
        x = f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE CAST({c} AS DOUBLE) END" if number else "CAST(NULL AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS column_name, count(*) AS total_rows, count({c}) AS non_null, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS distinct_count, round(avg({x}), 4) AS mean_value, round(stddev_samp({x}), 4) AS std_value,
            min({x}) AS min_value, max({x}) AS max_value, CAST({'sum(CASE WHEN ' + x + ' < q1 - 1.5 * (q3 - q1) OR ' + x + ' > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END)' if number else 'NULL'} AS BIGINT) AS outlier_count, {f'round(avg(length({c})), 2)' if k == 's' else 'CAST(NULL AS DOUBLE)'} AS avg_length
            FROM {t}, (SELECT quantile_disc({x}, 0.25) AS q1, quantile_disc({x}, 0.75) AS q3 FROM {t})""")
    # The text of a number or a time is written differently by the engines, so only texts and whole numbers are compared.
    modes = " UNION ALL ".join(f"(SELECT '{c}' AS column_name, count(*) AS mode_count, {f'substr(CAST({c} AS VARCHAR), 1, 50)' if k in 'is' else 'CAST(NULL AS VARCHAR)'} AS mode_value FROM {t} GROUP BY {c} ORDER BY count(*) DESC, {c} IS NOT NULL, CAST({c} AS VARCHAR) LIMIT 1)" for c, k in columns.items())
    kinds = {"i": "bigint", "d": "double", "s": "string"}
    types = "CASE column_name " + " ".join(f"WHEN '{c}' THEN '{kinds[k]}'" for c, k in columns.items() if k != "t") + " END"
    return f"""SELECT column_name, total_rows, non_null, total_rows - non_null AS null_count, round(100.0 * (total_rows - non_null) / total_rows, 2) AS null_pct, CAST(distinct_count AS BIGINT) AS distinct_count, round(100.0 * distinct_count / total_rows, 2) AS distinct_pct,
        CASE WHEN round(100.0 * distinct_count / total_rows, 2) >= 95 THEN 'VERY_HIGH' WHEN round(100.0 * distinct_count / total_rows, 2) >= 80 THEN 'HIGH' WHEN round(100.0 * distinct_count / total_rows, 2) >= 50 THEN 'MEDIUM' WHEN round(100.0 * distinct_count / total_rows, 2) >= 10 THEN 'LOW' ELSE 'VERY_LOW' END AS cardinality,
        min_value, max_value, mean_value, std_value, outlier_count, round(100.0 * outlier_count / total_rows, 2) AS outlier_pct, avg_length, mode_count, mode_value, CAST({len(columns)} AS INT) AS total_columns, {types} AS data_type,
        CASE WHEN coalesce(outlier_count, 0) > 0 THEN 'Yes' ELSE 'No' END AS has_outliers, CASE WHEN round(100.0 * distinct_count / total_rows, 2) > 80 THEN 'Yes' ELSE 'No' END AS high_cardinality, CASE WHEN total_rows > non_null THEN 'Yes' ELSE 'No' END AS has_nulls, CASE WHEN distinct_count = total_rows THEN 'Yes' ELSE 'No' END AS potential_unique_key
        FROM ({' UNION ALL '.join(parts)}) JOIN ({modes}) USING (column_name)"""


_PROFILED = [
    "column_name", "total_rows", "non_null", "null_count", "null_pct", "distinct_count", "distinct_pct", "cardinality", "min_value", "max_value", "mean_value", "std_value", "outlier_count", "outlier_pct", "avg_length",
    "mode_count", "total_columns", "has_nulls", "has_outliers", "high_cardinality", "potential_unique_key",
]


def _profiled(df):
    named = F.col("data_type").isin("int", "bigint", "double", "string")
    return df.select(*_PROFILED, F.when(F.col("data_type").isin("int", "bigint", "string"), F.col("mode_value")).alias("mode_value"), F.when(named, F.regexp_replace("data_type", "^int$", "bigint")).alias("data_type"))


@query(_profile_sql("events", {"event_id": "i", "ts": "t", "user_id": "i", "event_type": "s", "value": "d", "props": "s"}))
def profile_events(spark, d):
    return _profiled(profile(table(spark, d, "events"), "events"))


@query(_profile_sql("jobs", {"maskedMatchId": "s", "company": "s", "locationId": "s", "department": "s", "standardDailyHours": "d", "standardWeeklyHours": "d", "effectiveDate": "t", "managersMatchValue": "s", "payType": "s", "hrStatus": "s", "employmentType": "s", "accrualStartDate": "t"}))
def profile_jobs(spark, d):
    return _profiled(profile(table(spark, d, "jobs"), "jobs"))


@query()
def profile_datasets(spark, d):
    return profile_all(spark, {t: table(spark, d, t) for t in ("jobs", "shift", "swipe", "attendance", "facts", "cv", "member_alias", "org_units")})


@query(f"WITH {FACTS} SELECT member, day, max(fnoshow) AS noShow, max(fsick) AS sick, max(unpaid) AS unpaid, max(vac) AS vacation FROM (SELECT {_ID} AS member, CAST(date AS DATE) AS day, noShow AS fnoshow, isSickTime AS fsick, isUnpaidTime AS unpaid, isVacationTime AS vac FROM facts) GROUP BY member, day")
def exception_rollup_max(spark, d):
    f = table(spark, d, "facts").select(canonical_id("maskedMatchId").alias("member"), F.col("date").alias("day"), "noShow", F.col("isSickTime").alias("sick"), F.col("isUnpaidTime").alias("unpaid"), F.col("isVacationTime").alias("vacation"))
    return f.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in ("noShow", "sick", "unpaid", "vacation")])


_SWIPE_DAYS = f"SELECT {_ID} AS member, min(CAST(swipeTimestampLocal AS DATE)) AS first_day FROM swipe WHERE type = 'SWIPE_IN' GROUP BY 1"


def _first_swipes(spark, d):
    return table(spark, d, "swipe").where("type = 'SWIPE_IN'").groupBy(canonical_id("maskedMatchId").alias("member")).agg(F.min(F.to_date("swipeTimestampLocal")).alias("first_day"))


@query(_SWIPE_DAYS)
def first_event_min(spark, d):
    return _first_swipes(spark, d)


_JOB_ORDER = "hrStatus, company, locationId, department, managersMatchValue, payType, employmentType, standardDailyHours, standardWeeklyHours, accrualStartDate"
_JOBS = f"""jb AS (SELECT DISTINCT {_ID} AS member, effectiveDate AS eff, locationId, department, managersMatchValue, payType, hrStatus, employmentType FROM jobs WHERE effectiveDate IS NOT NULL),
j1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member, eff ORDER BY hrStatus DESC NULLS LAST, department DESC NULLS LAST, locationId DESC NULLS LAST, managersMatchValue DESC NULLS LAST, payType DESC NULLS LAST, employmentType DESC NULLS LAST) AS rn FROM jb) WHERE rn = 1)"""


def _jobs(spark, d):
    cols = ["locationId", "department", "managersMatchValue", "payType", "hrStatus", "employmentType"]
    j = table(spark, d, "jobs").where("effectiveDate is not null").select(canonical_id("maskedMatchId").alias("member"), F.col("effectiveDate").alias("eff"), *cols)
    return latest_per_key(j, ["member", "eff"], ["hrStatus", "department", "locationId", "managersMatchValue", "payType", "employmentType"])


@query(f"""WITH {_JOBS}, {ATT}, b AS (SELECT att.member, att.day, j1.eff, j1.hrStatus, j1.department, j1.locationId, j1.payType FROM att ASOF LEFT JOIN j1 ON att.member = j1.member AND att.day >= j1.eff),
    f AS (SELECT member, min_by(eff, eff) AS eff, min_by(coalesce(hrStatus, chr(1)), eff) AS hrStatus, min_by(coalesce(department, chr(1)), eff) AS department, min_by(coalesce(locationId, chr(1)), eff) AS locationId, min_by(coalesce(payType, chr(1)), eff) AS payType FROM j1 GROUP BY member)
    SELECT b.member, b.day, coalesce(b.eff, f.eff) AS eff, CASE WHEN b.eff IS NOT NULL THEN b.hrStatus ELSE nullif(f.hrStatus, chr(1)) END AS hrStatus, CASE WHEN b.eff IS NOT NULL THEN b.department ELSE nullif(f.department, chr(1)) END AS department,
    CASE WHEN b.eff IS NOT NULL THEN b.locationId ELSE nullif(f.locationId, chr(1)) END AS locationId, CASE WHEN b.eff IS NOT NULL THEN b.payType ELSE nullif(f.payType, chr(1)) END AS payType FROM b LEFT JOIN f USING (member)""")
def asof_job_history(spark, d):
    days = attendance_days(spark, d).select(*KEY)
    return asof_join(days, _jobs(spark, d), ["member"], "day", "eff", ["eff", "hrStatus", "department", "locationId", "payType"], forward_fallback=True)


_AS_OF = SQL["asof_job_history"]


@query("SELECT member, day, department, locationId, hrStatus FROM (" + _AS_OF.replace("b AS (SELECT att.member", "b AS (SELECT j1.employmentType, att.member").replace("AS hrStatus, min_by", "AS hrStatus, min_by(coalesce(employmentType, chr(1)), eff) AS employmentType, min_by", 1).replace("SELECT b.member, b.day,", "SELECT b.member, b.day, CASE WHEN b.eff IS NOT NULL THEN b.employmentType ELSE f.employmentType END AS employmentType,") + ") WHERE payType = 'H' AND employmentType = 'MEMBER-US'")
def asof_hourly_members(spark, d):
    """Job history as of each day, of members paid by the hour and employed in the country only."""
    columns = ["eff", "hrStatus", "department", "locationId", "payType", "employmentType"]
    found = asof_join(attendance_days(spark, d).select(*KEY), _jobs(spark, d), ["member"], "day", "eff", columns, forward_fallback=True)
    return found.where("payType = 'H' and employmentType = 'MEMBER-US'").select(*KEY, "department", "locationId", "hrStatus")


@query(f"""WITH {_JOBS}, {ATT}, s AS ({_SWIPE_DAYS}), l AS (SELECT member, max(eff) AS last_eff, max_by(coalesce(hrStatus, '-'), eff) AS st FROM j1 GROUP BY member)
    SELECT att.member, day FROM att JOIN s ON s.member = att.member JOIN l ON l.member = att.member WHERE day >= first_day AND (st <> 'T' OR day <= last_eff)""")
def employment_bounded_timeline(spark, d):
    last = _jobs(spark, d).groupBy("member").agg(F.max("eff").alias("last_eff"), F.max_by(F.coalesce("hrStatus", F.lit("-")), "eff").alias("st"))
    days = attendance_days(spark, d).select(*KEY).join(_first_swipes(spark, d), "member").join(last, "member")
    return days.where((F.col("day") >= F.col("first_day")) & ((F.col("st") != "T") | (F.col("day") <= F.col("last_eff")))).select(*KEY)


@query(f"SELECT member, day, row_id, noShow FROM (SELECT {_ID} AS member, CAST(date AS DATE) AS day, row_id, noShow, row_number() OVER (PARTITION BY {_ID}, date ORDER BY loadedAt DESC NULLS LAST, row_id DESC) AS rn FROM attendance) WHERE rn = 1")
def dedupe_latest(spark, d):
    a = table(spark, d, "attendance").select(canonical_id("maskedMatchId").alias("member"), F.col("date").alias("day"), "row_id", "noShow", "loadedAt")
    return latest_per_key(a, KEY, ["loadedAt", "row_id"]).select(*KEY, "row_id", "noShow")


@query("SELECT o_orderkey, o_custkey, o_totalprice, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_orders_per_customer(spark, d):
    return top_k_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_orderkey", "o_custkey", "o_totalprice", "rank")


@query("SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)), 2) AS day_total, CAST(date_diff('day', min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey), CAST(o_orderdate AS DATE)) + 1 AS INT) AS dayInGroup FROM orders")
def group_total_over_partition(spark, d):
    from pyspark.sql import Window

    day = F.to_date("o_orderdate")
    o = table(spark, d, "orders").withColumn("day", day)
    first = F.min("day").over(Window.partitionBy("o_custkey"))
    return o.select("o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(Window.partitionBy("o_custkey", "day")), 2).alias("day_total"), (F.datediff("day", first) + 1).alias("dayInGroup"))


@query(f"""WITH s AS (SELECT shift_id, {_ID} AS member, startAtTimestampLocal AS st, (epoch(endAtTimestampLocal) - epoch(startAtTimestampLocal)) / 3600.0 AS h FROM shift WHERE startAtTimestampLocal IS NOT NULL),
    n AS (SELECT *, lag(h, 1) OVER w AS p1, lead(h, 1) OVER w AS n1, lag(h, 2) OVER w AS p2, lead(h, 2) OVER w AS n2 FROM s WINDOW w AS (PARTITION BY member ORDER BY st, shift_id))
    SELECT shift_id, round(CASE WHEN h < 2 OR h > 16 THEN coalesce((p1 + n1) / 2, p1, n1, (p2 + n2) / 2, p2, n2, 8.5) ELSE h END, 6) AS hours FROM n""")
def neighbour_repair_hours(spark, d):
    s = shifts(spark, d).where("start is not null").withColumn("h", hours_between(F.col("start"), F.col("end")))
    fixed = neighbour_repair(s, ["member"], F.to_date("start"), ["start", "shift_id"], "h", 2, 16, 8.5, "hours")
    return fixed.select("shift_id", F.round("hours", 6).alias("hours"))


_RAW = f"""raw AS (SELECT row_id, {_ID} AS member, CAST(date AS DATE) AS day, isVacationTime AS vac, isUnpaidTime AS unpaid, noShow AS noshow, isSickTime AS sick, CASE WHEN NOT isnan(shiftDurationHrs) AND shiftDurationHrs > 0 AND shiftDurationHrs <= 24 THEN shiftDurationHrs END AS dur,
    CASE WHEN lower(trim(shift)) IN ('first', 'second', 'third') THEN upper(left(trim(shift), 1)) || lower(substr(trim(shift), 2)) END AS shift, nullif(upper(trim(department)), '') AS dept, nullif(upper(trim(locationId)), '') AS loc, managersMatchValue AS mgr FROM facts)"""


def _raw(spark, d):
    up = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    hours, shift = F.col("shiftDurationHrs"), F.initcap(F.trim("shift"))
    return table(spark, d, "facts").select(
        "row_id", canonical_id("maskedMatchId").alias("member"), F.col("date").alias("day"), F.col("isVacationTime").alias("vac"), F.col("isUnpaidTime").alias("unpaid"), F.col("noShow").alias("noshow"), F.col("isSickTime").alias("sick"),
        F.when((hours > 0) & (hours <= 24), hours).alias("dur"), F.when(shift.isin("First", "Second", "Third"), shift).alias("shift"), up("department").alias("dept"), up("locationId").alias("loc"), F.col("managersMatchValue").alias("mgr"),
    )


def _categories(spark, d):
    real = table(spark, d, "shift").select(canonical_id("maskedMatchId").alias("member"), F.to_date("startAtTimestampLocal").alias("day"))
    ins = table(spark, d, "swipe").where("type = 'SWIPE_IN'").select(canonical_id("maskedMatchId").alias("member"), F.col("swipeDate").alias("day"), F.col("swipeTimestampLocal").alias("at"))
    return categorise_days(_raw(spark, d), real, ins)


_CATEGORIES = f"""WITH {_RAW}, rd AS (SELECT DISTINCT {_ID} AS member, CAST(startAtTimestampLocal AS DATE) AS day FROM shift), fs AS (SELECT {_ID} AS member, CAST(swipeDate AS DATE) AS day, min(swipeTimestampLocal) AS sw FROM swipe WHERE type = 'SWIPE_IN' GROUP BY 1, 2),
    k AS (SELECT raw.*, sw, CASE WHEN rd.member IS NOT NULL THEN 'real_shift' WHEN vac = 1 OR unpaid = 1 THEN 'planned_absence'
        WHEN vac IS NOT NULL AND unpaid IS NOT NULL AND (coalesce(noshow, 0) = 1 OR coalesce(sick, 0) = 1 OR shift IS NOT NULL OR sw IS NOT NULL) THEN 'expected_work' ELSE 'other_days' END AS category
        FROM raw LEFT JOIN rd ON raw.member = rd.member AND raw.day = rd.day LEFT JOIN fs ON raw.member = fs.member AND raw.day = fs.day),
    c AS (SELECT *, CASE WHEN category <> 'expected_work' THEN NULL WHEN shift IS NOT NULL AND dur IS NOT NULL THEN 'complete' WHEN sw IS NOT NULL THEN 'needs_filling' ELSE 'incomplete' END AS work FROM k)"""


@query(_CATEGORIES + " SELECT category, work, count(*) AS n FROM c GROUP BY 1, 2")
def day_categorise(spark, d):
    return _categories(spark, d).groupBy("category", "work").agg(F.count(F.lit(1)).alias("n"))


@query(_CATEGORIES + """, u AS (SELECT *, CASE WHEN work = 'needs_filling' THEN coalesce(shift, CASE WHEN hour(sw) <= 9 THEN 'First' WHEN hour(sw) <= 17 THEN 'Second' ELSE 'Third' END) ELSE shift END AS us FROM c),
    a AS (SELECT dept, loc, shift, day, avg(dur) AS m FROM raw WHERE dur IS NOT NULL GROUP BY ALL), b AS (SELECT loc, shift, day, avg(dur) AS m FROM raw WHERE dur IS NOT NULL GROUP BY ALL)
    SELECT row_id, category, CASE WHEN category <> 'planned_absence' THEN us END AS shift, round(CASE WHEN category = 'planned_absence' THEN NULL WHEN work = 'needs_filling' THEN coalesce(dur, a.m, b.m, 8.5) ELSE dur END, 10) AS hours
    FROM u LEFT JOIN a ON u.dept = a.dept AND u.loc = a.loc AND u.us = a.shift AND u.day = a.day LEFT JOIN b ON u.loc = b.loc AND u.us = b.shift AND u.day = b.day""")
def hierarchical_avg_fill(spark, d):
    from panelwright.operators.clocking import shift_of_hour

    out = infer_shifts(_categories(spark, d), shift_of_hour(F.col("firstSwipe")))
    return out.select("row_id", "category", "shift", F.round("hours", 10).alias("hours"))


@query(f"WITH {_RAW}, g AS (SELECT day, loc, dept, min(mgr) AS m FROM raw WHERE mgr IS NOT NULL GROUP BY ALL) SELECT row_id, coalesce(mgr, g.m, 'EMPTY') AS manager FROM raw LEFT JOIN g ON raw.day = g.day AND raw.loc = g.loc AND raw.dept = g.dept")
def group_first_fill_manager(spark, d):
    return group_first_fill(_raw(spark, d), "mgr", ["day", "loc", "dept"], "EMPTY", "manager").select("row_id", "manager")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, last_order FROM (SELECT l.*, o2.o_orderkey AS last_order FROM (SELECT l.*, CAST(l_shipdate AS DATE) AS ship, o.o_custkey AS cust FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey) l ASOF LEFT JOIN (SELECT o_custkey, CAST(o_orderdate AS DATE) AS od, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o2 ON l.cust = o2.o_custkey AND l.ship >= o2.od)")
def asof_last_order(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("od"), F.col("o_orderkey").alias("last_order"))
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    owner = o.select(F.col("last_order").alias("l_orderkey"), "cust")
    lines = table(spark, d, "lineitem").select(*cols, F.to_date("l_shipdate").alias("ship")).join(owner, "l_orderkey")
    return asof_join(lines, o, ["cust"], "ship", "od", ["last_order"], tie=["last_order"]).select(*cols, "last_order")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, round(stddev_samp(l_discount), 6) AS std_disc, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY ALL")
def group_aggregates(spark, d):
    q, p, x = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum(q), 2).alias("sum_qty"), F.round(F.sum(p), 2).alias("sum_base"), F.round(F.sum(p * (1 - x)), 2).alias("sum_disc"), F.round(F.avg(q), 6).alias("avg_qty"), F.round(F.stddev(x), 6).alias("std_disc"),
        F.countDistinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("n"),
    )


@query("SELECT event_type, quantile_disc(value, 0.25) AS q1, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.75) AS q3 FROM events GROUP BY event_type")
def exact_quantiles(spark, d):
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)")
    return table(spark, d, "events").groupBy("event_type").agg(disc(0.25).alias("q1"), disc(0.5).alias("median"), disc(0.75).alias("q3"))


@query()
def approx_quantile(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.percentile_approx("value", [0.25, 0.5, 0.75]).alias("quartiles"))


@query()
def approx_distinct_window(spark, d):
    from panelwright.operators.frames import trailing_days

    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("day"), "user_id")
    return e.select("event_type", "day", F.approx_count_distinct("user_id").over(trailing_days(["event_type"], "day", 7)).alias("users_7d")).distinct()


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def daily_totals(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("WITH e AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events) SELECT user_id, day, bool_or(event_type = 'signup') AS signed, bool_or(event_type = 'error') AS failed FROM e WHERE event_type IN ('signup', 'error', 'click') GROUP BY 1, 2")
def key_spine_union(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    of = lambda t: e.where(F.col("event_type") == t).select("user_id", "day")
    spine = of("signup").union(of("error")).union(of("click")).distinct()
    mark = lambda t, n: of(t).distinct().withColumn(n, F.lit(True))
    out = spine.join(mark("signup", "signed"), ["user_id", "day"], "left").join(mark("error", "failed"), ["user_id", "day"], "left")
    return out.fillna(False, ["signed", "failed"])


@query("SELECT u.user_id FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') u WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = 'error' AND e.value > 95)")
def semi_and_anti(spark, d):
    e = table(spark, d, "events")
    buyers = e.select("user_id").distinct().join(e.where("event_type = 'purchase'"), "user_id", "left_semi")
    return buyers.join(e.where("event_type = 'error' and value > 95"), "user_id", "left_anti")


@query("SELECT * FROM (VALUES ('First', 3, 15), ('Second', 12, 24), ('Third', 20, 32)) t(shift, from_hour, to_hour)")
def literal_relation(spark, d):
    from panelwright.operators.clocking import SHIFT_HOURS

    return values(spark, [(k, *v) for k, v in SHIFT_HOURS.items()], "shift string, from_hour int, to_hour int")


@query("SELECT 'nation' AS name, count(*) AS n, CAST(sum(n_regionkey) AS BIGINT) AS total FROM nation UNION ALL SELECT 'region', count(*), CAST(sum(r_regionkey) AS BIGINT) FROM region")
def sink_roundtrip(spark, d):
    """Two tables through the sink of named tables and back, in the folder of intermediate results."""
    from panelwright.session import folder_of

    where = f"{folder_of(spark)}/sink_roundtrip_{spark.sparkContext.applicationId}"
    write_tables({name: table(spark, d, name) for name in ("nation", "region")}, where)
    back = lambda name, c: table(spark, where, name).select(F.lit(name).alias("name"), F.col(c).alias("k"))
    both = back("nation", "n_regionkey").unionByName(back("region", "r_regionkey"))
    return both.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("k").cast("long").alias("total"))


@query("SELECT CAST(range AS BIGINT) AS percentile FROM range(0, 101)")
def series_generator(spark, d):
    return spark.range(0, 101).toDF("percentile")


@query("WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, value FROM events) SELECT DISTINCT user_id, day, count(*) OVER w AS rows_7d, round(coalesce(sum(value) OVER w, 0), 6) AS value_sum_7d, round(avg(value) OVER w, 10) AS value_avg_7d FROM e WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)")
def rolling_7d_range(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "value")
    s = trailing_group_stats(e, ["user_id"], "day", {"value": F.col("value")}, (7,))
    return s.select("user_id", "day", "rows_7d", F.round("value_sum_7d", 6).alias("value_sum_7d"), F.round("value_avg_7d", 10).alias("value_avg_7d"))


_LINES = """r AS (SELECT o_custkey AS member, CAST(l_shipdate AS DATE) AS day, CAST(o_orderdate AS DATE) AS made, min(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_orderkey) AS st, max(CAST(l_shipdate AS DATE)) OVER (PARTITION BY l_orderkey) AS en,
    l_quantity AS qty, l_returnflag AS code, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {_LINES}, m AS (SELECT *, sum(qty) OVER (PARTITION BY member, made) AS total FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY member, day ORDER BY made DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM m)
    SELECT member, day, CAST(st - made AS INT) AS firstDayDelta, CAST(en - st + 1 AS INT) AS totalDays, CAST(day - st + 1 AS INT) AS dayInGroup, total AS totalHours, CASE WHEN code = 'R' THEN 1 ELSE 0 END AS isSick, CASE WHEN code = 'A' THEN 1 ELSE 0 END AS isVacation FROM k WHERE rn = 1""")
def time_off_metrics(spark, d):
    """Orders stand in for requests: made at the order, for the days of its shipments."""
    from pyspark.sql import Window

    ties = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = table(spark, d, "lineitem").select(*ties, F.to_date("l_shipdate").alias("day"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("code"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("member"), F.to_date("o_orderdate").alias("made"))
    w = Window.partitionBy("l_orderkey")
    rows = lines.join(orders, "l_orderkey").withColumns({"st": F.min("day").over(w), "en": F.max("day").over(w)})
    out = request_metrics(rows, "member", "day", "made", "st", "en", "qty", "code", {"isSick": "R", "isVacation": "A"}, ties)
    return out.select("member", "day", "firstDayDelta", "totalDays", "dayInGroup", "totalHours", "isSick", "isVacation")


@query(f"""WITH {ATT}, {FACTS}, s AS (SELECT member, workDate AS day, min(st) AS start_at FROM (SELECT {_ID} AS member, workDate, startAtTimestampLocal AS st FROM shift WHERE workDate IS NOT NULL AND endAtTimestampLocal > startAtTimestampLocal) GROUP BY 1, 2)
    SELECT att.member, att.day, att.worked, att.noshow, fct.dept, fct.loc, fct.vac, strftime(s.start_at, '%Y-%m-%d %H:%M:%S') AS start_at FROM att LEFT JOIN fct ON att.member = fct.member AND att.day = fct.day LEFT JOIN s ON att.member = s.member AND att.day = s.day""")
def assemble_facts(spark, d):
    from panelwright.plans.clocking import real_schedule

    real = real_schedule(spark, d).select("member", F.col("workDate").alias("day"), F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start_at"))
    days = attendance_days(spark, d).select(*KEY, "worked", "noshow")
    return assemble_days(days, {"facts": facts_days(spark, d).select(*KEY, "dept", "loc", "vac"), "schedule": real}, KEY)


@query("SELECT user_id, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    """The streaming kernel on a table, as a batch."""
    from panelwright.streaming.windows import tumbling_totals

    out = tumbling_totals(table(spark, d, "events"), "ts", "6 hours", ["user_id"], {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 6)})
    return out.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 21600000000 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n_events FROM k GROUP BY user_id, s""")
def session_windows(spark, d):
    from panelwright.streaming.windows import sessions

    out = sessions(table(spark, d, "events"), "ts", "6 hours", ["user_id"])
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n_events")
