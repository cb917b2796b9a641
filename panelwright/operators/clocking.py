"""From clock events and a schedule to one row per member and work day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.operators.dedupe import latest_per_key
from panelwright.operators.frames import ratio, trailing_rows
from panelwright.operators.joins import asof_join, interval_nearest_join, pair_sequences
from panelwright.session import materialise

KEY = ["member", "workDate"]
SHIFT_STARTS = {"First": 5, "Second": 14, "Third": 21}  # nominal hours
SHIFT_HOURS = {"First": (3, 15), "Second": (12, 24), "Third": (20, 32)}  # widest start and end, from midnight of the work day
# The weight of each kind of anomaly.
SEVERITY = {
    "extreme_long_shift": 5, "missing_clockout": 4, "missing_clockin": 4, "meal_without_full_shift": 3, "no_meal_break_full_day": 2,
    "excessive_meal_break": 2, "very_short_shift": 2, "incomplete_meal_break": 1, "normal": 0,
}


def hours(n: float) -> Column:
    return F.make_dt_interval(hours=F.lit(0), mins=F.lit(int(n * 60)))


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))) / 3600.0


def _moment(us: str) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def event_code(kind: str = "type", pay: str = "payCode") -> Column:
    """1 clock-in, 2 meal-in, 3 meal-out, 4 clock-out, 0 anything else, nulls too."""
    clock, brk = F.col(pay) == "CLOCK", F.col(pay) == "BREAK"
    t = F.col(kind)
    return F.when(clock & (t == "SWIPE_IN"), 1).when(brk & (t == "TRANSFER_PAY"), 2).when(clock & (t == "TRANSFER_PAY"), 3).when(clock & (t == "SWIPE_OUT"), 4).otherwise(0)


def shift_of_hour(at: Column) -> Column:
    """The shift whose nominal start hour is nearest on the clock face from 0 to 23; ties to the earlier shift."""
    names = sorted(SHIFT_STARTS, key=SHIFT_STARTS.get)
    h, out = F.hour(at), F.lit(names[-1])
    for a, b in list(zip(names, names[1:]))[::-1]:
        out = F.when(h * 2 <= SHIFT_STARTS[a] + SHIFT_STARTS[b], a).otherwise(out)
    return F.when(h.isNotNull(), out)


def synthetic_schedule(panel: DataFrame, shift: str = "shift") -> DataFrame:
    """``member, workDate, start, end`` from the shift a day was given; whole hours are added to midnight, so shifts
    that end at 24:00 or on the next day, or month, are as any other."""
    day = F.col("workDate").cast("timestamp_ntz")
    pick = lambda i: F.coalesce(*[F.when(F.col(shift) == n, F.lit(h[i])) for n, h in SHIFT_HOURS.items()])
    rows = panel.select(*KEY, shift).distinct().withColumns({"_from": pick(0), "_to": pick(1)}).where("_from is not null")
    return rows.select(*KEY, (day + F.make_dt_interval(hours=F.col("_from"))).alias("start"), (day + F.make_dt_interval(hours=F.col("_to"))).alias("end"))


def one_shift_a_day(schedule: DataFrame) -> DataFrame:
    """Of several usable shifts of a day the earliest, then the smallest id; ``member, workDate, start, end``."""
    usable = schedule.where("member is not null and workDate is not null and end > start")
    first = F.min_by(F.struct("start", "end"), F.struct("start", "shift_id")).alias("s")
    return usable.groupBy(*KEY).agg(first).select(*KEY, "s.start", "s.end")


def match_to_shifts(events: DataFrame, schedule: DataFrame) -> DataFrame:
    """``events`` (event_id, member, at, code: 1 clock-in, 4 clock-out) with ``workDate`` and ``matched``: clock-ins go to the
    shift whose start is nearest, from 18 hours before to 6 hours after it; clock-outs to the shift whose end is nearest,
    from its start to 12 hours after its end; what fits no shift to its own date, or the day before if it is before 6
    o'clock.  Both are one pass: a member's clock-ins and clock-outs are two entities with intervals of their own."""
    of = lambda code: F.concat(code.cast("string"), F.lit("|"), F.col("member"))
    ways = [(1, F.col("start") - hours(18), F.col("start") + hours(6), F.col("start")), (4, F.col("start"), F.col("end") + hours(12), F.col("end"))]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), lo.alias("lo"), hi.alias("hi"), anchor.alias("anchor")) for c, lo, hi, anchor in ways])).alias("w")
    shifts = schedule.select("member", F.unix_date("workDate").alias("_id"), each).select(of(F.col("w.code")).alias("who"), "_id", "w.lo", "w.hi", "w.anchor")
    points = events.select("event_id", of(F.col("code")).alias("who"), "at")
    joined = interval_nearest_join(points, "event_id", "who", "at", shifts, "_id", F.col("lo"), F.col("hi"), F.col("anchor")).withColumn("at", _moment("at"))
    own = F.date_sub(F.to_date("at"), F.when(F.hour("at") < 6, 1).otherwise(0))
    day = F.coalesce(F.date_from_unix_date(F.col("_id").cast("int")), own)
    code, member = F.substring("who", 1, 1).cast("int"), F.expr("substring(who, 3)")
    return joined.select("event_id", member.alias("member"), "at", code.alias("code"), day.alias("workDate"), F.col("_id").isNotNull().alias("matched"))


def clock_pairs(matched: DataFrame) -> DataFrame:
    """First clock-in and last clock-out of every member and work day that has either (a full outer join as one
    aggregate)."""
    of = lambda code: F.when(F.col("code") == code, F.col("at"))
    rows = matched.where("member is not null and workDate is not null")
    return rows.groupBy(*KEY).agg(F.min(of(1)).alias("clockIn"), F.max(of(4)).alias("clockOut"))


def attach_meals(meals: DataFrame, pairs: DataFrame) -> DataFrame:
    """``event_id, member, workDate, at``: each meal event goes to the day whose clock pair holds it, and of several to the one
    clocked in last before the meal.  A pair without clock-out reaches 16 hours from its clock-in.  A pair without
    clock-in has no lower bound and comes after all others: such a meal goes to the pair clocked out first after it."""
    full = pairs.where("clockIn is not null").withColumns({"_hi": F.coalesce(F.col("clockOut"), F.col("clockIn") + hours(16)), "_id": F.unix_date("workDate")})
    found = interval_nearest_join(meals, "event_id", "member", "at", full, "_id", F.col("clockIn"), F.col("_hi"), F.col("clockIn"))
    day = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
    held = found.where("_id is not null").select("event_id", "member", day("_id").alias("workDate"), _moment("at").alias("at"))
    # Backwards in time, the next clock-out is the last one before; of pairs clocked out at once the earlier day.
    rest = found.where("_id is null and member is not null").select("event_id", "member", "at", (-F.col("at")).alias("back"))
    outs = pairs.where("clockIn is null and clockOut is not null").select("member", (-F.unix_micros(F.col("clockOut").cast("timestamp"))).alias("_u"), F.unix_date("workDate").alias("_day"), (-F.unix_date("workDate")).alias("_tie"))
    late = asof_join(rest, outs, ["member"], "back", "_u", ["_day"], tie=["_tie"], bucket=64 * 86_400_000_000)
    return held.unionByName(late.where("_day is not null").select("event_id", "member", day("_day").alias("workDate"), _moment("at").alias("at")))


def meal_breaks(meal_ins: DataFrame, meal_outs: DataFrame) -> DataFrame:
    """One row per day with meal events: the first pair 5 to 120 minutes apart, else the first meal-in alone, else
    the first meal-out alone; ``completeness`` 3, 2 or 1."""
    pairs = pair_sequences(meal_ins, meal_outs, KEY, "at", 300, 7200)
    pairs = pairs.select(*KEY, F.col("open_at").alias("mealIn"), F.col("close_at").alias("mealOut"), F.lit(3).alias("completeness"))
    nothing = F.lit(None).cast("timestamp_ntz")
    only_in = meal_ins.groupBy(*KEY).agg(F.min("at").alias("mealIn")).select(*KEY, "mealIn", nothing.alias("mealOut"), F.lit(2).alias("completeness"))
    only_out = meal_outs.groupBy(*KEY).agg(F.min("at").alias("mealOut")).select(*KEY, nothing.alias("mealIn"), "mealOut", F.lit(1).alias("completeness"))
    return latest_per_key(pairs.unionByName(only_in).unionByName(only_out), KEY, ["completeness"])


def day_metrics(days: DataFrame, schedule: DataFrame) -> DataFrame:
    """Durations, anomalies and punctuality of each member and work day (``days``: key, clockIn, clockOut, mealIn,
    mealOut), and their trailing consistency over the last 30 rows."""
    valid_out = F.when(F.col("clockIn").isNull() | (F.col("clockOut") > F.col("clockIn")), F.col("clockOut"))
    days = days.withColumn("clockOut", valid_out)
    cin, cout, min_, mout = F.col("clockIn"), F.col("clockOut"), F.col("mealIn"), F.col("mealOut")
    raw, meal = hours_between(cin, cout), hours_between(min_, mout)
    days = days.withColumns({"_raw": raw, "_meal": meal})
    raw, meal = F.col("_raw"), F.col("_meal")
    has_pair = cin.isNotNull() & cout.isNotNull()
    kind = (
        F.when(has_pair & (raw > 16), "extreme_long_shift").when(cin.isNotNull() & cout.isNull(), "missing_clockout")
        .when(has_pair & (raw > 0) & (raw < 0.25), "very_short_shift").when(meal > 2, "excessive_meal_break").when(cin.isNull() & cout.isNotNull(), "missing_clockin")
        .when((min_.isNotNull() | mout.isNotNull()) & ~has_pair, "meal_without_full_shift").when(min_.isNull() != mout.isNull(), "incomplete_meal_break")
        .when(has_pair & min_.isNull() & mout.isNull() & (raw >= 6), "no_meal_break_full_day").otherwise("normal")
    )
    days = days.withColumn("anomalyType", kind)
    severity = F.coalesce(*[F.when(F.col("anomalyType") == k, F.lit(v)) for k, v in SEVERITY.items()])
    cout = F.when(F.col("anomalyType") != "extreme_long_shift", F.col("clockOut"))
    days = days.withColumns({"anomalySeverity": severity, "clockAnomaly": F.col("anomalyType") != "normal", "clockOut": cout})
    cout = F.col("clockOut")
    length = F.when(cin.isNotNull() & cout.isNotNull(), hours_between(cin, cout)).when(cin.isNotNull(), 8.5).otherwise(0.0)
    days = days.withColumn("dayDuration", length)
    length = F.col("dayDuration")
    no_meal, any_missing = min_.isNull() & mout.isNull(), min_.isNull() | mout.isNull()
    pause = F.when(~any_missing, F.col("_meal")).when(no_meal & (length >= 6), 0.0).when(any_missing & (length >= 5), 0.5).otherwise(0.0)
    days = days.withColumns({"mealDuration": pause, "mealStartDiff": F.when(min_.isNotNull() & cin.isNotNull(), hours_between(cin, min_)).otherwise(0.0)})
    pause = F.col("mealDuration")
    worked = (
        F.when(length == 0, 0.0).when((pause == 0) & (length < 0.25), length).when(pause == 0, F.greatest(length - 0.25, F.lit(0.0)))
        .otherwise(F.greatest(length - 0.25, length - pause, F.lit(0.0)))
    )
    days = days.withColumn("hoursWorked", worked).join(schedule.select(*KEY, F.col("start").alias("_start")), KEY, "left")
    late = lambda a, b: F.greatest(F.coalesce(hours_between(a, b) * 60, F.lit(0.0)), F.lit(0.0))
    minute = lambda c: F.when(c.isNotNull(), F.hour(c) * 60 + F.minute(c)).otherwise(-1)
    days = days.withColumns({
        "lateArrival": late(F.col("_start"), cin), "earlyArrival": late(cin, F.col("_start")), "clockInMinuteOfDay": minute(cin),
        "clockOutMinuteOfDay": minute(cout), "missedClockOut": cin.isNotNull() & cout.isNull(),
    })
    w = trailing_rows(["member"], ["workDate"], 30, include_current=True)
    days = days.withColumns({
        "clockInConsistency": F.coalesce(F.stddev("clockInMinuteOfDay").over(w), F.lit(0.0)),
        "anomalyRate": ratio(F.sum(F.col("clockAnomaly").cast("int")).over(w), F.count(F.lit(1)).over(w)),
    })
    return days.drop("_raw", "_meal", "_start")


def clock_metrics(swipes: DataFrame, schedule: DataFrame) -> dict[str, DataFrame]:
    """The whole way; ``swipes``: event_id, member, at, code; ``schedule``: member, workDate, start, end (one a day)."""
    schedule = materialise(schedule)
    matched = match_to_shifts(swipes.where("code in (1, 4)"), schedule)
    pairs = materialise(clock_pairs(matched))  # read several times below
    # Both meal events go one way; which they are is kept in their id.
    meals = swipes.where("code in (2, 3)").select((F.col("event_id") * 4 + F.col("code")).alias("event_id"), "member", "at")
    attached = materialise(attach_meals(meals, pairs).withColumn("code", F.pmod("event_id", F.lit(4))))
    meal_ins, meal_outs = (attached.where(F.col("code") == code).select(*KEY, "at") for code in (2, 3))
    meals = meal_breaks(meal_ins, meal_outs)
    days = pairs.join(meals.drop("completeness"), KEY, "full_outer")
    return {"schedule": schedule, "matched": matched, "pairs": pairs, "meal_ins": meal_ins, "meal_outs": meal_outs, "meals": meals, "days": day_metrics(days, schedule)}
