"""Filling missing values from similar records.

Method: label propagation on a two-sided graph.  A record is tied to the groups it belongs to (its member, its
unit on that day, the records of like length ...).  In each round every group averages what its records say (a
category distribution or a mean) and every missing cell averages what its groups say, by the weight of the tie.
Observed values are clamped: they are counted once and never change.  Cells that have settled stay as they are and
only the others are averaged again, until none moves.  Ties run through groups, so no pairs of records are ever
made, and a group with a third of all records is summed before it is shuffled.

How far the mean of a group may be trusted is read off the data: from the variance between and within the groups of a
tie follows the number of records of the overall mean that are added to each group.  Where groups differ by no more
than chance, as lengths do that vary from day to day, a fill is the overall mean.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import materialise

HOT_CELLS = 100_000  # a group with more missing cells is hot: its message is copied, and its cells are spread over the copies
FEW = 100_000  # groups of cells not yet settled that are handed to all tasks
MOST_HOT = 1 << 18  # there are fewer hot groups than this, however many cells there are
TIE_BITS = 6  # of a group's key
ALL = (1 << TIE_BITS) - 1  # the tie of all records, for what is said overall


@dataclass(frozen=True)
class Field:
    """A column to fill: its clean value (null where missing) and where a missing value is a case at all."""

    name: str
    observed: Column
    kind: str  # "category" or "number"
    applies: Column | None = None


@dataclass(frozen=True)
class Tie:
    """Records with equal ``by`` (all non-null) are alike as to ``fields``, with this weight."""

    name: str
    by: tuple[Column, ...]
    weight: float
    fields: tuple[str, ...]


def _trust(variances: list, names: Sequence[str], nums: Sequence[str], ties: int) -> tuple[dict[str, list[float]], dict[str, float]]:
    """Per number field: how many records of the overall mean each tie's groups are mixed with (-1: the groups say
    nothing), and the overall mean; by analysis of variance in one direction."""
    trust, mean = {c: [0.0] * (ties + 1) for c in nums}, dict.fromkeys(nums, 0.0)
    for r in variances:
        c, tie = names[r["fid"]], int(r["tie"])
        groups, n, total, squared, means, sizes = (float(r[k] or 0.0) for k in ("groups", "n", "total", "squared", "means", "sizes"))
        if tie == ALL:
            mean[c] = total / n
        elif groups > 1 and n > groups:
            within = max(squared - means, 0.0) / (n - groups)
            between = ((means - total * total / n) / (groups - 1) - within) / ((n - sizes / n) / (groups - 1))
            trust[c][tie] = within / between if between > 1e-12 * within else (-1.0 if within > 0 else 0.0)
    return trust, mean


def propagate_fills(df: DataFrame, key: str, fields: Sequence[Field], ties: Sequence[Tie], tolerance: float = 0.02, rounds: int | None = None) -> DataFrame:
    """One row per missing cell: ``key, field, value`` (category) or ``number``, ``share`` (of the value among what
    the cell's groups say; 1 for numbers), ``method``: ``propagated``, ``overall`` (no tie leads to an observed
    value: most frequent value or mean of the table) or ``none`` (nothing is observed), and ``filled`` (not none).

    A cell has settled when none of its shares (its number, in standard deviations) moved by more than ``tolerance`` in a round; rounds go on until all
    cells that can be reached have settled, or ``rounds`` of them are done.

    ``key`` names a record; records that repeat a key are one record and share its cells.  A cell with null key
    cannot be named and is left out.  Equal shares: the smaller text.  An empty table gives an empty result;
    further columns are not looked at.

    Groups are known by a 58-bit hash of tie and values; should two groups share one, each hears the other too.
    Sent to the driver: one row per number field and tie, and counts.
    """
    names, kinds = [f.name for f in fields], {f.name: f.kind for f in fields}
    fid = {c: i for i, c in enumerate(names)}
    cats, nums = [c for c in names if kinds[c] == "category"], [c for c in names if kinds[c] == "number"]
    if len(ties) >= ALL:
        raise ValueError(f"more than {ALL - 1} ties")
    obs = {f.name: (f.observed.cast("string") if f.kind == "category" else F.when(~F.isnan(f.observed.cast("double")), f.observed.cast("double"))) for f in fields}

    def group_key(i: int, t: Tie) -> Column:
        missing = F.lit(False)
        for c in t.by:
            missing = missing | c.isNull()
        return F.when(~missing, F.shiftleft(F.xxhash64(F.lit(t.name), *t.by), TIE_BITS).bitwiseOR(F.lit(i).cast("long")))

    tie_of = F.col("g").bitwiseAND(F.lit(ALL).cast("long")).cast("int")
    rows = df.select(
        F.col(key).alias("_key"), *[obs[f.name].alias(f"o_{f.name}") for f in fields],
        *[(obs[f.name].isNull() & F.coalesce(F.lit(True) if f.applies is None else f.applies, F.lit(False))).alias(f"m_{f.name}") for f in fields],
        *[group_key(i, t).alias(f"g_{i}") for i, t in enumerate(ties)],
    )

    # What the observed values say, per group: first by whole combinations of what the tie serves, then by field.
    voices = F.posexplode(F.array(*[F.col(f"g_{i}") for i in range(len(ties))], F.lit(ALL).cast("long"))).alias("tie", "g")
    served = {c: [i for i, t in enumerate(ties) if c in t.fields] + [len(ties)] for c in names}
    heeded = lambda c: (F.col(f"o_{c}") if len(served[c]) > len(ties) else F.when(F.col("tie").isin(served[c]), F.col(f"o_{c}"))).alias(f"o_{c}")
    combined = rows.select(voices, *[f"o_{c}" for c in names]).where("g is not null").select("g", *[heeded(c) for c in names]).groupBy("g", *[f"o_{c}" for c in cats])
    sums = [x for c in nums for x in (F.sum(f"o_{c}").alias(f"s_{c}"), F.count(f"o_{c}").alias(f"n_{c}"), F.sum(F.col(f"o_{c}") * F.col(f"o_{c}")).alias(f"q_{c}"))]
    combined = combined.agg(F.count(F.lit(1)).cast("double").alias("n"), *sums)
    zero = F.lit(0.0)
    entry = lambda c, value, mass, total, squared: F.struct(F.lit(fid[c]).alias("fid"), value.alias("value"), mass.alias("mass"), total.alias("total"), squared.alias("squared"))
    says = F.array(
        *[entry(c, F.col(f"o_{c}"), F.when(F.col(f"o_{c}").isNotNull(), F.col("n")), zero, zero) for c in cats],
        *[entry(c, F.lit(""), F.col(f"n_{c}").cast("double"), F.coalesce(F.col(f"s_{c}"), zero), F.coalesce(F.col(f"q_{c}"), zero)) for c in nums],
    )
    spoken = combined.select("g", F.inline(says)).where(F.col("mass") > 0)
    spoken = materialise(spoken.groupBy("g", "fid", "value").agg(*[F.sum(c).alias(c) for c in ("mass", "total", "squared")]))
    variances = spoken.where(F.col("fid").isin([fid[c] for c in nums])).groupBy("fid", tie_of.alias("tie")).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("mass").alias("n"), F.sum("total").alias("total"), F.sum("squared").alias("squared"),
        F.sum(F.col("total") * F.col("total") / F.col("mass")).alias("means"), F.sum(F.col("mass") * F.col("mass")).alias("sizes"),
    ).collect() if nums else []
    trust, mean = _trust(variances, names, nums, len(ties))
    spread = {names[r["fid"]]: max(float(r["squared"]) / float(r["n"]) - mean[names[r["fid"]]] ** 2, 0.0) ** 0.5 for r in variances if r["tie"] == ALL}
    observed = spoken.drop("squared").where(F.col("g") != ALL)

    # The missing cells and their ties.
    lacking = F.lit(False)
    for f in fields:
        lacking = lacking | F.col(f"m_{f.name}")
    records = rows.where(lacking & F.col("_key").isNotNull()).groupBy("_key")
    records = materialise(records.agg(*[F.max(f"m_{c}").alias(f"m_{c}") for c in names], *[F.max(f"g_{i}").alias(f"g_{i}") for i in range(len(ties))]))
    missing = [F.struct(F.lit(fid[c]).alias("fid"), F.col(f"m_{c}").alias("missing")) for c in names]
    cells = records.select("_key", F.inline(F.array(*missing))).where("missing").drop("missing")
    ways = [(c, i, t) for i, t in enumerate(ties) for c in names if c in t.fields]
    if ways:
        each = [F.struct(F.lit(fid[c]).alias("fid"), F.when(F.col(f"m_{c}"), F.col(f"g_{i}")).alias("g"), F.lit(float(t.weight)).alias("w")) for c, i, t in ways]
        tied = materialise(records.select("_key", F.inline(F.array(*each))).where("g is not null"))
    else:
        tied = df.sparkSession.createDataFrame([], cells.schema.add("g", "long").add("w", "double"))
    n_ties = tied.count()
    hot, by = None, ["g", "fid"]  # how ties and messages meet
    if n_ties > HOT_CELLS:
        least = max(HOT_CELLS, n_ties // MOST_HOT + 1)
        sizes = tied.groupBy("g", "fid").agg(F.count(F.lit(1)).alias("cells")).where(F.col("cells") > least)
        hot = materialise(sizes.select("g", "fid", F.ceil(F.col("cells") / F.lit(least)).cast("int").alias("copies")))
        hot = None if hot.isEmpty() else F.broadcast(hot)
    if hot is not None:
        by = [*by, "salt"]
        copies = F.coalesce("copies", F.lit(1))
        tied = tied.join(hot, ["g", "fid"], "left").withColumn("salt", F.pmod(F.xxhash64("_key"), copies).cast("int")).drop("copies")

    def summed(said: DataFrame) -> DataFrame:
        """By group, field and value.  Without hot groups rows go to their group at once, and need not move again."""
        said = said.repartition("g", "fid") if hot is None else said
        return said.groupBy("g", "fid", "value").agg(F.sum("mass").alias("mass"), F.sum("total").alias("total"))

    def tell(some: DataFrame, ties: DataFrame) -> DataFrame:
        return ties.join(some, ["_key", "fid"]).select("g", "fid", "value", F.col("share").alias("mass"), (F.col("share") * F.col("number")).alias("total"))

    is_number = F.col("fid").isin([fid[c] for c in nums])
    of_field = lambda values, other: F.element_at(F.array(*[F.lit(values.get(c, other)) for c in names]), F.col("fid") + 1)
    doubt = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in trust.get(c, [0.0] * (len(ties) + 1))]) for c in names]), F.col("fid") + 1)
    doubt, overall_mean, unit = F.element_at(doubt, tie_of + 1), of_field(mean, 0.0), of_field({c: 1.0 / x for c, x in spread.items() if x > 0}, 1.0)
    mixed = F.when(doubt < 0, overall_mean).otherwise((F.col("total") + doubt * overall_mean) / (F.col("mass") + doubt))

    said, active, before, settled = observed, tied, None, []
    done = 0
    while rounds is None or done < rounds:
        done += 1
        message = said.withColumns({"total": F.when(is_number, F.col("mass") * mixed).otherwise(F.lit(0.0)), "all": F.sum("mass").over(Window.partitionBy("g", "fid"))})
        if hot is not None:
            message = message.join(hot, ["g", "fid"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
        heard = active.join(message, by)
        scale = F.col("w") / F.col("all")
        none = F.lit(None).cast("double")
        heard = heard.select("_key", "fid", "value", (scale * F.col("mass")).alias("q"), (scale * F.col("total")).alias("x"), none.alias("was"), none.alias("was_number"))
        if before is not None:
            heard = heard.unionByName(before.select("_key", "fid", "value", F.lit(0.0).alias("q"), F.lit(0.0).alias("x"), F.col("share").alias("was"), F.col("number").alias("was_number")))
        # A cell hears of few values, so nothing is gained by summing them before they move.
        sums = heard.repartition("_key", "fid").groupBy("_key", "fid", "value").agg(F.sum("q").alias("q"), F.sum("x").alias("x"), F.max("was").alias("was"), F.max("was_number").alias("was_number"))
        cell = Window.partitionBy("_key", "fid")
        whole = F.sum("q").over(cell)
        share, number = F.col("q") / whole, F.col("x") / whole
        move = F.when(is_number, F.abs(number - F.col("was_number")) * unit).otherwise(F.abs(share - F.coalesce("was", F.lit(0.0))))
        moved = F.when(F.max("was").over(cell).isNull(), F.lit(1.0)).otherwise(F.max(move).over(cell))
        now = materialise(sums.select("_key", "fid", "value", share.alias("share"), number.alias("number"), moved.alias("moved")))
        rest = F.col("moved") > tolerance
        settled.append(now.where(~rest))
        before = now.where(rest)
        if (rounds is not None and done == rounds) or before.isEmpty():
            settled.append(before)
            break
        if done > 1:  # settled cells are never asked again; what they say stays with the groups of the others
            rest_of = materialise(active.join(now.where(~rest).select("_key", "fid").distinct(), ["_key", "fid"], "left_anti"))
            groups = rest_of.select("g", "fid").distinct()
            groups = F.broadcast(groups) if rest_of.count() <= FEW else groups
            fixed = tell(now.where(~rest), active.join(groups, ["g", "fid"], "left_semi"))
            observed = materialise(summed(observed.join(groups, ["g", "fid"], "left_semi").unionByName(fixed)))
            active = rest_of
        said = summed(observed.unionByName(tell(before, active)))

    # Greatest share first; shares are compared to nine places, so that the order of summation decides nothing.
    best = F.min_by(F.struct("value", "share", "number"), F.struct(-F.round("share", 9), "value"))
    told = None
    for part in settled:
        told = part if told is None else told.unionByName(part)
    chosen = cells.select("_key", "fid")
    if told is not None:
        chosen = chosen.join(told.groupBy("_key", "fid").agg(best.alias("b")).select("_key", "fid", "b.*"), ["_key", "fid"], "left")
    else:
        chosen = chosen.select("*", F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("number"))
    everyone = spoken.where(F.col("g") == ALL)  # one row per field comes of it
    overall = everyone.groupBy("fid").agg(F.min_by("value", F.struct(-F.col("mass"), "value")).alias("o_value"), (F.sum("total") / F.sum("mass")).alias("o_number"))
    out = chosen.join(F.broadcast(overall), "fid", "left")
    propagated = F.col("share").isNotNull()
    value = F.when(~is_number, F.when(propagated, F.col("value")).otherwise(F.col("o_value")))
    number = F.when(is_number, F.when(propagated, F.col("number")).otherwise(F.col("o_number")))
    method = F.when(propagated, "propagated").when(F.coalesce(value, number.cast("string")).isNotNull(), "overall").otherwise("none")
    field = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("fid") + 1)
    return out.select(F.col("_key").alias(key), field.alias("field"), value.alias("value"), number.alias("number"), "share", method.alias("method"), (method != "none").alias("filled"))


def apply_fills(df: DataFrame, key: str, fields: Sequence[Field], fills: DataFrame) -> DataFrame:
    """``df`` with each field clean and filled, and a flag ``{field}_filled`` beside it; every row is kept."""
    picked = [F.max(F.when(F.col("field") == f.name, F.col("value" if f.kind == "category" else "number"))).alias(f"_f_{f.name}") for f in fields]
    marks = [F.max(F.when((F.col("field") == f.name) & F.col("filled"), True)).alias(f"_m_{f.name}") for f in fields]
    wide = fills.groupBy(F.col(key).alias("_key")).agg(*picked, *marks)
    joined = df.withColumns({f"_o_{f.name}": f.observed for f in fields}).join(wide, F.col(key) == F.col("_key"), "left")
    filled = {f.name: F.coalesce(F.col(f"_o_{f.name}"), F.col(f"_f_{f.name}")) for f in fields}
    flags = {f"{f.name}_filled": F.col(f"_o_{f.name}").isNull() & F.coalesce(F.col(f"_m_{f.name}"), F.lit(False)) for f in fields}
    return joined.withColumns(filled | flags).select(*df.columns, *flags)
