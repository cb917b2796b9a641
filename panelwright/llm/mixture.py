"""Mixing sources to target weights.

Method: hierarchical budgeting.  The leaves (sources) stand in a tree, here domain - language - source, and a
node's weight is the sum of its leaves' weights.  The budget goes down the tree by weight; what a leaf cannot supply
even with all its repeats goes to its siblings first, and only what they cannot supply either to the siblings of its
ancestors.  A leaf's budget is drawn in epochs: whole passes over its records, then a prefix of the records in the
order of that epoch's seeded hash.  The prefix ends where a record does not fit; what it leaves is filled with records
beyond it that do fit, and what no record of the leaf fits goes to the leaf's siblings, then to those of its ancestors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.session import materialise

RANGES = 1 << 18  # hash ranges of the epochs' orders, over all leaves; only the range in which a prefix ends is sorted
MAX_LEAVES = 4_096
PER_CLASS = 4  # records looked at per leaf and power of two of their size, when what a prefix leaves is filled


@dataclass
class Leaf:
    path: tuple[str, ...]
    weight: float
    supply: float  # the most it can give: its tokens times its repeats
    budget: float = field(default=0.0)
    left: int = field(default=0)  # what could not be drawn so far


def allocate(leaves: Sequence[Leaf], total: float) -> None:
    """Sets every leaf's budget.  Water-filling per node: children share by weight, a child that cannot take its part
    gives what it has, the rest is shared again among its siblings; what no child can take goes up again."""

    def supply(group: Sequence[Leaf]) -> float:
        return sum(x.supply for x in group)

    def give(group: Sequence[Leaf], amount: float, depth: int) -> None:
        if len(group) == 1 or depth >= max(len(x.path) for x in group):
            parts = [[x] for x in group]
        else:
            by: dict[str, list[Leaf]] = {}
            for x in group:
                by.setdefault(x.path[depth], []).append(x)
            parts = list(by.values())
        # A leaf's shortage is met by its siblings: so a node first takes its full part, up to its supply.
        amount = min(amount, supply(group))
        got = [0.0] * len(parts)
        open_, left = set(range(len(parts))), amount
        while open_ and left > 1e-9:
            weight = sum(x.weight for k in open_ for x in parts[k])
            if weight <= 0:
                break
            full = [k for k in open_ if got[k] + left * sum(x.weight for x in parts[k]) / weight >= supply(parts[k]) - 1e-9]
            if not full:
                for k in open_:
                    got[k] += left * sum(x.weight for x in parts[k]) / weight
                break
            for k in full:
                left -= supply(parts[k]) - got[k]
                got[k] = supply(parts[k])
                open_.discard(k)
        for k, part in enumerate(parts):
            if len(part) == 1:
                part[0].budget = min(got[k], part[0].supply)
            else:
                give(part, got[k], depth + 1)

    if leaves:
        give(list(leaves), total, 0)


def fill_rest(leaves: Sequence[Leaf], loose: dict[tuple[str, ...], list[tuple[int, int, int]]]) -> list[int]:
    """Picks rows for what the leaves have left.  ``loose``: (size, order, row) of records not drawn, per leaf.

    Every leaf first takes of its own, the largest that fit first.  What is left then is put together per node, from the
    deepest up, and filled with records of any leaf below that node, so siblings come before ancestors.
    """
    picked: list[int] = []
    rest = {path: list(records) for path, records in loose.items()}

    def take(room: int, paths: Sequence[tuple[str, ...]]) -> int:
        for r, p in sorted(((r, p) for p in paths for r in rest.get(p, [])), key=lambda x: (-x[0][0], *x[0][1:])):
            if 0 < r[0] <= room:
                room -= r[0]
                picked.append(r[2])
                rest[p].remove(r)
        return room

    for x in leaves:
        x.left = take(x.left, [x.path])
    for depth in range(max((len(x.path) for x in leaves), default=0) - 1, -1, -1):
        nodes: dict[tuple[str, ...], list[Leaf]] = {}
        for x in leaves:
            nodes.setdefault(x.path[:depth], []).append(x)
        for group in nodes.values():
            room = take(sum(x.left for x in group), [x.path for x in group])
            for x in group:
                x.left = 0
            group[0].left = room
    return picked


def mix_sources(
    docs: DataFrame, key: str, leaf: str, tokens: str, targets: Sequence[tuple[tuple[str, ...], str, float, int]], seed: int = 42, total: int | None = None, level: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(``uses``, ``report``).  ``targets``: (path of the ancestors, source, share, most repeats).

    ``level`` names a column, say the language, that divides every source into leaves and stands between the given
    path and the source: a source's share is spread over its levels as its tokens are, and shortages go to other
    sources of the same level first.  Null levels are one level, named by the empty text.

    ``uses``: ``key, leaf, uses`` for every drawn record, uses counting how often (at most the source's repeats).
    ``report``: one row per leaf: ``leaf, level, target_share, reached_share`` (of the whole mixture), ``target_tokens,
    available_tokens`` (with all repeats), ``budget_tokens, drawn_tokens, short``: what it was given and what was
    drawn both stay below its share of the total.  A source without records has one row, of level empty.

    ``total`` is the size of the mixture, by default the tokens of all ``docs``, also of those whose leaf is null or
    no target (they are never drawn).  A record that would step over the leaf's budget is passed over; the mixture ends
    less than the smallest record not drawn below its size, if the sources can supply it.  Null sizes count 0; equal
    hashes go by key; repeated rows are records of their own.  An empty table gives an empty mixture and zeros.

    Sent to the driver: one row per leaf (at most MAX_LEAVES), and sizes of PER_CLASS records per leaf and power of two
    of the size; repeated with twice as many while a record fits, mostly once, so of no more records than twice those
    that fill what the prefixes leave, each leaf less than its longest record.  Broadcast: one sum per leaf and hash range,
    RANGES rows at most.  A leaf with a third of all records is summed by ranges before it is shuffled, and only the
    range in which its prefix ends is sorted, a RANGES / leaves part of the leaf.
    """
    spark: SparkSession = docs.sparkSession
    if len(targets) > MAX_LEAVES or len({t[1] for t in targets}) < len(targets):
        raise ValueError(f"more than {MAX_LEAVES} sources, or one named twice")
    weights = sum(t[2] for t in targets) or 1.0
    of_level = F.lit("") if level is None else F.coalesce(F.col(level).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.col(leaf).alias("leaf"), of_level.alias("level"), F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(0)), F.lit(0)).alias("n"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    named = F.col("leaf").isin([t[1] for t in targets])
    counted = rows.groupBy(F.when(named, F.col("leaf")).alias("leaf"), F.when(named, F.col("level")).alias("level")).agg(F.sum("n").alias("n")).limit(2 * MAX_LEAVES).collect()
    if len(counted) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    have = {(r["leaf"], r["level"]): int(r["n"]) for r in counted}
    size = sum(have.values()) if total is None else int(total)
    leaves, repeats, target = [], {}, {}
    for path, name, share, most in targets:
        own = {lv: n for (x, lv), n in sorted(have.items(), key=str) if x == name} or {"": 0}
        for lv, n in own.items():
            part = share / weights * (n / sum(own.values()) if sum(own.values()) else 1 / len(own))
            at = (*path, *([lv] if level is not None else []), name)
            leaves.append(Leaf(at, part, n * most))
            repeats[at], target[at] = most, size * part
    allocate(leaves, size)
    where = {x.path: (x.path[-1], x.path[-2] if level is not None else "") for x in leaves}
    path_of = {v: k for k, v in where.items()}

    whole = {x.path: int(x.budget + 1e-6) for x in leaves}
    lacking = min(size, sum(int(x.supply) for x in leaves)) - sum(whole.values())
    for x in sorted((x for x in leaves if whole[x.path] < x.supply), key=lambda x: whole[x.path] - x.budget)[: max(lacking, 0)]:
        whole[x.path] += 1
    plan = []
    for x in leaves:
        n = have.get(where[x.path], 0)
        epochs = min(whole[x.path] // n, repeats[x.path]) if n else 0
        x.left = whole[x.path] - epochs * n if epochs < repeats[x.path] else 0
        plan.append((*where[x.path], epochs, x.left, epochs < repeats[x.path]))
    rule = spark.createDataFrame(plan, "leaf string, level string, epochs int, rest long, goes_on boolean")
    # The epoch that is not finished has an order of its own: hash of seed, epoch and key.
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("key"))
    buckets = max(64, RANGES // max(len(leaves), 1))
    by = ["leaf", "level"]
    ranged = rows.join(F.broadcast(rule), by).withColumn("order", order).withColumn("range", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * buckets).cast("int"))

    def prefix(ranged: DataFrame) -> DataFrame:
        """``ranged`` with ``last``: 1 where a record lies within its leaf's ``rest``, in the order of the hash."""
        sums = ranged.groupBy(*by, "range").agg(F.sum("n").alias("s"))
        before = F.sum("s").over(Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
        placed = ranged.join(F.broadcast(sums.select(*by, "range", F.coalesce(before, F.lit(0)).alias("before"), "s")), [*by, "range"])
        inside, beyond = F.col("before") + F.col("s") <= F.col("rest"), F.col("before") >= F.col("rest")
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*by).orderBy("order", "key").rowsBetween(Window.unboundedPreceding, 0))
        sure = placed.where(inside | beyond).withColumn("last", inside.cast("int"))
        return sure.unionByName(placed.where(~inside & ~beyond).withColumn("last", (upto <= F.col("rest")).cast("int"))).drop("before", "s")

    drawn = materialise(prefix(ranged))
    got = {(r["leaf"], r["level"]): int(r["d"]) for r in drawn.groupBy(*by).agg(F.sum(F.col("n") * F.col("last")).alias("d")).collect()}
    for x in leaves:
        x.left -= got.get(where[x.path], 0)
    more: list[int] = []
    per_class = PER_CLASS
    while (room := sum(x.left for x in leaves)) > 0:
        loose = drawn.where((F.col("last") == 0) & F.col("goes_on") & (F.col("n") > 0) & (F.col("n") <= F.lit(room)))
        if more:
            loose = loose.join(F.broadcast(spark.createDataFrame([(x,) for x in more], "row long")), "row", "left_anti")
        first = F.row_number().over(Window.partitionBy(*by, F.floor(F.log2(F.col("n").cast("double")))).orderBy("order", "key", "row"))
        found: dict[tuple[str, ...], list[tuple[int, int, int]]] = {}
        for r in loose.withColumn("nth", first).where(F.col("nth") <= per_class).select(*by, "n", "order", "row").collect():
            found.setdefault(path_of[r["leaf"], r["level"]], []).append((int(r["n"]), int(r["order"]), int(r["row"])))
        picked = fill_rest(leaves, found)
        if not picked:
            break
        more += picked
        per_class *= 2
    uses = drawn.withColumn("more", F.lit(0))
    if more:
        uses = drawn.join(F.broadcast(spark.createDataFrame([(x, 1) for x in more], "row long, more int")), "row", "left").fillna(0, ["more"])
    uses = uses.withColumn("uses", F.col("epochs") + F.col("last") + F.col("more")).where("uses > 0")
    total_drawn = uses.groupBy(*by).agg(F.sum(F.col("n") * F.col("uses")).alias("drawn"))
    facts = [(*where[x.path], x.weight, float(target[x.path]), have.get(where[x.path], 0) * repeats[x.path], float(x.budget)) for x in leaves]
    report = spark.createDataFrame(facts, "leaf string, level string, target_share double, target double, available_tokens long, budget double").join(total_drawn, by, "left")
    got = F.coalesce("drawn", F.lit(0))
    below = F.col("target") * (1 - 1e-9)
    report = report.select(
        "leaf", "level", "target_share", (got / F.lit(float(max(size, 1)))).alias("reached_share"), F.round("target").cast("long").alias("target_tokens"), "available_tokens",
        F.round("budget").cast("long").alias("budget_tokens"), got.cast("long").alias("drawn_tokens"), ((F.col("budget") < below) & (got < below)).alias("short"),
    )
    return uses.select(F.col("key").alias(key), F.col("leaf"), "uses"), report
