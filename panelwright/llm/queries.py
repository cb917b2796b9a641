"""The p-queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.ids import canonical_id, canonical_id_sql, canonical_name
from panelwright.llm.mixture import mix_sources
from panelwright.llm.nearest_time import match_nearest_time
from panelwright.llm.packing import pack_items
from panelwright.llm.quality import text_quality
from panelwright.llm.runs import collapse_runs
from panelwright.llm.splits import grouped_splits
from panelwright.llm.tokens import piece_contents, with_token_counts
from panelwright.sources.tables import table

CAPACITY = 2048


def _day(c: F.Column) -> F.Column:
    return F.date_format(F.date_from_unix_date(c.cast("int")), "yyyy-MM-dd")


def _splits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    alias = table(spark, d, "member_alias")
    return grouped_splits(
        table(spark, d, "cv"), canonical_id("maskedMatchId"), {"train": 0.8, "validation": 0.1, "test": 0.1},
        label=F.col("noShow_day1_target") == 1, fold="fold_id", links=(alias, canonical_id("maskedMatchId"), canonical_id("otherMatchId")),
    )


def p2_split_rows(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d)[0].select("row_id", F.col("component").alias("person"), "split")


def p2_split_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _splits(spark, d)[1].groupBy("split").agg(F.count(F.lit(1)).alias("persons"), F.sum("n_rows").alias("rows"), F.sum("n_positive").alias("positives"))
    whole = F.sum("rows").over(Window.partitionBy(F.lit(1)))  # over one row per split
    return rows.select("split", "persons", "rows", "positives", F.round(F.col("rows") / whole, 4).alias("share"))


def p2_split_people(spark: SparkSession, d: str) -> DataFrame:
    """Every person with rows and the number of splits they lie in."""
    return p2_split_rows(spark, d).where("person is not null").groupBy("person").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("split").alias("splits"))


def p2_split_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Whether rows and positives of every split are within the largest person of its quota."""
    parts = _splits(spark, d)[1].groupBy("split").agg(F.sum("n_rows").alias("rows"), F.sum("n_positive").alias("positives"), F.max("n_rows").alias("largest"))
    every = Window.partitionBy(F.lit(1))  # over one row per split
    quota = F.when(F.col("split") == "train", 0.8).otherwise(0.1)
    near = lambda c: F.abs(F.col(c) - quota * F.sum(c).over(every)) <= F.max("largest").over(every)
    return parts.select("split", near("rows").alias("rows_kept"), near("positives").alias("positives_kept"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d)[1].where((F.col("n_folds") > 1) & F.col("split").isNotNull()).select(F.col("component").alias("maskedMatchId"))


def _clock_ins(spark: SparkSession, d: str) -> DataFrame:
    swipes = table(spark, d, "swipe").where("type = 'SWIPE_IN' and payCode = 'CLOCK'")
    return match_nearest_time(
        swipes, table(spark, d, "shift"), "swipe_id", canonical_id("maskedMatchId"), "swipeTimestampLocal",
        "shift_id", canonical_id("maskedMatchId"), "startAtTimestampLocal", tolerance_seconds=90 * 60,
    )


def p4_nearest_shift(spark: SparkSession, d: str) -> DataFrame:
    return _clock_ins(spark, d).select("swipe_id", "shift_id", (F.col("distance_us") / 1_000_000).cast("double").alias("seconds_apart"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _clock_ins(spark, d).where("shift_id is not null").select("swipe_id", "shift_id")


def _stretches(spark: SparkSession, d: str) -> DataFrame:
    worked = F.coalesce(F.col("worked"), F.col("clockIn").isNotNull() | F.col("clockOut").isNotNull())
    runs = collapse_runs(
        table(spark, d, "attendance"), canonical_id("maskedMatchId"), F.unix_date("date"), {"worked": (worked.cast("int"), 3.0)},
        penalty=1.0, absent={"worked": 0.0}, latest_by=["loadedAt", "row_id"],
    )
    return runs.select(
        F.col("entity").alias("maskedMatchId"), _day(F.col("run_start")).alias("runStart"), _day(F.col("run_end")).alias("runEnd"),
        F.col("duration").alias("days"), F.round("mean_worked", 6).alias("worked"),
    )


def p5_stretches(spark: SparkSession, d: str) -> DataFrame:
    return _stretches(spark, d).where("worked = 1").select("maskedMatchId", "runStart", "runEnd", "days")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _stretches(spark, d).where("worked = 1 and days >= 2").select("maskedMatchId", "runStart", "runEnd")


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return pack_items(with_token_counts(table(spark, d, "documents"), "text", ["doc_id"]), "doc_id", "n_tokens", CAPACITY)


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the texts that had to be divided: their container, tokens and content."""
    contents = piece_contents(table(spark, d, "documents"), "doc_id", "text", CAPACITY)
    placed = p7_packing(spark, d).select("doc_id", "piece", "length", "shard", "bin")
    return contents.join(placed, ["doc_id", "piece"]).select("doc_id", "piece", "n_tokens", "length", "shard", "bin", F.length("content").alias("bytes"), F.sha2("content", 256).alias("content_sha"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are, by the number of containers and tokens."""
    bins = p7_packing(spark, d).groupBy("shard", "bin").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("pieces"))
    used = F.sum("used")
    return bins.agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), used.alias("tokens"), F.round(used / (F.count(F.lit(1)) * CAPACITY), 6).alias("filled"))


def p7_characters(spark: SparkSession, d: str) -> DataFrame:
    """The texts packed by characters, which SQL can count too: pieces and characters of each document, and whether all
    its pieces lie in containers that are not overfull."""
    sizes = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    packed = pack_items(sizes, "doc_id", "n", 8192)
    bins = packed.groupBy("shard", "bin").agg(F.sum("length").alias("used"))
    rows = packed.join(bins, ["shard", "bin"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("characters"), F.max("used").alias("most"))
    return rows.select("doc_id", "pieces", "characters", (F.col("most") <= 8192).alias("fits"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_packing(spark, d).where("piece = 1").select("doc_id")


def _mixture(spark: SparkSession, d: str, by_chars: bool = False) -> tuple[DataFrame, DataFrame]:
    """The tree is posts - language - source; languages are those of ``common_words``, any other is one of its own."""
    tongues = [r["lang"] for r in table(spark, d, "common_words").select("lang").distinct().collect()]  # a fixed list
    lang = F.when(F.col("lang").isin(tongues), F.col("lang")).otherwise("")
    docs = table(spark, d, "documents").select("doc_id", "text", lang.alias("tongue"), canonical_name("source").alias("leaf"), F.length("text").alias("n_tokens"))
    sized = docs.drop("text") if by_chars else with_token_counts(docs, "text", ["doc_id", "tongue", "leaf"])
    targets = table(spark, d, "source_targets").select("source", canonical_name("source").alias("leaf"), "target_share", "max_repeats").collect()  # a fixed table
    tree = [(("posts",), t["leaf"], float(t["target_share"]), int(t["max_repeats"])) for t in targets]
    uses, report = mix_sources(sized, "doc_id", "leaf", "n_tokens", tree, level="tongue")
    names = spark.createDataFrame([(t["source"], t["leaf"], float(t["target_share"]), int(t["max_repeats"])) for t in targets], "source string, leaf string, share double, max_repeats int")
    return uses, report.join(F.broadcast(names), "leaf")


def _by_source(report: DataFrame) -> DataFrame:
    """One row per source; a source is short if what its leaves were given and what was drawn stay below its share."""
    sums = [F.sum(c).alias(c) for c in ("reached_share", "target_tokens", "available_tokens", "budget_tokens", "drawn_tokens")]
    return report.groupBy("source", F.col("share").alias("target_share"), "max_repeats").agg(*sums, F.bool_and("short").alias("short"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0].select("doc_id", F.col("leaf").alias("source"), "uses")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    report = _by_source(_mixture(spark, d)[1])
    return report.select("source", "target_share", F.round("reached_share", 6).alias("reached_share"), "target_tokens", "available_tokens", "drawn_tokens", "short")


def p8_tree_shares(spark: SparkSession, d: str) -> DataFrame:
    """The leaves of the tree: what each was given and what was drawn of it."""
    return _mixture(spark, d)[1].select(F.col("level").alias("lang"), "source", F.round("target_share", 6).alias("target_share"), F.round("reached_share", 6).alias("reached_share"), "budget_tokens", "drawn_tokens", "short")


def p8_characters(spark: SparkSession, d: str) -> DataFrame:
    """A mixture by characters, which SQL can count too: what the sources can give, who is short, and that the mixture
    is as large as it is to be (less than a median document away) and uses no document more often than its source allows."""
    uses, report = _mixture(spark, d, by_chars=True)
    most = uses.groupBy("leaf").agg(F.max("uses").alias("uses"))
    names = report.select("source", "leaf").distinct()
    rows = _by_source(report).join(names, "source").join(most, "leaf", "left")
    every = Window.partitionBy(F.lit(1))  # over one row per source
    off = F.sum("budget_tokens").over(every) - F.sum("drawn_tokens").over(every)
    typical = table(spark, d, "documents").agg(F.percentile_approx(F.length("text"), 0.5)).first()[0] or 0
    return rows.select(
        "source", F.col("available_tokens").alias("available"), "short", (F.coalesce("uses", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"), (F.abs(off) <= typical).alias("whole"),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _by_source(_mixture(spark, d)[1]).where("short").select("source")


def _quality(spark: SparkSession, d: str, **parts: bool) -> DataFrame:
    common: dict[str, list[str]] = {}
    for r in table(spark, d, "common_words").where("lang is not null and word is not null").collect():  # a fixed list
        common.setdefault(r["lang"], []).append(r["word"].lower())
    return text_quality(table(spark, d, "documents"), "doc_id", "text", dict(sorted(common.items())), **parts)


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    ratios = ["mean_word_length", "symbol_ratio", "lines_ending_in_punctuation", "common_word_share"]
    return _quality(spark, d, structure=False).select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ratios])


def p9_structure(spark: SparkSession, d: str) -> DataFrame:
    return _quality(spark, d).select("doc_id", "structure", "language", "prose_chars", "list_chars", "table_chars", "junk_chars", "code_chars", "n_words", F.round("common_word_share", 6).alias("common_word_share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    bad = F.col("list_chars") + F.col("table_chars") + F.col("junk_chars")
    return _quality(spark, d, counts=False).where(bad > F.col("prose_chars") + F.col("code_chars")).select("doc_id")


def p5_similar_days(spark: SparkSession, d: str) -> DataFrame:
    """Runs of days with nearly the same hours (a day without a row has none): count, duration and mean."""
    hours = F.when((F.col("hoursWorked") > 0) & (F.col("hoursWorked") <= 24), F.col("hoursWorked"))
    runs = collapse_runs(
        table(spark, d, "attendance"), canonical_id("maskedMatchId"), F.unix_date("date"), {"hours": (hours, 1.0)},
        penalty=2.0, absent={"hours": 0.0}, latest_by=["loadedAt", "row_id"],
    )
    return runs.select(F.col("entity").alias("maskedMatchId"), _day(F.col("run_start")).alias("runStart"), _day(F.col("run_end")).alias("runEnd"), "n_events", "duration", F.round("mean_hours", 6).alias("hours"))


def p5_similar_cover(spark: SparkSession, d: str) -> DataFrame:
    """Of :func:`p5_similar_days`, per member: that the runs hold every row once and every day from first to last once."""
    runs = p5_similar_days(spark, d).groupBy("maskedMatchId")
    return runs.agg(F.sum("n_events").alias("events"), F.sum("duration").alias("days"), F.min("runStart").alias("first"), F.max("runEnd").alias("last"))


_ID = canonical_id_sql("maskedMatchId")

_P2 = f"""
WITH RECURSIVE l AS (SELECT {_ID} AS a, {canonical_id_sql("otherMatchId")} AS b FROM member_alias),
e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS m, min(b) AS person FROM r GROUP BY a),
p AS (SELECT coalesce(person, {_ID}) AS person, fold_id FROM cv LEFT JOIN c ON c.m = {_ID})
"""

_P4 = f"""
WITH s AS (SELECT {_ID} AS m, startAtTimestampLocal AS t, min(shift_id) AS shift_id FROM shift WHERE startAtTimestampLocal IS NOT NULL GROUP BY 1, 2),
w AS (SELECT swipe_id, {_ID} AS m, swipeTimestampLocal AS t FROM swipe WHERE type = 'SWIPE_IN' AND payCode = 'CLOCK'),
b AS (SELECT w.*, s.shift_id AS s1, epoch_us(w.t) - epoch_us(s.t) AS d1 FROM w ASOF LEFT JOIN s ON w.m = s.m AND w.t >= s.t),
f AS (SELECT w.swipe_id, s.shift_id AS s2, epoch_us(s.t) - epoch_us(w.t) AS d2 FROM w ASOF LEFT JOIN s ON w.m = s.m AND w.t <= s.t),
n AS (SELECT swipe_id, CASE WHEN d2 IS NULL OR d1 <= d2 THEN s1 ELSE s2 END AS shift_id, CASE WHEN d2 IS NULL OR d1 <= d2 THEN d1 ELSE d2 END AS dist FROM b JOIN f USING (swipe_id)),
k AS (SELECT swipe_id, CASE WHEN dist <= 5400000000 THEN shift_id END AS shift_id, CASE WHEN dist <= 5400000000 THEN dist / 1e6 END AS seconds_apart FROM n)
"""

_P5 = f"""
WITH a AS (SELECT {_ID} AS m, CAST(date AS DATE) AS d, coalesce(worked, clockIn IS NOT NULL OR clockOut IS NOT NULL) AS w,
    row_number() OVER (PARTITION BY {_ID}, date ORDER BY loadedAt DESC NULLS LAST, row_id DESC) AS rn FROM attendance WHERE date IS NOT NULL),
k AS (SELECT m, d, d - CAST(row_number() OVER (PARTITION BY m ORDER BY d) AS INT) AS g FROM a WHERE rn = 1 AND w),
r AS (SELECT m, min(d) AS lo, max(d) AS hi, count(*) AS n FROM k GROUP BY m, g)
"""

_P9 = """
WITH t AS (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]+')) AS word FROM t),
n AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS letters FROM w GROUP BY doc_id),
c AS (SELECT doc_id, max(k) AS common FROM (SELECT doc_id, lang, count(*) AS k FROM w JOIN (SELECT DISTINCT lang, lower(word) AS word FROM common_words) q ON lower(w.word) = q.word GROUP BY doc_id, lang) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(regexp_replace(line, '\\s+$', ''), '[.!?:;,…]["''”’)]*$')) AS ended
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '\\S') GROUP BY doc_id),
s AS (SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS dense, length(regexp_replace(text, '[\\s\\p{L}\\p{N}]', '', 'g')) AS symbols FROM t)
"""

_NAME = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"

SQL = {
    "p8_characters": f"""WITH n AS (SELECT {_NAME.format('source')} AS leaf, sum(length(text)) AS n FROM documents GROUP BY 1), a AS (SELECT sum(n) AS size FROM n)
        SELECT t.source, CAST(coalesce(n.n, 0) * t.max_repeats AS BIGINT) AS available, coalesce(n.n, 0) * t.max_repeats < size * t.target_share AS short, true AS repeats_kept, true AS whole
        FROM source_targets t CROSS JOIN a LEFT JOIN n ON n.leaf = {_NAME.format('t.source')}""",
    "p9_statistics": _P9 + """SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, round(coalesce(letters / n_words, 0.0), 6) AS mean_word_length,
        round(CASE WHEN dense > 0 THEN symbols / dense ELSE 0.0 END, 6) AS symbol_ratio, round(coalesce(ended / lines, 0.0), 6) AS lines_ending_in_punctuation,
        round(coalesce(common / n_words, 0.0), 6) AS common_word_share FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "p2_split_people": _P2 + """SELECT person, count(*) AS rows, CAST(1 AS BIGINT) AS splits FROM p WHERE person IS NOT NULL GROUP BY person""",
    "p2_split_quotas": "SELECT split, true AS rows_kept, true AS positives_kept FROM (VALUES ('train'), ('validation'), ('test')) t(split)",
    "p2_found": _P2 + """SELECT person AS "maskedMatchId" FROM p WHERE person IS NOT NULL GROUP BY person HAVING count(DISTINCT fold_id) > 1""",
    "p4_nearest_shift": _P4 + """SELECT swipe_id, shift_id, CAST(seconds_apart AS DOUBLE) AS seconds_apart FROM k""",
    "p4_found": _P4 + """SELECT swipe_id, shift_id FROM k WHERE shift_id IS NOT NULL""",
    "p7_characters": """SELECT doc_id, CAST(greatest(ceil(coalesce(length(text), 0) / 8192.0), 1) AS BIGINT) AS pieces, CAST(coalesce(length(text), 0) AS BIGINT) AS characters, true AS fits FROM documents""",
    "p5_similar_cover": f"""SELECT m AS "maskedMatchId", count(*) AS events, CAST(max(d) - min(d) + 1 AS BIGINT) AS days, strftime(min(d), '%Y-%m-%d') AS "first", strftime(max(d), '%Y-%m-%d') AS "last"
        FROM (SELECT DISTINCT {_ID} AS m, CAST(date AS DATE) AS d FROM attendance WHERE date IS NOT NULL) WHERE m IS NOT NULL GROUP BY m""",
    "p5_stretches": _P5 + """SELECT m AS "maskedMatchId", strftime(lo, '%Y-%m-%d') AS "runStart", strftime(hi, '%Y-%m-%d') AS "runEnd", n AS days FROM r""",
    "p5_found": _P5 + """SELECT m AS "maskedMatchId", strftime(lo, '%Y-%m-%d') AS "runStart", strftime(hi, '%Y-%m-%d') AS "runEnd" FROM r WHERE n >= 2""",
}

QUERIES = {
    "p2_split_rows": p2_split_rows, "p2_split_report": p2_split_report, "p2_split_people": p2_split_people, "p2_split_quotas": p2_split_quotas, "p2_found": p2_found, "p4_nearest_shift": p4_nearest_shift,
    "p4_found": p4_found, "p5_stretches": p5_stretches, "p5_found": p5_found, "p5_similar_days": p5_similar_days, "p5_similar_cover": p5_similar_cover,
    "p7_packing": p7_packing, "p7_pieces": p7_pieces, "p7_containers": p7_containers, "p7_characters": p7_characters, "p7_found": p7_found, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_tree_shares": p8_tree_shares, "p8_characters": p8_characters, "p8_found": p8_found,
    "p9_statistics": p9_statistics, "p9_structure": p9_structure, "p9_found": p9_found,
}
