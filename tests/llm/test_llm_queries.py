"""The p-queries of the subpackage on the smallest tables, against SQL where there is some and against counts elsewhere."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelwright.llm import queries as Q
from tools.compare import norm

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, con, name):
    df = Q.QUERIES[name](spark, str(FOLDER))
    cols = sorted(df.columns)
    rel = con.sql(Q.SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert Counter(tuple(map(norm, r)) for r in df.select(*cols).collect()) == Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_every_row_gets_one_split_and_related_rows_the_same(spark):
    rows = Q.p2_split_rows(spark, str(FOLDER))
    assert rows.count() == spark.read.parquet(f"{FOLDER}/cv.parquet").count()
    assert rows.groupBy("person").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def test_containers_hold_every_token_once(spark):
    packed = Q.p7_packing(spark, str(FOLDER))
    tokens = Q.with_token_counts(spark.read.parquet(f"{FOLDER}/documents.parquet"), "text", ["doc_id"])
    assert packed.agg(F.sum("length")).first()[0] == tokens.agg(F.sum("n_tokens")).first()[0]
    assert packed.groupBy("shard", "bin").agg(F.sum("length").alias("x")).where("x > 2048").count() == 0
    assert packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("length").alias("x")).where("n > 1 and x <= 2048").count() == 0


def test_pieces_are_those_that_were_packed(spark):
    pieces = Q.p7_pieces(spark, str(FOLDER)).collect()
    packed = Q.p7_packing(spark, str(FOLDER)).groupBy("doc_id").count().where("count > 1").collect()
    assert len(pieces) == sum(r["count"] for r in packed) and all(r["n_tokens"] == r["length"] <= 2048 for r in pieces)


def test_mixture_keeps_to_repeats(spark):
    uses, shares = Q.p8_mixture(spark, str(FOLDER)), Q.p8_shares(spark, str(FOLDER))
    targets = spark.read.parquet(f"{FOLDER}/source_targets.parquet")
    assert uses.join(targets, "source").where("uses > max_repeats").count() == 0
    # Shares are of the whole mixture, which is as large as all documents but for less than a median one.
    sizes = sorted(r["n_tokens"] for r in Q.with_token_counts(spark.read.parquet(f"{FOLDER}/documents.parquet"), "text", ["doc_id"]).collect())
    drawn, reached = shares.agg(F.sum("drawn_tokens"), F.sum("reached_share")).first()
    assert 0 <= sum(sizes) - drawn < sizes[len(sizes) // 2] and reached == pytest.approx(drawn / sum(sizes), abs=1e-5) and shares.count() == targets.count()


def test_similar_days_cover_each_row_once(spark):
    runs = Q.p5_similar_days(spark, str(FOLDER))
    days = spark.read.parquet(f"{FOLDER}/attendance.parquet").select(Q.canonical_id("maskedMatchId"), "date").distinct().count()
    assert runs.agg(F.sum("n_events")).first()[0] == days and runs.where("duration < n_events").count() == 0
