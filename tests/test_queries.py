"""Some queries against their SQL on the smallest tables, if these are there; tools/compare.py does all of them."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tools.compare import norm

FOLDER = Path("/root/testdata/sf0.001")
SOME = [
    "p1_rolling_no_shows", "p1_found", "p3_periods", "p3_gaps", "p3_found", "p6_found", "profile_events", "asof_job_history", "neighbour_repair_hours", "anti_precedence_union", "interval_join_nearest_out", "duration_metrics",
    "manager_team_rates", "team_distinct_window", "hierarchical_rate_fallback", "streak_islands", "days_since_last_events", "weekday_history_rate", "lag_rolling_stats", "tail_clip", "time_off_metrics", "temporal_kfold", "weights_combined",
    "lift_chart", "roc_curve", "ks_2samp", "session_windows",
]


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))
    assert {f"p{n}_found" for n in (1, 3, 6)} <= set(queries)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    if not FOLDER.exists():
        pytest.skip("no test data here")
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_of(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(map(norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def sql_rows(con, text, cols):
    rel = con.sql(text)
    at = [rel.columns.index(c) for c in cols]
    return Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, con, name):
    cols, mine = rows_of(entry.queries()[name](spark, str(FOLDER)))
    assert mine == sql_rows(con, entry.oracle_sql()[name], cols)


def test_entry(spark):
    if not FOLDER.exists():
        pytest.skip("no test data here")
    assert entry.entry(spark).count() > 0
