"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from tidemark.plans import catalog, reports  # noqa: F401  (both register queries)
from tidemark.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value.replace(tzinfo=None)) if isinstance(value, datetime.datetime) else str(value)


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, DATA)
    got = ordered([tuple(r) for r in frame.collect()], frame.columns)
    if name not in SQL:
        assert got[1] is not None
        return
    con = duckdb.connect()
    for table in ("documents", "pages", "events"):
        con.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    done = con.execute(SQL[name])
    assert got == ordered(done.fetchall(), [c[0] for c in done.description])


def test_every_branch_is_hit(spark):
    """The registered queries show what they are there for: no result is empty or the same on all rows by default."""
    run = lambda name: QUERIES[name](spark, DATA)
    distinct = lambda name, column: {r[0] for r in run(name).select(column).distinct().collect()}
    assert run("tag_degree").count() == len(catalog.TAGS)
    assert len(distinct("infer_tags", "tags")) > 10 and len(distinct("heat_score", "heat_score")) > 20
    assert distinct("entity_momentum", "trend") == {"rising", "stable", "cooling"}
    assert distinct("entity_emergence", "is_new") == {True, False}
    assert distinct("clean_markdown", "shorter") == {True, False}
    assert distinct("upsert_merge", "fetch_count") == {1, 2, 3} and distinct("upsert_merge", "is_new") == distinct("upsert_merge", "heat_changed") == {True, False}
    assert max(distinct("stream_upsert", "fetch_count")) > 1
    assert {r["section"] for r in run("engine_aggregate").collect()} == {"word", "trend", "entity", "emergence", "convergence"}
    assert {r["section"] for r in run("feed_insights").collect()} == {"keyword", "phrase", "type", "date", "venue", "tag"}
    assert distinct("scoring_checkpoint", "method") == {"rule", "model"} and distinct("request_advice", "advice") >= {"often limited", "slow"}
    assert all(run(name).count() for name in QUERIES if name not in ("request_delays",) and name.startswith(("source_", "engine_", "topic_", "enrich")))
