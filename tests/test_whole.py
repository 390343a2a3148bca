"""Registered queries read whole texts and every row."""

import os

import duckdb
import pytest
from test_catalog import DATA

from tidemark.plans import catalog
from tidemark.sources.articles import articles_from_documents

has_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_adapter_keeps_whole_text(spark):
    text = "head " * 40 + "\n" + "filler " * 100 + "zebra"
    docs = spark.createDataFrame([(1, text, "en", "web", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    got = articles_from_documents(docs).first()
    assert got["desc"] == text and got["title"] == "head " * 40


LINKS = ["upsert_merge", "existing_links", "unseen_links", "paper_backfill"]


@has_tables
def test_links_cover_every_row(spark):
    stored, incoming = catalog._two(spark, DATA)
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert {r[0] for r in stored.select("id").collect()} == {r[0] for r in incoming.select("id").collect()} == ids
    merged = catalog.QUERIES["upsert_merge"](spark, DATA)
    cases = {(r["fetch_count"], r["heat_changed"]): r["count"] for r in merged.groupBy("fetch_count", "heat_changed").count().collect()}
    assert cases[2, True] and cases[2, False] and cases[1, False]
    known = sum(i % 5 < 2 for i in ids)
    assert [catalog.QUERIES[n](spark, DATA).count() for n in LINKS[:3]] == [2 * len(ids) - known, known, len(ids) - known]


def test_windows_open_at_the_end_are_counted(spark, tmp_path):
    values = ", ".join(f"({i}, TIMESTAMP '2024-01-01 {hour:02}:00:00', 1, 'view', 0.0::DOUBLE, '{{}}')" for i, hour in enumerate((1, 2, 23)))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {values}) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet'")
    got = catalog.QUERIES["stream_window_counts"](spark, str(tmp_path)).collect()
    assert [(r["event_type"], r["n"]) for r in got] == [("view", 3)]
