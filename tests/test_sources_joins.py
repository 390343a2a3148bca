"""The landed data source, the Bloom prefilter and kept answers."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import answers, bloom, feed
from tidemark.sources import articles as src
from tidemark.sources import landed

# Landed files


def write(folder, name, value):
    path = f"{folder}/{name}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(value if isinstance(value, str) else json.dumps(value))


def test_a_partition_a_file_and_malformed_files(spark, tmp_path):
    landed.register(spark)
    write(tmp_path, "a/1.json", {"hits": [{"x": 1}, {"x": 'q"é'}]})
    write(tmp_path, "a/2.json", "{broken")
    write(tmp_path, "a/3.json", {"other": 1})
    write(tmp_path, "a/_SUCCESS", "")
    write(tmp_path, "b.json", [{"hits": [{"x": 3}]}, {"hits": {"x": 4}}, 7])
    rows = spark.read.format("landed_json").option("records", "hits").load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4
    got = rows.collect()
    assert [(r["file"], r["place"], json.loads(r["record"])["x"]) for r in got if r["record"]] == [("a/1.json", 0, 1), ("a/1.json", 1, 'q"é'), ("b.json", 0, 3), ("b.json", 1, 4)]
    assert [(r["file"], r["error"][:4]) for r in got if r["error"]] == [("a/2.json", "JSON")]
    assert spark.read.format("landed_json").load(f"{tmp_path}/none").count() == 0


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    landed.register(spark)
    seen = []
    for n, files in enumerate([{"001.json": [1, 2]}, {"002.json": "nonsense{", "003.json": [3]}, {}]):
        for name, value in files.items():
            write(f"{tmp_path}/in", name, value)
        rows = spark.readStream.format("landed_json").load(f"{tmp_path}/in")
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema(landed.SCHEMA).parquet(f"{tmp_path}/out").collect()
        seen.append(sorted((r["file"], r["record"], r["error"] is None) for r in got))
    assert seen[0] == [("001.json", "1", True), ("001.json", "2", True)]
    assert seen[1] == seen[2] == sorted([*seen[0], ("002.json", None, False), ("003.json", "3", True)], key=str)


def test_registered_loaders(spark, tmp_path):
    src.register_loader("mine", lambda s, path: s.read.text(path))
    assert src.LOADERS.pop("mine") and "arxiv" in src.LOADERS


@pytest.mark.parametrize(("link", "words", "want"), [("https://arxiv.org/pdf/2401.01234v2", "x", "2401.01234"), ("https://x.y", "see arXiv: 2312.9999 there", "2312.9999"), ("https://arxiv.org/list", "none", None), (None, "ARXIV2401.00001", "2401.00001")])
def test_arxiv_ids(spark, link, words, want):
    from tidemark.functions.text import arxiv_id

    row = spark.createDataFrame([(link, words)], "link string, words string").select(arxiv_id(F.col("link"), F.col("words"))).first()
    assert row[0] == want


# Bloom filter


def test_prefilter_equals_the_anti_join_and_spares_rows(spark):
    stored = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("link_hash"))
    incoming = spark.range(18_000, 60_000).select("id", F.md5(F.col("id").cast("string")).alias("link_hash")).unionByName(spark.createDataFrame([(-1, None)], "id long, link_hash string"))
    want = incoming.join(stored, "link_hash", "left_anti")
    got = bloom.unseen(incoming, stored)
    assert got.columns == incoming.columns and {r["id"] for r in got.collect()} == {r["id"] for r in want.collect()}
    bits, hashes = bloom.size_of(20_000)
    filter_ = bloom.built(stored, "link_hash", bits, hashes)
    passed = incoming.where(bloom.maybe(F.col("link_hash"), filter_, bits, hashes)).count()
    # All 2,000 that are stored, and of the 40,000 others about one in a thousand: that many reach the join, not 42,000.
    assert 2000 <= passed <= 2000 + 40_000 * 0.003
    assert bloom.unseen(incoming, stored.limit(0)).count() == incoming.count() and bloom.unseen(incoming.limit(0), stored).count() == 0


def test_filter_is_bounded(spark):
    assert bloom.size_of(10**9)[0] == bloom.MOST_BYTES * 8 and bloom.size_of(0) == (bloom.ROW_BITS, 12)
    rows = spark.range(5000).select(F.col("id").cast("string").alias("link_hash"))
    few = bloom.built(rows, "link_hash", bloom.ROW_BITS, 1)
    assert len(few) == bloom.ROW_BITS // 8 and rows.where(~bloom.maybe(F.col("link_hash"), few, bloom.ROW_BITS, 1)).count() == 0


def test_plans_do_not_hold_the_filter(spark):
    """With a dozen copies of it in every plan a driver ran out of memory on half a million keys."""
    stored = spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("link_hash"))
    incoming = spark.range(190_000, 210_000).select("id", F.md5(F.col("id").cast("string")).alias("link_hash"))
    got = bloom.unseen(incoming, stored)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < bloom.size_of(200_000)[0] // 8
    assert {r["id"] for r in got.collect()} == set(range(200_000, 210_000))


# Answers


def provider(calls, fails=(), fatal=()):
    """Counts its calls in files; some titles fail at first, some kill the task until a file says otherwise."""

    def ask(title, text):
        n = len([f for f in os.listdir(calls) if f.startswith(f"{title}-")])
        open(f"{calls}/{title}-{n}", "w").close()
        if title in fatal and not os.path.exists(f"{calls}/go"):
            raise SystemExit(1)
        if title in fails and n == 0:
            raise answers.Later(0.01)
        if title == "bad":
            raise RuntimeError("never")
        return f"{title}:{text}"

    return ask


def test_nothing_is_asked_twice(spark, tmp_path):
    calls, folder = tmp_path / "calls", f"{tmp_path}/kept"
    calls.mkdir()
    rows = [(i, f"t{i}", "x" if i % 3 else None, "clash") for i in range(100)] + [(100, "bad", "y", "z")]
    table = spark.createDataFrame(rows, "id long, title string, desc string, folder string").coalesce(1)
    ask = provider(str(calls), fails=("t3", "t70"), fatal=("t80",))
    run = lambda: answers.with_kept_answers(table, ask, folder, per_second=2000, burst=200, pause=0.001)
    with pytest.raises(Exception):
        run().collect()
    (calls / "go").touch()
    got = {r["id"]: r["answer"] for r in run().collect()}
    assert got == {i: None if t == "bad" else f"{t}:{d or ''}" for i, t, d, _ in rows}
    count = lambda title: len([f for f in os.listdir(calls) if f.startswith(f"{title}-")])
    # Chunks that were answered before the task died were not asked for again; three tries for what never succeeds.
    assert [count(f"t{i}") for i in range(64)] == [2 if i == 3 else 1 for i in range(64)] and count("bad") == 3
    before = len(os.listdir(calls))
    assert {r["id"]: r["answer"] for r in run().collect()} == got and len(os.listdir(calls)) == before


def test_bucket_and_backoff():
    now = [0.0]
    bucket = answers.Bucket(2.0, 3, lambda: now[0])
    assert [bucket.wait() for _ in range(5)] == [0, 0, 0, 0.5, 1.0]
    now[0] = 10.0
    assert bucket.wait() == 0
    slept = []

    def ask(title, text):
        raise answers.Later(7.0)

    assert answers.tried(ask, "a", "b", answers.Bucket(1e9, 9), 3, 0.5, slept.append) is None
    assert [s for s in slept if s] == [7.0, 7.0]


def test_unseen_is_the_feeds(spark):
    r = random.Random(1)
    rows = [(i, f"k{r.randint(0, 30)}") for i in range(60)]
    incoming = spark.createDataFrame(rows, "id long, link_hash string")
    stored = spark.createDataFrame([(f"k{i}",) for i in range(0, 30, 2)], "link_hash string")
    first = incoming.groupBy("link_hash").agg(F.min("id").alias("id")).select("id", "link_hash")
    assert {x["id"] for x in bloom.unseen(first, stored).collect()} == {x["id"] for x in feed.unseen(incoming, stored).collect()}
