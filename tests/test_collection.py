"""Kept tables, the collection cycle and long lists of forms: recovery, files touched, pruning, and brute force."""

import datetime
import glob
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lexicons
from tidemark.operators import feed, matching, taxonomy, terms
from tidemark.plans import reports
from tidemark.plans.engine import Engine
from tidemark.sources import articles as src
from tidemark.sources.stored import Stored
from tidemark.streaming import feed as streams
from tidemark.streaming.cycle import Cycle
from tidemark.streaming.table import KeyedTable

ITEM = "id long, link string, type string, title string, desc string, event_date date, venue string, heat int, arxiv_id string"


def day(n):
    return datetime.date(2024, 1, n)


def rows_of(frame):
    return sorted(map(str, frame.collect()))


# Forms


def plain_matches(text, form, edges):
    form, text = form.strip().lower(), text.lower()
    if edges:
        return re.search(rf"\b{re.escape(form)}\b", text) is not None
    return re.search(rf"(?<!\w){re.escape(form)}(?!\w)", text) is not None


@pytest.mark.parametrize("edges", [False, True])
def test_five_thousand_forms_as_brute_force(spark, edges):
    r = random.Random(4)
    bits = ["c", "c++", "gpt", "3.5", ".net", "a", "b1", "état", "日本", "x_y", "+", "(", "[z", "q*", "-", "/", " ", "  "]
    form = lambda n: "".join(r.choice(bits) + r.choice(["", " ", "-", "."]) for _ in range(n)).strip()
    forms = [f for f in {form(r.randint(1, 4)) for _ in range(900)} if f]
    texts = ["", "c++ code, C++", "use .NET or asp.net", "(c (lang", "x" * 5000, None] + [form(r.randint(5, 40)) for _ in range(60)]
    many = forms + [f"filler{i} word*{i}" for i in range(5000 - len(forms))]
    table = spark.createDataFrame([(i, t, "form") for i, t in enumerate(texts)], "id long, text string, form string")
    for bound in (matching.BROADCAST, 0):
        found = matching.matched(table, F.col("text"), list(enumerate(many)) + [(-1, "  ")], edges, bound).distinct()
        got = {(x["id"], x["number"]) for x in found.collect()}
        want = {(i, n) for i, t in enumerate(texts) for n, f in enumerate(many) if t and plain_matches(t, f, edges)}
        assert got == want and len(want) > 300


def test_plan_does_not_grow_with_the_list(spark):
    table = spark.createDataFrame([(1, "a")], "id long, text string")
    size = lambda n: len(matching.matched(table, F.col("text"), [(i, f"form {i}") for i in range(n)])._jdf.queryExecution().optimizedPlan().treeString().split("\n"))
    assert size(5) == size(5000)


def test_literal_keywords_spans_and_rationale(spark):
    items = spark.createDataFrame([(1, "paper", 3, "Multi-Agent c++ code", "an LLM agent (beta) and LLM"), (2, "repo", 1, None, "nothing")], "id long, type string, heat int, title string, desc string")
    domains = [taxonomy.Domain("one", 1.5, ("multi-agent", "c++", "(beta)", "llm"), label="First"), taxonomy.Domain("two", 1.0, ("agent",), (r"c\+{2}\s\w+",))]
    got = {r["id"]: r for r in taxonomy.rule_score(items, domains).collect()}
    # "c++" and "(beta)" end in no word character, so that a word edge there needs one to follow.
    assert got[1]["hits"] == 4 and got[1]["spans"] == ["multi-agent", "llm", "agent", "c++ code"] and got[1]["top_domains"] == ["one", "two"]
    assert got[1]["rationale"] == f"与 AI Agent 工程 强相关（score={got[1]['score']}）。 主要涉及：First、two。 命中关键词：「multi-agent」、「llm」、「agent」。"
    assert (got[2]["score"], got[2]["spans"], got[2]["rationale"]) == (0.0, [], "与 AI Agent 工程无明显相关性。")


# Feed


def test_null_types_stay_in_the_feed(spark):
    rows = spark.createDataFrame([(i, f"l{i}", kind, "t", "", day(1), "v", i, None) for i, kind in enumerate(["paper", None, "news", None])], ITEM)
    assert feed.paper_floor(rows, 10, 2).count() == 4
    # The paper's room is half of a small feed at most.
    many = spark.createDataFrame([(i, f"l{i}", "paper" if i < 30 else "news", f"t{i}", "", day(1), "v", 1000 - i, None) for i in range(60)], ITEM)
    kinds = [r["type"] for r in Engine(many, "2024-01-31").feed(20).collect()]
    assert kinds.count("paper") == 10


def test_backfill_takes_arxiv_links_that_the_feed_lacks(spark):
    row = lambda i, link, kind: (i, link, kind, "t", "", day(i), "v", 1, None)
    stored = spark.createDataFrame([row(1, "https://arxiv.org/pdf/2401.00001v3.pdf", "paper"), row(2, "https://arxiv.org/abs/2401.00002", "paper"), row(3, "https://lab.example/x", "paper"), row(4, "https://arxiv.org/abs/2401.00004", "news")], ITEM)
    now = spark.createDataFrame([row(9, "https://arxiv.org/abs/2401.00001?ref=x", "paper")], ITEM)
    assert [r["link"] for r in feed.backfill(now, stored, 10).collect()] == ["https://arxiv.org/abs/2401.00001?ref=x", "https://arxiv.org/abs/2401.00002"]


def test_title_bonus_leaves_out_items_with_a_paper_id(spark):
    rows = spark.createDataFrame([(i, f"l{i}", "news", "deep blue sea", "", day(1), f"v{i}", 1, "y" if i == 3 else None) for i in range(4)], ITEM)
    assert {r["id"]: r["bonus"] for r in feed.cross_source_bonus(rows).collect()} == {0: 30, 1: 30, 2: 30, 3: 0}


def test_upsert_without_arrival_and_untouched_rows(spark):
    schema = "link_hash string, type string, title string, desc string, event_date date, venue string, heat int, tags array<string>, raw_data string"
    row = lambda key, title, raw, *more: (key, "news", title, "", None, "v", 5, ["t"], raw, *more)
    stored = spark.createDataFrame([row("a", "old", '{"z": 1}', 2), row("b", "kept", '{"z": 1, "a": bad', 1)], f"{schema}, fetch_count int")
    incoming = spark.createDataFrame([row("a", "new", '{"y": 2}', None)], f"{schema}, arrival long")
    got = {r["link_hash"]: r for r in feed.upsert(stored, incoming).collect()}
    assert (got["a"]["title"], json.loads(got["a"]["raw_data"]), got["a"]["fetch_count"]) == ("new", {"y": 2, "z": 1}, 3)
    assert (got["b"]["title"], got["b"]["raw_data"]) == ("kept", '{"z": 1, "a": bad')


# Kept terms


def feed_items(spark, days, seed=0, scale=1):
    r = random.Random(seed)
    words = ["llm", "agent", "rag", "kv-cache", "zebra", "apple", "the", "model"]
    rows = [(100 * d + i, f"l{d}-{i}", r.choice(["paper", "repo", "news", None]), " ".join(r.choices(words, k=4)), " ".join(r.choices(words, k=r.randint(0, 30))), day(d) if d else None, "v", r.randint(1, 999), None) for d in days for i in range(12 * scale)]
    return spark.createDataFrame(rows, ITEM)


def test_rolled_up_days_equal_the_items(spark, tmp_path):
    items = feed_items(spark, [0, 3, 10, 20, 24, 25, 30])
    kept = Stored(spark, str(tmp_path), ["the"])
    kept.put(items)
    recent, past = F.col("event_date") >= F.lit("2024-01-24").cast("date"), F.col("event_date") < F.lit("2024-01-24").cast("date")
    for as_of in ("2024-01-31", "2024-02-20"):
        direct = terms.Terms.of(terms.tokenized(items, as_of, ["the"]), phrases=True)
        for by in ((), ("type",)):
            for of in (lambda t: t.words(5, by), lambda t: t.phrases(5, by), lambda t: t.trends(recent, past, 5, by), lambda t: t.where(recent).words(3, by)):  # noqa: B023
                assert rows_of(of(kept.terms(as_of))) == rows_of(of(direct))
    a, b = (Engine(items, "2024-01-31", stop=["the"], concepts={}, compounds=[], anchors=["llm", "rag"], stored=x) for x in (kept, None))
    assert rows_of(a.topics()) == rows_of(b.topics()) and a.topics().count() and rows_of(a.trending()) == rows_of(b.trending())
    assert {r["term"] for r in b.topics().collect()} >= {"llm"} and "kv-cache" in {r["term"] for r in b.word_freq().withColumnRenamed("label", "term").collect()}


def test_upsert_sends_no_table_through_the_driver(spark):
    """Stored and incoming rows of a few megabytes would be broadcast, batch for batch, by way of the driver."""
    schema = "link_hash string, type string, title string, desc string, event_date date, venue string, heat int, tags array<string>, raw_data string"
    rows = spark.createDataFrame([("a", "news", "t", "d", None, "v", 1, ["x"], '{"k": 1}')], schema)
    out = feed.upsert(rows.withColumn("fetch_count", F.lit(1)), rows.withColumn("arrival", F.lit(1)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 3
    assert [(r["fetch_count"], r["is_new"]) for r in out.collect()] == [(2, False)]


def test_topics_take_tokens_apart_once(spark):
    """What cards are made of is summed by type and window in one pass; evidence makes a row of a key's words alone."""
    items = feed_items(spark, [0, 3, 10, 20, 24, 25, 30])
    recent, past = F.col("event_date") >= F.lit("2024-01-24").cast("date"), F.col("event_date") < F.lit("2024-01-24").cast("date")
    kept = Stored.scratch(spark, items, ["the"])
    sums = kept.by_window("2024-01-31", recent, past)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan(sums.rows) + plan(sums.totals)
    assert sums.rows.where("b is not null").agg(F.min("n")).first()[0] >= terms.LEAST_COUNT and not sums.rows.where(F.col("b").isNotNull() & past).count()
    direct = terms.Terms.of(terms.tokenized(items, "2024-01-31", ["the"]), phrases=True)
    found, want = (rows_of(terms.nominations(x, recent, past, ["llm", "agent", "rag"], "$^")) for x in (sums, direct))
    assert found == want and found
    ranked = spark.createDataFrame([("llm",), ("kv_cache model",), ("none such",)], "key string")
    evidence = terms.topic_evidence(ranked, kept.tokens().where(recent), 2)
    assert {r["key"] for r in evidence.collect()} == {"llm", "kv_cache model"}
    assert "Join" not in plan(evidence) and terms.topic_evidence(ranked.limit(0), kept.tokens(), 2).count() == 0
    kept.discard()


def test_a_day_that_is_put_again_changes_its_partitions_alone(spark, tmp_path):
    kept = Stored(spark, str(tmp_path), ["the"])
    kept.put(feed_items(spark, [3, 10, 20]))
    files = lambda: {p: os.path.getmtime(p) for p in glob.glob(f"{tmp_path}/*/event_date=*/*.parquet")}
    before = files()
    kept.put(feed_items(spark, [10], seed=9))
    changed = before.keys() ^ files().keys()
    assert changed and all("event_date=2024-01-10" in p for p in changed)
    both = feed_items(spark, [3, 20]).unionByName(feed_items(spark, [10], seed=9))
    # The generator draws days one after another, so day 20's items depend on those before it.
    again = Stored(spark, f"{tmp_path}-other", ["the"])
    again.put(both.where("event_date <> date'2024-01-10'").unionByName(both.where("event_date = date'2024-01-10'")))
    day10 = lambda k: rows_of(k.terms("2024-01-31").where(F.col("event_date") == F.lit("2024-01-10").cast("date")).words(9))
    assert day10(kept) == day10(again)


def test_a_window_reads_its_days_alone(spark, tmp_path):
    kept = Stored(spark, str(tmp_path))
    kept.put(feed_items(spark, range(1, 31)))
    recent = Engine(kept.items(), "2024-01-31").recent(7, "paper")
    plan = recent._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*event_date", plan) and re.search(r"PushedFilters: \[.*EqualTo\(type,paper\)", plan)
    scan = [x for x in plan.split("\n") if "event_date" in x and "PartitionFilters" in x]
    assert scan and recent.select("event_date").distinct().count() <= 7 and {str(r[0]) for r in recent.select("event_date").distinct().collect()} <= {f"2024-01-{d}" for d in range(24, 31)}
    read = {p.split("event_date=")[1][:10] for r in recent.select(F.input_file_name()).distinct().collect() for p in r}
    assert len(read) <= 7 < len(glob.glob(f"{tmp_path}/items/event_date=*"))


def test_topics_nominate_fifteen_words(spark):
    # Sixteen anchors of falling weight in one kind: the sixteenth is not nominated by words.
    names = [f"agent{chr(97 + i)}" for i in range(16)]
    rows = [(i, f"l{i}", "paper", " ".join(names[: 16 - i % 16]), "", day(30), "v", 500, None) for i in range(64)]
    items = spark.createDataFrame(rows, ITEM)
    found = terms.Terms.of(terms.tokenized(items, "2024-01-31"), phrases=True)
    got = terms.nominations(found, F.lit(True), F.lit(False), [], "^agent").where("kind = 'token'")
    assert got.count() == 15


def test_engine_looks_behind_its_answers(spark):
    rows = [(i, f"l{i}", kind, "zebra model", "an llm", day(d), venue, heat, paper) for i, (kind, d, venue, heat, paper) in enumerate([("paper", 30, "a", 5, "2401.1"), ("repo", 29, "b", 9, "2401.1"), ("news", 2, "c", 7, None)])]
    e = Engine(spark.createDataFrame(rows, ITEM), "2024-01-31", lexicon=[("zebra", "animal", "zebra")])
    assert [(r["entity_id"], r["rank"], r["id"]) for r in e.entity_evidence().collect()] == [("zebra", 1, 1), ("zebra", 2, 0)]
    assert {(r["arxiv_id"], r["type"], r["id"]) for r in e.convergence_evidence().collect()} == {("2401.1", "paper", 0), ("2401.1", "repo", 1)}
    # Both sources of the paper raise its items' heat in the feed.
    assert [(r["id"], r["heat"]) for r in e.feed(4).orderBy("id").collect()] == [(0, 65), (1, 69), (2, 7)]
    last = spark.createDataFrame([("a", datetime.datetime(2024, 1, 30, 12)), ("b", None)], "source string, last_ok timestamp")
    assert {r["source"]: r["status"] for r in e.health(last, "2024-01-30 13:00:00").collect()} == {"a": "ok", "b": "unknown"}
    answers = spark.createDataFrame([(0, '{"problem": "p", "novelty": 4}')], "id long, answer string")
    got = e.structs(spark.createDataFrame([], "id long"), answers).collect()
    assert [(r["id"], r["problem"], r["novelty"]) for r in got] == [(0, "p", 4)]
    assert e.to_enhance(2).count() == 2


# The keyed table and the cycle

ROW = "link_hash string, n long"


def added(stored, batch):
    both = stored.unionByName(batch.select("link_hash", "n"))
    return both.groupBy("link_hash").agg(F.sum("n").alias("n"))


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ROW, buckets=16)
    assert table.read().count() == 0
    everything = [(f"k{i}", 1) for i in range(200)] + [(None, 1)]
    assert len(table.merge(spark.createDataFrame(everything, ROW), 0, added)) == 16
    few = spark.createDataFrame([("k1", 5), ("k2", 7), ("new", 1)], ROW)
    touched = table.merge(few, 1, added)
    assert 1 <= len(touched) <= 3 and len(glob.glob(f"{tmp_path}/data/v1/bucket=*/*.parquet")) == len(touched)
    want = {f"k{i}": 1 for i in range(200)} | {"k1": 6, "k2": 8, "new": 1}
    assert {r["link_hash"]: r["n"] for r in table.read().collect()} == want
    # A batch that is run again starts from what stood before it.
    assert table.merge(few, 1, added) == touched and {r["link_hash"]: r["n"] for r in table.read().collect()} == want
    table.merge(spark.createDataFrame([("k1", 1)], ROW), 2, added)
    table.merge(spark.createDataFrame([("k1", 1)], ROW), 3, added)
    assert {r["link_hash"]: r["n"] for r in table.read().collect()} == want | {"k1": 8}
    assert table.versions() == [2, 3] and len(glob.glob(f"{tmp_path}/data/v*/bucket=*")) <= 18


def test_a_crash_between_data_and_manifest(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path), ROW, buckets=4)
    table.merge(spark.createDataFrame([("a", 1), ("b", 1)], ROW), 0, added)
    batch = spark.createDataFrame([("a", 10)], ROW)
    with monkeypatch.context() as m:
        m.setattr(spark.__class__, "createDataFrame", _failing(spark.createDataFrame, 2), raising=True)
        with pytest.raises(RuntimeError):
            table.merge(batch, 1, added)
    assert os.path.exists(f"{tmp_path}/data/v1") and {r["link_hash"]: r["n"] for r in table.read().collect()} == {"a": 1, "b": 1}
    table.merge(batch, 1, added)
    assert {r["link_hash"]: r["n"] for r in table.read().collect()} == {"a": 11, "b": 1}


def _failing(real, after):
    """createDataFrame, failing at its last use in a merge: that of the manifest."""
    calls = []

    def made(self, *a, **k):
        calls.append(1)
        if len(calls) >= after:
            raise RuntimeError("lost")
        return real(*a, **k)

    return made


def land(folder, name, number, stories):
    os.makedirs(f"{folder}/{name}", exist_ok=True)
    with open(f"{folder}/{name}/{number}.json", "w") as f:
        f.write(json.dumps({"hits": [{"objectID": str(i), "title": t, "url": u, "points": p, "num_comments": 0, "created_at": "2024-01-30T00:00:00Z"} for i, t, u, p in stories]}))


def test_cycle_runs_a_failed_batch_again(spark, tmp_path, monkeypatch):
    landed = f"{tmp_path}/landed"
    load = lambda s, paths: src.read_hacker_news(s, paths, most=None)
    make = lambda at: Cycle(spark, landed, f"{tmp_path}/{at}", {"one": load, "two": load}, "2024-01-31", [("zebra", "animal", "zebra")], buckets=4)
    land(landed, "one", 1, [(1, "A zebra", "http://x.y/a?ref=1", 50), (2, "Paper", "https://arxiv.org/pdf/2401.00001v2", 9)])
    land(landed, "two", 1, [(3, "Hotter", "http://x.y/a", 90)])
    a, b = make("a"), make("b")
    a.run()
    b.run()
    assert rows_of(a.feed()) == rows_of(b.feed()) and {r["link"] for r in a.feed().collect()} == {"http://x.y/a", "https://arxiv.org/abs/2401.00001"}
    land(landed, "two", 2, [(4, "Other zebra", "http://x.y/b", 5), (3, "Hotter", "http://x.y/a", 95)])
    with open(f"{landed}/one/2.json", "w") as f:
        f.write("{broken")
    a.run()
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "merge", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            b.run()
    assert b.table.versions() == [0]
    b.run()
    assert b.table.versions() == [0, 1] and rows_of(a.feed()) == rows_of(b.feed()) and rows_of(a.table.read()) == rows_of(b.table.read())
    got = {r["link"]: (r["fetch_count"], r["is_new"]) for r in b.table.read().collect()}
    assert got == {"http://x.y/a": (2, False), "http://x.y/b": (1, True), "https://arxiv.org/abs/2401.00001": (1, True)}
    assert {(r["source"], r["run"]): r["items"] for r in b.runs().collect()} == {("one", 0): 2, ("two", 0): 1, ("two", 1): 2}
    b.run()
    assert b.table.versions() == [0, 1]


def test_a_go_is_one_batch_whatever_its_files(spark, tmp_path, monkeypatch):
    """SQL ranks a go as a whole: split at so many files a batch, items of one go would not meet."""
    odd = "a\tb  c\u00a0d\u2003e,f.g \U0001f600 h\n\n<i>&amp; É_x "
    rows = [(25 * i, f"{odd * 3}{i}", "en", "s", 9) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = {r["doc_id"]: r["body"] for r in reports._docs(spark, str(tmp_path)).collect()}
    assert made == {i: re.sub(r"\s+", " ", re.sub("[^A-Za-z0-9 .,]", " ", text)).strip(" ") for i, text, *_ in rows}
    assert "GreaterThanOrEqual(doc_id,1488)" in streams.ranges(reports._docs(spark, str(tmp_path)), "doc_id", 2)[1]._jdf.queryExecution().executedPlan().toString()
    default = Cycle.__init__.__defaults__
    monkeypatch.setattr(Cycle.__init__, "__defaults__", default[:-2] + (1,) + default[-1:])
    cycle = reports._cycled(spark, str(tmp_path))
    assert cycle.table.versions() == [0, 1]
    # Files lie in one folder for each source and go, which is listed at once.
    files = glob.glob(f"{cycle.landed.removeprefix('file:')}/**/part-*", recursive=True)
    assert len(files) == 4 * 3 + 3 * 3 and len({os.path.dirname(f) for f in files}) == 7
    assert sum(r["items"] for r in cycle.runs().where("run = 0").collect()) > 20


def test_shipped_anchors_are_one_token_each(spark):
    assert all(re.fullmatch(terms.STEMS, x) or "_" in x or x.isalpha() for x in lexicons.ANCHORS)
