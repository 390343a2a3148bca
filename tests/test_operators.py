"""Hand-computed cases for the operators."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import lexicons, links, scores, text
from tidemark.operators import digest, enrich, entities, feed, insights, runs, scoring, taxonomy, terms
from tidemark.plans.engine import Engine, bounded
from tidemark.sources import articles as src


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://arxiv.org/pdf/2301.07041v3.pdf", "https://arxiv.org/abs/2301.07041"),
        ("https://arxiv.org/abs/cs/0012053v2", "https://arxiv.org/abs/cs/0012053"),
        ("https://GitHub.com/Own/Repo.git/tree/main", "https://github.com/own/repo"),
        ("https://gist.github.com/a/b/", "https://gist.github.com/a/b"),
        ("https://github.com/settings/x", "https://github.com/settings/x"),
        ("HTTP://X.com/a/?utm_source=f&b=1&ref=z#top", "http://x.com/a?b=1"),
        ("http://x.com/?b=%20c&c&d=%zz*~&REF=1", "http://x.com/?b=+c&c=&d=%25zz%2A~"),
        ("no host", "no host"),
        ("ftp://X.com/a/", "ftp://X.com/a/"),
        (None, ""),
    ],
)
def test_canonical_link(spark, url, want):
    assert one(spark, links.canonical_link, url) == want


def test_tokens(spark):
    assert one(spark, text.tokens, "State-of-the-art GPT4模型 a 3x llm_s") == ["state_of", "the_art", "llm_s"]
    assert one(spark, lambda c: text.tokens(c, stop=["dataset"]), "datasets dataset other") == ["other"]
    assert one(spark, lambda c: text.tokens(c, lexicon=[("kv cache", "kv_cache")]), "A KV cache, here") == ["kv_cache", "here"]
    assert one(spark, text.tokens, None) == []


@pytest.mark.parametrize(("raw", "want"), [("2024-1-5", "2024-01-05"), (None, "None"), ("Sun, 31 Mar 2024 10:00:00 GMT", "2024-03-31"), ("Tue, 31 Ma", "None")])
def test_dates(spark, raw, want):
    assert str(one(spark, text.event_date, raw)) == want


def test_tag_list_and_sidecar(spark):
    assert one(spark, text.tag_list, '["a","b"]') == ["a", "b"]
    assert one(spark, text.tag_list, "a, b,") == ["a", "b"]
    assert one(spark, lambda c: text.sidecar(c, "k"), "{bad") is None


def items(spark, rows):
    return spark.createDataFrame(rows, "id long, link string, type string, title string, desc string, event_date date, venue string, heat int, arxiv_id string")


def item(id, link="l", type="news", title="t", heat=1, day=1, venue="v", arxiv=None):
    import datetime

    return (id, link, type, title, "", datetime.date(2024, 1, day), venue, heat, arxiv)


def test_keep_best(spark):
    rows = items(spark, [item(1, heat=5, day=1), item(2, heat=5, day=2), item(3, heat=5, day=2), item(4, link="")])
    assert [r["id"] for r in feed.keep_best(rows).collect()] == [2]


@pytest.mark.parametrize(("others", "papers", "want"), [(100, 40, (67, 28)), (10, 200, (10, 85)), (120, 5, (90, 5)), (0, 0, (0, 0))])
def test_paper_floor(spark, others, papers, want):
    rows = items(spark, [item(i, link=str(i), heat=i) for i in range(others)] + [item(1000 + i, link=f"p{i}", type="paper") for i in range(papers)])
    got = [r["type"] for r in feed.paper_floor(rows).collect()]
    assert (got.count("news"), got.count("paper")) == want


def test_bonus(spark):
    rows = items(spark, [item(1, venue="a", arxiv="x"), item(2, venue="b", arxiv="x"), item(3, title="deep blue sea", venue="a"), item(4, title="sea deep blue", venue="b"), item(5, title="blue sea deep", venue="c", heat=990), item(6, venue="a", arxiv="y")])
    assert {r["id"]: r["new_heat"] for r in feed.cross_source_bonus(rows).collect()} == {1: 61, 2: 61, 3: 31, 4: 31, 5: 999, 6: 1}


def test_momentum_without_past(spark):
    rows = spark.createDataFrame([(1, "paper", 10, "e", "c"), (2, "repo", 20, "e", "c")], "id long, type string, heat int, entity_id string, category string")
    r = entities.momentum(rows, F.lit(True), F.lit(False), 5).first()
    assert (r["mentions"], r["types"], r["velocity"], r["trend"]) == (2, 2, 3.0, "rising")
    assert r["composite"] == pytest.approx(math.log1p(30) + 2 * math.log1p(2) + 4.5 + 3.0, abs=0.006)
    assert entities.emergence(rows, F.lit(True), F.lit(False), 5).first()["is_new"]


def test_npmi_of_one_bigram_does_not_fail(spark):
    rows = terms.tokenized(items(spark, [item(1, title="alpha beta")]), "2024-01-31")
    assert terms.npmi(rows, 10).count() <= 3
    assert terms.tfidf(rows.limit(0), 5).count() == 0


def test_heat_channels(spark):
    fields = ", ".join(f"{n} int" for n in src.ENGAGEMENT)
    base = {"type": "news", "venue": "Elsewhere", "link": "", "title": "", "desc": "", "event_date": None, "gh_full_name": None}

    def heat(**over):
        row = {**base, **dict.fromkeys(src.ENGAGEMENT), **over}
        schema = f"type string, venue string, link string, title string, desc string, event_date date, gh_full_name string, {fields}"
        return spark.createDataFrame([tuple(row[k] for k in ("type", "venue", "link", "title", "desc", "event_date", "gh_full_name", *src.ENGAGEMENT))], schema).select(scores.heat("2024-01-31")).first()[0]

    rec = math.exp(-45 / 28)
    assert heat() == 155 + int(110 * rec)
    assert heat(type="paper") == 138 + int(185 * rec)
    assert heat(venue="Hacker News", link="https://arxiv.org/abs/1") == 138 + int(185 * rec)
    assert heat(venue="Hacker News", hn_points=10**6, hn_comments=10**6) == 265 + 240 + int(138 * rec)
    assert heat(venue="OpenAI Blog") == 280 + int(180 * rec)
    assert heat(venue="BAIR") == 230 + int(165 * rec)
    assert heat(venue="GitHub", gh_stars=10**9, gh_forks=10**9, gh_open_issues=10**9, gh_full_name="openai/x") == 198 + 188 + 112 + 58 + 88 + int(100 * rec)
    assert heat(venue="huggingface:x", upvotes=10**9) == 145 + 180 + int(178 * rec)


def test_summary_and_bloom(spark):
    rows = spark.createDataFrame([("rss", "unchanged"), ("arxiv", "success"), ("github", "error")], "source string, outcome string")
    assert tuple(runs.fetch_summary(rows).first()) == (3, 2, 1, 1, "partial")
    assert runs.bloom_size() == (1437758, 9)


def test_landed_files(spark, tmp_path):
    (tmp_path / "hn.json").write_text(json.dumps({"hits": [{"objectID": "1", "title": "A", "url": "", "points": 9, "num_comments": 0}, {"objectID": "2", "title": "B", "url": "http://b.c/", "points": 1, "num_comments": 1}]}))
    got = src.read_hacker_news(spark, str(tmp_path / "hn.json")).collect()
    assert [(r["link"], r["hn_points"]) for r in got] == [("https://news.ycombinator.com/item?id=1", 9)]
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>T</title><link>http://x.y/z?ref=1</link><description>a &lt;b&gt;c&lt;/b&gt;</description><pubDate>Sun, 31 Mar 2024 10:00:00 GMT</pubDate></item></channel></rss>")
    r = src.read_rss(spark, str(tmp_path / "feed.xml")).first()
    assert (r["link"], r["desc"], str(r["event_date"]), r["venue"]) == ("http://x.y/z", "a c", "2024-03-31", "feed")


def test_references_as_the_standard_library_has_them(spark):
    import html

    many = ["a &amp; b", "&copy; &copy &notin; &notit;", "&#65;&#x42;&#67", "&#0;&#x110000;&#xD800;", "&#128;&#129;&#x9f;", "&bogus; & &; &#; &#x;", "&ampersand &lt;b&gt;", "&NotEqualTilde;&Aacute;", "no reference", "&&amp;&", "&#128512;"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in many], "x string").select(text.unescaped(F.col("x"))).collect()]
    assert got == [html.unescape(x) for x in many]
    assert one(spark, text.strip_html, "<p>a&nbsp;&#8364;\n b</p>") == "a € b"


def test_references_that_were_cut_stay_where_only_closed_ones_count(spark):
    """A page's title is cut within a reference, as on sf0.1."""
    stripped = lambda x: one(spark, lambda c: text.strip_html(c, closed=True), x)
    assert stripped("<p>unds&&&amp</p> &am <b>&lt;&amp;lt;&#39;&#x41;</b>&copy &copy;&bogus;") == "unds&&&amp &am <&lt;'A &copy ©&bogus;"
    assert one(spark, text.strip_html, "<p>a &amp</p>") == "a &"


def test_upsert_in_order(spark):
    schema = "link_hash string, type string, title string, desc string, event_date date, venue string, heat int, tags array<string>, raw_data string"
    row = lambda key, title, heat, raw, *more: (key, "news", title, "", None, "v", heat, ["t"], raw, *more)
    stored = spark.createDataFrame([row("a", "old", 5, '{"x": {"y": 1}, "z": 1}', 2), row("b", "kept", 7, "bad", 1)], f"{schema}, fetch_count int")
    incoming = spark.createDataFrame([row("a", "late", 5, '{"z": "n\\"q"}', 9), row("a", "first", 8, '{"z": 2, "w": [1]}', 3), row("c", "new", 1, None, 4), row(None, "x", 1, None, 5)], f"{schema}, arrival long")
    got = {r["link_hash"]: r for r in feed.upsert(stored, incoming).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"]["title"], got["a"]["fetch_count"], got["a"]["is_new"], got["a"]["heat_changed"]) == ("late", 4, False, False)
    assert json.loads(got["a"]["raw_data"]) == {"x": {"y": 1}, "z": 'n"q', "w": [1]}
    assert (got["b"]["title"], got["b"]["fetch_count"], got["b"]["raw_data"]) == ("kept", 1, "bad")  # nothing came for it: it stays as it is
    assert (got["c"]["fetch_count"], got["c"]["is_new"]) == (1, True)


def test_atom_and_topic_files(spark, tmp_path):
    atom = "<feed xmlns='http://www.w3.org/2005/Atom'>%s</feed>"
    entry = "<entry><title>%s</title>%s<summary>s &lt;i&gt;x&lt;/i&gt;</summary><updated>2024-02-0%dT00:00:00Z</updated></entry>"
    body = entry % ("A", "<link rel='self' href='http://s/'/><link href='http://x.y/a?ref=1'/>", 1) + entry % ("B", "<link rel='self' href='http://s/b'/>", 2) + entry % ("", "<link href='http://x.y/c'/>", 3)
    (tmp_path / "blog.xml").write_text(atom % body)
    got = {r["title"]: (r["link"], r["desc"], str(r["event_date"]), r["venue"]) for r in src.read_rss(spark, str(tmp_path / "blog.xml")).collect()}
    assert got == {"A": ("http://x.y/a", "s x", "2024-02-01", "blog"), "B": ("http://s/b", "s x", "2024-02-02", "blog")}
    paper = "<entry><id>http://arxiv.org/abs/2401.0000%dv1</id><title>T\n%d</title><summary>%s</summary><published>2024-01-0%dT10:00:00Z</published><arxiv:primary_category xmlns:arxiv='http://arxiv.org/schemas/atom' term='cs.AI'/></entry>"
    folder = tmp_path / "papers"
    folder.mkdir()
    (folder / "agents.xml").write_text(atom % "".join(paper % (i, i, "x" * 400, i) for i in (1, 2, 3)))
    (folder / "rag.xml").write_text(atom % "".join(paper % (i, i, "short", i) for i in (3, 4)))
    rows = src.read_arxiv(spark, str(folder), each={"agents": 2, "rag": 1}).collect()
    assert [r["link"][-5:] for r in rows] == ["00004", "00003", "00002"] and rows[0]["title"] == "T 4" and rows[0]["venue"] == "cs.AI" and len(rows[2]["desc"]) == 321
    assert src.read_arxiv(spark, str(folder), most=1).count() == 1


def test_engine_bounds(spark):
    engine = Engine(items(spark, [item(1, day=30), item(2, link="m", day=1)]), "2024-01-31")
    assert engine.recent(5).count() == 1 and engine.recent(30, " ").count() == 2
    assert [x.count() for x in engine.windows(7, 3)] == [1, 0] and [x.count() for x in engine.windows(7, 30)] == [1, 1]
    for wrong in (lambda: engine.recent(366), lambda: engine.word_freq(type="blog"), lambda: engine.word_freq(top_k=201), lambda: engine.windows(91, 100), lambda: engine.entities(category="x"), lambda: engine.trending(top_k=0)):
        with pytest.raises(ValueError):
            wrong()
    assert [bounded(x, 5, 1, 9) for x in (None, "x", "0", "7", "99")] == [5, 5, 1, 7, 9]
    assert engine.feed(1).count() == 1 and engine.feed(2).count() == 2


def test_shipped_words(spark):
    say = lambda x: one(spark, lambda c: text.tokens(c, (), lexicons.CONCEPTS, lexicons.COMPOUNDS), x)
    assert say("Retrieval-Augmented Generation for LLMs with a KV cache") == ["rag", "for", "llm", "with", "kv_cache"]
    assert one(spark, lambda c: terms.high_value(F.split(c, " "), lexicons.ANCHORS), "my_llm_tool x") and not one(spark, lambda c: terms.high_value(F.split(c, " "), lexicons.ANCHORS), "exploration dragon")


def test_digest_and_writer(spark):
    rows = spark.createDataFrame([(*item(i, link=f" l{i} ", heat=i)[:],) for i in (1, 2)], items(spark, []).schema)
    kept = spark.createDataFrame([], "fingerprint string, text string, written boolean")
    for writer, text_is, written in ((None, "Items: 2. No writer is configured.", False), (lambda m: "short", "Items: 2. No writer is configured.", False), (lambda m: m * 3, None, True)):
        r = digest.digest(rows, kept, "2024-01-31", writer).first()
        assert r["written"] == written and not r["cached"] and (text_is is None or r["text"] == text_is) and r["fingerprint"].startswith("2024-W05:")
    assert digest.digest(rows.limit(0), kept, "2024-01-31").count() == 0
    assert insights.headline(insights.insights(rows, terms.tokenized(rows, "2024-01-31"), F.array(F.lit("x")))).count() >= 2


def test_answers(spark):
    rows = spark.createDataFrame([(1, "good", "d"), (2, "bad", None)], "id long, title string, desc string")

    def ask(title, body):
        if title == "bad":
            raise RuntimeError("no answer")
        return f'```json\n{{"score": 12, "title": "{title}"}}\n```'

    got = enrich.with_answers(rows, ask).select("id", scoring.answered_score(F.col("answer")).alias("s")).collect()
    assert {r["id"]: r["s"] for r in got} == {1: 10.0, 2: None}
    read = lambda x: one(spark, scoring.paper_struct, x)
    assert read("[1]") is None and read("no") is None and read(None) is None
    assert read('{"novelty": 9, "method": "m"}')["novelty"] == 5 and read('{"novelty": "x"}')["novelty"] == 3 and read("```\n{}\n```")["problem"] == ""
    scored = scoring.score_missing(items(spark, [item(1), item(2)]), spark.createDataFrame([(1,)], "id long"), [taxonomy.Domain("d", 1.0, ("t",))])
    assert [(r["id"], r["method"]) for r in scored.collect()] == [(2, "rule")]


def test_kept_validators(spark, tmp_path):
    lines = [{"url": "a", "etag": "1", "cached_at": "2024-01-30T00:00:00"}, {"url": "b", "etag": "2", "cached_at": "2023-01-30T00:00:00"}, {"url": "c", "last_modified": "m"}]
    (tmp_path / "etags.json").write_text("\n".join(map(json.dumps, lines)))
    kept = src.read_etags(spark, str(tmp_path), "2024-01-31 00:00:00")
    assert {r["url"] for r in kept.collect()} == {"a", "c"}
    seen = spark.createDataFrame([("a", "1", None), ("b", "2", None), ("c", None, "m"), ("d", None, None)], "url string, etag string, last_modified string")
    assert {r["url"] for r in src.changed(seen, kept).collect()} == {"b", "d"}


def test_tokens_and_tags_are_worked_out_once(spark):
    """No filter that the optimiser puts before an explode makes the tokens, the tags or the places of forms once more."""
    from tidemark.operators import entities, terms

    rows = spark.createDataFrame([(i, "a b c. " * i, "b c d " * i, "paper", "2024-01-30", 5) for i in range(1, 6)], "id long, title string, desc string, type string, day string, heat int")
    rows = rows.withColumn("event_date", F.col("day").cast("date"))
    found = terms.tokenized(rows, "2024-01-31")
    ranked = spark.createDataFrame([("aa",)], "key string")
    for frame in (terms.tfidf(found, 5), terms.npmi(found, 5), terms.keyword_counts(found, 5), terms.topic_evidence(ranked, found, 2), terms.tag_degree(rows), entities.extracted(rows, [("x", "y", "bb")])):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.split("\n") if "Filter" in x and ("regexp_extract_all" in x or "Contains" in x)]


def test_phrases_take_their_totals_from_their_counts(spark):
    from tidemark.operators import terms

    rows = spark.createDataFrame([("paper", "ab cd", "ab cd ef ab cd"), ("news", "", "xx yy xx yy xx yy zz"), ("news", "", "")], "type string, title string, desc string").selectExpr("type", "title", "desc", "1L as id", "5 as heat", "date'2024-01-30' as event_date")
    found = terms.Terms.of(terms.tokenized(rows, "2024-01-31"), phrases=True)
    words = {k: sum(r[c] for r in found.totals.collect() if k in ("", r["type"])) for k in ("", "paper", "news") for c in ("tokens",)}
    assert words == {"": 18, "paper": 11, "news": 7}
    whole, split = {(r["a"], r["b"]): r for r in found.phrases(9).collect()}, {(r["type"], r["a"], r["b"]): r for r in found.phrases(9, ["type"]).collect()}
    p = 5 / 16  # of sixteen neighbours five are these
    import math

    assert whole["ab", "cd"]["n"] == 5 and whole["ab", "cd"]["score"] == pytest.approx(100 * math.log(p / (5 / 18) ** 2) / -math.log(p), abs=0.051)
    assert set(split) >= {("news", "xx", "yy")} and set(whole) >= {("xx", "yy")}


def test_fixed_parts_of_patterns_change_no_result(spark):
    words = ["an llm.", "ällm", "llms", "flash attn", "flashattn", "flash--attn", "multi\nagent", "multiagent", "inference", "ainference", "moe x", "12 3456", "", "quelque que"]
    for pattern in [p for _, ps in text.TAG_RULES for p in ps] + [r"\bque\b", r"\d{4}"]:
        got = spark.createDataFrame([(w,) for w in words], "x string").select(text.matches(F.col("x"), pattern), F.col("x").rlike(f"(?U){pattern}")).collect()
        assert all(a == b for a, b in got), pattern


def test_texts_without_references_stay_in_the_engine(spark):
    """Python is sent null for them: whole texts in batches of ten thousand rows took its memory."""
    rows = spark.createDataFrame([("a<b>c &lt; d",), ("none",), ("",), (None,)], "x string").select(text.strip_html(F.col("x")).alias("y"))
    assert [r["y"] for r in rows.collect()] == ["a c < d", "none", "", ""]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "unescaped(CASE WHEN Contains(" in plan


def test_a_text_is_lower_cased_once_for_all_tags(spark):
    frame = spark.createDataFrame([("Some LLM and RAG",)], "x string").select(text.infer_tags(F.col("x")).alias("t"))
    assert frame._jdf.queryExecution().analyzed().toString().count("lower(") == 1 and frame.first()["t"] == ["llm", "rag"]
