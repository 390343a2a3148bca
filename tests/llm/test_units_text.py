"""Tokenising, packing, token counts, page text and URL rules against libraries and brute force."""

import hashlib
import os
import random
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe, extract, packing, tokencount, units, urls

ODD = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "日本", "🙂", "1", "22", "!", "...", "<|endoftext|>", "aaa", "İ", "x́", "\x1c", "\r\n", "▁", "٣", "ing"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["", " ", "a " * 3000, *("".join(r.choice(ODD) for _ in range(r.randint(0, 30))) for _ in range(n))]


@pytest.fixture(scope="module")
def exact():
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


def test_encode_decode(spark, exact):
    many = odd_texts(300)
    rows = [(i, t) for i, t in enumerate(many)] + [(None, "x y"), (5000, None), (0, many[0])]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe.encode_decode(docs(spark, [(*r, 1, "z") for r in rows], ", n_tokens int, id string"), path, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in rows:
        ids = exact.encode_ordinary(t or "")
        assert by_id[i]["ids"] == ids and by_id[i]["n_tokens"] == len(ids)
        assert by_id[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert by_id[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and bytes(by_id[i]["decoded"]) == (t or "").encode()
    library = bpe.from_ranks(path, public_tokenizers.PATTERN)
    for i, t in rows:
        assert list(zip(by_id[i]["starts"], by_id[i]["ends"])) == library.encode(t or "", add_special_tokens=False).offsets, t


def test_decode_ids(spark, exact):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    many = [exact.encode_ordinary(t) for t in odd_texts(100, 5)] + [exact.encode_ordinary("🙂")[:1], exact.encode_ordinary("日本")[1:], None, []]
    table = spark.createDataFrame([(i, x, "z") for i, x in enumerate(many)] + [(0, many[0], "z"), (None, [64], "z")], "doc_id long, ids array<int>, text string")
    got = bpe.decode(table, path, public_tokenizers.PATTERN).collect()
    assert len(got) == len(many) + 2
    for r in got:
        want = None if r["doc_id"] is None else many[r["doc_id"]]
        raw = b"a" if r["doc_id"] is None else None if want is None else exact.decode_bytes(want)
        assert (None if r["decoded"] is None else bytes(r["decoded"])) == raw and r["text"] == (None if raw is None else raw.decode("utf-8", "replace"))
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>"), path, public_tokenizers.PATTERN).collect()


def test_encoding_edges(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = bpe.from_ranks(path, public_tokenizers.PATTERN)
    long = ["a" * 300_000, " " * 100_000 + "x", "ab" * 1000 + "\n" * 50_000]
    got = bpe.encode_decode(docs(spark, list(enumerate(long))), path, public_tokenizers.PATTERN).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(long)}
    assert bpe.encode_decode(docs(spark, []), path, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t'1é!"), max_size=25))
def test_chunks_do_not_change_ids(text):
    cut = units.chunks(text)
    assert " ".join(cut) == text
    assert [w for i, c in enumerate(cut) for w in _find(f" {c}" if i else c)] == _find(text)


def _find(text):
    import regex

    return regex.findall(public_tokenizers.PATTERN, text)


def check_pieces(got, want, size):
    """Each id of each document lies in one piece; sequences have no gaps and are full, or a power of two."""
    import numpy as np

    ends: dict = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[r["doc_id"]]
        assert r["start"] == ends.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids) and r["length"] > 0
        ends[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : ends[r["doc_id"]]], "<u4").tobytes())
    assert ends == {i: len(x) for i, x in want.items()}
    sequences: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= size and n & (n - 1) == 0 for n in sequences.values())


def test_pack_places_each_id_once(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    many = odd_texts(120, 3)
    assert any("<|endoftext|>" in x for x in many)
    rows = [(i, x) for i, x in enumerate(many)] + [(9000, None)]
    got = packing.pack(docs(spark, rows), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, size=64, partitions=3).collect()
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    check_pieces(got, want, 64)
    odd = spark.createDataFrame([(None, "x y", 1, "z"), (3, "a b", 1, "z"), (3, "a b", 1, "z"), (4, None, 1, "z"), (5, "w" * 9000, 1, "z")], "doc_id long, text string, key int, length string")
    pieces = packing.pack(odd, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, size=64, partitions=2).collect()
    lengths = {x: len(t.encode(x, add_special_tokens=False).ids) + 1 for x in ("x y", "a b", "", "w" * 9000)}
    assert sum(r["length"] for r in pieces) == sum(lengths.values()) + lengths["a b"]
    assert [sum(r["length"] for r in pieces if r["doc_id"] == i) for i in (None, 3, 4, 5)] == [lengths["x y"], 2 * lengths["a b"], 1, lengths["w" * 9000]]
    assert packing.pack(docs(spark, []), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == 0


def test_packing_ids_are_the_librarys():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), packing.Encoder(path, public_tokenizers.PATTERN)
    assert e.fast and e.ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    many = [*odd_texts(2000, 11), " " * 300_000, "a" * 200_000, "\n " * 100_000, "日本" * 50_000, *t.get_vocab()]
    many += [f"a{chr(c)}1{chr(c)} {chr(c)}!" for c in range(0, 0x30000, 37) if not 0xD800 <= c < 0xE000]
    for x, made in zip(many, t.encode_batch(many, add_special_tokens=False), strict=True):
        assert e.ids(x).tolist() == made.ids, x[:60]


def test_hilbert_is_a_curve():
    import numpy as np

    grid = np.array([[i, j, k] for i in range(4) for j in range(4) for k in range(4)])
    keys = packing.hilbert_keys(grid, 2)
    assert sorted(keys) == list(range(64))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_token_counts(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    v = tokencount.read_vocabulary(path)
    t = Tokenizer(models.Unigram([("<unk>", min(s for _, s in v)), *v], unk_id=0))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rows = [(i, x) for i, x in enumerate(odd_texts(400, 7))] + [(None, None)]
    rows += [(9001, "a" * 20_000), (9002, "🙂 " * 3000), (9003, "  a  b  ")]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(docs(spark, rows), path).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in rows}
    clash = spark.createDataFrame([(1, "a b", 7, 8), (1, "a b", 7, 8)], "doc_id long, text string, id int, n_tokens int")
    assert len({tuple(r) for r in tokencount.token_counts(clash, path).collect()}) == 1 and tokencount.token_counts(clash, path).count() == 2
    assert tokencount.token_counts(docs(spark, []), path).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_token_count_queries(spark):
    """The registered encoding, packing and counting queries on whole tables, against the libraries."""
    import tiktoken
    from tokenizers import Tokenizer, models, pre_tokenizers

    at = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = {r["doc_id"]: r for r in bpe.op2_byte_bpe(spark, at).collect()}
    for i, x in rows.items():
        ids = exact.encode_ordinary(x)
        assert encoded[i]["n_tokens"] == len(ids) and encoded[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and encoded[i]["decoded_sha256"] == hashlib.sha256(x.encode()).hexdigest()
    v = tokencount.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram([("<unk>", min(s for _, s in v)), *v], unk_id=0))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counted = {r["doc_id"]: r["n_tokens"] for r in tokencount.op7_token_counts(spark, at).collect()}
    assert counted == dict(zip(rows, (len(e.ids) for e in t.encode_batch(list(rows.values()), add_special_tokens=False))))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: [*e.ids, 1] for i, e in zip(rows, library.encode_batch(list(rows.values()), add_special_tokens=False))}
    check_pieces(packing.op3_curve_packing(spark, at).collect(), want, 2048)


RULES = [("com", "/", "block"), ("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("b.a.com", "", "block"), ("com", "/x/y", "block"), ("", "/q", "block"), ("net", "/de/", "allow")]


def by_hand(host, path):
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return None, "allow"
    best = max(f[:3] for f in fits)
    return best[2], "allow" if any(f[:3] == best and f[3] == "allow" for f in fits) else "block"


def test_url_rules(spark):
    r = random.Random(4)
    part = lambda: r.choice(["a", "b", "com", "net", "", "aa", "COM"])
    many = [None, "", "no", "http://", "://a.com", "http://com/x/y?q", "http://b.a.com#f", "http://x.a.com/x/y/z"]
    many += ["http://" + ".".join(part() for _ in range(r.randint(1, 4))) + r.choice(["", "/", "/x", "/x/y", "/de/", "?a", "/q"]) for _ in range(500)]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(many * 2)], "page_id long, url string, host string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block")], "host string, path string, verdict string")
    got = urls.judge(pages, rules).collect()
    assert len(got) == len(many) * 2
    for row in got:
        assert (row["rule"], row["verdict"]) == by_hand(row["host"], row["path"]), row
    one = {x["page_id"]: x for x in got}
    assert (one[0]["host"], one[0]["path"]) == ("", "") and (one[5]["host"], one[5]["path"]) == ("com", "/x/y")
    odd = spark.createDataFrame([(None, "http://com/", "p", "r"), (5, "http://com/", "p", "r"), (5, "http://com/", "p", "r"), (6, "http://" + "a." * 20_000 + "com/" + "x" * 100_000, "p", "r")], "page_id long, url string, path string, rule string")
    got = urls.judge(odd, rules).collect()
    assert sorted(str(r["page_id"]) for r in got) == ["5", "5", "6", "None"] and all((r["rule"], r["verdict"]) == by_hand(r["host"], r["path"]) for r in got)
    assert urls.judge(pages.limit(0), rules).count() == 0 and urls.judge(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(many) * 2


BODY = "<main><article class='post-12'><h1>Head &amp; line</h1><p>First <b>bold</b>er&nbsp; text that is long enough to count here.<p>Second,\n line that also is long enough.<div class='share'>no</div><ul><li>one<li>two</ul></article></main>"
PAGE = "<html><head><title>t</title><style>x</style></head><body class='has-sidebar'><header>top</header><nav><a href=/>menu</a></nav>%s<div id=comments><p>A reader says something quite long, longer than the article itself, in fact much longer than all that it says, on and on.</p></div><form>f</form><aside>s</aside><div class='cookie-notice'>c</div><script>var a='</p>';</script><!-- <p>x</p> --><footer>end</footer></body></html>"


def reference_text(page):
    """What the generator below put into the article."""
    return " ".join(" ".join(x.split()) for x in page)


def generated_pages(n, seed=8):
    """Pages of several layouts with their articles' blocks."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeilnorst") for _ in range(r.randint(2, 9)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize() + "."
    for i in range(n):
        layout, blocks, body = i % 4, [], ""
        for _ in range(r.randint(2, 9)):
            t = say(12, 50)
            kind = r.choice(["p", "p", "p", "ul", "h2", "blockquote", "div"])
            if kind == "ul":
                items = [say(2, 5) for _ in range(3)]
                body += "<ul>" + "".join(f"<li>{x}" + "</li>" * r.randint(0, 1) for x in items) + "</ul>"
                blocks += items
            else:
                shown = t.replace(" ", r.choice([" ", "  ", "\n", " <b>", "&#32;"]), 1)
                body += f"<{kind}>{shown}{'</b>' * ('<b>' in shown)}" + r.choice([f"</{kind}>", "" if kind == "p" else f"</{kind}>"])
                blocks.append(t)
            if r.random() < 0.3:
                body += r.choice([f"<div class='share-bar'>{say(3, 9)}</div>", f"<script>var x = '<p>{word()}</p>';</script>", f"<!-- {word()} <p> -->", f"<aside>{say(5, 30)}</aside>", f"<form><p>{say(3, 5)}</p></form>", f"<div id=newsletter-box>{say(9, 30)}</div>"])
        article = [f"<article>{body}</article>", f"<main class='layout has-sidebar'><div class='entry'>{body}</div></main>", f"<div class='post-content with-comments' data-n='{i}'>{body}</div>", f"<table><tr><td class=text>{body}</td></tr></table>"][layout]
        menu = "".join(f"<li><a href=/{word()}>{word()}</a>" for _ in range(8))
        comments = "".join(f"<article class='comment'><p>{say(20, 60)}</p></article>" for _ in range(r.randint(0, 6)))
        page = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p > a {{}}</style></head><body class='no-header'><header><p>{say(9, 30)}</p></header><nav><ul>{menu}</ul></nav><div class='ad-slot'>{say(5, 40)}</div>{article}<section id='comments'>{comments}</section><div class='sidebar'>{say(9, 60)}</div><footer>{say(5, 20)}</footer></body></html>"
        yield i, f"https://host{layout}.example/{i}", page, reference_text(blocks)


def test_main_text_of_generated_pages(spark):
    pages = list(generated_pages(240))
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")).collect()}
    wrong = [(i, got[i][:200], want[:200]) for i, _, _, want in pages if got[i] != want]
    assert not wrong, (len(wrong), wrong[0])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_main_text_query(spark):
    import html
    import re

    at = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in extract.op4_main_text(spark, at).collect()}
    rows = spark.read.parquet(f"{at}/pages.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        inner = row["html"][row["html"].index("<article>") : row["html"].index("</article>")]
        inner = re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", inner, flags=re.S)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br|ul|li|article|div)\b[^>]*>", " ", inner))).split())
        assert got[row["page_id"]]["text"] == want and got[row["page_id"]]["n_chars"] == len(want) and got[row["page_id"]]["url"] == row["url"]


@pytest.mark.parametrize("name", ["main-content has-sidebar", "no-header", "with-comments", "social-article"])
def test_a_states_name_does_not_hide_the_article(name):
    for inner in ("<article><p>The text of it.</p></article>", "<p>The text of it.</p>", "<main>The text of it.</main>"):
        page = f"<body><nav>menu</nav><div class='{name}'>{inner}</div><div class='comments'><article class=comment>A remark.</article></div><div class='related-article'>Other.</div></body>"
        assert extract.Page(page).main_text([]) == "The text of it."


@pytest.mark.parametrize("source", ["<script " * 100_000, "<a '" * 100_000, "<a '>'" * 80_000, "<a \"'>" * 80_000, "<div>" * 80_000 + "</section>" * 80_000, "<div class='a b'>" * 50_000 + "x" + "</b>" * 50_000, "<!--" * 100_000, "<" * 400_000, "<ul><li>x" * 40_000, "</script" * 100_000])
def test_hostile_pages_take_linear_time(source):
    import time

    began = time.process_time()
    page = extract.Page(source)
    page.main_text([])
    assert time.process_time() - began < 5 and sum(map(len, page.paths)) <= 32 * len(page.paths)


def test_main_text(spark):
    text = "Head & line First bolder text that is long enough to count here. Second, line that also is long enough. one two"
    short = "<main><article class='post-7'><p>Tiny.</p></article></main>"
    rows = [(1, "http://h.x/1", PAGE % BODY), (2, "http://h.x/2", PAGE % BODY), (3, "http://h.x/3", PAGE % short), (4, None, None), (5, "http://h.x/5", ""), (6, "http://y.x/", "plain < text"), (1, "http://h.x/1", PAGE % BODY)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, n_chars int")
    for limit in (10, 0):
        got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract.extract(pages, broadcast_rows=limit).collect()}
        assert got == {1: (text, len(text)), 2: (text, len(text)), 3: ("Tiny.", 5), 4: ("", 0), 5: ("", 0), 6: ("plain < text", 12)}
    assert extract.extract(pages.limit(0)).count() == 0
