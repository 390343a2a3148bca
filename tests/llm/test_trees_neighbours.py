"""The Merkle manifest, the prefix trie and the adaptive scan against SQL and brute force."""

import os
import random
import zlib
from collections import defaultdict
from functools import reduce
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_catalog import ordered

from tidemark.llm import merkle, neighbours, ordered as order, prefixes
from tidemark.llm.urls import OP6_SQL, op6_url_rules

DATA = "/root/testdata/sf0.01"
has_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def in_duckdb(sql, data=DATA):
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        if os.path.exists(f"{data}/{table}.parquet"):
            con.execute(f"create view {table} as select * from read_parquet('{data}/{table}.parquet')")
    done = con.execute(sql)
    return ordered(done.fetchall(), [c[0] for c in done.description])


def plain(frame):
    return ordered([tuple(r) for r in frame.collect()], frame.columns)


@has_tables
@pytest.mark.parametrize("query, sql", [(merkle.op11_merkle_manifest, merkle.OP11_SQL), (prefixes.op12_prefix_trie, prefixes.OP12_SQL), (op6_url_rules, OP6_SQL)])
def test_as_sql(spark, query, sql):
    assert plain(query(spark, DATA)) == in_duckdb(sql)


# Merkle manifest


def top(values, arity=8):
    while len(values) > 1:
        values = [merkle.digest(*values[i : i + arity]) for i in range(0, len(values), arity)]
    return values[0]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(2, 9), st.randoms(use_true_random=False))
def test_forest_is_a_commutative_monoid(n, arity, r):
    leaves = [f"{i:064x}".encode() for i in range(n)]
    parts = [merkle.Forest(arity) for _ in range(r.randint(1, 6))]
    for i in r.sample(range(n), n):
        r.choice(parts).add("t", 0, i, leaves[i], n)
    while len(parts) > 1:
        a = parts.pop(r.randrange(len(parts)))
        at = r.randrange(len(parts))
        parts[at] = parts[at].merge(a) if r.random() < 0.5 else a.merge(parts[at])
    level = next(k for k in range(99) if parts[0].width("t", k) == 1)
    assert parts[0].open == {("t", level, 0): top(leaves, arity)}


def manifest_rows(n, r):
    value = lambda: "%064x" % r.getrandbits(256)
    rows = [(None if r.random() < 0.05 else r.randint(-n, n), r.choice(["a", "b", None, "é", "", "z"]), value(), value() if r.random() < 0.2 else None) for _ in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize("n", [0, 1, 9, 700])
def test_manifest_against_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(order, "ROWS", 40)  # many ranges, so that proofs reach outside
    rows = manifest_rows(n, random.Random(n))
    table = spark.createDataFrame(rows, "id long, tree string, leaf string, seen string").withColumn("idx", order.F.lit("x"))
    got = merkle.manifest(table, keep_siblings=True).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[2], x[3] is not None, x[3] or "")
    trees = {t: sorted((x for x in rows if x[1] == t), key=key) for t in sorted({x[1] for x in rows}, key=lambda t: (t is not None, (t or "").encode()))}
    tops = {t: top([x[2].encode() for x in v]) for t, v in trees.items()}
    root = merkle.digest(*tops.values())
    want = []
    for tree, held in trees.items():
        for i, (key_, _, leaf, seen) in enumerate(held):
            nodes, at, proof, found = [x[2].encode() for x in held], i, [], (seen or leaf).encode()
            while len(nodes) > 1:
                a = at // 8 * 8
                left, right = nodes[a:at], nodes[at + 1 : a + 8]
                proof += left + right
                found = merkle.digest(*left, found, *right)
                nodes, at = [merkle.digest(*nodes[j : j + 8]) for j in range(0, len(nodes), 8)], at // 8
            names = list(tops)
            left, right = ([tops[t] for t in names[: names.index(tree)]], [tops[t] for t in names[names.index(tree) + 1 :]])
            found = merkle.digest(*left, found, *right)
            want.append((key_, leaf, tops[tree].decode(), root.decode(), merkle.digest(*proof, *left, *right).decode(), found.decode(), found == root))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:7]) for r in got)
    for r in got:
        path = [("".join(s["left"]).encode(), "".join(s["right"]).encode()) for s in r["siblings"]]
        assert r["verified"] == (merkle.folded(r["leaf"].encode(), path).decode() == r["root"] and r["folded_root"] == r["root"])


def test_leaves_with_nulls_and_tampering(spark):
    rows = [(1, None, "Ab É", "en", None), (2, "s", None, None, 5), (3, "s", "", "en", 0), (None, "s", "XyZ", "fr", 3), (4, "x", "A" * 100_000, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, lang string, n_chars long").withColumn("leaf", order.F.lit("clash"))
    looked = order.F.crc32(order.F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    got = {r["id"]: (r["leaf"], r["seen"]) for r in merkle.document_leaves(docs, merkle.lowered, looked).collect()}
    for key, source, text, lang, n in rows:
        h = lambda t: sha256("".join(map(part, (key, source, lang, n, t))).encode()).hexdigest()  # noqa: B023, E731
        checked = key is not None and zlib.crc32(str(key).encode()) % 3 == 0
        assert got[key] == (h(text), h(text and text.translate(low)) if checked else None)


# Prefix trie


def plain_trie(rows, most=6, every=100):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        rebuilt[c] = own.get(c - int(np.fmod(c, every)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in sorted(rebuilt.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, convs in members.items():
        d = len(node)
        below = [n for n in members if n[:d] == node]
        kids = [n for n in below if len(n) == d + 1]
        leaves = [n for n in below if not any(len(x) == len(n) + 1 and x[: len(n)] == n for x in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in convs if len(rebuilt[c]) == d)
        out.append((convs[0], d, members[node[:-1]][0] if node else None, len(convs), len(kids), len(leaves), saved, sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


SCHEMA = "conv_id long, turn long, role string, text string, depth string"


@pytest.mark.parametrize("seed", range(3))
def test_trie_against_brute_force(spark, monkeypatch, seed):
    r = random.Random(seed)
    monkeypatch.setattr(order, "ROWS", 30)
    monkeypatch.setattr(prefixes, "IDS", 7)
    rows = []
    for conv in r.sample(range(-30, 420), 60) + [0, 100, None]:
        for turn in range(r.randint(1, 9)):
            rows.append((conv, r.choice([None, turn, turn, turn]), r.choice(["user", "bot", None]), r.choice(["a", "b", "", None, "🙂é"])))
    rows += [(200, i, "user", "long") for i in range(150)] + [(201 + i, 0, "user", "same") for i in range(40)]  # one long conversation, many copies
    rows += rows[:10]
    table = spark.createDataFrame([(*x, "z") for x in rows], SCHEMA)
    assert sorted(str(tuple(x)) for x in prefixes.trie(*prefixes.forked(table)).collect()) == plain_trie(rows)


def test_trie_without_conversations_or_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixes.trie(*prefixes.forked(empty)).count() == 0
    one = [(3, None, None, None)]  # its only turn is replaced by those of a conversation that is not there
    assert zlib.crc32(b"3") % 6 > 0
    got = prefixes.trie(*prefixes.forked(spark.createDataFrame([(*x, "z") for x in one], SCHEMA))).collect()
    assert [str(tuple(x)) for x in got] == plain_trie(one)


# Adaptive scan


def brute(rows, k=5, every=50):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        close = u @ u[i]
        rest = [j for j in np.lexsort((ids, -np.round(close, 12))) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), close[j]) for j in rest]
    return out


def test_scan_abandons_few_true_neighbours(rng=np.random.default_rng(3)):
    x = rng.standard_normal((4000, 128))
    held = neighbours._Held([v.astype("<f4").tobytes() for v in x], [[i] for i in range(len(x))], [b""] * len(x), "<f4", neighbours.rotation(128))
    q = neighbours._unit(x[:50]) @ neighbours.rotation(128)
    exact = 2 - 2 * (neighbours._unit(x[:50]) @ neighbours._unit(x).T)
    limits = np.sort(exact, 1)[:, 5]
    i, j, left = neighbours.scan(held, q.astype(np.float32), limits)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    near = [(a, b) for a in range(50) for b in np.flatnonzero(exact[a] <= limits[a])]
    assert sum(p in found for p in near) >= 0.99 * len(near)
    assert left == sorted(left, reverse=True) and left[3] < 0.8 * exact.size and left[5] < 0.3 * exact.size and left[-1] < 0.01 * exact.size


@has_tables
def test_recall_and_scores(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = defaultdict(list)
    for r in neighbours.op13_adaptive_scan(spark, DATA).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute(rows)
    assert got.keys() == want.keys()
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    vectors = dict(rows)
    for q, found in got.items():
        for v, score in found:
            a, b = np.array(vectors[q], float), np.array(vectors[v], float)
            assert abs(score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_many_lists_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 40)
    monkeypatch.setattr(neighbours, "SHELF", 64)
    r = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((600, 24)))]
    rows += [(600 + i, rows[50][1]) for i in range(300)]  # a third of all are copies of one query
    odd = [(10_000, None), (10_050, []), (10_100, [0.0] * 24), (10_150, [float("nan")] * 24), (10_200, [1.0, None] + [0.0] * 22), (None, rows[1][1]), rows[7], rows[100]]
    table = spark.createDataFrame([(*x, "z", 1) for x in rows + odd], "vec_id long, embedding array<double>, ids string, shelf int")
    got = defaultdict(list)
    for x in neighbours.nearest(table, order.F.col("id") % 50 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    want = brute(rows)
    assert got.keys() == want.keys() and all([n for n, _, _ in v] == [1, 2, 3, 4, 5] for v in got.values())
    hit = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit >= 0.95 * 5 * len(want)
    assert [v for _, v, _ in got[50]] == [600, 601, 602, 603, 604] and [v for _, v, _ in got[600]] == [50, 601, 602, 603, 604]


def test_few_vectors_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0, 0.0]), (3, [0.0, 1.0]), (4, [5e-200, 0.0]), (0, [0.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((x["query_id"], x["rank"], x["vec_id"], round(x["score"], 9)) for x in neighbours.nearest(table, order.F.col("id") % 50 == 0).collect())
    # Id 0 has two vectors: each is a row, and finds the other.
    assert got == [(0, 1, 3, 1.0), (0, 1, 4, 1.0), (0, 2, 0, 0.0), (0, 2, 0, 0.0), (0, 3, 3, 0.0), (0, 3, 4, 0.0)]
    assert neighbours.nearest(table.where("false"), order.F.col("id") % 50 == 0).count() == 0
