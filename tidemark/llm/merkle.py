"""Operator 11: a Merkle manifest of a dataset, as an associative sparse forest.

Rows are leaves of one tree a group; every run of `arity` neighbours becomes their hash until one node is left. A
`Forest` holds nodes whose runs are not complete, keyed by tree, level and index. As a tree's size says how many nodes
each of its runs has, a run that is complete is replaced by its parent, wherever its members came from: forests may be
merged in any order and grouping. Each range of rows gives a forest of a few open nodes for each of its edges; rounds
of a tree reduction merge those of sixteen ranges at a time. A leaf's proof takes siblings from its own range, and
the few that lie outside from what the reduction wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.graph import written
from tidemark.llm.ordered import pieces, placed, ranged

ARITY = 8
#: Forests that one step of the reduction merges.
FAN = 16

Node = tuple[str | None, int, int]


def digest(*parts: bytes) -> bytes:
    """Lowercase hexadecimal SHA-256 of the parts, one after another."""
    return sha256(b"".join(parts)).hexdigest().encode()


def field(c: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


class Forest:
    """Nodes that wait for their siblings. `made` are the parents that merging has added, in order."""

    def __init__(self, arity: int = ARITY):
        self.arity, self.sizes = arity, {}
        self.open: dict[Node, bytes] = {}
        self.made: list[tuple[Node, bytes]] = []
        self._seen: dict[Node, int] = {}

    def width(self, tree: str | None, level: int) -> int:
        """Nodes of a level."""
        return -(-self.sizes[tree] // self.arity**level)

    def add(self, tree: str | None, level: int, index: int, value: bytes, size: int) -> None:
        """A node of a tree of so many leaves; each node is added once."""
        self.sizes[tree] = size
        while True:
            self.open[tree, level, index] = value
            width = self.width(tree, level)
            if width == 1:
                return
            run = index // self.arity
            first, last = run * self.arity, min(width, (run + 1) * self.arity)
            seen = self._seen[tree, level, run] = self._seen.get((tree, level, run), 0) + 1
            if seen < last - first:
                return
            del self._seen[tree, level, run]
            value = digest(*(self.open.pop((tree, level, i)) for i in range(first, last)))
            level, index = level + 1, run
            self.made.append(((tree, level, index), value))

    def merge(self, other: Forest) -> Forest:
        for (tree, level, index), value in other.open.items():
            self.add(tree, level, index, value, other.sizes[tree])
        return self


_NODE = "part long, tree string, level int, idx long, hash string, size long, made boolean, open boolean"


def _batch(part: int, rows: Iterable[tuple[Node, bytes, bool, bool]], forest: Forest) -> pa.RecordBatch:
    rows = list(rows)
    of = lambda f, kind: pa.array([f(r) for r in rows], kind)
    columns = [
        of(lambda r: part, pa.int64()), of(lambda r: r[0][0], pa.string()), of(lambda r: r[0][1], pa.int32()), of(lambda r: r[0][2], pa.int64()),
        of(lambda r: r[1].decode(), pa.string()), of(lambda r: forest.sizes[r[0][0]], pa.int64()), of(lambda r: r[2], pa.bool_()), of(lambda r: r[3], pa.bool_()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["part", "tree", "level", "idx", "hash", "size", "made", "open"])


def _waits(forest: Forest, node: Node) -> bool:
    """Whether the node is one of several of its level, so that it still has a parent to come."""
    return forest.width(node[0], node[1]) > 1


def _fragments(leaves: DataFrame, arity: int) -> DataFrame:
    """The open nodes of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, now = Forest(arity), None
        for b in batches:
            for part, tree, idx, size, leaf in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    if now is not None:
                        yield _batch(now, ((k, v, True, _waits(forest, k)) for k, v in forest.open.items()), forest)
                    forest, now = Forest(arity), part
                forest.add(tree, 0, idx, leaf.encode(), size)
                forest.made.clear()
        if now is not None:
            yield _batch(now, ((k, v, True, _waits(forest, k)) for k, v in forest.open.items()), forest)

    return leaves.select("_part", "tree", "place", "whole", "leaf").mapInArrow(run, _NODE)


def _merged(waiting: DataFrame, span: int, arity: int) -> DataFrame:
    """The open nodes of `span` ranges in one forest, and all the nodes that this made."""

    def merge(table: pa.Table) -> pa.Table:
        forest, given = Forest(arity), set()
        part = table.column("part")[0].as_py() // span * span
        for tree, level, idx, value, size in zip(*(table.column(c).to_pylist() for c in ("tree", "level", "idx", "hash", "size")), strict=True):
            given.add((tree, level, idx))
            forest.add(tree, level, idx, value.encode(), size)
        rows = [(k, v, False, True) for k, v in forest.open.items() if k in given]
        rows += [(k, v, True, k in forest.open and _waits(forest, k)) for k, v in forest.made]
        return pa.Table.from_batches([_batch(part, rows, forest)])

    return waiting.groupBy(F.floor(F.col("part") / span).alias("span")).applyInArrow(merge, _NODE)


def reduced(leaves: DataFrame, parts: int, arity: int) -> DataFrame:
    """All nodes that no single range could put into a parent, and each tree's topmost: part, tree, level, idx, hash, size."""
    step = written(_fragments(leaves, arity), "forest")
    nodes, span = step, 1
    while span < parts:
        span *= FAN
        step = written(_merged(step.where("open"), span, arity), "forest")
        nodes = nodes.unionByName(step)
    return nodes.where("made").drop("made", "open")


def _wanted(of: DataFrame, arity: int) -> DataFrame:
    """The siblings, at every level, of nodes of a range that the range itself can't make up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for part, tree, first, here, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                end, level, span = first + here, 0, 1
                while (width := -(-size // span)) > 1 and here < size:
                    runs = {first // span // arity, (end - 1) // span // arity}
                    for i in (i for r in sorted(runs) for i in range(r * arity, min(width, (r + 1) * arity))):
                        if i * span < first or min(size, (i + 1) * span) > end:
                            out.append((part, tree, level, i))
                    level, span = level + 1, span * arity
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["part", "tree", "level", "idx"])

    return of.select("_part", "tree", "before", "here", "whole").mapInArrow(run, "part long, tree string, level int, idx long")


class _Range:
    """The part of one tree that a range holds: its own nodes, level by level, and siblings from outside."""

    def __init__(self, first: int, leaves: list[bytes], size: int, outside: dict[tuple[int, int], bytes], arity: int):
        self.arity, self.outside, self.size = arity, outside, size
        self.levels, self.first, self.widths = [leaves], [first], [size]
        while self.widths[-1] > 1:
            here, a, width = self.levels[-1], self.first[-1], self.widths[-1]
            end, start = a + len(here), -(-a // arity)
            runs = -(-width // arity) if end == width else end // arity
            self.levels.append([digest(*here[r * arity - a : (r + 1) * arity - a]) for r in range(start, runs)])
            self.first.append(start)
            self.widths.append(-(-width // arity))

    def node(self, level: int, index: int) -> bytes:
        at = index - self.first[level]
        return self.levels[level][at] if 0 <= at < len(self.levels[level]) else self.outside[level, index]

    def sides(self, level: int, index: int) -> tuple[bytes, bytes]:
        """The siblings on the left and on the right."""
        first = index // self.arity * self.arity
        last = min(self.widths[level], first + self.arity)
        return b"".join(self.node(level, i) for i in range(first, index)), b"".join(self.node(level, i) for i in range(index + 1, last))

    def paths(self) -> Iterator[tuple[bytes, list[tuple[bytes, bytes]]]]:
        """Each leaf with its siblings at every level below the topmost."""
        above: dict[int, tuple[int, list[tuple[bytes, bytes]]]] = {}

        def up(level: int, index: int) -> list[tuple[bytes, bytes]]:
            if self.widths[level] == 1:
                return []
            if above.get(level, (None,))[0] != index:
                above[level] = index, [self.sides(level, index), *up(level + 1, index // self.arity)]
            return above[level][1]

        for i, leaf in enumerate(self.levels[0], self.first[0]):
            yield leaf, up(0, i)


def folded(leaf: bytes, path: Iterable[tuple[bytes, bytes]]) -> bytes:
    """The topmost hash of a leaf and its siblings."""
    for left, right in path:
        leaf = digest(left, leaf, right)
    return leaf


_PROVED = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(rows: DataFrame, arity: int, keep_siblings: bool) -> DataFrame:
    """rows: sorted by part, and within it the top hashes first, then nodes from outside, then leaves."""
    names = [x.split()[0] for x in _PROVED.split(", ")]

    def prove(tops: dict, outside: dict, leaves: dict) -> Iterator[pa.RecordBatch]:
        order, root = list(tops), digest(*tops.values())
        for tree, (ids, values, seen, first, size) in leaves.items():
            at = order.index(tree)
            last = b"".join(tops[t] for t in order[:at]), b"".join(tops[t] for t in order[at + 1 :])
            out: list[list] = [[] for _ in range(len(names) + keep_siblings)]
            held = _Range(first, values, size, outside.get(tree, {}), arity)
            for n, (leaf, path) in enumerate(held.paths()):
                path = [*path, last]
                found = folded(seen[n].encode() if seen[n] else leaf, path)
                row = [ids[n], leaf.decode(), tops[tree].decode(), root.decode(), digest(*(x for sides in path for x in sides)).decode(), found.decode(), found == root]
                if keep_siblings:
                    row.append([{"left": _cut(a), "right": _cut(b)} for a, b in path])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                if len(out[0]) == 4096:
                    yield table(out)
                    out = [[] for _ in out]
            yield table(out)

    def table(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        if keep_siblings:
            kinds.append(pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names + ["siblings"] * keep_siblings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tops, outside, leaves = None, {}, {}, {}
        for b in batches:
            for part, tree, level, idx, size, value, seen, key, every in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    yield from prove(tops, outside, leaves)
                    now, tops, outside, leaves = part, {}, {}, {}
                if every is not None:
                    tops = {x["name"] if x["has"] else None: x["hash"].encode() for x in every}
                elif level is not None:
                    outside.setdefault(tree, {})[level, idx] = value.encode()
                else:
                    held = leaves.setdefault(tree, ([], [], [], idx, size))
                    for column, x in zip(held, (key, value.encode(), seen), strict=False):
                        column.append(x)
        yield from prove(tops, outside, leaves)

    schema = _PROVED + ", siblings array<struct<left:array<string>,right:array<string>>>" * keep_siblings
    return rows.select("part", "tree", "level", "idx", "size", "hash", "seen", "id", "every").mapInArrow(run, schema)


def _cut(run: bytes) -> list[str]:
    return [run[i : i + 64].decode() for i in range(0, len(run), 64)]


def manifest(leaves: DataFrame, arity: int = ARITY, keep_siblings: bool = False) -> DataFrame:
    """Leaves with their tree's root, the root of all trees, and a proof for each.

    `leaves` has id (an integer), tree (a string; null is a tree of its own), leaf and seen: hexadecimal digests, seen
    being the leaf as it was found later, null where it was not looked at again. A tree's leaves stand in order of id,
    nulls first, then leaf; rows that repeat both are leaves of their own. Trees stand in bytewise order of their
    names, null first. Returns id, leaf, subroot, root, proof_sha256 (of all siblings, level by level, left to right),
    folded_root (of seen, or else leaf, and its siblings) and verified (whether that is the root); with `keep_siblings`
    also the siblings. No leaves give no rows. As a proof holds all other trees' roots, trees should be few; everything
    else is bounded by a range of rows.
    """
    at, parts = ranged(leaves.select("id", "tree", "leaf", "seen"), ["tree", "id", "leaf", "seen"], "leaves")
    of = written(pieces(at, "tree"), "pieces")
    rows = placed(at, of, "tree")
    nodes = reduced(rows, parts, arity)
    topmost = nodes.where(F.col("level") == _height(F.col("size"), arity))
    name = F.struct(F.col("tree").isNotNull().alias("has"), F.coalesce("tree", F.lit("")).alias("name"), "hash")
    tops = topmost.agg(F.array_sort(F.collect_list(name)).alias("every"))
    wanted = _wanted(of, arity).alias("w")
    n = nodes.alias("n")
    same = F.col("w.tree").eqNullSafe(F.col("n.tree")) & (F.col("w.level") == F.col("n.level")) & (F.col("w.idx") == F.col("n.idx"))
    outside = wanted.join(n, same).select("w.part", "w.tree", "w.level", "w.idx", "n.hash", F.lit(1).alias("kind"))
    headers = of.select(F.col("_part").alias("part")).distinct().join(F.broadcast(tops), how="cross").withColumn("kind", F.lit(0))
    found = rows.select(F.col("_part").alias("part"), "tree", F.col("place").alias("idx"), F.col("whole").alias("size"), F.col("leaf").alias("hash"), "seen", "id", F.lit(2).alias("kind"))
    every = headers.unionByName(outside, allowMissingColumns=True).unionByName(found, allowMissingColumns=True)
    return _proved(every.repartition("part").sortWithinPartitions("part", "kind", "tree", "idx"), arity, keep_siblings)


def _height(size: Column, arity: int) -> Column:
    """Levels above the leaves: how often a size shrinks to one."""
    level, span = F.lit(0), 1
    while span < 1 << 62:
        level, span = level + F.when(size > span, 1).otherwise(0), span * arity
    return level


def lowered(c: Column) -> Column:
    """A to Z in lower case, nothing else."""
    capitals = "".join(map(chr, range(65, 91)))
    return F.translate(c, capitals, capitals.lower())


def document_leaves(docs: DataFrame, again: Callable[[Column], Column] | None = None, looked: Column | None = None) -> DataFrame:
    """Leaves of documents, one tree a language; where `looked` holds, `again` is what has become of the text."""
    leaf = lambda text: leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    seen = F.when(looked, leaf(again(F.col("text")))) if again else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").alias("tree"), leaf(F.col("text")).alias("leaf"), seen.alias("seen"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    looked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(document_leaves(docs, lowered, looked)).withColumnRenamed("id", "doc_id")


#: CRC-32 of an integer's decimal digits, bit by bit.
CRC_SQL = "(4294967295::UBIGINT - list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({x}::VARCHAR, ''), lambda d: ascii(d)::UBIGINT)), lambda c, d: list_reduce(list_prepend(xor(c, d), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda b, _: xor(b >> 1, (b & 1) * 3988292384::UBIGINT))))"


def _sql(levels: int = 9, arity: int = ARITY) -> str:
    """Levels one after another: each groups the nodes of the one below, and a path gathers the siblings on both sides."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    with_ = [
        f"l AS MATERIALIZED (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {CRC_SQL.format(x='doc_id')} % 3 = 0 THEN {leaf(low)} END AS seen FROM documents)",
        "n0 AS MATERIALIZED (SELECT *, leaf AS h, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, seen NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS w FROM l)",
        "p0 AS (SELECT *, i AS j, coalesce(seen, leaf) AS f, '' AS proof FROM n0)",
    ]
    before = "coalesce(string_agg(h, '') OVER (PARTITION BY lang, i // {a} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')"
    after = "coalesce(string_agg(h, '') OVER (PARTITION BY lang, i // {a} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')"
    for k in range(levels):
        with_ += [
            f"s{k} AS MATERIALIZED (SELECT lang, i, h, w, {before.format(a=arity)} AS a, {after.format(a=arity)} AS b FROM n{k})",
            f"n{k + 1} AS MATERIALIZED (SELECT lang, i // {arity} AS i, CASE WHEN any_value(w) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, CAST(ceil(any_value(w) / {arity}.0) AS BIGINT) AS w FROM n{k} GROUP BY lang, i // {arity})",
            f"p{k + 1} AS (SELECT p.* REPLACE (j // {arity} AS j, CASE WHEN s.w = 1 THEN f ELSE sha256(s.a || f || s.b) END AS f, CASE WHEN s.w = 1 THEN proof ELSE proof || s.a || s.b END AS proof) FROM p{k} p JOIN s{k} s ON p.lang IS NOT DISTINCT FROM s.lang AND p.j = s.i)",
        ]
    edge = "coalesce(string_agg(h, '') OVER (ORDER BY lang NULLS FIRST ROWS BETWEEN {r}), '')"
    with_.append(f"t AS (SELECT lang, h, {edge.format(r='UNBOUNDED PRECEDING AND 1 PRECEDING')} AS a, {edge.format(r='1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS b, (SELECT sha256(string_agg(h, '' ORDER BY lang NULLS FIRST)) FROM n{levels}) AS root FROM n{levels})")
    return "WITH " + ",\n".join(with_) + f"""
SELECT doc_id, leaf, t.h AS subroot, root, sha256(proof || a || b) AS proof_sha256, sha256(a || f || b) AS folded_root, sha256(a || f || b) = root AS verified FROM p{levels} p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang"""


OP11_SQL = _sql()
