"""Operator 1: embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c or more lie within squared distance 2 - 2c. After a fixed rotation the coordinates are cut
into blocks; each block gets a share of that squared distance in proportion to its width, and a pair within the whole
lies within the share of one block at least. Each block's range join lays a grid of cells as wide as twice the
block's radius over its first coordinates, and meets every vector with its own cell and, on one side, with the cells
that its radius reaches. A pair is verified in double precision in the first block that admits it, in the task that
finds it, so no candidate is ever a row. Vectors travel in the column's own precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tidemark.llm.graph import components, written
from tidemark.llm.units import small_batches

COSINE = 0.9
#: Coordinates of a block: the wider, the fewer pairs pass its share by chance. Those of them that the grid uses.
WIDTH, GRID = 16, 2
#: Vectors of a cell that one task holds; those of a larger cell are dealt to several tasks. Rows compared with them at once.
CHUNK, STRIP = 16_384, 512
SLACK = 1e-6


def rotation(n: int, seed: int = 17) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def blocks_of(n: int) -> list[slice]:
    return [slice(i, min(n, i + WIDTH)) for i in range(0, n, WIDTH)]


def shares(n: int, cosine: float) -> np.ndarray:
    """Each block's part of the squared distance, in proportion to its width."""
    return np.array([(2 - 2 * cosine) * (b.stop - b.start) / n for b in blocks_of(n)])


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision; None where null, empty, zero or not finite throughout."""
    out = []
    for x in column:
        v = None
        if x.is_valid and len(x) and x.values.null_count == 0:
            v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
            if not np.isfinite(v).all() or not v.any():
                v = None
        out.append(v)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(-1, keepdims=True)  # so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(-1, keepdims=True))


def _digests(vectors: DataFrame, kind: str) -> DataFrame:
    """id, digest, and the vector's values as bytes, of the column's own width; both null if it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None if v is None else (v + 0.0).astype(kind).tobytes() for v in _rows(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if r is None else xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], ["id", "digest", "raw"])

    return vectors.mapInArrow(run, "id long, digest binary, raw binary")


def _cell(n: int, k: int, place: np.ndarray) -> np.ndarray:
    """One number for a cell of block k of vectors of length n."""
    key = np.full(len(place), n << 12 | k, np.int64)
    for c in place.T:
        if (np.abs(c) >= 1 << 12).any():
            raise ValueError("the cosine is too high for the grid")
        key = key << 13 | (c.astype(np.int64) + (1 << 12))
    return key


#: The own cell and half of its neighbours, so that two cells meet once.
_STEPS = [s for s in product((-1, 0, 1), repeat=GRID) if s >= (0,) * GRID]


def _placed(classes: DataFrame, cosine: float, kind: str, homes: bool = False) -> DataFrame:
    """cls, members, raw for every block and cell that the vector meets; is_home: the cell is its own. With `homes` only the vectors' own cells."""
    schema = "cell long" if homes else "cls long, members long, raw binary, block int, cell long, is_home boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, np.ndarray] = {}
        for b in batches:
            raw = b.column(2).to_pylist()
            by_length: dict[int, list[int]] = {}
            for at, r in enumerate(raw):
                by_length.setdefault(len(r), []).append(at)
            for some in by_length.values():
                at = np.array(some)
                v = np.frombuffer(b"".join(raw[i] for i in some), kind).reshape(len(some), -1).astype(np.float64)
                n = v.shape[1]
                if n not in turned:
                    turned[n] = rotation(n)
                x = _unit(v) @ turned[n]
                for k, (block, share) in enumerate(zip(blocks_of(n), shares(n, cosine), strict=True)):
                    radius = np.sqrt(share) + SLACK
                    place = x[:, block][:, :GRID] / (2 * radius)
                    own = np.floor(place)
                    for step in map(np.array, sorted({s[: place.shape[1]] for s in _STEPS})):
                        away = np.where(step > 0, own + 1 - place, np.where(step < 0, place - own, 0.0)) * 2 * radius
                        met = np.flatnonzero((away * away).sum(1) <= radius * radius)
                        cells = pa.array(_cell(n, k, (own + step)[met]))
                        if homes:
                            if not step.any():
                                yield pa.RecordBatch.from_arrays([cells], ["cell"])
                            continue
                        take = pa.array(at[met])
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(np.full(len(met), k, np.int32)), cells, pa.array(np.full(len(met), not step.any()))],
                            ["cls", "members", "raw", "block", "cell", "is_home"],
                        )

    return classes.select("cls", "members", "raw").mapInArrow(run, schema)


class _Side:
    """Vectors of one task, as the filter of a block and the verification need them."""

    def __init__(self, ids: list[int], members: list[int], raw: list[bytes], kind: str, turn: np.ndarray, block: slice):
        self.ids, self.members = np.array(ids, np.int64), np.array(members, np.int64)
        self.unit = _unit(np.frombuffer(b"".join(raw), kind).reshape(len(ids), -1).astype(np.float64))
        self.turned = self.unit @ turn
        x = self.turned[:, block].astype(np.float32)
        square, one = (x * x).sum(1, keepdims=True), np.ones((len(x), 1), np.float32)
        self.left, self.right = np.hstack([-2 * x, square, one]), np.hstack([x, one, square])


def _pairs(a: _Side, b: _Side, k: int, limits: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs that block k is the first to admit, a strip of rows of `a` at a time."""
    blocks = blocks_of(a.turned.shape[1])[: k + 1]
    for start in range(0, len(a.ids), STRIP):
        i, j = np.nonzero(a.left[start : start + STRIP] @ b.right.T <= limits[k] + 1e-4)
        i += start
        if a is b:
            on = i < j
            i, j = i[on], j[on]
        found = []
        for s in range(0, len(i), 50_000):
            p, q = i[s : s + 50_000], j[s : s + 50_000]
            for at in range(k, -1, -1):
                d = a.turned[p, blocks[at]] - b.turned[q, blocks[at]]
                within = (d * d).sum(1) <= limits[at] + 1e-12
                on = within if at == k else ~within
                p, q = p[on], q[on]
            on = (a.unit[p] * b.unit[q]).sum(1) >= cosine
            found.append((p[on], q[on]))
        if found:
            yield np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _least(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each node's smallest label among all nodes that the links i-j connect it to."""
    while True:
        least = np.minimum(labels[i], labels[j])
        before = labels.copy()
        np.minimum.at(labels, i, least)
        np.minimum.at(labels, j, least)
        if (labels == before).all():
            return labels


class _Links:
    """Counts and smallest linked classes within one task."""

    def __init__(self):
        self.count: dict[int, int] = {}
        self.root: dict[int, int] = {}

    def _find(self, x: int) -> int:
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def add(self, a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        for side, own, members in ((a, i, b.members[j]), (b, j, a.members[i])):
            n = np.bincount(own, members, len(side.ids)).astype(np.int64)
            for x in np.flatnonzero(n).tolist():
                key = int(side.ids[x])
                self.count[key] = self.count.get(key, 0) + int(n[x])
        shift = 0 if a is b else len(a.ids)
        ids = a.ids if a is b else np.concatenate([a.ids, b.ids])
        met = np.unique(np.concatenate([i, j + shift]))
        labels = _least(ids.copy(), i, j + shift)
        for x, y in zip(ids[met].tolist(), labels[met].tolist(), strict=True):
            x, y = self._find(x), self._find(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)

    def batch(self) -> pa.RecordBatch:
        ids = list(self.count)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(self.count.values()), pa.int64()), pa.array([self._find(x) for x in ids], pa.int64())], ["cls", "links", "root"])


def _joined(rows: DataFrame, cosine: float, kind: str) -> DataFrame:
    """rows: cell, part, is_left, block, cls, members, raw, sorted by task with the held side first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, np.ndarray] = {}
        task, held, links, waiting = None, None, _Links(), []

        def side(some: list[tuple]) -> _Side:
            n = len(some[0][2]) // np.dtype(kind).itemsize
            if n not in turned:
                turned[n] = rotation(n)
            return _Side([x[0] for x in some], [x[1] for x in some], [x[2] for x in some], kind, turned[n], blocks_of(n)[task[2]])

        def compare() -> None:
            nonlocal held, waiting
            if not waiting:
                return
            new, waiting = side(waiting), []
            limits = shares(new.turned.shape[1], cosine)
            if held is None:
                held = new
            for i, j in _pairs(new, held, task[2], limits, cosine):
                links.add(new, held, i, j)

        left_before = False
        for b in batches:
            for cell, part, is_left, block, cls, members, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (cell, part, block) != task:
                    compare()
                    if links.count:
                        yield links.batch()
                    task, held, links, left_before = (cell, part, block), None, _Links(), False
                if is_left and not left_before:
                    compare()
                    left_before = True
                if is_left and held is None:
                    continue  # nobody lives in this cell
                waiting.append((cls, members, raw))
                if is_left and len(waiting) >= 2048:
                    compare()
        compare()
        if links.count:
            yield links.batch()

    return rows.select("cell", "part", "is_left", "block", "cls", "members", "raw").mapInArrow(run, "cls long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links vectors of equal length whose cosine, in double precision, is `cosine` or more.

    Returns for each row `id_col`, n_links (other rows linked directly, copies included), component_id (the smallest
    id reachable by links, its own included) and kept (whether that is its own). Vectors that are null, empty, zero or
    hold a null or a value that is not finite link with nothing. Rows with a null id are not compared: 0 links, no
    component, kept. Rows that repeat an id count as vectors of their own. Ids must be integers; other columns are not
    read.
    """
    small_batches(vectors, 1024)
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    signed = written(_digests(rows, kind), "vectors")
    has = F.col("id").isNotNull() & F.col("digest").isNotNull()
    classes = written(signed.where(has).groupBy("digest").agg(F.min("id").alias("cls"), F.count("*").alias("members"), F.first("raw").alias("raw")), "classes")
    placed = _placed(classes, cosine, kind)
    # One row for each cell that holds more than a chunk; a cell is of the fixed grid over the unit ball.
    large = {r["cell"]: -(-r["n"] // chunk) for r in _placed(classes, cosine, kind, homes=True).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > chunk).collect()}
    parts = F.lit(1).cast("long")
    if large:
        pairs = vectors.sparkSession.createDataFrame(list(large.items()), "cell long, parts long")
        placed = placed.join(F.broadcast(pairs), "cell", "left")
        parts = F.coalesce("parts", F.lit(1).cast("long"))
    placed = placed.withColumn("n", parts).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("n")))
    seats = F.when(F.col("is_home"), F.sequence("own", F.col("n") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    dealt = placed.withColumn("part", F.explode(seats)).withColumn("is_left", ~F.col("is_home") | (F.col("part") > F.col("own")))
    dealt = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "block", "is_left", "cls")
    found = written(_joined(dealt, cosine, kind), "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    known = classes.select("digest", F.col("cls").alias("class_id"), "members").join(links, F.col("class_id") == F.col("cls"), "left").join(whole, F.col("class_id") == F.col("node"), "left")
    # Rows without a class match nothing, each under a key of its own, longer than a digest, rather than all under null.
    alone = F.encode(F.concat(F.lit("-" * 17), F.coalesce("id", F.lit(0)).cast("string")), "utf-8")
    known = known.select(F.col("digest").alias("match"), "class_id", "members", "links", "component")
    out = signed.select("id", F.when(has, F.col("digest")).otherwise(alone).alias("match")).join(known, "match", "left")
    component = F.coalesce("component", "class_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        (F.coalesce("members", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def op1_pigeonhole_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
