"""Operator 13: approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Unit vectors are turned by a fixed random rotation and cut into blocks of columns; each belongs to the list of its
nearest centre. Of a list that a query probes, the first block's partial squared distances are worked out for all
candidates at once. In a random direction the share of a squared distance that d of D coordinates hold is Beta
distributed with mean d / D, so a candidate whose part lies significantly above that share of the k-th best found so
far is abandoned; the next block is only read for those that remain, and what is left at the end is scored in double
precision on the vectors as given.

Centres are fitted on a bounded sample; every row is indexed. How many lists a query probes is chosen so that a sample
of queries finds `RECALL` of its true neighbours, which are worked out against all rows. Equal vectors are one
candidate with its smallest ids, so that copies cost nothing. A query's home list is searched where it lives; what it
finds there is the threshold with which it sets out to the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tidemark.llm.graph import written
from tidemark.llm.units import small_batches
from tidemark.llm.vectors import _digests, _unit, rotation

#: Neighbours of a query; columns of a block; how many standard deviations above its mean a part may lie.
NEAREST, BLOCK, DEVIATIONS = 5, 16, 3.0
#: Rows that the centres are fitted on, most centres, rows of a list that is aimed at, rounds of fitting.
SAMPLE, CENTRES, LIST, ROUNDS = 16_384, 1024, 512, 12
#: Queries that choose how many lists are probed, and the share of their true neighbours that must lie in those.
TRIALS, RECALL = 128, 0.97
#: Candidates of a shelf, which one task holds at a time, and queries that it answers at once.
SHELF, ASKED = 8192, 512
#: Bytes of the sample's vectors, and of a shelf's: wide vectors are fewer.
SAMPLE_BYTES, SHELF_BYTES = 64 << 20, 16 << 20


@dataclass
class Index:
    """Centres by length of vector, and how many lists a query of that length probes."""

    centres: dict[int, np.ndarray]
    probes: dict[int, int]

    def lists(self, unit: np.ndarray, most: int) -> np.ndarray:
        """The nearest centres of each vector, nearest first."""
        centres = self.centres.get(unit.shape[1])
        if centres is None:
            return np.zeros((len(unit), 1), np.int64)
        close = unit @ centres.T
        most = min(most, len(centres))
        if most < len(centres):
            some = np.argpartition(-close, most - 1, axis=1)[:, :most]
            return np.take_along_axis(some, np.argsort(-np.take_along_axis(close, some, 1), axis=1, kind="stable"), 1)
        return np.argsort(-close, axis=1, kind="stable")


def _vectors(raw: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def _by_length(raw: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, [raw[i] for i in at]


def _means(x: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means from rows spread over the sample."""
    centres = x[np.linspace(0, len(x) - 1, count).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def _key(n: int, number: np.ndarray | int) -> np.ndarray | int:
    """One number for a list of vectors of length n."""
    return n << 20 | number


def _classes(signed: DataFrame, query: Column, k: int) -> DataFrame:
    """cls (the digest of a vector), raw, ids (the k + 1 smallest that have it) and asks (whether one of them is a query).

    Ids are cut within salted groups first, so that those of a vector with many copies are never in one list.
    """
    salted = Window.partitionBy("cls", F.pmod(F.xxhash64("id"), F.lit(256))).orderBy("id")
    few = signed.select("cls", "id").distinct().withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    ids = few.groupBy("cls").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    return signed.groupBy("cls").agg(F.first("raw").alias("raw"), F.max(query).alias("asks")).join(ids, "cls")


def _sampled(classes: DataFrame, most: int) -> list[bytes]:
    """So many vectors with the smallest hashes: a uniform sample that does not depend on the order of rows."""
    got = classes.select("raw", F.xxhash64("raw").alias("h")).orderBy("h", "raw").limit(most).select("raw").toArrow()
    return got.column("raw").to_pylist()


def _exact(classes: DataFrame, trials: list[bytes], k: int, kind: str, index: Index) -> DataFrame:
    """trial and rank of its list for the k vectors nearest to each trial, of all but itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        asked = {q.shape[1]: (at, q) for at, raw in _by_length(trials) for q in [_unit(_vectors(raw, kind))]}
        ranks = {n: np.argsort(index.lists(q, 1 << 20), axis=1) for n, (_, q) in asked.items()}
        number = {t: i for i, t in enumerate(trials)}
        for b in batches:
            for _, raw in _by_length(b.column(0).to_pylist()):
                x = _unit(_vectors(raw, kind))
                if x.shape[1] not in asked:
                    continue
                at, q = asked[x.shape[1]]
                close = q @ x.T
                for j, r in enumerate(raw):
                    if r in number:
                        close[np.flatnonzero(at == number[r]), j] = -9
                new = np.stack([close, ranks[x.shape[1]][:, index.lists(x, 1)[:, 0]]], 2)
                every = np.concatenate([best[x.shape[1]], new], 1) if x.shape[1] in best else new
                take = np.argsort(-every[:, :, 0], axis=1, kind="stable")[:, :k]
                best[x.shape[1]] = np.take_along_axis(every, take[:, :, None], 1)
        for n, found in best.items():
            at, flat = np.repeat(asked[n][0], found.shape[1]), found.reshape(-1, 2)
            on = flat[:, 0] > -9
            yield pa.RecordBatch.from_arrays([pa.array(at[on]), pa.array(flat[on, 0]), pa.array(flat[on, 1].astype(np.int64))], ["trial", "score", "rank"])

    rows = classes.select("raw").mapInArrow(run, "trial long, score double, rank long")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score")))).where(F.col("n") <= k)


def fit(classes: DataFrame, count: int, k: int, kind: str, recall: float = RECALL, width: int = 1) -> Index:
    """Centres from a bounded sample of the classes, and the fewest probes with which a sample of queries reaches the recall; `width` is the widest vector's bytes."""
    sample = _sampled(classes, max(64, min(SAMPLE, SAMPLE_BYTES // max(1, width))))
    index = Index({}, {})
    for _, raw in _by_length(sample):
        x = _unit(_vectors(raw, kind))
        index.centres[x.shape[1]] = _means(x, int(max(1, min(CENTRES, len(x), count * len(x) // max(1, len(sample)) // LIST))))
    trials = sample[:: max(1, len(sample) // TRIALS)]
    size = np.dtype(kind).itemsize
    ranks: dict[int, list[int]] = {}
    for r in _exact(classes, trials, k, kind, index).select("trial", "rank").collect():
        ranks.setdefault(len(trials[r["trial"]]) // size, []).append(r["rank"])
    for n in index.centres:
        found = np.sort(ranks.get(n, [0]))
        index.probes[n] = int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) + 1
    return index


def _homes(classes: DataFrame, index: Index, kind: str) -> DataFrame:
    """The classes with the list of their nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            for at, raw in _by_length(b.column("raw").to_pylist()):
                x = _unit(_vectors(raw, kind))
                out[at] = _key(x.shape[1], index.lists(x, 1)[:, 0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, "list"])

    return classes.select("cls", "raw", "ids", "asks").mapInArrow(run, "cls binary, raw binary, ids array<long>, asks boolean, list long")


def _shelves(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """Each list's first shelf and how many shelves its rows are dealt to; small lists share one."""
    out, shelf, room = {}, 0, most
    for number in sorted(sizes):
        n = sizes[number]
        if n > most:
            shelf += room < most
            times = -(-n // most)
            out[number] = shelf, times
            shelf, room = shelf + times, most
            continue
        if n > room:
            shelf, room = shelf + 1, most
        out[number] = shelf, 1
        room -= n
    return out


def _dealt(homes: DataFrame, shelves: dict[int, tuple[int, int]]) -> DataFrame:
    """The classes with their shelf. There is one row a list in the table that is broadcast."""
    table = homes.sparkSession.createDataFrame([(k, *v) for k, v in shelves.items()], "list long, shelf long, times long")
    shelf = F.col("shelf") + F.pmod(F.xxhash64("cls"), F.col("times"))
    return homes.join(F.broadcast(table), "list").withColumn("shelf", shelf).drop("times")


def _probes(asked: DataFrame, index: Index, shelves: dict[int, tuple[int, int]], kind: str) -> DataFrame:
    """cls, raw, limit, and each shelf with the lists of it that the query has yet to look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at_list, at_shelf, numbers = [], [], []
            own = b.column("shelf").to_pylist()
            home = b.column("list").to_pylist()
            for at, raw in _by_length(b.column("raw").to_pylist()):
                x = _unit(_vectors(raw, kind))
                n = x.shape[1]
                for i, row in zip(at.tolist(), _key(n, index.lists(x, index.probes.get(n, 1))).tolist(), strict=True):
                    by_shelf: dict[int, list[int]] = {}
                    for number in row:
                        first, times = shelves.get(number, (0, 0))
                        for s in range(first, first + times):
                            if number != home[i] or s != own[i]:
                                by_shelf.setdefault(s, []).append(number)
                    for s, some in by_shelf.items():
                        at_list.append(i)
                        at_shelf.append(s)
                        numbers.append(some)
            take = pa.array(at_list, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("cls").take(take), b.column("raw").take(take), b.column("limit").take(take), pa.array(at_shelf, pa.int64()), pa.array(numbers, pa.list_(pa.int64()))], ["cls", "raw", "limit", "shelf", "lists"])

    return asked.select("cls", "raw", "limit", "shelf", "list").mapInArrow(run, "cls binary, raw binary, limit double, shelf long, lists array<long>")


class _Held:
    """Candidates of one list, as given and turned, with the columns of each block together."""

    def __init__(self, raw: list[bytes], ids: list[list[int]], cls: list[bytes], kind: str, turn: np.ndarray):
        self.ids, self.cls = ids, cls
        self.given = _vectors(raw, kind)
        x = (_unit(self.given) @ turn).astype(np.float32)
        self.blocks = [np.ascontiguousarray(x[:, i : i + BLOCK]) for i in range(0, x.shape[1], BLOCK)]
        self.square = (self.blocks[0] * self.blocks[0]).sum(1)


def scan(held: _Held, turned: np.ndarray, limits: np.ndarray, deviations: float = DEVIATIONS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Pairs (query, candidate) that no test of the blocks has abandoned, and how many were left after each block.

    `limits` are squared distances of unit vectors. Of a distance at its query's limit, d of D columns would hold more
    than the mean share and `deviations` times its standard deviation only by chance; what does is abandoned.
    """
    n, d, left = turned.shape[1], 0, []
    i = j = part = None
    for number, block in enumerate(held.blocks):
        q = turned[:, d : d + BLOCK]
        d += block.shape[1]
        share = min(1.0, d / n + deviations * np.sqrt(2 * d * (n - d) / (n + 2)) / n)
        allowed = limits * share + 1e-5
        if number == 0:
            sums = (q * q).sum(1)[:, None] + held.square[None, :] - 2 * (q @ block.T)
            i, j = np.nonzero(sums <= allowed[:, None])
            part = sums[i, j]
        else:
            step = q[i] - block[j]
            part = part + (step * step).sum(1)
            on = part <= allowed[i]
            i, j, part = i[on], j[on], part[on]
        left.append(len(i))
    return i, j, left


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; scaled first, so that squares neither vanish nor overflow."""
    a, b = (x / np.abs(x).max(1, keepdims=True) for x in (a, b))
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


class _Answers:
    """The best ids found for some queries, and the squared distances beyond which nothing helps."""

    def __init__(self, cls: list[bytes], limits: np.ndarray, k: int):
        self.cls, self.k, self.limits = cls, k, limits.copy()
        #: Cosine with its sign turned, id, and whether its vector is the query's own.
        self.best: list[list[tuple[float, int, bool]]] = [[] for _ in cls]

    def add(self, held: _Held, queries: np.ndarray, given: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs of places in `queries`, which are numbers of answers, and candidates, in order of the first."""
        for s in range(0, len(i), 65_536):
            p, c = i[s : s + 65_536], j[s : s + 65_536]
            scores = _cosines(given[p], held.given[c])
            for at in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p)) + 1):
                q = int(queries[p[at[0]]])
                if len(at) > self.k:  # the best alone, and what ties with the last of them
                    at = at[scores[at] >= np.partition(scores[at], len(at) - self.k)[len(at) - self.k]]
                found = [(-float(scores[x]), id_, held.cls[c[x]] == self.cls[q]) for x in at for id_ in held.ids[c[x]]]
                self.best[q] = sorted(self.best[q] + found)[: self.k]
                if len(self.best[q]) == self.k:
                    self.limits[q] = min(self.limits[q], 2 + 2 * self.best[q][-1][0])

    def batch(self) -> pa.RecordBatch:
        of = lambda place, kind, sign=1: pa.array([[sign * x[place] for x in b] if sign < 0 else [x[place] for x in b] for b in self.best], pa.list_(kind))
        return pa.RecordBatch.from_arrays([pa.array(self.cls, pa.binary()), pa.array(self.limits), of(1, pa.int64()), of(0, pa.float64(), -1), of(2, pa.bool_())], ["cls", "limit", "ids", "scores", "own"])


_FOUND = "cls binary, limit double, ids array<long>, scores array<double>, own array<boolean>"


def _searched(rows: DataFrame, k: int, kind: str, at_home: bool) -> DataFrame:
    """rows: shelf, list (null for queries), lists, cls, raw, ids, asks, limit, sorted by shelf with candidates first.

    At home the asking candidates are the queries, each of its own list; else the rows without a list are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        shelf, waiting, held, asked = None, {}, {}, []

        def lay(number: int) -> _Held:
            if number not in held:
                cls, raw, ids, _ = waiting.pop(number)
                n = len(raw[0]) // np.dtype(kind).itemsize
                if n not in turns:
                    turns[n] = rotation(n)
                held[number] = _Held(raw, ids, cls, kind, turns[n])
            return held[number]

        def ask(number: int, answers: _Answers, queries: np.ndarray, given: np.ndarray) -> None:
            h = lay(number)
            turned = (_unit(given) @ turns[given.shape[1]]).astype(np.float32)
            i, j, _ = scan(h, turned, answers.limits[queries])
            answers.add(h, queries, given, i, j)

        def home() -> Iterator[pa.RecordBatch]:
            for number in sorted(waiting):
                asks = np.flatnonzero(waiting[number][3])
                h = lay(number)
                for s in range(0, len(asks), ASKED):
                    at = asks[s : s + ASKED]
                    answers = _Answers([h.cls[i] for i in at], np.full(len(at), 4.0), k)
                    # A few at first, so that the rest of the list is met with a threshold.
                    for some in np.array_split(np.arange(len(h.cls)), max(1, len(h.cls) // 256)):
                        view = _view(h, some)
                        i, j, _ = scan(view, (_unit(h.given[at]) @ turns[h.given.shape[1]]).astype(np.float32), answers.limits)
                        answers.add(view, np.arange(len(at)), h.given[at], i, j)
                    yield answers.batch()

        def visit() -> Iterator[pa.RecordBatch]:
            for at, raw in _by_length([r for _, r, _, _ in asked]):
                given = _vectors(raw, kind)
                answers = _Answers([asked[i][0] for i in at], np.array([asked[i][2] for i in at]), k)
                by_list: dict[int, list[int]] = {}
                for q, i in enumerate(at):
                    for number in asked[i][3]:
                        by_list.setdefault(number, []).append(q)
                for number in sorted(by_list):
                    if number in waiting or number in held:
                        queries = np.array(by_list[number])
                        ask(number, answers, queries, given[queries])
                yield answers.batch()

        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("shelf", "list", "lists", "cls", "raw", "ids", "asks", "limit"))
            for at, number, lists, cls, raw, ids, asks, limit in zip(*columns, strict=True):
                if at != shelf:
                    yield from home() if at_home else visit()
                    shelf, waiting, held, asked = at, {}, {}, []
                if number is None:
                    asked.append((cls, raw, limit, lists))
                    if len(asked) >= ASKED:
                        yield from visit()
                        asked = []
                else:
                    for column, value in zip(waiting.setdefault(number, ([], [], [], [])), (cls, raw, ids, asks), strict=True):
                        column.append(value)
        yield from home() if at_home else visit()

    return rows.select("shelf", "list", "lists", "cls", "raw", "ids", "asks", "limit").mapInArrow(run, _FOUND)


def _view(held: _Held, some: np.ndarray) -> _Held:
    """Some of a list's candidates."""
    out = object.__new__(_Held)
    out.ids, out.cls, out.given = [held.ids[i] for i in some], [held.cls[i] for i in some], held.given[some]
    out.blocks, out.square = [b[some] for b in held.blocks], held.square[some]
    return out


def nearest(vectors: DataFrame, query: Column, k: int = NEAREST, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id fulfils `query` (a condition on the column `id`) the k nearest other rows found, by cosine in double precision.

    Returns query_id, rank from 1, `id_col` and score, best first and ties to the smaller id. Vectors that are null,
    empty, zero or hold a null or a value that is not finite take no part, nor do rows with a null id; only vectors of
    equal length are compared. Rows that repeat both id and vector are one row; those that repeat an id with another
    vector are rows of their own. Ids must be integers; other columns are not read.
    """
    small_batches(vectors, 1024)
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    signed = written(_digests(rows, kind).where("digest is not null").withColumnRenamed("digest", "cls"), "vectors")
    classes = written(_classes(signed, query, k), "classes")
    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("raw")), F.lit(1)).alias("width")).first()
    index = fit(classes, size["n"], k, kind, recall, size["width"])
    homes = written(_homes(classes, index, kind), "homes")
    # One row for each list: at most CENTRES a length of vector.
    room = max(64, min(SHELF, SHELF_BYTES // size["width"]))
    shelves = _shelves({r["list"]: r["count"] for r in homes.groupBy("list").count().collect()}, room)
    kept = written(_dealt(homes, shelves), "shelves")
    none = {"lists": F.lit(None).cast("array<long>"), "limit": F.lit(None).cast("double")}
    near = written(_searched(kept.withColumns(none).repartition("shelf").sortWithinPartitions("shelf", "list"), k + 1, kind, True), "near")
    probes = _probes(kept.where("asks").join(near.select("cls", "limit"), "cls"), index, shelves, kind)
    both = kept.withColumns(none | {"asks": F.lit(False)}).unionByName(probes.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    far = _searched(both.repartition("shelf").sortWithinPartitions("shelf", "asks", "list"), k + 1, kind, False)
    found = near.unionByName(far).select("cls", F.explode(F.arrays_zip("ids", "scores", "own")).alias("x")).select("cls", "x.*")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("scores"), "ids", F.desc("own")))).where(F.col("n") <= k + 1).drop("n")
    asked = signed.where(query).select(F.col("id").alias("query_id"), "cls").distinct()
    pairs = asked.join(best, "cls").where("not (own and ids = query_id)")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "cls").orderBy(F.desc("scores"), "ids"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("ids").alias(id_col), F.col("scores").alias("score"))


def op13_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
