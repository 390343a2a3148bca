"""Operator 5: n-gram Jaccard join by MinHash banding.

Texts with the same n-gram set are one class. Classes that share a band hash are candidates. Those connected by
candidates meet in one task, which compares the full n-gram sets of candidates and gives every class the number of
texts that it links to and the smallest class that it is linked with there. Where they are too many for a task they
are dealt into blocks that meet in pairs: all of them, or band by band where that sends fewer texts, and then a pair
counts in the first band that it shares. The same pairs are compared either way, and no pair is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.graph import components, written
from tidemark.llm.units import Runs, pieces_of, reads, small_batches, texts

#: Words of an n-gram, least similarity, chance that a pair of just that similarity shares a band, most hashes.
WORDS, SIMILARITY, RECALL, HASHES = 5, 0.8, 0.9999, 128
#: N-grams and classes of a block: a task compares two blocks at most.
BLOCK, CLASSES = 1_000_000, 4096


def bands_for(similarity: float, recall: float, most: int = HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows to a band with which at most `most` hashes reach the recall at that similarity."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)), 1) if similarity < 1 else (1, 1)
    for rows in range(2, 16):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows))) if similarity < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def word_hashes(many: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts' words in order: the text's number and a hash. Words are lower-case runs of letters, digits and underscores."""
    found = [Runs(parts, "word") for parts in reads([x.lower() for x in many])]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(f.text for f in found)]), np.concatenate([none.astype(np.uint64), *(f.hash for f in found)])


class Grams:
    """The set of a text's n-grams as sorted hashes; a text of fewer words, but one at least, is one n-gram."""

    def __init__(self, words: int = WORDS):
        self.words = words

    @staticmethod
    def _joined(h: np.ndarray, n: int) -> np.ndarray:
        """A hash of each n neighbours."""
        g = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            g *= np.uint64(0x9E3779B97F4A7C15)
            g ^= g >> np.uint64(29)
            g += h[i : len(h) - n + 1 + i]
        g *= np.uint64(0xBF58476D1CE4E5B9)
        return g ^ (g >> np.uint64(32))

    def sets(self, many: list[str]) -> Iterator[np.ndarray]:
        text, h = word_hashes(many)
        size = np.bincount(text, minlength=len(many))
        start = np.cumsum(size) - size
        all_of = self._joined(h, self.words) if len(h) >= self.words else h[:0]
        for at, n in zip(start.tolist(), size.tolist(), strict=True):
            if n >= self.words:
                yield np.unique(all_of[at : at + n - self.words + 1])
            else:
                yield self._joined(h[at : at + n], n) if n else h[:0]


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.xor = rng.integers(0, 1 << 63, bands * rows, np.uint64)
        self.times = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """A hash for each band, different for different bands."""
        low = np.full(len(self.xor), np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(grams), 2048):
            part = (grams[start : start + 2048, None] ^ self.xor[None, :]) * self.times[None, :]
            low = np.minimum(low, (part ^ (part >> np.uint64(31))).min(0))
        low = low.reshape(self.bands, self.rows)
        key = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(self.rows):
            key = (key ^ low[:, i]) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(30)
        return key.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """id, raw, digest of the n-gram set (null if it is empty), n_grams, keys of the bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, hashed = Grams(words), MinHash(bands, rows)
        for whole in batches:
            for batch in pieces_of(whole):
                digests, sizes, keys = [], [], []
                for g in grams.sets(texts(batch)):
                    digests.append(xxhash.xxh3_128_digest(g.tobytes()) if len(g) else None)
                    sizes.append(len(g))
                    keys.append(hashed.keys(g) if len(g) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "raw", "digest", "n_grams", "keys"])

    return docs.select("id", "raw", "text").mapInArrow(run, "id long, raw long, digest binary, n_grams long, keys array<long>")


class _Block:
    """What one task compares: the classes of one block, or of two blocks with each other, in order of class."""

    def __init__(self, similarity: float, key: int | None):
        self.similarity, self.key = similarity, key  # the band that the block's candidates share first; None for any
        self.ids: list[int] = []
        self.members: list[int] = []
        self.sets: list[np.ndarray] = []
        self.keys: list[list[int]] = []
        self.right: list[bool | None] = []  # None where a block meets itself

    def compare(self) -> pa.RecordBatch:
        """class, texts that it links to here, smallest class that it is linked with here."""
        n = len(self.ids)
        sizes, members, keys = np.array([len(s) for s in self.sets]), np.array(self.members, np.int64), np.array(self.keys, np.int64)
        links, root = np.zeros(n, np.int64), np.arange(n)
        two = self.right[0] is not None
        against = np.array([i for i in range(n) if self.right[i] or not two], np.int64)
        owner = np.repeat(against, sizes[against])
        grams = np.concatenate([np.zeros(0, np.uint64), *(self.sets[i] for i in against)])
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        for i in range(n):
            if two and self.right[i]:
                continue
            start = np.searchsorted(grams, self.sets[i], "left")
            count = np.searchsorted(grams, self.sets[i], "right") - start
            at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            common = np.bincount(owner[at], minlength=n)
            linked = common >= self.similarity * (sizes[i] + sizes - common) - 1e-9
            linked[: i + 1] &= two
            linked &= common > 0
            linked[i] = False
            found = np.flatnonzero(linked)
            same = keys[found] == keys[i]
            on = same.any(1)
            if self.key is not None:
                on &= keys[i][same.argmax(1)] == self.key
            found = found[on]
            if len(found):
                links[i] += members[found].sum()
                links[found] += members[i]
                met = np.unique(np.append(root[found], root[i]))
                if len(met) > 1:
                    root[np.isin(root, met[1:])] = met[0]
        ids = np.array(self.ids, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(ids[root])], ["cls", "links", "root"])


def _compared(rows: DataFrame, similarity: float, words: int) -> DataFrame:
    """rows: task, is_right (null where a block meets itself), band, cls, members, keys, text, sorted by task and cls. Returns cls, links, root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, task, block = Grams(words), None, None
        for whole in batches:
            for batch in pieces_of(whole):
                for at, right, band, cls, members, keys, g in zip(*(batch.column(i).to_pylist() for i in range(6)), grams.sets(texts(batch)), strict=True):
                    if at != task:
                        if block:
                            yield block.compare()
                        task, block = at, _Block(similarity, band)
                    block.ids.append(cls)
                    block.members.append(members)
                    block.keys.append(keys)
                    block.sets.append(g)
                    block.right.append(right)
        if block:
            yield block.compare()

    return rows.select("task", "is_right", "band", "cls", "members", "keys", "text").mapInArrow(run, "cls long, links long, root long")


def _tasks(placed: DataFrame, shared: DataFrame, block: int, most: int) -> DataFrame:
    """task, is_right, band, cls, members, split: which classes meet where.

    A unit is a component of candidates, or, where it takes more than one block and that sends fewer n-grams, each of
    its bands; a unit's blocks meet in pairs.
    """
    whole = placed.select("component", "cls", "members", F.lit(None).cast("long").alias("band"), F.col("component").alias("unit"), "blocks")
    units = whole.withColumn("split", F.col("blocks") > 1)
    large = placed.where("blocks > 1")
    if not large.isEmpty():
        keyed = written(large.withColumn("key", F.explode("keys")).drop("keys").join(shared.select("key"), "key", "left_semi"), "keyed")
        bands = keyed.groupBy("component", "key").agg(_blocks(block, most).alias("key_blocks"), F.sum("n_grams").alias("key_grams"))
        sent = bands.groupBy("component").agg(F.sum(F.col("key_grams") * F.col("key_blocks")).alias("sent"))
        cheap = large.groupBy("component").agg(F.sum(F.col("n_grams") * F.col("blocks")).alias("whole")).join(sent, "component").where("sent < whole").select("component")
        banded = keyed.join(cheap, "component", "left_semi").join(bands, ["component", "key"])
        banded = banded.select("component", "cls", "members", F.col("key").alias("band"), F.xxhash64("component", "key").alias("unit"), F.col("key_blocks").alias("blocks"), F.lit(True).alias("split"))
        units = units.join(cheap, "component", "left_anti").unionByName(banded)
    dealt = units.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    is_right = F.when(F.col("own") != F.col("other"), F.col("own") > F.col("other"))
    return dealt.select(F.xxhash64("unit", F.least("own", "other"), F.greatest("own", "other")).alias("task"), is_right.alias("is_right"), "band", "cls", "members", "split")


def _blocks(block: int, most: int):
    return F.greatest(F.ceil(F.sum("n_grams") / F.lit(block)), F.ceil(F.count("*") / F.lit(most)))


def jaccard_join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK, most: int = CLASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links texts whose sets of `words`-word n-grams have a Jaccard similarity of `similarity` or more.

    Words are lower-case runs of letters, digits and underscores. Returns for each row `id_col`, class_id (the
    smallest id with the same n-gram set), n_links (other rows linked directly, copies included), component_id (the
    smallest id reachable by links) and kept (whether that is the row itself). A text without words links with
    nothing, not even its copies. Rows with a null id are not compared: 0 links, no class, kept. Rows that repeat an
    id count as texts of their own. Ids must be integers; other columns are not read. A pair of just `similarity` is
    compared with probability `recall`, more similar ones with more. A task holds two blocks of `block` n-grams and
    `most` classes at most, about.
    """
    out = _joined(docs, words, similarity, recall, block, most, id_col, text_col)
    return out.select(F.col("id").alias(id_col), "class_id", "n_links", "component_id", "kept")


def _joined(docs: DataFrame, words: int, similarity: float, recall: float, block: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """As jaccard_join, with raw (a hash of the text) and root (the group's key, null for a text without words).

    A class goes by the hash of its n-gram digest, and its representative by id and raw: an id alone may stand for
    different texts.
    """
    bands, rows = bands_for(similarity, recall)
    small_batches(docs)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("raw"), F.col(text_col).alias("text"))
    signed = written(signatures(named, bands, rows, words), "signatures")
    has = F.col("id").isNotNull() & F.col("digest").isNotNull()
    classes = written(signed.where(has).groupBy("digest").agg(F.xxhash64("digest").alias("cls"), F.min(F.struct("id", "raw")).alias("rep"), F.count("*").alias("members"), F.first("n_grams").alias("n_grams"), F.first("keys").alias("keys")), "classes")
    keyed = classes.select(F.explode("keys").alias("key"), "cls")
    shared = keyed.groupBy("key").agg(F.min("cls").alias("v"), F.max("cls").alias("x")).where("v <> x").select("key", "v")
    near = components(keyed.join(shared, "key").select(F.col("cls").alias("u"), "v"))
    sized = near.join(classes.withColumnRenamed("cls", "node").drop("digest"), "node").withColumnRenamed("node", "cls")
    placed = written(sized.join(sized.groupBy("component").agg(_blocks(block, most).alias("blocks")), "component"), "placed")
    tasks = written(_tasks(placed, shared, block, most), "tasks")
    wanted = placed.select(F.col("cls").alias("of"), "rep.id", "rep.raw", "keys")
    reps = named.where("id is not null").join(wanted, ["id", "raw"]).dropDuplicates(["of"]).select("of", "keys", "text")
    together = tasks.join(reps, tasks["cls"] == reps["of"]).repartition("task").sortWithinPartitions("task", "cls")
    found = written(_compared(together, similarity, words), "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    edges = found.join(tasks.where("split").select("cls").distinct(), "cls", "left_semi").select(F.col("cls").alias("u"), F.col("root").alias("v"))
    whole = components(edges)
    links = links.join(whole, links["cls"] == whole["node"], "left").select(F.col("cls").alias("of"), "links", F.coalesce("component", "root").alias("root"))
    linked = written(classes.select("cls", "rep.id").join(links, F.col("cls") == F.col("of")).select("of", "id", "links", "root"), "linked")
    least = written(linked.groupBy("root").agg(F.min("id").alias("least")), "least")
    links = linked.join(least, "root").select("of", "links", "root", "least")
    known = classes.select(F.col("digest").alias("match"), "cls", F.col("rep.id").alias("class_id"), "members").join(links, F.col("cls") == F.col("of"), "left")
    # Rows without a class match nothing, each under a key of its own, longer than a digest, rather than all under null.
    alone = F.encode(F.concat(F.lit("-" * 17), F.coalesce("id", "raw").cast("string")), "utf-8")
    out = signed.select("id", "raw", F.when(has, F.col("digest")).otherwise(alone).alias("match")).join(known, "match", "left")
    component = F.coalesce("least", "class_id", "id")
    return out.select(
        "id",
        "raw",
        F.coalesce("root", "cls").alias("root"),
        F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"),
        (F.coalesce("members", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, all columns, of one document for each connected group; rows that repeat an id and its text are one document."""
    options = {"words": WORDS, "similarity": SIMILARITY, "recall": RECALL, "block": BLOCK, "most": CLASSES, "id_col": "doc_id", "text_col": "text"} | options
    id_col, text_col = options["id_col"], options["text_col"]
    kept = _joined(docs, **options).where("kept and id is not null")
    kept = kept.groupBy("id", "root", F.when(F.col("root").isNull(), F.col("raw")).alias("alone")).agg(F.min("raw").alias("raw"), F.count("*").alias("copies"))
    copies = next(name for name in (f"_copies{i}" for i in range(len(docs.columns) + 1)) if name not in docs.columns)
    same = (F.col(f"d.{id_col}").cast("long") == F.col("k.id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("k.raw"))
    rows = docs.alias("d").join(kept.alias("k"), same).select("d.*", F.col("k.copies").alias(copies))
    once = rows.where(F.col(copies) == 1).unionByName(rows.where(F.col(copies) > 1).dropDuplicates([id_col, text_col]))
    return once.drop(copies).unionByName(docs.where(F.col(id_col).isNull()))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
