"""Operator 3: packing documents into fixed-length sequences along a space-filling curve.

Each document's hashed vector is projected to a few dimensions; its place on a Hilbert curve through them is the
sort key, so like documents stand together. The rows are range-partitioned by that key and every partition is packed as one
stream of tokens, cut where a sequence is full. Only the last, unfinished stretch of a partition would need padding;
it is cut into sequences whose lengths are powers of two, which need none.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import ByteTable
from tidemark.llm.units import pieces_of, small_batches, texts

#: Buckets of a document's hashed vector, dimensions it is projected to, bits of each.
BUCKETS, DIMENSIONS, BITS = 256, 4, 12
#: Random rows for each partition that the bounds of ranges are drawn from, and of all together.
BOUND_ROWS, MOST_BOUND_ROWS = 200, 1_000_000
#: Bytes of text from which a partition of its own is made.
PARTITION_BYTES = 64 << 20


def hashed_vector(text: str) -> np.ndarray:
    """Log counts of the text's hashed byte 4-grams, of length 1; zeros if there are none."""
    raw = text.encode()
    n = np.zeros(BUCKETS)
    for first in range(min(4, max(0, len(raw) - 3))):  # each reads every fourth 4-gram in place
        h = np.frombuffer(raw, "<u4", (len(raw) - first) // 4, first) * np.uint32(0x9E3779B1)
        n += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    v = np.log1p(n)
    return v / max(np.linalg.norm(v), 1e-12)


def projection(seed: int = 11) -> np.ndarray:
    """Fixed directions of mean 0, so that what all documents share falls out."""
    r = np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))
    r -= r.mean(0)
    return r / np.linalg.norm(r, axis=0)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of non-negative integers below 2 ** bits.

    By the transpose form of the curve: undo the excess rotations from the top bit down, Gray-code the result and
    interleave its bits.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(many: list[str]) -> np.ndarray:
    """Sort keys of texts: hashed, projected, squeezed to (0, 1) in each dimension, placed on the curve."""
    v = np.array([hashed_vector(t) for t in many]).reshape(-1, BUCKETS) @ projection()
    cells = np.minimum((1 << BITS) - 1, (1 << BITS) / (1 + np.exp(-12.0 * v))).astype(np.int64)
    return hilbert_keys(cells, BITS)


def _powers(n: int) -> list[int]:
    """Powers of two that sum to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Cuts a stream of documents' ids at `size`; the last stretch goes out only when `finish` says that it ends."""

    def __init__(self, size: int, first: int):
        self.size, self.sequence, self.fill = size, first, 0
        self.open: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(self.size - self.fill, len(ids) - at)
            self.open.append((doc_id, at, ids[at : at + n], len(ids)))
            self.fill, at = self.fill + n, at + n
            if self.fill == self.size:
                self._write(self.size)

    def _write(self, n: int) -> None:
        """The next n open ids as one sequence."""
        offset = 0
        while offset < n:
            doc_id, start, ids, total = self.open.pop(0)
            if len(ids) > n - offset:
                k = n - offset
                self.open.insert(0, (doc_id, start + k, ids[k:], total))
                ids = ids[:k]
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset))
            offset += len(ids)
        self.sequence, self.fill = self.sequence + 1, self.fill - n

    def finish(self) -> None:
        for n in _powers(self.fill):
            self._write(n)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [()] * 7
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def _place(key: int, id_: int | None, tie: int) -> tuple[int, int, int]:
    """Where a row stands in the order; a null id comes first."""
    return key, -(1 << 63) if id_ is None else id_, tie


def _bounds(rows: DataFrame, keyed: Callable[[DataFrame], DataFrame], n: int, total: int) -> list[tuple]:
    """Places that cut the order into n ranges of about equally many rows: quantiles of BOUND_ROWS random rows a range.

    They only say which task gets a row. Spark's own range partitioning would hash every text a second time for them.
    """
    if n < 2:
        return []
    fraction = min(1.0, min(BOUND_ROWS * n, MOST_BOUND_ROWS) / max(1, total))
    some = keyed(rows.sample(fraction, 17) if fraction < 1 else rows).select("key", "id", "tie")
    places = sorted(_place(*r) for r in some.collect())
    return [places[len(places) * i // n] for i in range(1, n)] if places else []


class Encoder:
    """Texts to the ids that `tokenizers` gives for the file at `path`, as little-endian unsigned 32-bit numbers.

    `tiktoken` merges by rank. Where a byte-level vocabulary's merges stand in the order of their tokens' ids, ids are
    ranks and both libraries give the same ids, `tiktoken` in a quarter of the time. Other vocabularies, texts that
    hold an added token's string, and texts whose white space is too long for its pattern go to `tokenizers`.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library, self.fast = Tokenizer.from_file(path), None
        added = self.library.get_added_tokens_decoder()
        self.added = [] if self.library.encode_special_tokens else [t.content for t in added.values()]
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab = model.get("vocab", {})
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", [])]
        own = {t: i for t, i in vocab.items() if i not in added}
        if made and made == sorted(made) and len(own) == len(made) + 256:
            table = ByteTable(own)
            ranks = {table.bytes[i]: i for i in own.values()}
            self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not any(t in text for t in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # more white space in a row than its pattern's stack holds
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> Encoder:
    """Kept for a worker's next task."""
    return Encoder(path, pattern)


def pack(docs: DataFrame, path: str, pattern: str, size: int = 2048, end_id: int = 1, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents' ids, each followed by `end_id`, cut into sequences of `size` ids, neighbours on the curve together.

    Ids are those of the `tokenizers` file at `path`, whose pre-tokeniser is `pattern`, with add_special_tokens=False:
    none are added, but an added token's own string in a text is that token, as the library has it. Null counts as the
    empty text, which is `end_id` alone. Returns a row for each piece: `id_col`, start, length, ids_crc32 (of the ids
    as little-endian 32-bit numbers), doc_tokens, sequence_id and offset. Every id of every row, repeated or not, lies
    in exactly one piece; sequences have no gaps; only those of a partition's end are shorter than `size`, and their
    lengths are powers of two. There is a partition for every PARTITION_BYTES of text, and at least as many as the
    session shuffles into. Equal keys are ordered by id (null first) and a hash of the text, and split between
    partitions where they are many. Ids must be integers; other columns are not read.
    """
    spark = docs.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole):
                keys = curve_keys(texts(batch)).tolist()
                ids, ties = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                to = [bisect_right(bounds, _place(*row)) for row in zip(keys, ids, ties, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(keys, pa.int64()), *batch.columns], ["to", "key", "id", "text", "tie"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        packer = Packer(size, TaskContext.get().partitionId() << 36)
        end = np.array([end_id], "<u4")
        for whole in batches:
            for batch in pieces_of(whole):
                for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                    packer.add(doc_id, np.concatenate([encoder.ids(text), end], dtype="<u4"))
                yield packer.batch()
        packer.finish()
        yield packer.batch()

    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    schema = "to int, key long, id long, text string, tie long"
    size_of = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size_of["bytes"] or 0) // PARTITION_BYTES))
    bounds: list[tuple] = []
    bounds = _bounds(rows, lambda some: some.mapInArrow(keyed, schema), n, size_of["rows"])
    rows = rows.mapInArrow(keyed, schema).repartitionById(n, F.col("to")).sortWithinPartitions("key", "id", "tie").select("id", "text")
    return rows.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
