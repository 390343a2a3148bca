"""Operator 2: byte-level BPE encoding and decoding.

`tokenizers` does the merges; its vocabulary is written in characters, one for each byte, so the rank file's byte
strings go through that byte-to-character table on the way in and ids go back through it to bytes on the way out. A
character whose bytes lie in several tokens comes back whole because decoding joins bytes, not characters.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.units import Memo, chunks, pieces_of, small_batches, texts

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Marks that are a match of their own behind letters, where the chunk ends.
_MARKS = frozenset(",.!?;:")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one from U+0100 on, in order."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def from_ranks(path: str, pattern: str):
    """A `tokenizers` tokeniser that gives the ids of a rank file.

    Ranks merge any two neighbours whose join has a rank, so every way to cut a token into two tokens is a merge,
    with the rank of the token that it makes; a match that is itself a token is that token.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    written = {t: "".join(chars[b] for b in t) for t in ranks}
    merges = [
        (written[t[:i]], written[t[i:]])
        for t, _ in sorted(ranks.items(), key=lambda x: x[1])
        for i in range(1, len(t))
        if t[:i] in ranks and t[i:] in ranks
    ]
    made = Tokenizer(models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return made


class ByteTable:
    """From ids to bytes: each token's characters, reversed through the byte table."""

    def __init__(self, vocab: dict[str, int]):
        byte = {c: b for b, c in enumerate(byte_characters())}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(byte.__getitem__, token)) if all(c in byte for c in token) else token.encode()
        self.sizes = np.array([len(b) for b in self.bytes])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Encoder:
    """Texts to ids, chunk by chunk (`units.chunks`).

    Ids are little-endian unsigned 32-bit numbers, in bytes. A chunk is cut into the pattern's matches, and each
    distinct match goes through the byte-to-character table and the library's merges once, many matches to a call.
    Both steps are kept in bounded memos.
    """

    def __init__(self, tokenizer, pattern: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.merges, self.limit = Tokenizer(tokenizer.model), limit
        self.find = regex.compile(pattern).findall
        self.chars = dict(enumerate(byte_characters()))
        self.words: dict[str, bytes] = {}
        self.led = Memo(lambda keys: self._values(list(map(self._matches, keys))), limit)

    def _merge(self, words: list[str], at_once: int = 2048) -> None:
        """Puts the ids of these matches into the memo."""
        for i in range(0, len(words), at_once):
            part = words[i : i + at_once]
            spelled = [w.encode().decode("latin-1").translate(self.chars) for w in part]
            made = self.merges.encode(spelled, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(made.ids, "<u4").tobytes()
            ends = (np.searchsorted(np.array(made.word_ids), np.arange(len(part) + 1)) * 4).tolist()
            self.words.update(zip(part, map(ids.__getitem__, map(slice, ends[:-1], ends[1:])), strict=True))

    def _matches(self, key: str) -> list[str]:
        """Of a chunk that had a space before it. Letters, with at most one mark behind them, need no pattern."""
        if key.isalpha():
            return [" " + key]
        if key[-1:] in _MARKS and key[:-1].isalpha():
            return [" " + key[:-1], key[-1]]
        return self.find(" " + key)

    def _values(self, cut: list[list[str]]) -> list[bytes]:
        """Ids of chunks, given as their matches. The memo of matches starts anew when it is full; long ones are not kept."""
        if len(self.words) > self.limit:
            self.words.clear()
        words = self.words
        self._merge(list({w for x in cut for w in x}.difference(words)))
        out = [words[x[0]] if len(x) == 1 else b"".join(map(words.__getitem__, x)) for x in cut]
        for w in {w for x in cut for w in x if len(w) > 160}:
            del words[w]
        return out

    def encode(self, many: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids."""
        cut = [chunks(x) for x in many]
        heads = self._values([self.find(x[0]) for x in cut])
        rests = [x[1:] for x in cut]
        of = self.led.table(rests).__getitem__
        for x, head, rest in zip(cut, heads, rests, strict=True):
            yield np.frombuffer(b"".join([head, *map(of, rest)] if x[0] else list(map(of, rest))), "<u4")


@lru_cache(maxsize=1)
def _rank_encoder(path: str, pattern: str) -> tuple[Encoder, ByteTable, list[str]]:
    """An encoder by a rank file, its byte table and ids in decimal; kept for a worker's next task."""
    tokenizer = from_ranks(path, pattern)
    table = ByteTable(tokenizer.get_vocab())
    return Encoder(tokenizer, pattern), table, list(map(str, range(len(table.bytes))))


def offsets_of(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end, in code points, of tokens of these sizes in bytes; tokens that share a character all cover it."""
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return character[ends - sizes], character[ends - 1] + 1


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every whole text encoded by the rank file at `path`, each match of `pattern` separately, and decoded again.

    Returns `id_col`, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the decoded
    bytes) and, with keep_ids, ids (array of int), starts and ends (each token's place in code points) and decoded
    (binary). Null counts as the empty text: no tokens, both digests those of the empty string. Text that looks like a
    special token is ordinary text. Null and repeated ids and repeated rows come out as they came in, one row for
    each; ids must be integers; other columns are not read.
    """
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, starts array<int>, ends array<int>, decoded binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table, decimal = _rank_encoder(path, pattern)
        number, spell = decimal.__getitem__, table.bytes.__getitem__
        for whole in batches:
            for batch in pieces_of(whole):
                many = texts(batch)
                counts, digests, back, held = [], [], [], []
                for text, ids in zip(many, encoder.encode(many), strict=True):
                    listed = ids.tolist()
                    decoded = b"".join(map(spell, listed))
                    counts.append(len(listed))
                    digests.append(hashlib.sha256(" ".join(map(number, listed)).encode()).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                    if keep_ids:
                        held.append((ids.astype(np.int32), *offsets_of(text, table.sizes[ids]), decoded))
                arrays = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    arrays += [pa.array([h[k] for h in held], pa.list_(pa.int32())) for k in range(3)] + [pa.array([h[3] for h in held], pa.binary())]
                    names += ["ids", "starts", "ends", "decoded"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    small_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`id_col`, decoded (binary) and text of arrays of ids, by the rank file at `path`.

    Bytes are joined before characters are read, so a character whose bytes lie in several tokens comes back whole;
    bytes that are no character, as where an array ends inside one, become U+FFFD in text. A null array gives null,
    an empty one the empty text; an id that the file lacks, or a null one, raises an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, _ = _rank_encoder(path, pattern)
        for whole in batches:
            for batch in pieces_of(whole):
                made = []
                for ids in batch.column(1).to_pylist():
                    if ids and (None in ids or min(ids) < 0 or max(ids) >= len(table.bytes)):
                        raise ValueError("an id is not in the vocabulary")
                    made.append(None if ids is None else table.decode(ids))
                shown = [None if x is None else x.decode("utf-8", "replace") for x in made]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array(shown, pa.string())], ["id", "decoded", "text"])

    small_batches(rows)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<long>").alias("ids")).mapInArrow(run, "id long, decoded binary, text string").withColumnRenamed("id", id_col)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
