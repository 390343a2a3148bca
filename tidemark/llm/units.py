"""Whole texts as runs of characters, each distinct run worked out once per worker.

Most per-text work here (scoring, counting, hashing) is a sum or a concatenation over a text's words or chunks. `Runs`
finds and hashes those of many texts at once, and a worker keeps a bounded memo from a run's hash to its result, so
that only runs not seen lately are worked out. `chunks` and `Memo` do the same for work that needs strings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A space after something that is not white space: no match of the usual pre-tokeniser patterns spans it.
_CUT, _RUN = re.compile(r"(?<=\S) "), re.compile(r"\s ")
#: Chunks and runs longer than this are worked out but not kept.
_LONG = 160
#: Characters that are read at once, but for a longer text without spaces.
READ = 1 << 19

_TESTS: dict[str, Callable[[str], bool]] = {
    "letter": lambda c: unicodedata.category(c)[0] == "L",
    "letter or mark": lambda c: unicodedata.category(c)[0] in "LM",
    "alphanumeric": str.isalnum,
    "word": lambda c: c.isalnum() or c == "_",  # \w
    "space": lambda c: c == " ",
    "not space": lambda c: c != " ",
    "space or line": lambda c: c in " \n",
}


@lru_cache(maxsize=None)
def code_points(kind: str) -> np.ndarray:
    """For each code point whether it is of that kind."""
    test = _TESTS[kind]
    return np.fromiter((test(chr(c)) for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    base = 0x5851F42D4C957F2D
    made = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    return made[0], made[1]


def reads(many: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Numbers of texts with their parts, about READ characters together; a text is cut behind spaces only."""
    some, size = [], 0
    for i, text in enumerate(many):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > READ:
                space = text.find(" ", at + READ)
                end = space + 1 if space >= 0 else end
            some.append((i, text[at:end]))
            size, at = size + end - at, end
            if size >= READ:
                yield some
                some, size = [], 0
    if some:
        yield some


class Runs:
    """The runs of some parts of texts, in order.

    A run holds the characters of one kind that stand between two breaks, at least one; where `breaks` is None, any
    other character is a break. Spaces must be breaks.
    """

    def __init__(self, parts: list[tuple[int, str]], keep: str, breaks: str | None = None):
        points = np.frombuffer(" ".join([p for _, p in parts]).encode("utf-32-le"), "<u4")
        kept = code_points(keep)[points]
        at = np.flatnonzero(kept)
        group = np.cumsum(code_points(breaks)[points] if breaks else ~kept)[at]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        #: Code points of all runs, and where each of them begins in that and in the parts.
        self.points, self.start = points[at], first
        self.size = np.diff(first, append=len(at))
        self.group = group[first]
        ends = np.cumsum([len(p) + 1 for _, p in parts])
        #: The number of each run's text.
        self.text = np.array([i for i, _ in parts], np.int64)[np.searchsorted(ends, at[first], "right")]
        up, down = _powers(1 << max(READ, len(at)).bit_length())
        mixed = (self.points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * up[: len(mixed)], dtype=np.uint64)])
        hashed = (sums[first + self.size] - sums[first]) * down[first] + self.size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        hashed = (hashed ^ (hashed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        self.hash = hashed ^ (hashed >> np.uint64(29))

    def __len__(self) -> int:
        return len(self.start)

    def count(self, kind: str) -> np.ndarray:
        """How many characters of that kind each run holds."""
        sums = np.concatenate([[0], np.cumsum(code_points(kind)[self.points])])
        return sums[self.start + self.size] - sums[self.start]

    def only(self, on: np.ndarray) -> Runs:
        """These runs alone."""
        self.start, self.size, self.group, self.text, self.hash = (x[on] for x in (self.start, self.size, self.group, self.text, self.hash))
        return self

    def spelled(self, which: np.ndarray) -> list[str]:
        return [self.points[a : a + n].tobytes().decode("utf-32-le") for a, n in zip(self.start[which].tolist(), self.size[which].tolist(), strict=True)]

    def by_size(self, which: np.ndarray, short: int, most: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in `which` and code points of runs of one size at a time; those longer than `short` singly."""
        size = self.size[which]
        order = np.argsort(size, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
            n = int(size[group[0]])
            step = most if n <= short else 1
            for at in range(0, len(group), step):
                part = group[at : at + step]
                yield part, self.points[self.start[which[part], None] + np.arange(n)]


class Rows:
    """A memo from a run's hash to a row of numbers, which a function gives for some runs.

    A hash table in arrays, within `most_bytes`; it starts anew when half its slots are taken. Runs longer than
    `longest` are worked out each time.
    """

    def __init__(self, width: int, longest: int = _LONG, most_bytes: int = 32 << 20):
        self.width, self.longest = width, longest
        bits = max(10, (most_bytes // (12 + 4 * width)).bit_length() - 1)
        self.shift, self.mask, self.limit = np.uint64(64 - bits), (1 << bits) - 1, 1 << (bits - 1)
        self.keys, self.place = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        self.rows, self.used = np.zeros((self.limit, width)), 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's row number, or -1, and the slot where it is or may be put."""
        slot = (keys >> self.shift).astype(np.int64)
        place = self.place[slot]
        on = np.flatnonzero((place >= 0) & (self.keys[slot] != keys))
        while len(on):
            slot[on] = (slot[on] + 1) & self.mask
            place[on] = self.place[slot[on]]
            on = on[(place[on] >= 0) & (self.keys[slot[on]] != keys[on])]
        return place, slot

    def _add(self, keys: np.ndarray, slot: np.ndarray, number: np.ndarray) -> None:
        """Puts distinct new keys into free slots; those that meet in one try the next."""
        while len(keys):
            self.keys[slot], self.place[slot] = keys, number
            lost = self.place[slot] != number
            keys, number = keys[lost], number[lost]
            slot = self._find(keys)[1]

    def _places(self, runs: Runs, short: np.ndarray, compute: Callable[[Runs, np.ndarray], np.ndarray]) -> np.ndarray:
        keys, first, back = np.unique(runs.hash[short], return_index=True, return_inverse=True)
        at, slot = self._find(keys)
        new = np.flatnonzero(at < 0)
        if self.used + len(new) > self.limit:
            self.place.fill(-1)
            self.used, new = 0, np.arange(len(keys))
            at, slot = self._find(keys)
        at[new] = np.arange(self.used, self.used + len(new))
        self.rows[at[new]] = compute(runs, short[first[new]])
        self._add(keys[new], slot[new], at[new])
        self.used += len(new)
        return at[back]

    def of(self, runs: Runs, compute: Callable[[Runs, np.ndarray], np.ndarray]) -> np.ndarray:
        """A row for each run. `compute` is not kept: an owner that its memo refers to would outlive its task."""
        out = np.empty((len(runs), self.width))
        short = np.flatnonzero(runs.size <= self.longest)
        if 0 < len(short) <= self.limit:
            out[short] = self.rows[self._places(runs, short, compute)]
        elif len(short):
            out[short] = compute(runs, short)
        if len(short) < len(runs):
            long = np.flatnonzero(runs.size > self.longest)
            out[long] = compute(runs, long)
        return out


def per_text(runs: Runs, rows: np.ndarray, texts: int, by: np.ufunc = np.add, empty: float = 0.0) -> np.ndarray:
    """The rows of each text's runs put together."""
    out = np.full((texts, rows.shape[1]), empty)
    if len(runs):
        first = np.flatnonzero(np.diff(runs.text, prepend=-1))
        out[runs.text[first]] = by(out[runs.text[first]], by.reduceat(rows, first))
    return out


def chunks(text: str) -> list[str]:
    """The text cut at spaces that follow something else; every chunk but the first had a space before it.

    Runs of white space stay inside one chunk, so that patterns that look at them see them whole.
    """
    return _CUT.split(text) if _RUN.search(text) else text.split(" ")


class Memo:
    """A bounded memo of `compute`, a function from a list of distinct keys to the list of their values.

    Two generations: when the young one is full it becomes the old one; what is still in use moves over.
    """

    def __init__(self, compute: Callable[[list[str]], Iterable[Any]], limit: int = 200_000):
        self.compute, self.limit = compute, limit
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}
        self.long: list[str] = []

    def table(self, lists: Iterable[list[str]]) -> dict[str, Any]:
        """A dictionary that holds every key of the lists."""
        need: set[str] = set()
        for x in lists:
            need.update(x)
        for k in self.long:
            self.young.pop(k, None)
            self.old.pop(k, None)
        new = need - self.young.keys()
        if len(self.young) + len(new) > self.limit and self.young:
            self.old, self.young, new = self.young, {}, need
        old = self.old
        kept = new & old.keys()
        for k in kept:
            self.young[k] = old[k]
        miss = list(new - kept)
        if miss:
            self.young.update(zip(miss, self.compute(miss), strict=True))
        self.long = [k for k in miss if len(k) > _LONG]
        return self.young


def small_batches(frame: DataFrame, rows: int = 256) -> None:
    """Python gets at most so many rows, and about 32 MB, at a time, from all plans that the session makes from now on."""
    conf = frame.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def pieces_of(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in slices, where a session's setting gave larger ones."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's values, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
