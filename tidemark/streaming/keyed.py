"""Keyed state with timers: a cache whose entries expire, and what is known of each source's requests.

State is kept by Spark, one small value a key; a row that comes later than the watermark is left out. Both run under
`with_state`, which sets the store that such state needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Entries of a cache, seconds that one lives; requests of a source that are remembered, and of those the ones that its mean and its rate look at.
MOST_ENTRIES, LIFE = 1000, 1800
REMEMBERED, MEAN_OF, RATE_OF = 20, 5, 10
#: From so many entries on a cache has room for all of them; the parts that such a cache is dealt to.
UNBOUNDED, PARTS = 1 << 40, 64
#: The groups that sources are dealt to; one holds a batch's rows of its sources at once.
SHARES = 256


def with_state(spark: SparkSession) -> None:
    """State with lists, maps and timers needs this store; stateful queries that start later use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Cache(StatefulProcessor):
    """Entries of one cache: rows put and get them, in order of their time.

    A get finds what was put last under its key within `life` seconds, unless it was pushed out: a put that finds `most`
    entries removes the oldest, the smallest key of equals, before it renews or adds its own. Timers drop what has
    expired, so that nothing stays that no row asks for.
    """

    FOUND = "cache string, key string, at timestamp, seq long, op string, outcome string, value string"
    COLUMNS = [x.split()[0] for x in FOUND.split(", ")]

    def __init__(self, most: int = MOST_ENTRIES, life: int = LIFE):
        self.most, self.life = most, life * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "value string, at long")

    def _write(self, before: dict[str, tuple], held: dict[str, tuple]) -> None:
        """Changes alone, and a timer for the next entry that expires."""
        for key in before.keys() - held.keys():
            self.entries.removeKey((key,))
        for key, entry in held.items():
            if before.get(key) != entry:
                self.entries.updateValue((key,), entry)
        if held:
            self.handle.registerTimer((min(at for _, at in held.values()) + self.life) // 1000 + 1)

    @staticmethod
    def _drop(held: dict[str, tuple], at: int, key: str) -> bool:
        """Removes the entry that was put at that time, if it is still there."""
        there = key in held and held[key][1] == at
        if there:
            del held[key]
        return there

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        before = {k: tuple(v) for (k,), v in self.entries.iterator()}
        held, out = dict(before), []
        # Entries by age; those that were renewed or pushed out since are passed over.
        old = [(t, k) for k, (_, t) in held.items()]
        heapify(old)
        for name, at, seq, op, value in zip(every["key"], every["at"], every["seq"], every["op"], every["value"], strict=True):
            now = at.value // 1000
            if op == "put":
                while old and old[0][0] + self.life < now:
                    self._drop(held, *heappop(old))
                outcome = "renewed" if name in held else "kept"
                if len(held) >= self.most:
                    while not self._drop(held, *heappop(old)):
                        pass
                held[name] = value, now
                heappush(old, (now, name))
            elif name in held and now <= held[name][1] + self.life:
                outcome, value = "hit", held[name][0]
            else:
                outcome, value = "miss", None
            out.append((key[0], name, at, seq, op, outcome, value))
        self._write(before, held)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        before = {k: tuple(v) for (k,), v in self.entries.iterator()}
        self._write(before, {k: v for k, v in before.items() if now <= v[1] + self.life})
        yield pd.DataFrame([], columns=self.COLUMNS)

    def close(self) -> None:
        pass


def cached(rows: DataFrame, late: str = "1 hour", most: int = MOST_ENTRIES, life: int = LIFE) -> DataFrame:
    """A stream of rows (cache, key, at, seq, op, value; op is put or get) with the outcome of each: Cache.FOUND.

    Rows of one micro-batch are taken in order of at and seq; those of later batches come after them. The entries of a
    cache compete for its room, so it is one group; where there is room for all (`most` is UNBOUNDED), no entry depends
    on another, and a cache is dealt to PARTS groups by its keys.
    """
    timed, by = rows.withWatermark("at", late), ["cache"]
    if most >= UNBOUNDED:
        timed, by = timed.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS))), ["cache", "part"]
    return timed.groupBy(*by).transformWithStateInPandas(Cache(most, life), outputStructType=Cache.FOUND, outputMode="append", timeMode="EventTime")


class Requests(StatefulProcessor):
    """The last requests of each source and its failures in a row; says after every batch what `operators.runs` says of the whole log.

    A group holds a share of the sources, as a call for every source costs far more than what is worked out for it. The
    state is one value for each source; a batch reads and writes those of its own sources alone.
    """

    FIGURES = "source string, seq long, mean double, rate double, failures long, limits long, limited_at long, tries long"
    STATE = "seqs array<long>, seconds array<double>, oks array<boolean>, tries long, good long, failures long, limits long, limited_at long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sources = handle.getMapState("sources", "source string", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        codes, names = pd.factorize(every["source"], use_na_sentinel=False)
        order = np.lexsort((every["seq"], codes))
        seq, at, seconds = (every[n].to_numpy()[order] for n in ("seq", "at", "seconds"))
        ok, limited = (every[n].eq(True).to_numpy(bool)[order] for n in ("ok", "limited"))
        ends, out, begin = np.cumsum(np.bincount(codes, minlength=len(names))), [], 0
        for name, end in zip(names, ends.tolist(), strict=True):
            name, mine = None if pd.isna(name) else name, slice(begin, end)
            begin = end
            held = self.sources.getValue((name,))
            seqs, took, oks, tries, good, failures, limits, limited_at = ([], [], [], 0, 0, 0, 0, None) if held is None else tuple(held)
            n, right, hit = mine.stop - mine.start, np.flatnonzero(ok[mine]), at[mine][limited[mine]]
            failures = int(n - 1 - right[-1]) if len(right) else failures + n
            tries, good, limits = tries + n, good + len(right), limits + len(hit)
            if len(hit):
                limited_at = max(int(hit.max()), limited_at if limited_at is not None else int(hit.max()))
            last = slice(max(begin - REMEMBERED, mine.start), end)
            seqs, took, oks = ((list(x) + y[last].tolist())[-REMEMBERED:] for x, y in ((seqs, seq), (took, seconds), (oks, ok)))
            self.sources.updateValue((name,), (seqs, took, oks, tries, good, failures, limits, limited_at))
            some = took[-MEAN_OF:]
            out.append((name, seqs[-1], sum(some) / len(some), good / min(tries, RATE_OF), failures, limits, limited_at, tries))
        yield pd.DataFrame(out, columns=["source", "seq", "mean", "rate", "failures", "limits", "limited_at", "tries"]).astype({"limited_at": "Int64"})

    def close(self) -> None:
        pass


def figures(log: DataFrame, parts: int = SHARES) -> DataFrame:
    """A stream of log rows (source, seq, at, seconds, ok, limited), seq rising from batch to batch, as a stream of Requests.FIGURES: one row for each source of a batch.

    Sources are dealt to `parts` groups by a hash; the number must stay the same for a checkpoint's life.
    """
    dealt = log.withColumn("part", F.pmod(F.xxhash64("source"), F.lit(parts)))
    return dealt.groupBy("part").transformWithStateInPandas(Requests(), outputStructType=Requests.FIGURES, outputMode="update", timeMode="None")
