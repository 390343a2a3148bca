"""A Bloom filter built as an aggregate over partitions, ahead of an exact join.

Each key sets a few bits of one row of 4 KB; Spark's bitmap aggregates put them together, partial filters of every task
first. What the filter says is not there needs no shuffle to be known as missing; only the rest meets the stored keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one row of the aggregate; bytes of a filter that go to every task.
ROW_BITS, MOST_BYTES = 32_768, 2 << 20


def size_of(keys: int, error: float = 0.001, most_bytes: int = MOST_BYTES) -> tuple[int, int]:
    """Bits, in whole rows, and hash functions for so many keys; fewer bits than the error asks for where they would not fit."""
    wanted = math.ceil(-max(1, keys) * math.log(error) / math.log(2) ** 2)
    bits = min(-(-wanted // ROW_BITS) * ROW_BITS, most_bytes * 8 // ROW_BITS * ROW_BITS)
    return bits, max(1, min(12, round(bits / max(1, keys) * math.log(2))))


def _places(key: Column, bits: int, hashes: int) -> tuple[Column, list[Column]]:
    """The row of a key, and its places there, from two hashes."""
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(7))
    step = F.shiftright(b, 20) * 2 + 1  # odd: the places differ
    return F.pmod(a, F.lit(bits // ROW_BITS)).cast("int"), [F.pmod(F.pmod(b, F.lit(ROW_BITS)) + i * F.pmod(step, F.lit(ROW_BITS)), F.lit(ROW_BITS)) for i in range(hashes)]


def rows_of(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """The filter of all keys: row and map, one row of 4 KB for each 32,768 bits."""
    row, places = _places(F.col(key), bits, hashes)
    at = keys.where(F.col(key).isNotNull()).select(row.alias("row"), F.explode(F.array(*places)).alias("at"))
    return at.groupBy("row").agg(F.bitmap_construct_agg("at").alias("map"))


def built(keys: DataFrame, key: str, bits: int, hashes: int) -> bytes:
    """The filter as one value, MOST_BYTES at most, for few keys: it goes into the plan of whatever tests it."""
    out = bytearray(bits // 8)
    for r in rows_of(keys, key, bits, hashes).collect():
        out[r["row"] * ROW_BITS // 8 : r["row"] * ROW_BITS // 8 + len(r["map"])] = r["map"]
    return bytes(out)


def _set(blob: Column, at: Column) -> Column:
    """Whether a bit is set."""
    byte = F.conv(F.hex(F.substr(blob, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2.0), at % 8)).cast("int") % 2 == 1


def maybe(key: Column, filter_: bytes, bits: int, hashes: int) -> Column:
    """False where the key is certainly not in the filter."""
    row, places = _places(key, bits, hashes)
    return F.forall(F.array(*places), lambda at: _set(F.lit(filter_), row * ROW_BITS + at))


def unseen(incoming: DataFrame, stored: DataFrame, key: str = "link_hash", error: float = 0.001) -> DataFrame:
    """Rows of `incoming` whose key is not among the stored ones; null keys are not. Equal to the anti-join.

    The filter's rows are broadcast and joined by the row of a key, so that no plan holds them.
    """
    keys = stored.select(key)
    count = keys.count()
    bits, hashes = size_of(count, error)
    if bits < 3 * count:  # so full that it would let most pass
        return incoming.join(keys, key, "left_anti").select(*incoming.columns)
    row, places = _places(F.col(key), bits, hashes)
    there = F.col(key).isNotNull() & F.col("_map").isNotNull()
    for at in places:
        there = there & _set(F.col("_map"), at)
    maps = rows_of(keys, key, bits, hashes).select(F.col("row").alias("_row"), F.col("map").alias("_map"))
    tested = incoming.withColumn("_row", row).join(F.broadcast(maps), "_row", "left").withColumn("_there", F.coalesce(there, F.lit(False))).drop("_row", "_map")
    rest = tested.where("_there").select(*incoming.columns).join(keys, key, "left_anti")
    return tested.where("not _there").select(*incoming.columns).unionByName(rest.select(*incoming.columns))
