"""Operator 6: URL filters by a sort-merge range join.

A host's labels, reversed, each followed by LOW, make a key under which a rule's host and all its subdomains are one
interval. Rules and URLs are range-partitioned and sorted by that key; a rule goes to every partition that its
interval meets. The sweep keeps a stack of the nested rule hosts around the current key and looks the URL's path up
under each of them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ends each label of a key; sorts before all that hosts hold.
LOW = "\x01"
#: Random rows for each partition that the bounds of ranges are drawn from, and of all together; rows of a partition.
BOUND_ROWS, MOST_BOUND_ROWS, PARTITION_ROWS = 100, 100_000, 1_000_000
#: Characters of a key that a bound holds: it only says which task gets a row.
LONGEST_BOUND = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's rules: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), LOW), F.lit(LOW))


class Sweep:
    """Takes rules and hosts in order of key; finds the longest rule that fits."""

    def __init__(self):
        self.stack: list[tuple[str, str, dict[str, str]]] = []

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, host: str, path: str, verdict: str) -> None:
        self._close(key)
        if not self.stack or self.stack[-1][0] != key or self.stack[-1][1] != host:
            self.stack.append((key, host, {}))
        paths = self.stack[-1][2]
        paths[path] = "allow" if "allow" in (verdict, paths.get(path)) else "block"

    def find(self, key: str, host: str, path: str) -> tuple[str | None, str | None]:
        self._close(key)
        best: tuple | None = None
        for _, owner, paths in self.stack:
            if host != owner and not host.endswith(f".{owner}"):
                continue
            for end in range(len(path), -1, -1) if len(path) <= len(paths) else sorted((len(p) for p in paths), reverse=True):
                if (start := path[:end]) in paths:
                    found = (len(owner) + len(start), len(owner), owner + start, paths[start])
                    if best is None or found[:3] > best[:3]:
                        best = found
                    break
        return (best[2], best[3]) if best else (None, None)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """`id_col`, host, path, rule and verdict of every row.

    `rules` has host, path and verdict (allow or block); its hosts are lower-cased, rows with a null are left out, and
    of equal rules allow wins. A rule fits its host and all subdomains if the URL's path starts with the rule's; the
    longest fits best (host and path together, then the longer host). Without a fit rule is null and verdict is
    `default`. A null URL or one without :// has an empty host and path, which no rule with a host fits. Null and
    repeated ids and repeated rows come out as they came in; equal keys are split by a hash of the row, so one URL may
    hold any share of the rows.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.select("id", "host", "path", host_key(F.col("host")).alias("key"), F.xxhash64("id", "host", "path").alias("salt"))
    rules = rules.dropna(subset=["host", "path", "verdict"]).select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").withColumn("key", host_key(F.col("host")))

    total = pages.count()
    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_ROWS))
    fraction = min(BOUND_ROWS * partitions, MOST_BOUND_ROWS) / max(1, total)
    some = rows.select(F.substring("key", 1, LONGEST_BOUND).alias("key"), "salt")
    drawn = sorted((r["key"], r["salt"]) for r in (some.sample(fraction, 17) if fraction < 1 else some).collect()) if partitions > 1 else []
    bounds = sorted({drawn[len(drawn) * i // partitions] for i in range(1, partitions)}) if drawn else []
    lowest, highest = -(1 << 63), (1 << 63) - 1

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(bounds, x) for x in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns[:4]], ["part", "id", "host", "path", "key"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for host, path, verdict, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                last = bisect_right(bounds, (key[:-1] + chr(ord(LOW) + 1), lowest)) if key else 0
                parts = range(bisect_right(bounds, (key, lowest)), last + 1)
                for start in range(0, len(parts), 10_000):
                    some = parts[start : start + 10_000]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([host] * n), pa.array([path] * n), pa.array([key] * n), pa.array([verdict] * n)], ["part", "host", "path", "key", "verdict"])

    urls = rows.mapInArrow(placed, "part int, id long, host string, path string, key string").withColumn("verdict", F.lit(None).cast("string")).withColumn("is_url", F.lit(True))
    owned = rules.select("host", "path", "verdict", "key").mapInArrow(spread, "part int, host string, path string, key string, verdict string").withColumn("id", F.lit(None).cast("long")).withColumn("is_url", F.lit(False))
    both = urls.unionByName(owned).repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "key", "is_url", "host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, part, last, seen = Sweep(), None, None, None
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for at, doc, host, path, key, verdict, is_url in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("part", "id", "host", "path", "key", "verdict", "is_url")), strict=True):
                if at != part:
                    sweep, part, last = Sweep(), at, None
                if not is_url:
                    sweep.rule(key, host, path, verdict)
                    last = None
                    continue
                if (host, path) != last:
                    last, seen = (host, path), sweep.find(key, host, path)
                for column, value in zip(out, (doc, host, path, seen[0], seen[1] or default), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(out)], ["id", "host", "path", "rule", "verdict"])

    return both.mapInArrow(run, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))


OP6_SQL = """
WITH cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(rhost, rpath, rverdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (
  SELECT DISTINCT host, path, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
  FROM (SELECT DISTINCT host, path FROM cut) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, cut.host AS host, cut.path AS path, rule, coalesce(rverdict, 'allow') AS verdict
FROM cut LEFT JOIN fits ON cut.host = fits.host AND cut.path = fits.path AND k = 1
"""
