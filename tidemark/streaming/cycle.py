"""The collection cycle as a stream over the files that sources land, a transaction for every micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scores import TOPIC_GROUPS
from tidemark.operators import collect, feed
from tidemark.sources.articles import ENGAGEMENT
from tidemark.streaming.feed import remove
from tidemark.streaming.table import KeyedTable

_FILE = "path string, modificationTime timestamp, length long, content binary"
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
STORED = "link_hash string, link string, type string, title string, desc string, event_date date, venue string, heat int, tags array<string>, raw_data string, fetch_count int, is_new boolean, heat_changed boolean"


@dataclass
class Cycle:
    """Sources land files in folders of their names under `landed`; everything else is kept under `folder`.

    One query reads all of them: its checkpoint holds how far each source was read. A micro-batch reads the new files
    of every source with that source's loader, makes the feed, merges it into the stored table and notes the run. All of
    it is named by the batch's number and made from what stood before, so a batch that failed is run again as if for
    the first time.
    """

    spark: SparkSession
    landed: str
    folder: str
    loaders: Mapping[str, Callable[[SparkSession, list[str]], DataFrame]]
    as_of: str
    lexicon: Sequence[tuple[str, str, str]] = ()
    topics: Sequence = field(default_factory=lambda: TOPIC_GROUPS)
    size: int = feed.FEED
    most_files: int | None = 1000
    buckets: int = 16

    @property
    def table(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.folder}/stored", STORED, buckets=self.buckets)

    def _files(self) -> DataFrame:
        most = {} if self.most_files is None else {"maxFilesPerTrigger": self.most_files}
        one = lambda name: self.spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True).options(**most).load(f"{self.landed}/{name}").select(F.lit(name).alias("source"), "path")
        return reduce(DataFrame.unionByName, map(one, self.loaders))

    def _kept(self, rows: DataFrame, name: str, number: int) -> DataFrame:
        at = f"{self.folder}/{name}/v{number}"
        rows.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(rows.schema).parquet(at)

    def _batch(self, files: DataFrame, number: int) -> None:
        # At most `most_files` names of each source; names alone, without what the files hold.
        named: dict[str, list[str]] = {}
        for r in files.select("source", "path").collect():
            named.setdefault(r["source"], []).append(r["path"])
        if not named:
            return
        read = [self.loaders[s](self.spark, sorted(paths)).select("link", "title", "desc", "event_date", "venue", "type", *ENGAGEMENT, F.lit(s).alias("source")) for s, paths in sorted(named.items())]
        made = lambda rows: collect.prepared(rows, self.as_of, self.lexicon, self.topics)
        # Each step is written: files are read once, and a step that is lost is not worked out from the start.
        raw = self._kept(reduce(DataFrame.unionByName, read), "read", number)
        items = self._kept(made(raw), "items", number)
        found = self._kept(collect.best(items), "best", number)
        old = collect.missing(found, self.table.read(before=number), self.size)
        again = old if old is None else self._kept(made(self._kept(old, "missing", number)), "again", number)
        out = self._kept(collect.cycle(found, again, self.size), "feed", number)
        sidecar = F.to_json(F.struct("arxiv_id", "entities"))
        rows = out.select(F.md5("link").alias("link_hash"), *collect.ITEM[:7], F.array().cast("array<string>").alias("tags"), sidecar.alias("raw_data"), F.lit(number).alias("arrival"))
        self.table.merge(rows, number, _merged)
        run = items.groupBy("source").agg(F.count("*").alias("items")).withColumn("run", F.lit(number))
        self._kept(run, "runs", number)
        for name in ("read", "items", "best", "missing", "again"):
            remove(self.spark, f"{self.folder}/{name}/v{number - 1}")

    def run(self) -> None:
        """Reads all that has landed since the last run."""
        # Named files are looked up in as many tasks as there are cores, not in one each.
        before = self.spark.conf.get(_LISTING)
        self.spark.conf.set(_LISTING, self.spark.sparkContext.defaultParallelism)
        try:
            query = self._files().writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            self.spark.conf.set(_LISTING, before)

    def feed(self, number: int | None = None) -> DataFrame:
        """The feed of a batch, or of the last one that was stored."""
        number = self.table.versions()[-1] if number is None else number
        return self.spark.read.parquet(f"{self.folder}/feed/v{number}")

    def runs(self) -> DataFrame:
        """source, items, run: what every batch had of each source."""
        return self.spark.read.parquet(f"{self.folder}/runs/v*")


def _merged(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """`operators.feed.upsert`, with links."""
    links = stored.select("link_hash", "link").unionByName(batch.select("link_hash", "link")).dropDuplicates(["link_hash"])
    return feed.upsert(stored.drop("link"), batch.drop("link")).join(links.hint("merge"), "link_hash")
