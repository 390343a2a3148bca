"""A table of rows by key that batches are merged into, without being written anew as a whole.

Rows are dealt to buckets by a hash of their key. A batch reads and writes the buckets that it touches; a manifest says
for every bucket which batch wrote it last. A batch only counts once its manifest is complete, and what it wrote stands
beside what it read: after a crash anywhere it is run again from the manifest before it, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming.feed import remove


@dataclass
class KeyedTable:
    """`schema` is DDL of the rows and holds `key`.

    The number of buckets must stay the same for the table's life: so many that one is cheap to write anew, a few
    gigabytes, and that batches do not touch all of them.
    """

    spark: SparkSession
    folder: str
    schema: str
    key: str = "link_hash"
    buckets: int = 64

    def _listed(self, pattern: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at) or []
        return [f.getPath().toString() for f in found]

    def versions(self) -> list[int]:
        """The batches whose manifests are complete."""
        return sorted(int(p.split("/")[-2][1:]) for p in self._listed("manifest/v*/_SUCCESS"))

    def _manifest(self, version: int | None) -> dict[int, int]:
        """For every bucket that has rows the batch that wrote it: one row a bucket."""
        if version is None:
            return {}
        rows = self.spark.read.schema("bucket int, at int").json(f"{self.folder}/manifest/v{version}").collect()
        return {r["bucket"]: r["at"] for r in rows}

    def _rows(self, manifest: dict[int, int]) -> DataFrame:
        if not manifest:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/data/v{at}/bucket={b}" for b, at in sorted(manifest.items())))

    def read(self, before: int | None = None) -> DataFrame:
        """The table as of the last complete batch, or of the last one before a number."""
        known = [v for v in self.versions() if before is None or v < before]
        return self._rows(self._manifest(known[-1] if known else None))

    def merge(self, batch: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Merges a batch, whose number is above all earlier ones or is run again, and returns the buckets that it touched.

        `merge` takes the stored rows of those buckets and the batch, and returns rows of the schema. Rows of the batch
        without a key are left out.
        """
        known = [v for v in self.versions() if v < number]
        before = self._manifest(known[-1] if known else None)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        batch = batch.where(F.col(self.key).isNotNull())
        touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())
        if touched:
            merged = merge(self._rows({b: before[b] for b in touched if b in before}), batch)
            fields = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
            rows = merged.select(*fields, bucket.alias("bucket"))
            # A bucket is in as few files as its size allows; a large one is split.
            rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/v{number}")
        after = before | {b: number for b in touched}
        self.spark.createDataFrame(list(after.items()), "bucket int, at int").coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/v{number}")
        self._clean(number, after, before)
        return touched

    def _clean(self, number: int, *manifests: dict[int, int]) -> None:
        """Removes what neither this batch nor the one before it needs; a later batch removes what this leaves."""
        used = {(b, at) for m in manifests for b, at in m.items()}
        for path in self._listed("data/v*/bucket=*"):
            at, b = int(path.split("/")[-2][1:]), int(path.rsplit("=", 1)[1])
            if at < number and (b, at) not in used:
                remove(self.spark, path)
        for version in self.versions()[:-2]:
            remove(self.spark, f"{self.folder}/manifest/v{version}")
