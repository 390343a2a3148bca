"""Incremental collection as Structured Streaming: file source, availableNow trigger, keyed state, foreachBatch upsert."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, shared by all machines; in local mode, where it is unset, one of its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="tidemark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder and all in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def ranges(rows: DataFrame, key: str, times: int) -> list[DataFrame]:
    """The rows in so many ranges of an integer key, rising, as a service would land them one after another; null keys come first."""
    ends = rows.agg(F.min(key).alias("a"), F.max(key).alias("b")).first()
    first, width = ends["a"] or 0, -(-((ends["b"] or 0) - (ends["a"] or 0) + 1) // times)
    # Plain bounds, so that row groups outside of them are not read.
    at = lambda i: F.lit(first + i * width)
    parts = [rows.where(F.col(key).isNull() | (F.col(key) < at(1))) if times > 1 else rows]
    parts += [rows.where((F.col(key) >= at(i)) & (F.col(key) < at(i + 1))) for i in range(1, times - 1)]
    return parts + ([rows.where(F.col(key) >= at(times - 1))] if times > 1 else [])


def files_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over the files of a folder."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs the stream over all that is there now, and returns what it wrote."""
    spark = stream.sparkSession
    at = _folder(spark, name)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def window_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events of each type in tumbling windows, with a watermark for late rows."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("day"), "event_type", "n")


def first_seen(events: DataFrame) -> DataFrame:
    """When each key was first seen; the state is one row for each key."""
    return events.groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))


def deduplicated(events: DataFrame, keep: str = "7 days") -> DataFrame:
    """The first row of each id; an id's state is dropped once the watermark has passed it."""
    return events.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, begun, ended, n: runs of a user's events that lie less than a gap apart, in append mode.

    An event that comes again counts once; one that comes later than the watermark, as a repeated one may, is left out.
    A session is written once, when the watermark has passed its end.
    """
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    runs = once.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("ended"))
    return runs.select("user_id", F.col("w.start").alias("begun"), "ended", "n")


def upsert_stream(incoming: DataFrame, folder: str, buckets: int = 64):
    """Merges each micro-batch of items (those of `operators.feed.upsert`) into a `table.KeyedTable`, and returns that."""
    from tidemark.operators.feed import REPLACED, upsert
    from tidemark.streaming.table import KeyedTable

    fields = {f.name: f.dataType for f in incoming.schema}
    schema = ", ".join(["link_hash string", *(f"`{n}` {fields[n].simpleString()}" for n in REPLACED), "raw_data string, fetch_count int, is_new boolean, heat_changed boolean"])
    table = KeyedTable(incoming.sparkSession, f"{folder}/table", schema, buckets=buckets)
    query = incoming.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number, upsert) and None).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return table
