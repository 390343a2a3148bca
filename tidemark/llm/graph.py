"""Shared scratch space and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; in local mode, where that is unset, one of its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        named = tempfile.mkdtemp(prefix="tidemark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


#: Tables written by this process, in order.
_WRITTEN: list[str] = []


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: read again at will, and safe from lost executors.

    Results may read it later, so it stays until `discard` removes it.
    """
    path = f"{shared_folder(frame.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def mark() -> int:
    """How many tables were written so far, for `discard`."""
    return len(_WRITTEN)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Removes the tables written since a mark, but for the last `keep` of them; nothing may read them any more."""
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    del _WRITTEN[since : len(_WRITTEN) - keep]
    for path in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component: each node that has an edge, with the smallest node that it is connected to.

    `edges` has long columns u and v. Large-star and small-star steps alternate until nothing changes: the first joins
    each node's larger neighbours to its smallest neighbour, the second its smaller ones. Every step is a grouped
    minimum, pre-aggregated before its shuffle, and a join that Spark may split where a node is hot. Each round is
    checkpointed to the shared folder.
    """
    shared_folder(edges.sparkSession)
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state = _state(now)
    if not state[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        now = small.checkpoint()
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
