"""Operator 12: the prefix trie of conversations, by smallest-member ownership.

A node is a distinct sequence of first turns, and its members are the conversations that start with it. The smallest
of them owns it; what a conversation owns is a suffix of its own path, since the smallest member of a node is the
smallest of the one below it that holds it. Windows mark owned nodes. Then one grouping by prefix gives every subtree's
sums without walking the tree: what a node's members still have to come, less what they own of it, counts each node
below once less than it has members, and each childless one is counted by its owner.

Places and running sums are worked out by ranges of turns, so that a conversation of any length is spread over tasks.
A prefix is known by the sum of 120 bits of SHA-256 of its turns and their places.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import written
from tidemark.llm.merkle import CRC_SQL
from tidemark.llm.ordered import pieces, placed, ranged

#: Groups that a hot node's members are dealt to before its owner is found, and ids that make one text for hashing.
SALTS, IDS = 64, 4096
ROOT = "0-0-0"


def _turns(table: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.sha2(text, 256).alias("tie"), F.length(text).cast("long").alias("size"))


def conversations(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, step from 0, role, tie, size) and conversations (conv_id, length) as they stand.

    Turns are in order of turn, null first, then role, then SHA-256 of text; rows without conv_id are left out.
    """
    at, _ = ranged(_turns(table), ["conv_id", "turn", "role", "tie"], "turns")
    of = written(pieces(at, "conv_id"), "pieces")
    return placed(at, of, "conv_id").withColumnRenamed("place", "step"), of.where("before = 0").select("conv_id", F.col("whole").alias("length"))


def forked(table: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """As `conversations`, but the first h turns of each come from the conversation whose id is the last multiple of `every`; h is the id's CRC-32 modulo `most`."""
    turns, convs = conversations(table)
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % every
    own = convs.select("conv_id", "length", heads.alias("h"), base.alias("base"))
    of = own.join(convs.select(F.col("conv_id").alias("base"), F.col("length").alias("given")), "base", "left")
    taken = F.least("h", F.coalesce("given", F.lit(0)))
    known = written(of.select("conv_id", "base", "h", taken.alias("k"), (taken + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")), "forks")
    columns = ["conv_id", "step", "role", "tie", "size"]
    kept = turns.join(known, "conv_id").where("step >= h").withColumn("step", F.col("step") - F.col("h") + F.col("k")).select(*columns)
    lent = turns.where((F.col("conv_id") % every == 0) & (F.col("step") < most)).select(F.col("conv_id").alias("base"), "step", "role", "tie", "size")
    return kept.unionByName(lent.join(known, "base").where("step < h").select(*columns)), known.select("conv_id", "length")


def _lane(digest: Column, number: int) -> Column:
    return F.conv(F.substring(digest, 1 + 15 * number, 15), 16, 10).cast("decimal(20,0)")


def _occurrences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of every conversation's path: node, parent, conv_id, depth, length, before (code points of the turns above), whole (of all turns)."""
    digest = F.sha2(F.concat_ws(":", "step", F.octet_length("role"), "role", "tie"), 256)
    hashed = turns.select("conv_id", "step", "size", digest.alias("digest")).select("conv_id", "step", "size", _lane(F.col("digest"), 0).alias("a"), _lane(F.col("digest"), 1).alias("b"))
    at, _ = ranged(hashed, ["conv_id", "step"], "steps")
    of = pieces(at, "conv_id", a_before=F.col("a"), b_before=F.col("b"), size_before=F.col("size")).join(convs, "conv_id")
    earlier = Window.partitionBy("_part", "conv_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    above = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)) + F.col(f"{c}_before")
    rows = placed(at, of, "conv_id").select("conv_id", "length", (F.col("step") + 1).alias("depth"), "a", "b", "size", above("a").alias("above_a"), above("b").alias("above_b"), above("size").alias("before"), F.col("size_before_whole").alias("whole"))
    key = lambda depth, a, b: F.concat_ws("-", depth, a, b)
    node = key(F.col("depth"), F.col("above_a") + F.col("a"), F.col("above_b") + F.col("b"))
    return written(rows.select(node.alias("node"), key(F.col("depth") - 1, F.col("above_a"), F.col("above_b")).alias("parent"), "conv_id", "depth", "length", "before", "whole"), "occurrences")


def _owners(rows: DataFrame) -> DataFrame:
    """conv_id, own (the depth from which on it owns its path), own_before (code points above that), leaf (1 if it owns a childless node).

    Members are compared within salted groups first, then the smallest of each.
    """
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt")
    some, all_ = Window.partitionBy("node", "salt"), Window.partitionBy("node")
    first = rows.select("node", salt, "conv_id", "depth", "before", "length").withColumns({"n": F.row_number().over(some.orderBy("conv_id")), "longest": F.max("length").over(some)}).where("n = 1")
    owned = first.withColumns({"n": F.row_number().over(all_.orderBy("conv_id")), "longest": F.max("longest").over(all_)}).where("n = 1")
    return owned.groupBy("conv_id").agg(F.min("depth").alias("own"), F.min_by("before", "depth").alias("own_before"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))


def _hashed(ends: DataFrame) -> DataFrame:
    """node and ends_sha256: of its ids in order, joined by commas; texts of up to IDS of them are read one after another."""
    texts = ends.groupBy("node", F.floor(F.col("conv_id") / IDS).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            nodes, sums = [], []
            for node, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if node == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now is not None:
                    nodes.append(now)
                    sums.append(sha.hexdigest())
                now, sha = node, sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(sums, pa.string())], ["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])

    return texts.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(run, "node string, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of the conversations' turns (those of `conversations` or `forked`).

    Returns conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves
    (childless nodes of its subtree, itself included), saved_tokens (over its subtree, code points of each node's last
    turn times members but one) and ends_sha256 (of the sorted ids of the conversations that end there). The root has
    depth 0 and all conversations, also those without turns. No conversations give no rows.
    """
    rows = _occurrences(turns, convs)
    owners = written(_owners(rows), "owners")
    flagged = rows.join(owners, "conv_id", "left")
    here = F.col("own") <= F.col("depth")
    still = F.col("whole") - F.when(F.coalesce(here, F.lit(True)), F.col("before")).otherwise(F.col("own_before"))
    saved = F.col("whole") - F.col("before") - F.when(F.col("own").isNull(), 0).otherwise(still)
    child = (F.col("depth") < F.col("length")) & (F.col("own") <= F.col("depth") + 1)
    ones = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    nodes = flagged.groupBy("node", "parent", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.min_by("own", "conv_id").alias("own"), F.count("*").alias("n_convs"), ones(child).alias("n_children"), ones(F.col("leaf")).alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
    )
    nodes = written(nodes, "nodes")
    totals = rows.where("depth = 1").select("conv_id", "whole")
    of = convs.join(owners, "conv_id", "left").join(totals, "conv_id", "left")
    unowned = F.coalesce(F.when(F.col("own").isNull(), F.col("whole")).otherwise(F.col("own_before")), F.lit(0))
    childless = F.when(F.max("length") == 0, 1).otherwise(ones(F.col("leaf"))).cast("long")
    root = of.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), ones(F.col("own") == 1).alias("n_children"), childless.alias("n_leaves"), F.sum(unowned).alias("saved_tokens")).where("n_convs > 0")
    first = root.select(F.col("conv_id").alias("least"))
    # A node's owner mostly owns its parent as well; the others' parents are looked up.
    own = nodes.where("own < depth").withColumn("parent_conv_id", F.col("conv_id"))
    top = nodes.where("own = depth and depth = 1").join(F.broadcast(first), how="cross").withColumnRenamed("least", "parent_conv_id")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    met = nodes.where("own = depth and depth > 1").join(parents, "parent")
    every = own.unionByName(top).unionByName(met).drop("own", "parent").unionByName(root.withColumns({"node": F.lit(ROOT), "depth": F.lit(0).cast("long"), "parent_conv_id": F.lit(None).cast("long")}))
    ends = rows.where("depth = length").select("node", "conv_id").unionByName(convs.where("length = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    found = every.join(_hashed(ends), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    return found.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_tokens").cast("long").alias("saved_tokens"), "ends_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*forked(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: Nodes by whole paths; each node's and each leaf's ancestors are the steps of its smallest member.
OP12_SQL = f"""WITH o AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, count(*) AS n, {CRC_SQL.format(x="conv_id")}::BIGINT % 6 AS h, conv_id - conv_id % 100 AS base FROM o GROUP BY conv_id),
k AS MATERIALIZED (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c b ON c.base = b.conv_id),
r AS MATERIALIZED (SELECT conv_id, pos - h + k + 1 AS d, role, text FROM o JOIN k USING (conv_id) WHERE pos >= h UNION ALL SELECT k.conv_id, pos + 1, role, text FROM k JOIN o ON o.conv_id = k.base AND o.pos < k.h),
p AS MATERIALIZED (SELECT conv_id, d, length(text) AS t, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS node FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM k),
q AS MATERIALIZED (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY d) AS parent, max(d) OVER (PARTITION BY conv_id) AS last FROM p),
g AS MATERIALIZED (SELECT node, d, any_value(parent) AS parent, any_value(t) AS t, min(conv_id) AS owner, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last = d) AS ends FROM q GROUP BY node, d),
y AS MATERIALIZED (SELECT g.*, coalesce(z.kids, 0) AS kids FROM g LEFT JOIN (SELECT parent, d - 1 AS e, count(*) AS kids FROM g WHERE d > 0 GROUP BY ALL) z ON z.parent = g.node AND z.e = g.d),
s AS (SELECT q.node, q.d, sum((y.n - 1) * y.t) AS saved, count(*) FILTER (WHERE y.kids = 0) AS leaves FROM y JOIN q ON q.conv_id = y.owner AND q.d <= y.d GROUP BY q.node, q.d)
SELECT y.owner AS conv_id, y.d AS depth, u.owner AS parent_conv_id, y.n AS n_convs, y.kids AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(y.ends, '')) AS ends_sha256
FROM y JOIN s USING (node, d) LEFT JOIN g u ON u.node = y.parent AND u.d = y.d - 1"""
