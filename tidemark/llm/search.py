"""Operator 9: exact top-k search by BM25 over an inverted index with block-max WAND.

Every document's terms are written once as a table; global statistics (documents, mean length, document frequencies)
come from it, and each query carries those of its terms. Queries go in blocks of bounded size. For a block each task
turns its documents into shards of an inverted index over blocks of neighbouring documents, and takes a group of
queries at a time. Postings of a query's rarer terms are added up; its frequent ones stand in a table, and bound a
document by what it gets from the rarer ones and its block's maxima of the others. Blocks whose best bound lies below
the query's threshold are passed over; in the others the table's rows are added up for all queries of the group that
are left there, as a product of matrices in single precision. Its error is bounded, and what can be among the best is
scored anew in full. The threshold rises, and carries over from shard to shard. Shards' best are merged exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import shared_folder, written
from tidemark.llm.jaccard import word_hashes
from tidemark.llm.units import pieces_of, small_batches, texts

K, K1, B = 10, 1.2, 0.75
#: Queries that are looked for at a time.
GROUP = 128
#: A shard's frequent terms stand in one in so many documents; most of them, and bytes of their table.
FREQUENT, MOST_FREQUENT, DENSE_BYTES = 16, 1024, 32 << 20
#: What sums in another order, and sums of MOST_FREQUENT values in single precision, may differ by: in all, and by share.
SLACK, SHARE = 1e-7, 1e-4
#: Queries of a block, and their terms; documents of a shard, and their terms; documents of a block of postings.
QUERIES, QUERY_TERMS, SHARD, SHARD_TERMS, BLOCK = 4096, 2_000_000, 8192, 2_500_000, 128


def _postings(docs: DataFrame) -> DataFrame:
    """id, length, terms (hashes of distinct words, rising) and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole):
                text, words = word_hashes(texts(batch))
                words = words.view(np.int64)
                lengths = np.bincount(text, minlength=batch.num_rows)
                order = np.lexsort((words, text))
                text, words = text[order], words[order]
                first = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(words, prepend=0) != 0)) if len(words) else np.zeros(0, np.int64)
                offsets = pa.array(np.searchsorted(text[first], np.arange(batch.num_rows + 1)), pa.int32())
                held = pa.ListArray.from_arrays(offsets, pa.array(words[first]))
                counts = pa.ListArray.from_arrays(offsets, pa.array(np.diff(first, append=len(words)), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), held, counts], ["id", "length", "terms", "counts"])

    return docs.select("id", "text").mapInArrow(run, "id long, length long, terms array<long>, counts array<int>")


class Shard:
    """An inverted index of some documents: postings by term, then document, with block maxima.

    Postings of frequent terms stand as rows of a table over all documents, within DENSE_BYTES.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float):
        n = len(ids)
        order = self._alike(terms, sizes, len(idf))
        self.ids = ids[order]
        # By document: its terms, rising, and their impacts.
        starts = np.concatenate([[0], np.cumsum(sizes)])
        norm = K1 * (1 - B + B * np.repeat(lengths, sizes) / mean)
        impact = counts * (K1 + 1) / (counts + norm) * idf[terms]
        at = self._ranges(starts[order], starts[order + 1])
        self.held, self.given = terms[at], impact[at]
        self.stop = np.concatenate([[0], np.cumsum(sizes[order])])
        # By term.
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes[order])
        by = np.argsort(self.held, kind="stable")
        term, self.doc, self.impact = self.held[by], doc[by], self.given[by]
        self.first = np.searchsorted(term, np.arange(len(idf) + 1))
        frequency = np.diff(self.first)
        self.blocks = -(-n // BLOCK)
        frequent = np.flatnonzero(frequency >= max(1, n // FREQUENT))
        frequent = frequent[np.argsort(-frequency[frequent], kind="stable")][: max(1, min(MOST_FREQUENT, DENSE_BYTES // (4 * max(1, self.blocks * BLOCK))))]
        self.row = np.full(len(idf), -1, np.int32)
        self.row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.blocks * BLOCK), np.float32)
        for i, t in enumerate(frequent.tolist()):
            part = slice(self.first[t], self.first[t + 1])
            self.dense[i, self.doc[part]] = self.impact[part]
        self.most = self.dense.reshape(len(frequent), self.blocks, BLOCK).max(2, initial=0.0)

    @staticmethod
    def _alike(terms: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
        """Documents with like terms stand together: by the mean of fixed random numbers of their terms."""
        r = np.random.default_rng(9).standard_normal(n)
        total = np.concatenate([[0.0], np.cumsum(r[terms])])
        stop = np.cumsum(sizes)
        return np.argsort((total[stop] - total[stop - sizes]) / np.maximum(sizes, 1), kind="stable")

    @staticmethod
    def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - start
        return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())

    def search(self, queries: list[np.ndarray], thresholds: list[float], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every query ids and scores of all documents that can be among the best k, given that k others score its threshold or more."""
        for at in range(0, len(queries), GROUP):
            yield from self._group(queries[at : at + GROUP], np.array(thresholds[at : at + GROUP], float), k)

    def _group(self, queries: list[np.ndarray], thresholds: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = self.blocks * BLOCK
        least = lambda threshold: threshold * (1 - SHARE) - SLACK
        near, asked = np.zeros((len(queries), n)), np.zeros((len(queries), len(self.dense)), np.float32)
        for q, query in enumerate(queries):
            row = self.row[query]
            asked[q, row[row >= 0]] = 1
            rare = query[row < 0]
            at = self._ranges(self.first[rare], self.first[rare + 1])
            near[q] = np.bincount(self.doc[at], self.impact[at], n)
        # The most that a document of each block can score: blocks below the threshold are passed over.
        live = near.reshape(len(queries), self.blocks, BLOCK).max(2, initial=0.0) + asked @ self.most >= least(thresholds)[:, None]
        for b in range(self.blocks):
            on, part = np.flatnonzero(live[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
            if len(on):
                near[on, part] += asked[on] @ self.dense[:, part]
        wanted = np.zeros(len(self.row), bool)
        for q, query in enumerate(queries):
            blocks = np.flatnonzero(live[q])
            score = near[q].reshape(self.blocks, BLOCK)[blocks].ravel()
            threshold = thresholds[q]
            if len(score) > k:
                threshold = max(threshold, least(float(np.partition(score, -k)[-k])))
            found = np.flatnonzero((score >= least(threshold)) & (score > 0))
            docs = blocks[found // BLOCK] * BLOCK + found % BLOCK
            wanted[query] = True
            yield self._kept(self.ids[docs], self._scores(docs, wanted), k)
            wanted[query] = False

    def _scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Scores in full, added up in order of term: equal documents have equal scores."""
        return np.array([self.given[i:j][wanted[self.held[i:j]]].sum() for i, j in zip(self.stop[docs].tolist(), self.stop[docs + 1].tolist(), strict=True)])

    @staticmethod
    def _kept(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k, the smaller id first of equals."""
        if len(ids) > k:
            on = scores >= np.partition(scores, -k)[-k]
            ids, scores = ids[on], scores[on]
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        return ids, scores


def _best(postings: DataFrame, block, mean: float, k: int) -> DataFrame:
    """query_id, doc_id, score: every task's best k of each query. `block` is broadcast: vocabulary, idf, and of each query id and terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf, queries = block.value
        kept = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        waiting: list[pa.RecordBatch] = []

        def built(t: pa.Table) -> Shard:
            held, counts = t["terms"].combine_chunks(), t["counts"].combine_chunks()
            sizes = np.diff(held.offsets.to_numpy())
            words = held.flatten().to_numpy()
            terms = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            on = vocabulary[terms] == words
            doc = np.repeat(np.arange(len(sizes)), sizes)[on]
            return Shard(t["id"].to_numpy(), t["length"].to_numpy(), terms[on], counts.flatten().to_numpy()[on], np.bincount(doc, minlength=len(sizes)), idf, mean)

        def flush() -> None:
            shard = built(pa.Table.from_batches(waiting).combine_chunks())
            waiting.clear()
            least = [float(scores[-1]) if len(ids) >= k else 0.0 for ids, scores in kept]
            for q, new in enumerate(shard.search([asked for _, asked in queries], least, k)):
                if len(new[0]):
                    ids, scores = (np.concatenate(x) for x in zip(kept[q], new, strict=True))
                    order = np.lexsort((ids, -scores))[:k]
                    kept[q] = ids[order], scores[order]

        rows = size = 0
        for batch in batches:
            waiting.append(batch)
            rows, size = rows + batch.num_rows, size + len(batch.column(2).flatten())
            if rows >= SHARD or size >= SHARD_TERMS:
                flush()
                rows = size = 0
        if waiting:
            flush()
        for start in range(0, len(queries), 1024):
            part = range(start, min(len(queries), start + 1024))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([queries[q][0] for q in part], [len(kept[q][0]) for q in part]), pa.int64()),
                    pa.array(np.concatenate([kept[q][0] for q in part]), pa.int64()),
                    pa.array(np.concatenate([kept[q][1] for q in part]), pa.float64()),
                ],
                ["query_id", "doc_id", "score"],
            )

    return postings.select("id", "length", "terms", "counts").mapInArrow(run, "query_id long, doc_id long, score double")


def search(docs: DataFrame, queries: DataFrame, k: int = K, block: int = QUERIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The best `k` documents of every query by BM25 over whole texts: query_id, doc_id, rank (from 1), score.

    Both tables have `id_col`, an integer, and `text_col`. A query's distinct terms count once each. Scores use the
    statistics of all documents; equal scores are ordered by id, documents that share no term with a query are not
    returned, and a query without words, or with null text, has no rows. Rows with a null id are left out on either
    side, and do not count in the statistics. Documents that repeat an id are documents of their own; of queries that
    repeat an id the terms are taken together. Other columns are not read. The driver holds one block of queries at a
    time: `block` of them and QUERY_TERMS terms, about, or one query if it has more.
    """
    spark = docs.sparkSession
    small_batches(docs)
    named = lambda rows: rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    postings = written(_postings(named(docs)), "postings")
    total = postings.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    frequency = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    wanted = _postings(named(queries)).select("id", F.explode("terms").alias("term")).distinct().join(frequency, "term")
    asked = written(wanted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "df"))).alias("held")), "queries")
    sizes = asked.agg(F.count("*").alias("n"), F.sum(F.size("held")).alias("terms")).first()
    number = max(-(-sizes["n"] // block), -(-(sizes["terms"] or 0) // QUERY_TERMS))
    schema = "query_id long, doc_id long, rank int, score double"
    if not number:
        return spark.createDataFrame([], schema)
    path = f"{shared_folder(spark)}/tidemark/best-{uuid.uuid4().hex}"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    for at in range(number):
        part = asked.where(F.pmod(F.xxhash64("id"), F.lit(number)) == at).select("id", F.col("held.term").alias("terms"), F.col("held.df").alias("df"))
        held = part.toArrow().sort_by("id")
        if not held.num_rows:
            continue
        flat, sides = (held[c].combine_chunks() for c in ("terms", "df"))
        vocabulary, first = np.unique(flat.flatten().to_numpy(), return_index=True)
        df = sides.flatten().to_numpy()[first]
        places = np.split(np.searchsorted(vocabulary, flat.flatten().to_numpy()), flat.offsets.to_numpy()[1:-1] - flat.offsets.to_numpy()[0])
        sent = spark.sparkContext.broadcast((vocabulary, np.log1p((total["n"] - df + 0.5) / (df + 0.5)), list(zip(held["id"].to_pylist(), places, strict=True))))
        best = _best(postings, sent, total["mean"] or 1.0, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best.select("query_id", "doc_id", "rank", "score").write.mode("append").parquet(path)
        sent.unpersist()
    return spark.read.schema(schema).parquet(path)


def op9_bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, docs.where("doc_id % 100 = 0"))
