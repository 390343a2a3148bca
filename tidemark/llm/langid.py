"""Operator 10: language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. A word's probability is the sum over
all ways to cut it into pieces, by the forward algorithm; a text's is the product over its words. Words are lower-case
runs of letters and the marks that go with them; what else a text holds says nothing about its language here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tokencount import MARK, read_vocabulary
from tidemark.llm.units import Rows, Runs, code_points, per_text, pieces_of, reads, small_batches, texts

#: Rows of each language that the model is fitted on, about: those with the smallest hashes.
FIT_ROWS = 3000
#: Added to each piece's expected count; probability of a character that is no piece.
SMOOTHING, UNKNOWN = 0.05, 1e-7
#: Words of up to SHORT characters go through the forward algorithm many at a time, longer ones singly in logarithms.
SHORT = 40
#: Each piece's probability is multiplied by this to the power of its length, to stay within a double's range.
SCALE = 24.0
#: A text is in a language if its log-probability per letter is not this far below the language's lowest fitted row.
FLOOR_SLACK = 0.5

_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def words_of(parts: list[tuple[int, str]]) -> Runs:
    """Lower-case runs of letters and marks (Unicode categories L and M) with one letter at least."""
    runs = Runs([(i, part.lower()) for i, part in parts], "letter or mark")
    return runs.only(runs.count("letter") > 0)


def _marked(points: np.ndarray) -> np.ndarray:
    """Words' code points behind MARK."""
    return np.insert(points.astype(np.uint64), 0, ord(MARK), 1)


class Pieces:
    """The vocabulary's pieces, lower-cased, found for all substrings of many words at once through a hash table."""

    def __init__(self, path: str, slots: int = 19):
        self.names = sorted({p.lower() for p, _ in read_vocabulary(path)} - {""})
        self.lengths = np.array([len(p) for p in self.names])
        inner = code_points("letter or mark")
        #: Length of the longest piece that a word can hold.
        self.reach = max((len(p) for p in self.names if all(inner[ord(c)] for c in p.removeprefix(MARK))), default=1)
        self.shift = np.uint64(64 - slots)
        self.keys, self.ids = np.zeros(1 << slots, np.uint64), np.full(1 << slots, -1, np.int32)
        for i, p in enumerate(self.names):
            h = 7
            for c in p:
                h = (h * int(_STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            at = (h * int(_MIX) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
            while self.ids[at] >= 0:
                at = (at + 1) % len(self.ids)
            self.keys[at], self.ids[at] = h, i

    def __len__(self) -> int:
        return len(self.names)

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = ((h * _MIX) >> self.shift).astype(np.int64)
        ids = self.ids[at]
        wrong = np.flatnonzero((ids >= 0) & (self.keys[at] != h))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(self.ids)
            ids[wrong] = self.ids[at[wrong]]
            wrong = wrong[(ids[wrong] >= 0) & (self.keys[at[wrong]] != h[wrong])]
        return ids

    def substrings(self, points: np.ndarray) -> list[np.ndarray]:
        """For each length from 1 on: starts by words, the id of the piece there, or -1."""
        size = points.shape[1]
        h = np.full(points.shape, 7, np.uint64)
        found = []
        for k in range(min(self.reach, size)):
            h = h[:, : size - k] * _STEP + points[:, k:] + np.uint64(1)
            found.append(np.ascontiguousarray(self._find(h.ravel()).reshape(h.shape).T))
        return found


def _hits(found: list[np.ndarray]) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """For each start the pieces there: length, words, ids. A character that is no piece has id -1."""
    size = len(found[0])
    out: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
    for start in range(size):
        here = [(1, slice(None), found[0][start])]
        for k in range(1, min(len(found), size - start)):
            on = np.flatnonzero(found[k][start] >= 0)
            if len(on):
                here.append((k + 1, on, found[k][start][on]))
        out.append(here)
    return out


def _forward(hits: list, words: int, table: np.ndarray) -> np.ndarray:
    """Sums over segmentations up to each position; table: scaled probabilities, pieces by models, last that of an unknown character."""
    alpha = np.zeros((len(hits) + 1, words, table.shape[1]))
    alpha[0] = 1.0
    for start, here in enumerate(hits):
        for k, on, ids in here:
            alpha[start + k, on] += alpha[start, on] * table[ids]
    return alpha


def _forward_logs(hits: list, logs: np.ndarray) -> np.ndarray:
    """As `_forward` for one word, in logarithms."""
    alpha = np.full((len(hits) + 1, logs.shape[1]), -np.inf)
    alpha[0] = 0.0
    for start, here in enumerate(hits):
        for k, _, ids in here:
            alpha[start + k] = np.logaddexp(alpha[start + k], alpha[start] + logs[ids[0]])
    return alpha


class Model:
    """languages; probabilities, pieces by languages; the least log-probability per letter of a text in each language."""

    def __init__(self, languages: list[str], probabilities: np.ndarray, path: str, floors: np.ndarray | None = None):
        self.languages, self.probabilities, self.path, self.floors = languages, probabilities, path, floors


class Scorer:
    """On a worker: texts to their log-probability under each language, and their letters."""

    def __init__(self, model: Model):
        self.pieces, n = Pieces(model.path), len(model.languages)
        self.logs = np.log(np.vstack([model.probabilities, np.full((1, n), UNKNOWN)]))
        self.table = np.vstack([model.probabilities * SCALE ** self.pieces.lengths[:, None], np.full((1, n), UNKNOWN * SCALE)])
        self.memo = Rows(n, SHORT)

    def _of(self, words: Runs, which: np.ndarray) -> np.ndarray:
        out = np.empty((len(which), self.table.shape[1]))
        for part, points in words.by_size(which, SHORT):
            n, size = points.shape
            hits = _hits(self.pieces.substrings(_marked(points)))
            if size > SHORT:
                out[part] = _forward_logs(hits, self.logs)[-1]
            else:
                out[part] = np.log(_forward(hits, n, self.table)[-1]) - (size + 1) * np.log(SCALE)
        return out

    def score(self, many: list[str]) -> tuple[np.ndarray, np.ndarray]:
        total, letters = np.zeros((len(many), self.table.shape[1])), np.zeros((len(many), 1), np.int64)
        for parts in reads(many):
            words = words_of(parts)
            total += per_text(words, self.memo.of(words, self._of), len(many))
            letters += per_text(words, words.count("letter")[:, None], len(many)).astype(np.int64)
        return total, letters[:, 0]


def expected_counts(pieces: Pieces, words: Runs, which: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pieces by columns of weights: each word's expected number of each piece, all pieces equally likely, times its weights."""
    total = np.zeros((len(pieces), weights.shape[1]))
    table = np.append((1.0 / len(pieces)) * SCALE**pieces.lengths, UNKNOWN * SCALE)[:, None]
    logs = np.append(np.full(len(pieces), -np.log(len(pieces))), np.log(UNKNOWN))[:, None]
    for part, points in words.by_size(which, SHORT):
        hits, n = _hits(pieces.substrings(_marked(points))), len(points)
        size = len(hits)
        long = size - 1 > SHORT
        alpha = _forward_logs(hits, logs) if long else _forward(hits, n, table)[:, :, 0]
        beta = np.full((size + 1, 1), -np.inf) if long else np.zeros((size + 1, n))
        beta[size] = 0.0 if long else 1.0
        for start in range(size - 1, -1, -1):
            for k, on, ids in hits[start]:
                if long:
                    beta[start] = np.logaddexp(beta[start], logs[ids[0]] + beta[start + k])
                else:
                    beta[start, on] += table[ids, 0] * beta[start + k, on]
        for start in range(size):
            for k, on, ids in hits[start]:
                if long:
                    share = np.exp(alpha[start] + logs[ids[0]] + beta[start + k] - beta[0])
                else:
                    share = alpha[start, on] * table[ids, 0] * beta[start + k, on] / beta[0, on]
                known = ids >= 0
                np.add.at(total, ids[known], share[known, None] * weights[part][on][known])
    return total


def _sample(docs: DataFrame, fit_rows: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], DataFrame]:
    """Languages, and about `fit_rows` rows (lang, text) of each: those with the smallest hashes of id and text.

    The hash that a language's rows stay below comes from an approximate count of its distinct hashes, so no task sees
    all rows of a language; rows with one hash are one row.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"))
    counted = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    taken = F.lit(False)
    for r in counted:
        limit = min((1 << 63) - 1, int((1 << 64) * fit_rows / max(1, r["n"])) - (1 << 63))
        taken = taken | ((F.col("lang") == r["lang"]) & (F.col("h") <= limit))
    return sorted(r["lang"] for r in counted), rows.where(taken).dropDuplicates(["lang", "h"]).select("lang", "text")


def fit(docs: DataFrame, path: str, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", floors: bool = False) -> Model | None:
    """One step of expectation-maximisation from equal piece probabilities, over about `fit_rows` rows a language.

    All languages of the column are learned. The driver gets only piece counts, at most the vocabulary's size for each
    language. With `floors`, each language's lowest log-probability per letter among its fitted rows is kept as well,
    which takes a second reading of them. None if nothing is labelled.
    """
    small_batches(docs)
    known, rows = _sample(docs, fit_rows, id_col, text_col, lang_col)
    if not known:
        return None
    column = {lang: i for i, lang in enumerate(known)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        total = np.zeros((len(pieces), len(known)))
        for whole in batches:
            for batch in pieces_of(whole):
                lang = np.array([column[x] for x in batch.column(0).to_pylist()])
                for parts in reads(texts(batch)):
                    words = words_of(parts)
                    keys, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
                    weights = np.zeros((len(keys), len(known)))
                    np.add.at(weights, (back, lang[words.text]), 1.0)
                    total += expected_counts(pieces, words, first, weights)
        p, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(at, pa.int32()), pa.array(total[p, at], pa.float64())], ["piece", "lang", "n"])

    counts = rows.mapInArrow(count, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(Pieces(path)), len(known)), SMOOTHING)
    np.add.at(table, (counts["piece"].to_numpy(), counts["lang"].to_numpy()), counts["n"].to_numpy().round(6))
    model = Model(known, table / table.sum(0), path)
    if floors:

        def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer, least = Scorer(model), np.full(len(known), np.inf)
            for whole in batches:
                for batch in pieces_of(whole):
                    lang = np.array([column[x] for x in batch.column(0).to_pylist()])
                    total, letters = scorer.score(texts(batch))
                    on = letters > 0
                    np.minimum.at(least, lang[on], total[on, lang[on]] / letters[on])
            on = np.flatnonzero(np.isfinite(least))
            yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(least[on], pa.float64())], ["lang", "least"])

        model.floors = np.full(len(known), -np.inf)
        for r in rows.mapInArrow(lowest, "lang int, least double").groupBy("lang").agg(F.min("least").alias("least")).collect():
            model.floors[r["lang"]] = r["least"] - FLOOR_SLACK
    return model


def _judged(scorer: Scorer, many: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the best language, its posterior with equal priors, its log-probability per letter, letters."""
    total, letters = scorer.score(many)
    best = total.argmax(1)
    top = total[np.arange(len(many)), best]
    sure = 1.0 / np.exp(total - top[:, None]).sum(1)
    return best, np.where(letters > 0, sure, 0.0), top / np.maximum(letters, 1), letters


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, lang_pred and score, the posterior of that language with equal priors, for every whole text.

    `und` with score 0 if the text is null or has no letter (Unicode category L), or if nothing could be learned. Ties
    go to the language first in alphabetical order. Null and repeated ids and repeated rows come out as they came in,
    one row for each; ids must be integers; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, names = Scorer(model), np.array([*model.languages, "und"], object)
        for whole in batches:
            for batch in pieces_of(whole):
                best, sure, _, letters = _judged(scorer, texts(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[np.where(letters > 0, best, -1)], pa.string()), pa.array(sure, pa.float64())], ["id", "lang_pred", "score"])

    small_batches(docs)
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_languages(docs: DataFrame, model: Model | None, wanted: list[str] | None = None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is one of `wanted` (None: any learned one) with that score.

    Where the model has floors, the text's log-probability per letter must reach its language's too: the posterior
    alone only tells learned languages from each other. Texts without a letter are `und`, kept only if `wanted` names it.
    """
    und = wanted is not None and "und" in wanted
    if model is None:
        return docs.where(F.lit(und))
    at = docs.columns.index(text_col)
    allowed = np.array([wanted is None or x in wanted for x in model.languages])
    floors = np.full(len(allowed), -np.inf) if model.floors is None else model.floors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for batch in pieces_of(whole):
                best, sure, each, letters = _judged(scorer, [x or "" for x in batch.column(at).to_pylist()])
                keep = np.where(letters > 0, allowed[best] & (sure >= least) & (each >= floors[best]), und)
                yield batch.filter(pa.array(keep, pa.bool_()))

    small_batches(docs)
    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()), public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
