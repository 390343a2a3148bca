"""Operator 7: token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton lists the vocabulary's matches in a word; dynamic programming over their ends carries the
best score and the number of pieces of the best path. Ties go as in the library's Viterbi: starts are taken in order
and only a strictly better score replaces a path, so of equal paths the one whose last piece starts first stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.units import Rows, Runs, per_text, pieces_of, reads, small_batches, texts

#: Stands for a space, and before each word.
MARK = "▁"
#: How far below the worst piece an unknown character scores.
UNKNOWN_BELOW = 10.0


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in order of id; its control and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Counter:
    """Counts the pieces of a word's best segmentation; a run of unknown characters is one piece."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and not self.automaton.exists(piece):
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_BELOW

    def count(self, word: str) -> int:
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = [False] * (n + 1)
        for end, (length, score) in self.automaton.iter(word):
            ending[end + 1].append((end + 1 - length, score))
            single[end + 1] |= length == 1
        best = [0.0] * (n + 1)
        pieces = [0] * (n + 1)
        known = [True] * (n + 1)  # whether the best path's last piece is of the vocabulary
        for end in range(1, n + 1):
            options = sorted(ending[end])
            if not single[end]:
                options.append((end - 1, None))
            top = None
            for start, score in options:
                total = best[start] + (self.unknown if score is None else score)
                if top is None or total > top:
                    top = total
                    fused = score is None and start > 0 and not known[start]
                    count, seen = pieces[start] + (not fused), score is not None
            best[end], pieces[end], known[end] = top, count, seen
        return pieces[n]


class Texts:
    """On a worker: texts to their numbers of tokens."""

    def __init__(self, counter: Counter):
        self.memo, self.counter = Rows(1), counter
        self.bare = counter.count(MARK)

    def _of(self, runs: Runs, which: np.ndarray) -> np.ndarray:
        return np.array([self.counter.count(MARK + w) for w in runs.spelled(which)], float).reshape(-1, 1)

    def count(self, many: list[str]) -> np.ndarray:
        """Chunks between spaces count once each when new; those that hold nothing, between two spaces, count as MARK alone."""
        many = [x.replace(MARK, " ") for x in many]
        chunks = np.array([x.count(" ") + (x[:1] not in ("", " ")) for x in many], np.int64)
        total, held = np.zeros(len(many), np.int64), np.zeros(len(many), np.int64)
        for parts in reads(many):
            runs = Runs(parts, "not space")
            total += per_text(runs, self.memo.of(runs, self._of), len(many))[:, 0].astype(np.int64)
            held += np.bincount(runs.text, minlength=len(many))
        return total + (chunks - held) * self.bare


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's number of tokens, as `tokenizers.models.Unigram` over the pieces and scores of `path` gives it.

    Spaces become `MARK`, one is put before the text, and words are cut before each mark. Returns `id_col`, n_tokens
    and n_chars (code points). Null counts as the empty text: 0 and 0. Null and repeated ids and repeated rows come out
    as they came in, one row for each; ids must be integers; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Texts(Counter(read_vocabulary(path)))
        for whole in batches:
            for batch in pieces_of(whole):
                many = texts(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.count(many), pa.int64()), pa.array([len(x) for x in many], pa.int64())], ["id", "n_tokens", "n_chars"])

    small_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_tokens long, n_chars long").withColumnRenamed("id", id_col)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
