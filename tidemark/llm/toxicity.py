"""Operator 8: toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel of two spans sums, over all ordered choices of 3 or 4 characters that both hold within WINDOW, DECAY to the
power of the characters that each choice skips; so an insult keeps most of its weight when characters are inserted or
dropped. Landmarks are spans of labelled texts; a span's Nystroem features are its kernel values with them, times
the inverse root of their own kernel matrix. The machine is linear in these features, so after training landmarks,
root and weights fold into one weight for each subsequence. A text scores as its worst span, and a logistic curve turns that margin into a probability.

A span is a chunk between spaces without its punctuation; four or more single characters in a row ("i d i o t") are
one span.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.units import Rows, Runs, per_text, pieces_of, reads, small_batches, texts

#: Bound of the fit: rows of each label, those with the smallest hashes of their id, and their longest text.
FIT_ROWS, FIT_CHARS = 3000, 20_000
#: Landmarks; clean spans that the machine starts from; rounds of adding the clean spans that it gets wrong.
LANDMARKS, CLEAN_SPANS, ROUNDS = 160, 6000, 4
#: Bounds of the fit's memory, in spans: sure positives, positives in all, frequent clean spans, and clean spans that a
#: round adds. They bound what the machine is fitted on, the strongest first. Every span of the fitted rows is counted,
#: and all clean ones are scored in the first round and the last, so that those that it gets wrong are found among all.
SURE_SPANS, POSITIVE_SPANS, FREQUENT_SPANS, WRONG_SPANS = 1500, 2500, 400, 1500
#: Sure positives of which disguised forms are shown; new landmarks of a round.
DISGUISED, NEW_LANDMARKS = 60, 20
#: Association with the label (log-likelihood ratio) from which a span counts as positive wherever it stands, and the
#: share of toxic texts among those that hold it, were both labels as frequent, from which clean ones count as mislabelled.
SURE, SHARE = 20.0, 0.9
#: Characters that a subsequence may stretch over; weight lost for each character that it skips.
WINDOW, DECAY = 7, 0.45
#: Subsequences are hashed to this many bits.
TABLE_BITS = 20
#: Longer spans are cut into overlapping parts of that length.
LONGEST = 24

#: Four or more single letters or digits between single spaces.
_SPELLED = re.compile(r"(?<![^ ])[^\W_](?: [^\W_]){3,}(?![^\W_])")


def _parts(span: str) -> list[str]:
    """A long span in overlapping parts of LONGEST."""
    return [span] if len(span) <= LONGEST else [span[i : i + LONGEST] for i in range(0, len(span) - LONGEST // 2, LONGEST // 2)]


def spans_of(many: list[str]) -> list[set[str]]:
    """Each text's lower-case spans: the letters and digits between spaces and line ends, what else stands there dropped; and spelled ones."""
    one: dict[str, str] = {}
    out = [{one.setdefault(p, p) for s in spelled(text) for p in _parts(s)} for text in many]
    for parts in reads([text.lower() for text in many]):
        runs = Runs(parts, "alphanumeric", "space or line")
        _, first, place = np.unique(runs.hash, return_index=True, return_inverse=True)
        names = [[one.setdefault(p, p) for p in _parts(s)] for s in runs.spelled(first)]
        for i, k in set(zip(runs.text.tolist(), place.tolist(), strict=True)):
            out[i].update(names[k])
    return out


def spelled(text: str) -> list[str]:
    """Runs of four or more single characters, each run as one span."""
    return [m.replace(" ", "").lower() for m in _SPELLED.findall(text)]


def _choices() -> list[tuple[tuple[int, ...], int]]:
    """Places of the chosen characters after the first, and how many characters are skipped."""
    return [((0, *c), c[-1] - n + 1) for n in (3, 4) for c in combinations(range(1, WINDOW), n - 1)]


CHOICES = _choices()
#: Weight by the number of skipped characters; bits that hold that number.
WEIGHTS, GAP_BITS = DECAY ** np.arange(WINDOW), 3


def _hashed(h: np.ndarray, places: tuple[int, ...], reach: int) -> np.ndarray:
    """The hashed subsequence with these places from each of the first `reach` positions."""
    code = h[:, :reach] * np.uint32(0x85EBCA6B)
    for p in places[1:]:
        code += h[:, p : p + reach]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B if len(places) == 3 else 0xC2B2AE35)
    return code >> np.uint32(32 - TABLE_BITS)


def _codes(points: np.ndarray) -> np.ndarray:
    """For each span, given as a row of code points, its chosen subsequences' codes above their numbers of gaps, sorted."""
    c = np.empty((len(points), points.shape[1] + 1), np.uint32)
    c[:, 0], c[:, 1:] = ord("^"), points
    h = (c * np.uint32(0x9E3779B1)) ^ (c >> np.uint32(3))
    found = [(_hashed(h, places, c.shape[1] - places[-1]) << np.uint32(GAP_BITS)) | np.uint32(gaps) for places, gaps in CHOICES if places[-1] < c.shape[1]]
    return np.sort(np.concatenate(found, 1), axis=1) if found else np.zeros((len(c), 0), np.uint32)


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted codes: span, subsequence and its weight, summed over its occurrences; a span's weights have length 1 together."""
    n, wide = codes.shape
    if not wide:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    flat = codes.ravel()
    code = flat >> np.uint32(GAP_BITS)
    fresh = np.ones(len(flat), bool)
    fresh[1:] = code[1:] != code[:-1]
    fresh[::wide] = True
    first = np.flatnonzero(fresh)
    weight = np.add.reduceat(WEIGHTS[flat & np.uint32((1 << GAP_BITS) - 1)], first)
    span = first // wide
    return span, code[first].astype(np.int64), weight / np.sqrt(np.bincount(span, weight * weight, n))[span]


def subsequences(spans: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All spans' distinct subsequences: span number, hashed subsequence, weight; a span's weights have length 1 together."""
    by_length: dict[int, list[int]] = {}
    for k, s in enumerate(spans):
        by_length.setdefault(len(s), []).append(k)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for n, part in by_length.items():
        points = np.frombuffer("".join(spans[k] for k in part).encode("utf-32-le"), "<u4").reshape(len(part), n)
        span, code, weight = _distinct(_codes(points))
        found.append((np.array(part)[span], code, weight))
    return tuple(np.concatenate([f[x] for f in found]) for x in range(3))


def kernel(spans: list[str], landmarks: list[str], rows: int = 64) -> np.ndarray:
    """Kernel values, over the landmarks' subsequences only and so many spans at a time."""
    out = np.zeros((len(spans), len(landmarks)))
    li, lc, lw = subsequences(landmarks)
    used, column = np.unique(lc, return_inverse=True)
    of = np.zeros((len(used), len(landmarks)), np.float32)
    np.add.at(of, (column, li), lw)
    for start in range(0, len(spans), rows):
        part = spans[start : start + rows]
        i, code, w = subsequences(part)
        k = np.minimum(np.searchsorted(used, code), len(used) - 1)
        on = used[k] == code
        both = np.bincount(i[on] * len(used) + k[on], w[on], len(part) * len(used)).reshape(len(part), -1)
        out[start : start + len(part)] = both.astype(np.float32) @ of
    return out


class Model:
    """One weight for each hashed subsequence, the machine's offset, and the logistic curve of a text's margin."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float):
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift

    def of_points(self, points: np.ndarray) -> np.ndarray:
        """Margins of spans of one length, given as rows of code points."""
        span, code, weight = _distinct(_codes(points))
        return self.offset + np.bincount(span, weight * self.weights[code], len(points))

    def margins(self, spans: list[str]) -> np.ndarray:
        """The sum over a span's distinct subsequences of their weight in it times that of the machine."""
        out = np.full(len(spans), self.offset)
        by_length: dict[int, list[int]] = {}
        for k, s in enumerate(spans):
            by_length.setdefault(len(s), []).append(k)
        for n, part in by_length.items():
            for at in range(0, len(part), 1024):
                some = part[at : at + 1024]
                out[some] = self.of_points(np.frombuffer("".join(spans[k] for k in some).encode("utf-32-le"), "<u4").reshape(len(some), n))
        return out

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50))))


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """The linear machine by Newton steps on the rows inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    reg = np.full(x1.shape[1], ridge)
    reg[-1] = 1e-6
    active = None
    for _ in range(rounds):
        inside = y * (x1 @ w) < 1
        if active is not None and (inside == active).all():
            break
        active = inside
        a = x1[inside] * weight[inside, None]
        w = np.linalg.solve(a.T @ x1[inside] + np.diag(reg), a.T @ y[inside])
    return w[:-1], float(w[-1])


def _disguised(span: str, turn: int) -> list[str]:
    """The span with a character put in, or one doubled, at each place: what the machine should see through."""
    return [span[:at] + c + span[at:] for at in range(1, len(span)) for c in ("xqzjw01k"[(at + turn) % 8], span[at - 1])]


def _association(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """The log-likelihood ratio of a span with the label, negative where it speaks against it."""
    share = n_toxic / (n_toxic + n_clean)
    n = toxic + clean
    g = sum(2 * o * np.log(o / e) for o, e in ((toxic, n * share), (clean, n * (1 - share))) if o)
    return g if toxic > n * share else -g


def train(rows: list[tuple[str, int]]) -> Model | None:
    """A model of labelled texts, or None if either label is missing.

    Every span of a clean text is clean. In a toxic text the witness, the span that most speaks for toxicity, is
    the positive one; first by how often texts of either label hold it, then by the machine's own margins.
    """
    held = list(zip(spans_of([text for text, _ in rows]), [label for _, label in rows], strict=True))
    texts_of = [sum(1 for _, y in held if y == k) for k in (0, 1)]
    if not all(texts_of):
        return None
    df = [Counter(), Counter()]
    for spans, y in held:
        df[y].update(spans)
    odds = {s: math.log((n + 0.5) / (texts_of[1] + 1)) - math.log((df[0][s] + 0.5) / (texts_of[0] + 1)) for s, n in df[1].items()}
    strength = {s: o * math.sqrt(df[1][s]) for s, o in odds.items()}
    witness = Counter(max(spans, key=lambda s: (strength[s], s)) for spans, y in held if y and spans)
    clean = sorted(df[0])
    if not witness or not clean:
        return None
    frequent = [s for s, _ in df[0].most_common(FREQUENT_SPANS)]
    rng = np.random.default_rng(5)
    start = [clean[i] for i in rng.permutation(len(clean))[:CLEAN_SPANS]]
    sure = {s: g for s, n in df[1].items() if (g := _association(n, df[0][s], texts_of[1], texts_of[0])) >= SURE}
    known = sorted(sure, key=lambda s: (-sure[s], s))[:SURE_SPANS]
    # A span that toxic texts hold far more often stays positive, by its share, though a clean text or two hold it.
    share = {s: df[1][s] / (df[1][s] + df[0][s] * texts_of[1] / texts_of[0]) for s in known}
    trusted = {s for s in known if share[s] >= SHARE}
    trust = {s: share[s] * sure[s] / (sure[s] + 5 * SURE) for s in known}
    clean = [s for s in clean if s not in trusted]
    frequent, start = [s for s in frequent if s not in trusted], [s for s in start if s not in trusted]
    positive = list(dict.fromkeys(known + [s for s, _ in sorted(witness.items(), key=lambda x: (-x[1], x[0]))]))[:POSITIVE_SPANS]
    landmarks = positive[: LANDMARKS // 2]
    negative = list(dict.fromkeys(frequent + start))
    landmarks = list(dict.fromkeys(landmarks + frequent[: LANDMARKS // 4] + start))[:LANDMARKS]
    model, margins, plain = None, {}, set(clean)
    for turn in range(ROUNDS):
        own = kernel(landmarks, landmarks)
        values, vectors = np.linalg.eigh(own + 1e-6 * np.eye(len(landmarks)))
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        seen = [(s, 1.0) for s in positive] + [(d, 0.5) for k, s in enumerate(known[:DISGUISED]) if len(s) > 3 for d in _disguised(s, k + turn)]
        seen = [(s, w * trust.get(s, 0.5)) for s, w in seen if s in trusted or df[0][s] == 0]
        x = kernel([s for s, _ in seen] + negative, landmarks) @ root
        y = np.array([1.0] * len(seen) + [-1.0] * len(negative))
        weight = np.array([w for _, w in seen] + [1.0] * len(negative))
        weight[: len(seen)] *= max(1.0, 0.2 * len(negative) / max(1, len(seen)))
        w, offset = _squared_hinge(x, y, weight, 1.0)
        beta = root @ w
        table = np.zeros(1 << TABLE_BITS)
        li, lc, lw = subsequences(landmarks)
        np.add.at(table, lc, lw * beta[li])
        model = Model(table.astype(np.float32), offset, 1.0, 0.0)
        # In between only spans that the machine was not sure of are looked at again.
        watched = clean if turn in (0, ROUNDS - 1) else [s for s in clean if margins[s] > -0.9]
        margins |= dict(zip(watched, model.margins(watched).tolist(), strict=True))
        worst = sorted((s for s in clean if margins[s] > -0.5), key=lambda s: (-margins[s], s))[:WRONG_SPANS]
        negative = list(dict.fromkeys(negative + worst))
        landmarks = list(dict.fromkeys(landmarks + worst[:NEW_LANDMARKS]))
        toxic = [s for s in df[1] if s not in plain]
        margins |= dict(zip(toxic, model.margins(toxic).tolist(), strict=True))
        again = Counter(max(spans, key=lambda s: (margins[s] + 0.05 * min(odds[s], 5.0), s)) for spans, y in held if y and spans)
        positive = list(dict.fromkeys(known + [s for s, n in sorted(again.items(), key=lambda x: (-x[1], x[0])) if odds[s] > 0 and (df[1][s] > 1 or margins[s] > 0)]))[:POSITIVE_SPANS]
    top = np.array([max((margins[s] for s in spans), default=offset - 1) for spans, _ in held])
    label = np.array([y for _, y in held], float)
    model.slope, model.shift = _curve(top, label)
    return model


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of a text's margin, a little shrunk, by Newton steps."""
    x = np.stack([margin, np.ones(len(margin))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), x.T @ (p - label) + 0.05 * w)
        w = w - np.clip(step, -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def _smallest(known: DataFrame, label: int, rows: int) -> int:
    """The hash that the label's `rows` rows with the smallest hashes do not pass.

    The search is narrowed by the label's count first, so that no task sends many hashes to the driver.
    """
    hashes = known.where(F.col("toxic") == label).select("h")
    share = 1.25 * rows / max(1, hashes.count())
    near = hashes.where(F.col("h") <= min((1 << 63) - 1, int((1 << 64) * share) - (1 << 63)))
    for some in (near, hashes):
        found = [r[0] for r in some.orderBy("h").limit(rows).collect()]
        if len(found) == rows:
            break
    return found[-1] if found else -(1 << 63)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Trains on the driver on at most `fit_rows` rows of each label whose texts have at most `fit_chars` characters.

    Rows with a null id or another label than 0 and 1 are left out; an id that is labelled both ways is toxic; of
    texts that repeat an id the first in alphabetical order counts. None if either label is missing.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")).withColumn("h", F.xxhash64("id"))
    limits = [_smallest(known, y, fit_rows) for y in (0, 1)]
    chosen = known.where(F.col("h") <= F.when(F.col("toxic") == 1, limits[1]).otherwise(limits[0])).select("id", "toxic")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= fit_chars)
    rows = rows.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).collect()
    return train([(r["text"], r["toxic"]) for r in sorted(rows)])


class Judge:
    """Texts to probabilities on a worker."""

    def __init__(self, model: Model | None):
        self.model = model
        self.memo = Rows(1)

    def _worst(self, runs: Runs, which: np.ndarray) -> np.ndarray:
        """Margin of a run, or of its worst part."""
        out = np.empty((len(which), 1))
        whole = runs.size[which] <= LONGEST
        for part, points in runs.by_size(which[whole], LONGEST, 1024):
            out[np.flatnonzero(whole)[part], 0] = self.model.of_points(points)
        for k, span in zip(np.flatnonzero(~whole).tolist(), runs.spelled(which[~whole]), strict=True):
            out[k, 0] = self.model.margins(_parts(span)).max()
        return out

    def judge(self, many: list[str]) -> list[float]:
        if self.model is None:
            return [0.0] * len(many)
        top = np.full((len(many), 1), self.model.offset - 1)
        for parts in reads([x.lower() for x in many]):
            runs = Runs(parts, "alphanumeric", "space or line")
            top = np.maximum(top, per_text(runs, self.memo.of(runs, self._worst), len(many), np.maximum, -np.inf))
        for i, text in enumerate(many):
            for span in spelled(text):
                top[i, 0] = max(top[i, 0], self.model.margins(_parts(span)).max())
        return [self.model.probability(x) for x in top[:, 0].tolist()]


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, score (0 to 1) and predicted (1 from 0.5) of every whole text; a null text scores as the empty one.

    Without a model (one of the labels is missing) all score 0. One row for each row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for whole in batches:
            for batch in pieces_of(whole):
                p = judge.judge(texts(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], ["id", "score", "predicted"])

    small_batches(docs)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below 0.5."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model)
        for whole in batches:
            for batch in pieces_of(whole):
                p = judge.judge([x or "" for x in batch.column(at).to_pylist()])
                yield batch.filter(pa.array([x < 0.5 for x in p], pa.bool_()))

    small_batches(docs)
    return docs.mapInArrow(run, docs.schema)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model | None:
    """The model of the production query: labels of rows that are not held out."""
    return fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fitted(spark, docs, sf_dir)
    return score(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")
