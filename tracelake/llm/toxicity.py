"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII signs. Its features are the words,
the pairs of neighbours and the pairs with one or two words between, each hashed to ``BITS`` bits and counted once
per text. Training walks the sample a few times; each coordinate has its own learning rate, and the L1 term keeps
most weights at exactly zero, so that what is sent to the executors is a short list of (feature, weight).

Training runs on the driver over a bounded sample (``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` bytes per label, those with
the smallest hash of the identifier, held-out fold excluded); the bounds are parameters and do not grow with the input. The offset is
then moved from the balanced sample to the share of label 1 among all labelled rows, and a last fold of the sample
calibrates the slope. Scoring reads every whole text once, without a shuffle.

Null and empty texts have no features: their score is the intercept's. Null labels are not learnt from; without
both labels every score is the known label's share (0.001 or 0.999, 0.5 without labels). Repeated rows get equal
scores, of ids that repeat in the labels the smaller label counts; other columns are ignored, whatever their names. Texts
are never split: a task holds 2 MB of text plus the longest text, times the size of its arrays. An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import LOWER, U64, WORD_LETTERS, Tokens, column, map_rows, mix, pieces, rank_mod
from tracelake.llm.labels import label_share, labelled_sample
from tracelake.runtime import ship_package

BITS = 22
SAMPLE_ROWS = 4000
SAMPLE_BYTES = 32_000_000
EPOCHS = 5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def feature_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every word, neighbouring pair and skip-gram, repeats included."""
    tokens = Tokens(LOWER[data], offsets, WORD_LETTERS)
    words, doc = tokens.word_hashes(), tokens.doc
    rows, values = [doc], [words]
    with np.errstate(over="ignore"):
        for gap in (1, 2, 3):
            n = max(0, len(words) - gap)
            same = np.flatnonzero(doc[:n] == doc[gap : gap + n])
            rows.append(doc[same])
            values.append(mix(words[same] * U64(3) + words[same + gap] * U64(5) + U64(gap)))
    return np.concatenate(rows), (np.concatenate(values) >> U64(64 - BITS)).astype(np.int64)


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct features of each text."""
    out = []
    for t in texts:
        _, f = feature_rows(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        out.append(np.unique(f).astype(np.int32))
    return out


class FTRL:
    """Per-coordinate proximal follow-the-regularised-leader for logistic loss."""

    def __init__(self, alpha: float = 0.2, beta: float = 1.0, l1: float = 14.0, l2: float = 0.5) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(1 << BITS, np.float32)
        self.n = np.zeros(1 << BITS, np.float32)
        self.z0 = self.n0 = 0.0

    def _weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def _intercept(self) -> float:
        return -self.z0 / ((self.beta + math.sqrt(self.n0)) / self.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        w, w0 = self._weights(at), self._intercept()
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, w0 + float(w.sum())))))
        g = p - label
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g
        step0 = (math.sqrt(self.n0 + g * g) - math.sqrt(self.n0)) / self.alpha
        self.z0 += g - step0 * w0
        self.n0 += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        at = np.flatnonzero(np.abs(self.z) > self.l1)
        return at, self._weights(at), self._intercept()


class ToxicityModel:
    """Sparse weights, looked up by feature."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, offset: float, slope: float = 1.0) -> None:
        self.at, self.weights, self.offset, self.slope = at, weights, offset, slope
        self._dense: np.ndarray | None = None

    def __getstate__(self):
        return self.at, self.weights, self.offset, self.slope

    def __setstate__(self, state) -> None:
        self.__init__(*state)

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sum of the weights of each text's distinct features."""
        if self._dense is None:
            self._dense = np.zeros(1 << BITS, np.float32)
            self._dense[self.at] = self.weights
        doc, feature = feature_rows(data, offsets)
        weight = self._dense[feature]
        used = np.flatnonzero(weight)
        pairs = np.unique((doc[used].astype(np.int64) << BITS) | feature[used])
        return np.bincount(pairs >> BITS, self._dense[pairs & ((1 << BITS) - 1)], len(offsets) - 1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.sums(data, offsets) + self.offset, -40, 40)))


def fit(sample: list[tuple[bytes, int]], prior: float | None = None, epochs: int = EPOCHS) -> ToxicityModel:
    """Every fifth text of a label calibrates, the others train."""
    by_label = [[t for t, y in sample if y == k] for k in (0, 1)]
    if not all(by_label):
        share = 0.5 if not sample else 0.999 if by_label[1] else 0.001
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), math.log(share / (1 - share)))
    train, rest = [], []
    for y, part in enumerate(by_label):
        held = part[::5] if len(part) >= 10 else part
        train += [(f, y) for f in _sets([t for i, t in enumerate(part) if len(part) < 10 or i % 5])]
        rest += [(t, y) for t in held]
    model = FTRL()
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(train)):
            model.learn(*train[i])
    at, weights, _ = model.sparse()
    out = ToxicityModel(at, weights, 0.0)
    # one text at a time: the arrays of a text are many times its size, and all of this is the driver's memory
    x = np.array([float(out.sums(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]) for t, _ in rest])
    y = np.array([y for _, y in rest], float)
    z = np.stack([x, np.ones_like(x)], 1)
    w, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    out.slope, out.offset = float(w[0]), float(w[1])
    if prior is not None and 0 < prior < 1:
        out.offset += math.log(prior / (1 - prior)) - math.log(y.sum() / (len(y) - y.sum()))
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows_per_label: int = SAMPLE_ROWS, bytes_per_label: int = SAMPLE_BYTES, held_out: int = 2) -> ToxicityModel:
    sample = labelled_sample(docs, labels, label, rows_per_label, bytes_per_label, held_out=held_out)
    return fit(sample, label_share(labels, label, held_out))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, held_out: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``. What is broadcast is bounded by the sample: the weights that L1 left."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part, data, offsets in pieces(batch):
                scores = own.scores(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), column(part, "held_out"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (rank_mod(key) == held_out).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; one pass, all columns kept."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part, data, offsets in pieces(batch, text):
                yield part.filter(pa.array(own.scores(data, offsets) < threshold))

    return map_rows(docs, run)
