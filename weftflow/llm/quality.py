"""Quality classifier by supervised subword embeddings.

A word's features are the word itself and its character n-grams, hashed into rows of an embedding table; a word that
repeats the one before it has a further feature, which all such pairs of words share. A document is
the average of the vectors of all features of its whole text, a linear layer and a softmax give the probability of
label 1. Table and layer are learned by numpy stochastic gradient descent on a bounded sample of labelled documents.

For two labels the softmax of an average is the logistic function of the average of each feature's own score, so a
trained model holds one score per row; that scores alike and keeps the broadcast at `buckets` floats.

Nulls and empty texts have no features: their score comes from the bias alone. Repeated rows score alike. Without
labels, or with one label only, the score is the share of label 1 with one document of each added. Extra columns
are carried along; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import labelled_sample, map_in_arrow, slices

BUCKETS = 1 << 18
DIMENSIONS = 8
NGRAMS = (3, 4)
#: Labelled documents that a model is fitted to, at most.
TRAIN_DOCS = 6000
EPOCHS, RATE = 4, 0.5
#: Words whose features are made at a time.
PIECE_WORDS = 20_000


@dataclass
class Settings:
    buckets: int = BUCKETS
    dimensions: int = DIMENSIONS
    ngrams: tuple[int, ...] = NGRAMS
    epochs: int = EPOCHS
    rate: float = RATE
    seed: int = 0


U = np.uint64


def scatter(x: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    """Rows of the table for hashes of one kind of feature."""
    x = (x + U(kind)) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> U(32))) % U(buckets)).astype(np.int64)


def features(text: str, s: Settings) -> Iterator[np.ndarray]:
    """Rows of all features of a text, in pieces of a bounded number of words.

    Of each word the word itself, and the n-grams of the word with a space on either side; of each word that repeats
    the one before it, one row that all such words share.
    """
    words = text.split()
    for at in range(0, len(words), PIECE_WORDS):
        first = max(0, at - 1)  # the word before the piece, for repeats only
        c = np.frombuffer(f" {' '.join(words[first : at + PIECE_WORDS])} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
        gap = c == 32
        starts = np.flatnonzero(gap)[:-1] + 1
        place = np.arange(len(c)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(c)]])))
        powers = np.cumprod(np.full(int(place.max()) + 1, 0x100000001B3, U))
        whole = np.add.reduceat(np.where(gap, U(0), c * powers[place]), starts)
        repeats = int((whole[1:] == whole[:-1]).sum())
        if at > first:
            c, gap, whole = c[starts[1] - 1 :], gap[starts[1] - 1 :], whole[1:]
        found = [scatter(whole, 1, s.buckets), np.full(repeats, scatter(np.zeros(1, U), 2, s.buckets)[0])]
        for n in s.ngrams:
            if len(c) < n:
                continue
            size = len(c) - n + 1
            h, inside = c[:size], np.ones(size, bool)
            for j in range(1, n):
                h = h * U(0x100000001B3) + c[j : j + size]
                if j < n - 1:
                    inside &= ~gap[j : j + size]
            found.append(scatter(h[inside], 16 + n, s.buckets))
        yield np.concatenate(found)


@dataclass
class Model:
    scores: np.ndarray  # of each row, float32
    bias: float
    settings: Settings


def train(texts: list[str], labels: list[int], settings: Settings | None = None) -> Model:
    """Fit to the documents in a random order, one at a time; the learning rate falls in a line to 0."""
    s = settings or Settings()
    share = (sum(labels) + 1) / (len(labels) + 2)
    if len(set(labels)) < 2:
        return Model(np.zeros(s.buckets, np.float32), float(np.log(share / (1 - share))), s)
    rng = np.random.default_rng(s.seed)
    docs = []
    for text in texts:
        rows = list(features(text, s))
        docs.append(np.unique(np.concatenate(rows), return_counts=True) if rows else None)
    table = rng.uniform(-1 / s.dimensions, 1 / s.dimensions, (s.buckets, s.dimensions)).astype(np.float32)
    out, bias = np.zeros((2, s.dimensions), np.float32), np.zeros(2, np.float32)
    out[1] = rng.normal(0, 0.1, s.dimensions)
    steps, done = s.epochs * len(docs), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(docs)):
            rate = s.rate * (1 - done / steps)
            done += 1
            if docs[i] is None:
                continue
            rows, counts = docs[i]
            weight = (counts / counts.sum()).astype(np.float32)
            hidden = weight @ table[rows]
            logit = out @ hidden + bias
            p = np.exp(logit - logit.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = error @ out
            out -= rate * np.outer(error, hidden)
            bias -= rate * error
            # as each vector counts by its share, its step is scaled by the number of features
            table[rows] -= rate * np.minimum(1, weight * len(rows))[:, None] * back
    return Model(table @ (out[1] - out[0]), float(bias[1] - bias[0]), s)


def score_text(text: str, model: Model) -> float:
    total, count = 0.0, 0
    for rows in features(text, model.settings):
        total += float(model.scores[rows].sum(dtype=np.float64))
        count += len(rows)
    average = total / count if count else 0.0
    return float(1 / (1 + np.exp(-np.clip(average + model.bias, -700, 700))))


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with a column score_col, double, from 0 to 1; a column that has its name already is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # buckets floats, whatever the input
    rows = df.drop(score_col)
    at, names = rows.columns.index(text_col), [*rows.columns, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            scores = pa.array([score_text(t or "", model) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names)

    return map_in_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField(score_col, T.DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_DOCS, settings: Settings | None = None) -> Model:
    """A model from at most `rows` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, label, rows).select("text", "label").collect()
    return train([r["text"] for r in sample], [r["label"] for r in sample], settings)
