"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic passages. Each window of a text, a few words with the
spaces around them, is compressed twice: with the ordinary dictionary, and with the ordinary and the toxic one together, so that
ordinary words cost the same on either side. The bytes that the toxic dictionary saves tell how like the window is to toxic
passages. Windows overlap and cover the whole text.

Training takes a bounded sample of labelled documents, of copies and near copies one each. Which windows of a toxic document are
its toxic passages isn't known beforehand: a first dictionary is trained on all windows of one half of the toxic documents. In the
other half, the windows that it shortens most, narrowed by compression again, train the next dictionary. Of that, the parts stay
which shorten windows of the half that it hasn't seen many times as often as ordinary windows. A third of the sample is kept from
the dictionaries; on it thresholds are calibrated: how much more often toxic documents hold a window of some compressed length and
saving than ordinary ones do, and a logistic curve from the largest such weights to a probability.

Nulls and empty texts have no windows and get the curve's value for none. Repeated rows score alike. Without labels, or
where toxic documents hold no passage of their own, the score is the share of toxic documents with one document of each
kind added. Extra columns are carried along, one named like the score is replaced; an empty table gives no rows.

Bounds: at most TRAIN_DOCS documents reach the driver, whole; a training document's windows beyond TRAIN_WINDOWS are left out of
the fit, never of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import labelled_sample, map_in_arrow, slices

#: Labelled documents that a model is fitted to, at most; windows of each.
TRAIN_DOCS, TRAIN_WINDOWS = 6000, 4096
#: Words of a window, and words after which the next one begins.
WINDOW_WORDS, WINDOW_STEP = 4, 3
#: A longer word counts as several, each starting WORD_STEP after the last.
WORD_CHARS, WORD_STEP = 48, 32
#: Both sides' dictionaries and all windows end with it: a compressor starts no match in the last bytes, and stores what it can't shorten.
TAIL = bytes(range(1, 32))
#: Bytes of the ordinary dictionary, of the first toxic one and of the toxic one before it is pruned; bytes of the segments that training picks for each.
ORDINARY_BYTES, FIRST_BYTES, TOXIC_BYTES = 64 << 10, 8 << 10, 2 << 10
ORDINARY_SEGMENT, TOXIC_SEGMENT, WORD_SEGMENT = 256, 32, 16
#: Bytes of a match at least.
LEAST_MATCH = 6
#: Ordinary windows that the ordinary dictionary is trained on, at most; ordinary documents that the toxic one is pruned by, for each toxic one.
ORDINARY_WINDOWS, PLAIN_DOCS = 150_000, 2
#: Windows of each toxic document that the toxic dictionary is trained on, at most; bytes that they save at least; rounds.
TOP_WINDOWS, LEAST_SAVED, ROUNDS = 4, 2, 2
#: Toxic documents that a word of the toxic dictionary helps at least, and how many times as often as ordinary ones.
LEAST_DOCS, TIMES = 3, 6.0
#: Compressed lengths (in steps of LENGTH_STEP) and savings that are told apart.
LENGTHS, LENGTH_STEP, SAVINGS = 16, 4, 24
#: Least hashes by which near copies are told.
SKETCHES = 4
#: Documents that hold a window of a cell at least; those of rarer cells are judged by the saving alone.
LEAST_SEEN = 64


def words(text: str) -> list[str]:
    found = text.lower().split()
    if any(len(w) > WORD_CHARS for w in found):
        found = [w[i : i + WORD_CHARS] for w in found for i in range(0, max(1, len(w) - WORD_CHARS + WORD_STEP), WORD_STEP)]
    return found


def encoded(text: str) -> bytes:
    """A byte for each character where all are in Latin-1, so that letters with accents don't share half of their bytes; else UTF-8."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return text.encode("utf-8", "surrogatepass")


def windows(text: str) -> list[bytes]:
    """WINDOW_WORDS words each, with the spaces around them; the last may be shorter."""
    found = words(text)
    if not found:
        return []
    data = encoded(f" {' '.join(found)} ")
    gaps = [i for i, c in enumerate(data) if c == 32] if len(data) < 256 else np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist()
    last = len(gaps) - 1
    return [data[gaps[i] : gaps[min(i + WINDOW_WORDS, last)] + 1] for i in range(0, max(1, last - WINDOW_WORDS + WINDOW_STEP), WINDOW_STEP)]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Matches are of LEAST_MATCH bytes at least, so that a saving is that of a word's better part. Before the tail stands the same on either side, whatever the dictionary ends with."""
    settings = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=LEAST_MATCH, window_log=18, hash_log=17, chain_log=17, search_log=4, write_checksum=False, write_content_size=False, write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=zstandard.ZstdCompressionDict(dictionary + b"\0 " + TAIL, dict_type=zstandard.DICT_TYPE_RAWCONTENT))


def lengths(by: zstandard.ZstdCompressor, found: Iterable[bytes]) -> np.ndarray:
    return np.array([len(by.compress(w + TAIL)) for w in found], np.int64)


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros((LENGTHS, SAVINGS)))  # by compressed length and bytes saved
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)  # constant, factors of the largest weight and of the sum of the next two


class WindowWeights:
    """The weights of windows, from their two compressed lengths."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.by = [compressor(model.ordinary), compressor(model.ordinary + model.toxic)] if model.toxic else None

    def cells(self, found: list[bytes]) -> np.ndarray:
        """For each window the row and column of its weight."""
        plain, both = (lengths(c, found) for c in self.by)
        return np.stack([np.minimum(plain // LENGTH_STEP, LENGTHS - 1), np.clip(plain - both, 0, SAVINGS - 1)])

    def of(self, found: list[bytes]) -> np.ndarray:
        return self.model.weights[tuple(self.cells(found))] if self.by and found else np.zeros(0)


def unlike(texts: list[str]) -> list[int]:
    """Numbers of the texts without later copies and near copies: those that share one of SKETCHES least hashes of word triples."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, t in enumerate(texts):
        w = words(t)
        h = np.array([xxhash.xxh3_64_intdigest(" ".join(w[k : k + 3]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(w) - 2))], np.uint64)
        sketch = {(k, int((h * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1) ^ (h >> np.uint64(32))).min())) for k in range(SKETCHES)}
        if seen.isdisjoint(sketch):
            kept.append(i)
        seen |= sketch
    return kept


#: A document's windows and their lengths under the ordinary dictionary.
Measured = tuple[list[bytes], np.ndarray]


def passages(docs: list[Measured], ordinary: bytes, toxic: bytes) -> list[bytes]:
    """Of each document the windows that a toxic dictionary shortens most, TOP_WINDOWS at most, narrowed to the word without which it saves least."""
    base, by, found = compressor(ordinary), compressor(ordinary + toxic), []
    for d, plain in docs:
        saved = plain - lengths(by, d)
        for i in np.argsort(-saved, kind="stable")[:TOP_WINDOWS]:
            if saved[i] < LEAST_SAVED:
                break
            gaps = [k for k, c in enumerate(d[i]) if c == 32]
            without = [d[i][:a] + d[i][b:] for a, b in zip(gaps, gaps[1:], strict=False)]
            at = int(np.argmin(lengths(base, without) - lengths(by, without)))
            found.append(d[i][gaps[at] : gaps[at + 1] + 1])
    return found


def pruned(dictionary: bytes, ordinary: bytes, toxic: list[Measured], plain: list[Measured]) -> bytes:
    """The words of a toxic dictionary that shorten windows of toxic documents, and seldom ordinary ones, beyond what better words do; the best last, where it is nearest."""
    whole, asked, docs, before = compressor(ordinary + dictionary), [], [], []  # windows that the whole dictionary shortens, their documents, toxic ones first, and their lengths
    for i, (d, known) in enumerate([*toxic, *plain]):
        at = np.flatnonzero(known - lengths(whole, d) >= LEAST_SAVED)
        asked += [d[k] for k in at]
        docs += [i] * len(at)
        before += known[at].tolist()
    docs, before = np.array(docs, np.int64), np.array(before, np.int64)

    def helped(words_: bytes) -> tuple[int, np.ndarray]:
        """How many toxic documents they help, none unless the odds are high enough, and the lengths with them."""
        after = lengths(compressor(ordinary + words_), asked)
        hit = np.unique(docs[before - after >= LEAST_SAVED])
        n = int((hit < len(toxic)).sum())
        odds = ((n + 0.5) / (len(toxic) + 1)) / ((len(hit) - n + 0.5) / (len(plain) + 1))
        return n if n >= LEAST_DOCS and odds >= TIMES else 0, after

    found = {p: helped(p)[0] for p in {b" " + p + b" " for p in re.split(rb"[\x00-\x20]+", dictionary) if p}} if asked else {}
    kept = b""
    for piece in sorted((p for p, n in found.items() if n), key=lambda p: (-found[p], p)):
        n, after = helped(piece + kept)
        if n:
            kept, before = piece + kept, np.minimum(before, after)
    return kept


def dictionaries(toxic: list[list[bytes]], plain: list[list[bytes]], seed: int = 0) -> Model:
    """From the windows of toxic and of ordinary documents. Each half of the toxic ones gets a dictionary that is judged by the other half."""
    rng = np.random.default_rng(seed)
    pool = [w for d in plain for w in d]
    pool = [pool[i] for i in rng.permutation(len(pool))[:ORDINARY_WINDOWS]]
    if not pool or not all(any(h) for h in (toxic[::2], toxic[1::2])):
        return Model()
    ordinary = trained(pool, ORDINARY_BYTES, ORDINARY_SEGMENT)
    base = compressor(ordinary)
    measured = lambda docs: [(d, lengths(base, d)) for d in docs]
    picked = measured([plain[i] for i in rng.permutation(len(plain))[: PLAIN_DOCS * len(toxic)]])
    halves = measured(toxic[::2]), measured(toxic[1::2])
    parts, kept = [trained([w for d, _ in h for w in d], FIRST_BYTES, TOXIC_SEGMENT) for h in halves], [b"", b""]
    for _ in range(ROUNDS):
        found = [passages(h, ordinary, p) for h, p in zip(halves, parts[::-1], strict=True)]
        parts = kept = [pruned(trained(f, TOXIC_BYTES, WORD_SEGMENT) + k if f else k, ordinary, h, picked) for f, k, h in zip(found, kept, halves[::-1], strict=True)]
    return Model(ordinary, b"".join(kept))


def largest(weights: np.ndarray) -> tuple[float, float]:
    """The largest and the sum of the next two; what isn't above 0 counts as 0."""
    top = np.zeros(3)
    best = np.sort(weights[weights > 0])[::-1][:3]
    top[: len(best)] = best
    return float(top[0]), float(top[1] + top[2])


def train(texts: list[str], labels: list[int]) -> Model:
    """Fit to the documents; of copies and near copies only the first counts, since a text that recurs would pass for what toxic documents share."""
    kept = unlike(texts)
    labels = [labels[i] for i in kept]
    share = (sum(labels) + 1) / (len(labels) + 2)
    prior = (float(np.log(share / (1 - share))), 0.0, 0.0)
    cut = [windows(texts[i])[:TRAIN_WINDOWS] for i in kept]
    fitted, judged = ([[w for i, (w, x) in enumerate(zip(cut, labels, strict=True)) if x == k and (i % 3 == 0) == late] for k in (0, 1)] for late in (False, True))
    model = dictionaries(fitted[1], fitted[0]) if all(fitted) and all(judged) else Model()
    model.curve = prior
    if not model.toxic:
        return Model(curve=prior)
    # how much more often toxic documents hold a window of a cell, and of its saving
    compare, counts, wide, seen = WindowWeights(model), np.zeros((2, LENGTHS, SAVINGS)), np.zeros((2, SAVINGS)), []
    for kind in (0, 1):
        for d in judged[kind]:
            cells = compare.cells(d) if d else np.zeros((2, 0), np.int64)
            here = np.unique(cells, axis=1)
            counts[kind, here[0], here[1]] += 1
            wide[kind, np.unique(cells[1])] += 1
            seen.append((kind, cells))
    n0, n1 = len(judged[0]), len(judged[1])
    odds = lambda c: np.log((c[1] + 0.5 * n1 / n0) / (n1 + 0.5)) - np.log((c[0] + 0.5) / (n0 + 0.5))
    model.weights = np.where(counts.sum(0) >= LEAST_SEEN, odds(counts), odds(wide)[None, :])
    model.weights[:, 0] = 0.0  # no saving says nothing
    x = np.array([(1.0, *largest(model.weights[tuple(cells)])) for _, cells in seen])
    model.curve = tuple(logistic(x, np.array([float(kind) for kind, _ in seen])))
    return model


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> list[float]:
    """Newton's steps; the ridge keeps the curve finite where the classes can be parted."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(b))
        b = b - np.clip(np.linalg.solve(hessian, x.T @ (p - y) + ridge * b), -2, 2)
    return [float(v) for v in b]


def score_text(text: str, weights: WindowWeights) -> float:
    c = weights.model.curve
    first, next_ = largest(weights.of(windows(text))) if weights.by else (0.0, 0.0)
    return float(1 / (1 + np.exp(-np.clip(c[0] + c[1] * first + c[2] * next_, -700, 700))))


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The rows with a column score_col, double, from 0 to 1; a column that has its name already is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries and a small table, whatever the input
    rows = df.drop(score_col)
    at, names = rows.columns.index(text_col), [*rows.columns, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = WindowWeights(shared.value)
        for batch in slices(batches):
            scores = pa.array([score_text(t or "", weights) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names)

    return map_in_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField(score_col, T.DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_DOCS) -> Model:
    """A model from at most `rows` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, label, rows).select("text", "label").collect()
    return train([r["text"] for r in sample], [r["label"] for r in sample])
