"""Quality classifier: support vectors over naive Bayes features.

Features are indicators of n-grams: words, pairs of neighbouring words, and pairs
and triples of word shapes (case, digits, attached punctuation, equal to the word
before). Each indicator
is scaled by the log-count ratio of its feature between the classes, vectors are
brought to unit length, and a linear model with hinge loss is fitted by dual
coordinate descent on a bounded sample of labelled documents (``SAMPLE``).
Margins of cross-fitted models give a sigmoid that turns margins into scores.

Null and empty texts have no features and get the score of a model's bias alone.
Without labels of both classes every score is the share of label 1, or 0.5.
Repeated rows give repeated results, an empty table an empty one; texts of any
length are read whole, and a word's features don't depend on other documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_arrow, raw, slices
from ledgerloom.llm.labelled import fit_sigmoid, held_out, labelled_features, ragged

#: Labelled documents to fit on at most.
SAMPLE = 8192
THRESHOLD = 0.3
WORD_BUCKETS, WORD_PAIR_BUCKETS, TRIPLE_BUCKETS = 1 << 18, 1 << 18, 1 << 16
SHAPES = 128
#: Words whose features a task remembers.
CACHE_WORDS = 500_000
WORD_PAIRS = WORD_BUCKETS
PAIRS = WORD_PAIRS + WORD_PAIR_BUCKETS
TRIPLES = PAIRS + SHAPES * SHAPES
FEATURES = TRIPLES + TRIPLE_BUCKETS

_SMALL, _LARGE = re.compile(rb"[a-z\x80-\xff]"), re.compile(rb"[A-Z]")
_DIGIT, _TAIL = re.compile(rb"[0-9]"), re.compile(rb"[^A-Za-z0-9\x80-\xff]+$")


def shape(word: bytes) -> int:
    """0 to 63: what the word is made of, and what punctuation ends it."""
    tail = _TAIL.search(word)
    end = tail.group() if tail else b""
    body = word[: len(word) - len(end)]
    small, large, digit = bool(_SMALL.search(body)), bool(_LARGE.search(body)), bool(_DIGIT.search(body))
    if large and not small:
        kind = 3 if len(body) > 1 else 2
    elif large:
        kind = 2 if body[:1].isupper() and not _LARGE.search(body[1:]) else 4
    else:
        kind = 1 if small else 0
    if digit:
        kind = 5 if not (small or large) else 6
    if not body:
        kind = 7
    if not end:
        close = 0
    elif len(end) == 1:
        close = {b",": 1, b".": 2}.get(end, 3 if end in b"!?;:)\"'" else 4)
    else:
        close = 5 if len(set(end)) == 1 and end[:1] in b"!?." else 6 if len(set(end)) == 1 else 7
    return kind * 8 + close


class Extractor:
    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def features(self, data: bytes) -> np.ndarray:
        """The distinct features of a text, ascending."""
        words = data.split()
        if not words:
            return np.empty(0, np.int64)
        known = self.known
        fresh = set(words).difference(known)
        if len(known) + len(fresh) > CACHE_WORDS:
            known.clear()
            fresh = set(words)
        for w in fresh:
            known[w] = (zlib.crc32(w.lower()) & (WORD_BUCKETS - 1)) << 6 | shape(w)
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        names, shapes = codes >> 6, codes & 63
        shapes[1:][codes[1:] == codes[:-1]] += 64
        pairs = shapes[:-1] * SHAPES + shapes[1:]
        triples = (pairs[:-1] * SHAPES + shapes[2:]) * 2654435761 >> 7 & (TRIPLE_BUCKETS - 1)
        neighbours = (names[:-1] * 1_000_003 + names[1:]) * 2654435761 >> 9 & (WORD_PAIR_BUCKETS - 1)
        return np.unique(np.concatenate((names, WORD_PAIRS + neighbours, PAIRS + pairs, TRIPLES + triples)))


class Model:
    """weights: per feature, with the log-count ratio multiplied in; square: the squared ratios, for unit length."""

    def __init__(self, weights: np.ndarray, square: np.ndarray, bias: float, sigmoid: tuple[float, float], prior: float | None) -> None:
        self.weights, self.square, self.bias, self.sigmoid, self.prior = weights, square, bias, sigmoid, prior

    def margin(self, features: np.ndarray) -> float:
        norm = math.sqrt(float(self.square[features].sum()))
        return (float(self.weights[features].sum()) / norm if norm else 0.0) + self.bias

    def score(self, features: np.ndarray) -> float:
        if self.prior is not None:
            return self.prior
        a, b = self.sigmoid
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, a * self.margin(features) + b))))


def ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log-count ratios of all features; zero for those that no row has."""
    counts = [np.bincount(np.concatenate([r for r, c in zip(rows, y) if c == k] or [np.empty(0, np.int64)]), minlength=FEATURES).astype(float) for k in (0, 1)]
    seen = counts[0] + counts[1] > 0
    logs = [np.log((c + smooth) / max(1.0, c.sum() + smooth * seen.sum())) for c in counts]
    return np.where(seen, logs[1] - logs[0], 0.0)


def coordinate_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = 1.0, rounds: int = 12, tolerance: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge-loss support vectors: the dual variables are optimised one by one, each between 0 and its class's cost, until none moves by ``tolerance``."""
    random = np.random.default_rng(seed)
    sign = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, c * len(y) / max(1, 2 * y.sum()), c * len(y) / max(1, 2 * (len(y) - y.sum())))
    values = [r[x] / n if (n := np.sqrt((r[x] ** 2).sum())) else r[x] for x in rows]
    square = np.array([(v**2).sum() + 1.0 for v in values])  # the bias is a feature that is always 1
    w, bias, alpha = np.zeros(len(r)), 0.0, np.zeros(len(y))
    for _ in range(rounds):
        largest = 0.0
        for i in random.permutation(len(y)):
            g = sign[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < tolerance:
            break
    return w, bias


def fit(rows: list[np.ndarray], y: np.ndarray, folds: int = 3) -> Model:
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32), 0.0, (1.0, 0.0), float(y.mean()) if len(y) else 0.5)
    margins, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    for k in range(folds):
        part = [x for x, f in zip(rows, fold) if f != k]
        if len(set(y[fold != k])) == 2:
            r = ratios(part, y[fold != k])
            w, bias = coordinate_descent(part, y[fold != k], r)
            model = Model(w * r, r**2, bias, (1.0, 0.0), None)
            margins[fold == k] = [model.margin(x) for x, f in zip(rows, fold) if f == k]
    r = ratios(rows, y)
    w, bias = coordinate_descent(rows, y, r)
    return Model((w * r).astype(np.float32), (r**2).astype(np.float32), bias, fit_sigmoid(margins, y), None)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> Model:
    def extract():
        own = Extractor()
        return lambda data: {"features": own.features(data).astype(np.int32)}

    table = labelled_features(docs, labels, label, sample, extract, {"features": pa.list_(pa.int32())}, key, text)
    start, values = ragged(table, "features")
    return fit([values[a:b] for a, b in zip(start, start[1:])], table.column("label").to_numpy().astype(np.int64))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, sample, key, text))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, extract = model.value, Extractor()
        for batch in batches:
            for part in slices(batch, text):
                scores = [known.score(extract.features(x)) for x in raw(part.column(text))]
                yield pa.record_batch({key: part.column(key), "held_out": part.column("held_out"), "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32())})

    return map_arrow(docs.select(key, held_out(F.col(key)).alias("held_out"), text), run, f"`{key}` {kind}, held_out boolean, score double, predicted int")
