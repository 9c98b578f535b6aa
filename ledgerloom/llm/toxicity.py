"""Toxicity by the nearest labelled examples.

Examples are a bounded sample of labelled documents (``EXAMPLES``). All their
words are terms. Examples and documents are vectors of term frequency times
inverse document frequency times what the term says about the label: its
information gain among the examples, as a share of the label's entropy, plus
``FLOOR``, so that every term counts and alike texts are near each other where
no term tells the labels apart. (Without the gain the nearest examples are those
of the same topic, whatever their label.)

The examples' inverted index is cut into blocks; for each term and block the
largest weight is known, which bounds the cosine of every example in a block. A
search scores the blocks with the highest bounds, then all blocks whose bound
reaches the worst of the nearest so far, so the nearest are exact. Their votes,
weighted by closeness, become a score by a sigmoid, fitted on votes that each
part of the examples gets from an index of the others.

Documents without any known word (empty and null texts too) get the share of
label 1 among such examples. Without labelled examples every score is 0.5. Of
examples as similar as the last of the nearest all vote, so no order decides,
and all that vote are evidence. Repeated rows give repeated results, an empty
table an empty one; texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_arrow, slices, texts
from ledgerloom.llm.labelled import fit_sigmoid, held_out, labelled_features, ragged

#: Labelled examples in the index at most.
EXAMPLES = 4096
BLOCK, NEIGHBOURS = 512, 15
#: Blocks that a search scores before it has a bound.
FIRST_BLOCKS = 1
#: The weight of a term that says nothing about the label, against 1 for one that says all.
FLOOR = 0.003
#: Cosines this close are ties.
TIE = 1e-9
#: Parts of the examples for the sigmoid.
PARTS = 4
CACHE_WORDS = 500_000
THRESHOLD = 0.5

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def term(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


class Bags:
    """Examples as bags of terms: those of example i are terms[start[i] : start[i + 1]], ascending, with counts."""

    def __init__(self, keys: list, labels: np.ndarray, start: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.labels, self.start, self.terms, self.counts = keys, np.asarray(labels, float), start, terms, counts

    def __len__(self) -> int:
        return len(self.keys)

    def take(self, rows: np.ndarray) -> Bags:
        at = spread(self.start[rows], self.start[rows + 1] - self.start[rows])
        return Bags([self.keys[i] for i in rows.tolist()], self.labels[rows], np.concatenate(([0], np.cumsum(np.diff(self.start)[rows]))), self.terms[at], self.counts[at])

    def bag(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.start[i], self.start[i + 1])
        return self.terms[part], self.counts[part]


def spread(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of several ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + sizes, sizes)


def _entropy(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of a and b of two kinds, in bits."""
    n = np.maximum(a + b, 1e-300)
    p, q = a / n, b / n
    return -(p * np.log2(np.where(p > 0, p, 1)) + q * np.log2(np.where(q > 0, q, 1)))


class Index:
    """Examples in blocks. Postings lie by term, then block, then place; an entry is a term's postings in one block."""

    def __init__(self, bags: Bags) -> None:
        sizes = np.diff(bags.start)
        doc = np.repeat(np.arange(len(bags)), sizes)
        self.vocabulary, at = np.unique(bags.terms, return_inverse=True)
        self.df = np.bincount(at, minlength=len(self.vocabulary))
        self.weigh(bags, doc, at)
        w = (1 + np.log(bags.counts)) * self.term_weight[at]
        norm = np.sqrt(np.bincount(doc, w * w, len(bags)))
        w = w / norm[doc]
        # alike examples into the same block: ordered by their most frequent terms
        rank = np.empty(len(self.df), np.int64)
        rank[np.lexsort((self.vocabulary, -self.df))] = np.arange(len(self.df))
        first = [np.sort(rank[at[a:b]])[:8].tolist() for a, b in zip(bags.start, bags.start[1:])]
        order = sorted(np.flatnonzero(sizes > 0).tolist(), key=lambda i: (first[i], bags.keys[i]))
        self.keys, self.labels = [bags.keys[i] for i in order], bags.labels[order]
        self.blocks = -(-len(order) // BLOCK)
        place = np.full(len(bags), -1, np.int64)
        place[order] = np.arange(len(order))
        by = np.lexsort((place[doc], at))
        self.place, self.weight = place[doc][by].astype(np.int32), w[by]
        owner, block = at[by], self.place // BLOCK
        begin = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (block[1:] != block[:-1]))) if len(by) else np.empty(0, np.int64)
        self.entry_start = np.append(begin, len(by)).astype(np.int32)
        self.entry_block = block[begin].astype(np.int32)
        self.entry_most = np.maximum.reduceat(self.weight, begin) if len(begin) else self.weight
        self.term_start = np.searchsorted(owner[begin], np.arange(len(self.df) + 1)).astype(np.int32)
        empty = bags.labels[sizes == 0]
        self.base = float(bags.labels.mean()) if len(bags) else 0.5
        self.empty = (float(empty.sum()) + self.base) / (len(empty) + 1)
        self.sigmoid: tuple[float, float] | None = None

    def weigh(self, bags: Bags, doc: np.ndarray, at: np.ndarray) -> None:
        """Each term's weight. Copies of an example count once, else what they happen to share would look like a mark of their label."""
        seen, once = set(), np.zeros(len(bags), bool)
        for i in range(len(bags)):
            t, c = bags.bag(i)
            mark = (bags.labels[i], t.tobytes(), c.tobytes())
            once[i] = mark not in seen
            seen.add(mark)
        n, pos = float(once.sum()), float((bags.labels * once).sum())
        n1 = np.bincount(at, (bags.labels * once)[doc], len(self.df))
        df = np.bincount(at, once[doc].astype(float), len(self.df))
        whole = _entropy(np.array([pos]), np.array([n - pos]))[0] if n else 0.0
        rest = (df * _entropy(n1, df - n1) + (n - df) * _entropy(pos - n1, n - df - (pos - n1))) / max(n, 1.0)
        gain = np.maximum(0.0, (whole - rest) / whole) if whole > 0 else np.zeros(len(df))
        self.term_weight = (np.log((n + 1) / (df + 1)) + 1) * (FLOOR + gain)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (ascending) and weights, of unit length, of the terms that the index knows."""
        if not len(self.vocabulary) or not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == terms
        return self.scaled(at[hit], counts[hit])

    def scaled(self, t: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.term_weight[t]
        return t, w / np.sqrt((w * w).sum()) if len(t) else w

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines, nearest first, of the k nearest examples with a positive cosine and of all as near as the last of them."""
        begin = self.term_start[t]
        sizes = self.term_start[t + 1] - begin
        entry, weight = spread(begin, sizes), np.repeat(w, sizes)
        block = self.entry_block[entry]
        bounds = np.bincount(block, weight * self.entry_most[entry], self.blocks) * (1 + 1e-9)
        first = bounds >= (np.partition(bounds, -FIRST_BLOCKS)[-FIRST_BLOCKS] if self.blocks > FIRST_BLOCKS else 0)
        sums = self._sums(entry, weight, first[block])
        floor = self._floor(sums, k)
        more = (bounds >= floor) & ~first
        if more.any():
            sums += self._sums(entry, weight, more[block])
            floor = self._floor(sums, k)
        near = np.flatnonzero((sums > 0) & (sums >= floor))
        near = near[np.lexsort((near, -sums[near]))]
        return near, sums[near]

    def _sums(self, entry: np.ndarray, weight: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """The cosine of every example in the blocks of the chosen entries; 0 elsewhere."""
        entry, weight = entry[chosen], weight[chosen]
        begin = self.entry_start[entry]
        sizes = self.entry_start[entry + 1] - begin
        at = spread(begin, sizes)
        return np.bincount(self.place[at], self.weight[at] * np.repeat(weight, sizes), len(self.keys))

    @staticmethod
    def _floor(sums: np.ndarray, k: int) -> float:
        return float(np.partition(sums, -k)[-k]) - TIE if len(sums) > k else 0.0

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """Votes of the neighbours by 1 / (distance + 0.1), with one vote of the base rate at distance 1."""
        weights, prior = 1 / (1.1 - np.minimum(1.0, cosine)), 1 / 1.1
        return float(((weights * self.labels[near]).sum() + prior * self.base) / (weights.sum() + prior))

    def score(self, t: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        if not len(t):
            return self.empty, np.empty(0, np.int64), np.empty(0)
        near, cosine = self.nearest(t, w)
        vote = self.vote(near, cosine)
        if self.sigmoid is None:
            return vote, near, cosine
        a, b = self.sigmoid
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, a * vote + b)))), near, cosine


def calibration(bags: Bags) -> tuple[float, float] | None:
    """The sigmoid from votes to scores; each part of the examples is voted on by an index of the others."""
    x, y = [], []
    part = np.arange(len(bags)) % PARTS
    for p in range(PARTS):
        others, own = np.flatnonzero(part != p), np.flatnonzero(part == p)
        if not len(own) or len(set(bags.labels[others])) < 2:
            continue
        index = Index(bags.take(others))
        for i in own.tolist():
            t, w = index.vector(*bags.bag(i))
            if len(t):
                x.append(index.vote(*index.nearest(t, w)))
                y.append(bags.labels[i])
    return fit_sigmoid(x, y) if len(set(y)) == 2 else None


def examples(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = EXAMPLES, key: str = "doc_id", text: str = "text") -> Bags:
    def extract():
        def bag(data: bytes) -> dict:
            counts = Counter(map(term, words(data.decode())))
            found = sorted(counts)
            return {"terms": found, "counts": [counts[t] for t in found]}

        return bag

    table = labelled_features(docs, labels, label, limit, extract, {"terms": pa.list_(pa.int64()), "counts": pa.list_(pa.int32())}, key, text)
    start, found = ragged(table, "terms")
    return Bags(table.column("key").to_pylist(), table.column("label").to_numpy(), start, found, ragged(table, "counts")[1])


def build(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = EXAMPLES, key: str = "doc_id", text: str = "text") -> Index:
    bags = examples(docs, labels, label, limit, key, text)
    index = Index(bags)
    index.sigmoid = calibration(bags)
    return index


class Reader:
    """Texts to vectors of an index, with a memory of recent words."""

    def __init__(self, index: Index) -> None:
        self.index, self.known = index, {}

    def vectors(self, whole: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        split, known, vocabulary = [words(x) for x in whole], self.known, self.index.vocabulary
        fresh = list(set().union(*split).difference(known))
        if len(known) + len(fresh) > CACHE_WORDS:
            known.clear()
            fresh = list(set().union(*split))
        if fresh:
            terms = np.fromiter(map(term, fresh), np.int64, len(fresh))
            at = np.minimum(np.searchsorted(vocabulary, terms), max(0, len(vocabulary) - 1))
            hit = vocabulary[at] == terms if len(vocabulary) else np.zeros(len(fresh), bool)
            known.update(zip(fresh, np.where(hit, at, -1).tolist()))
        for found in split:
            t, n = np.unique(np.fromiter(map(known.__getitem__, found), np.int64, len(found)), return_counts=True)
            inside = t >= 0
            yield self.index.scaled(t[inside], n[inside])


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = EXAMPLES, key: str = "doc_id", text: str = "text", evidence: bool = True) -> DataFrame:
    """key, held_out, score, predicted, and with ``evidence`` the examples that voted: array<struct<key, label, similarity>>, nearest first."""
    sent = docs.sparkSession.sparkContext.broadcast(build(docs, labels, label, limit, key, text))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        reader, memory = Reader(index), {}
        for batch in batches:
            for part in slices(batch, text):
                found = []
                for t, w in reader.vectors(texts(part.column(text))):
                    at = (t.tobytes(), w.tobytes())
                    if at not in memory:
                        if len(memory) > 4096:
                            memory.clear()
                        memory[at] = index.score(t, w)
                    found.append(memory[at])
                cols = {
                    key: part.column(key),
                    "held_out": part.column("held_out"),
                    "score": pa.array([s for s, _, _ in found], pa.float64()),
                    "predicted": pa.array([int(s >= THRESHOLD) for s, _, _ in found], pa.int32()),
                }
                if evidence:
                    rows = [[{"key": index.keys[p], "label": int(index.labels[p]), "similarity": s} for p, s in zip(near.tolist(), cosine.tolist())] for _, near, cosine in found]
                    cols["evidence"] = pa.array(rows, pa.list_(pa.struct([("key", part.column(key).type), ("label", pa.int32()), ("similarity", pa.float64())])))
                yield pa.record_batch(cols)

    more = f", evidence array<struct<key:{kind},label:int,similarity:double>>" if evidence else ""
    return map_arrow(docs.select(key, held_out(F.col(key)).alias("held_out"), text), run, f"`{key}` {kind}, held_out boolean, score double, predicted int{more}")
