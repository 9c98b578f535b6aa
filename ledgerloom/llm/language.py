"""Language identification by rank-order profiles.

A profile lists the most frequent n-grams (1 to 3 letters, word edges included)
of a language in order. A document's own most frequent n-grams are compared to
each profile: the out-of-place distance adds up how far each n-gram's rank is
from its rank in the profile, at most the profile's length. The nearest
profile's language is predicted; the score is the margin to the next one.

Profiles are counted over all documents that may be learned from, summed per
task and then over tasks. Ties of counts go to the shorter n-gram, then to the
smaller one (a word's edge before any letter), ties of distances to the smaller
language. Null texts and texts without a letter give ``und`` and the score 0, as
do all texts if nothing can be learned from. Repeated rows are counted and judged
each for itself; an empty table gives an empty result. Long texts are counted in
pieces that carry their last two symbols along, so that pieces count what the
whole does, wherever they are cut.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import map_arrow, remainder, slices, texts

PROFILE = 300
#: Longer texts are counted in pieces of so many characters.
PIECE = 1 << 20
#: The symbol of a word's edge: no letter, and smaller than any.
EDGE = 1


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """The symbols of a text: letters, and one edge before, between and behind words. Each piece comes with the number of symbols that lead it and belong to the one before."""
    low, led = text.lower(), np.array([EDGE])
    for at in range(0, len(low), PIECE):
        s = np.frombuffer(low[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        letter = _letters()[s]
        before = np.concatenate((led[-1:] != EDGE, letter[:-1]))  # whether a letter precedes
        s = np.where(letter, s, EDGE)[letter | before]
        if at + PIECE >= len(low) and (s[-1] if len(s) else led[-1]) != EDGE:
            s = np.append(s, EDGE)
        if len(s):
            yield np.concatenate((led, s)), len(led)
            led = np.concatenate((led, s))[-2:]


def _codes(s: np.ndarray, led: int) -> np.ndarray:
    """All n-grams that end behind the first ``led`` symbols (one or two), as numbers of 21 bits a symbol."""
    one, middle = s[led:], s[1:-1]
    two = s[led - 1 : -1] << 21 | one
    three = s[:-2] << 42 | middle << 21 | s[2:]
    return np.concatenate((one[one != EDGE], two, three[middle != EDGE]))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in ascending order, with counts."""
    return merged([np.unique(_codes(*p), return_counts=True) for p in _pieces(text)])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes, counts = (np.concatenate(x) for x in zip(*parts))
    codes, back = np.unique(codes, return_inverse=True)
    return codes, np.bincount(back, counts, len(codes)).astype(np.int64)


def most_frequent(codes: np.ndarray, counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    return codes[np.argsort(-counts, kind="stable")[:n]]


class Profiles:
    def __init__(self, by_lang: dict[str, list[int]]) -> None:
        self.langs = sorted(by_lang)
        self.codes = np.unique(np.concatenate([np.array(v, np.int64) for v in by_lang.values()])) if by_lang else np.empty(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[k, np.searchsorted(self.codes, by_lang[lang])] = np.arange(len(by_lang[lang]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Mean out-of-place distance to each language as a share of the largest, 0 to 1."""
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = self.ranks[:, np.where(self.codes[at] == own, at, len(self.codes))]
        return np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own)))).sum(1) / (PROFILE * len(own))

    def predict(self, text: str) -> tuple[str, float]:
        if not self.langs:
            return "und", 0.0
        own = most_frequent(*ngrams(text))
        if not len(own):
            return "und", 0.0
        d = self.distances(own)
        order = np.argsort(d, kind="stable")
        best = float(d[order[0]])
        if len(d) == 1:
            return self.langs[0], 1 - best
        second = float(d[order[1]])
        return self.langs[order[0]], (second - best) / second if second else 0.0


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of all languages in ``docs``; rows without a language or text are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list] = defaultdict(list)
        for batch in batches:
            for part in slices(batch, text):
                for name, t in zip(part.column(lang).to_pylist(), texts(part.column(text))):
                    parts[name].append(ngrams(t))
                    if len(parts[name]) >= 256:
                        parts[name] = [merged(parts[name])]
        for name, found in parts.items():
            codes, counts = merged(found)
            yield pa.record_batch({"lang": pa.array([name] * len(codes), pa.string()), "code": pa.array(codes, pa.int64()), "n": pa.array(counts, pa.int64())})

    rows = docs.select(F.col(lang).cast("string").alias(lang), text).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = map_arrow(rows, run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # ranks up to a limit: each task passes on no more than a profile of each language
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    found: dict[str, list[int]] = defaultdict(list)
    for r in top.orderBy("lang", "rank").collect():
        found[r.lang].append(r.code)
    return Profiles(found)


def predict(docs: DataFrame, profiles: Profiles, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in slices(batch, text):
                found = [known.predict(t) for t in texts(part.column(text))]
                yield pa.record_batch({key: part.column(key), "held_out": part.column("held_out"), "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([s for _, s in found], pa.float64())})

    return map_arrow(docs.select(key, held_out.alias("held_out"), text), run, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, fold: int = 2) -> DataFrame:
    """Learn from the documents outside one fold of keys, predict all."""
    held = remainder(F.col(key), folds) == fold
    return predict(docs, learn(docs.where(~held), text, lang), held, key, text)


def oracle_sql(folds: int = 4, fold: int = 2) -> str:
    """``identify`` for DuckDB, on the table documents."""
    edge = f"chr({EDGE})"
    grams = lambda n, more: f"list_transform(range(1, CAST(length(w) + {more} AS BIGINT)), lambda k: substr({edge} || w || {edge}, k, {n}))"
    rank = lambda by, n: f"row_number() OVER (PARTITION BY {by} ORDER BY {n} DESC, length(g), g)"
    return f"""WITH crc_table AS (SELECT list(c ORDER BY n) AS crcs FROM (SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(n))),
    d AS (SELECT row_number() OVER () AS i, doc_id, lang, text, xor(list_reduce(list_concat([4294967295], list_transform(range(1, CAST(length(s) + 1 AS BIGINT)), lambda k: CAST(ascii(substr(s, k, 1)) AS BIGINT))), lambda c, b: xor(c // 256, crcs[xor(c, b) % 256 + 1])), 4294967295) % {folds} = {fold} AS held_out
        FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') AS s FROM documents), crc_table),
    words AS (SELECT i, w, count(*) AS n FROM (SELECT i, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM d) GROUP BY ALL),
    own AS (SELECT i, g, CAST(sum(n) AS BIGINT) AS n FROM (SELECT i, n, unnest(list_concat(list_transform(range(1, CAST(length(w) + 1 AS BIGINT)), lambda k: substr(w, k, 1)), {grams(2, 2)}, {grams(3, 1)})) AS g FROM words) GROUP BY ALL),
    ranked AS (SELECT * FROM (SELECT i, g, {rank('i', 'n')} - 1 AS r FROM own) WHERE r < {PROFILE}),
    profiles AS (SELECT * FROM (SELECT lang, g, {rank('lang', 'n')} - 1 AS r FROM (SELECT lang, g, sum(n) AS n FROM own JOIN d USING (i) WHERE lang IS NOT NULL AND NOT held_out GROUP BY ALL)) WHERE r < {PROFILE}),
    langs AS (SELECT DISTINCT lang FROM profiles),
    far AS (SELECT i, langs.lang, CAST(sum(coalesce(abs(p.r - o.r), {PROFILE})) AS BIGINT) / ({PROFILE} * count(*)) AS far FROM ranked AS o CROSS JOIN langs LEFT JOIN profiles AS p ON p.lang = langs.lang AND p.g = o.g GROUP BY i, langs.lang),
    near AS (SELECT i, list(lang ORDER BY far, lang)[1] AS lang_pred, list(far ORDER BY far, lang) AS f FROM far GROUP BY i)
    SELECT doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, coalesce(CASE WHEN len(f) = 1 THEN 1 - f[1] WHEN f[2] > 0 THEN (f[2] - f[1]) / f[2] ELSE 0 END, 0) AS score FROM d LEFT JOIN near USING (i)"""
