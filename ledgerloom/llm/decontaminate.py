"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item gives windows of ``WINDOW`` consecutive words (a shorter item
gives one window of all its words). A document contains a window only if it
contains all its words, so one necessary word is enough to find candidates: each
window is indexed under its rarest word, by counts over all documents. A
document looks up its words in that index; each hit fixes where the window would
start, places before the start or beyond the end of the document are dropped,
and the rest is compared word by word.

The windows of a benchmark of up to ``BROADCAST_WINDOWS`` windows are sent to
every task. A larger benchmark is joined: the documents' hits on index words are
matched with the windows in a shuffle join, and verified against the words around
them; windows are repeated under ``SALTS`` salts there, so that a frequent word
meets its windows in many tasks.

Null text has no words; an item without words has no window. Null item ids count
as empty ids, repeated item ids as one item. Repeated documents give repeated
results. Without items no document is hit; without documents there is no row.
Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, map_arrow, raw, slices, small

WINDOW = 10
#: Windows up to which a benchmark is broadcast (about half a kilobyte each in a worker).
BROADCAST_WINDOWS = 100_000
SALTS = 32
#: Marks of contaminated texts that are broadcast at most.
BROADCAST_MARKS = 100_000

#: Bytes that end words: ASCII but for digits and letters; capitals are small before this.
_BREAKS = bytes.maketrans(bytes(i for i in range(128) if not re.match(rb"[0-9a-z]", bytes([i]))), b" " * 92)


def words(data: bytes) -> list[bytes]:
    return data.lower().translate(_BREAKS).split()


def item_windows(text: bytes) -> list[tuple[bytes, ...]]:
    w = words(text)
    return [tuple(w[i : i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1))] if w else []


def word_counts(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """How often the benchmark's words occur in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        known = sent.value
        for batch in batches:
            for part in slices(batch, text):
                for data in raw(part.column(text)):
                    found.update(filter(known.__contains__, words(data)))
        yield pa.record_batch({"word": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    rows = map_arrow(docs.select(text), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


class Index:
    """Windows under their rarest word. For each word: (offset in the window, the window, the numbers of its items)."""

    def __init__(self, items: dict[str, set[tuple[bytes, ...]]], counts: dict[bytes, int]) -> None:
        self.ids = sorted(items)
        owners: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        for number, item in enumerate(self.ids):
            for window in items[item]:
                owners[window].append(number)
        self.under: dict[bytes, list[tuple[int, tuple[bytes, ...], tuple[int, ...]]]] = defaultdict(list)
        for window, numbers in sorted(owners.items()):
            rarest = min(range(len(window)), key=lambda i: (counts.get(window[i], 0), window[i], i))
            self.under[window[rarest]].append((rarest, window, tuple(numbers)))
        self.under.default_factory = None

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words inside occurrences of windows, and the numbers of the items."""
        spans, items = [], set()
        if not self.under.keys().isdisjoint(w):
            under = self.under
            for p, word in enumerate(w):
                if word in under:
                    for offset, window, numbers in under[word]:
                        start = p - offset
                        end = start + len(window)
                        if start >= 0 and end <= len(w) and tuple(w[start:end]) == window:
                            spans.append((start, end))
                            items.update(numbers)
        return spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    total = reach = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def build_index(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text") -> Index:
    items: dict[str, set[tuple[bytes, ...]]] = defaultdict(set)
    for r in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).toLocalIterator():
        if found := item_windows((r.t or "").encode()):
            items[r.i].update(found)
    vocabulary = {w for windows in items.values() for window in windows for w in window}
    return Index(items, word_counts(docs, vocabulary) if vocabulary else {})


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split(text: Column) -> Column:
    """``words`` as a column."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _CAPITALS.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def fits(benchmark: DataFrame, text: str, limit: int) -> bool:
    """Whether the benchmark has at most ``limit`` windows."""
    sizes = benchmark.select(F.size(split(F.col(text))).alias("n")).where("n > 0")
    return (sizes.agg(F.sum(F.greatest(F.lit(1), F.col("n") - (WINDOW - 1)))).first()[0] or 0) <= limit


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated, and the items' ids as a sorted array."""
    if not fits(benchmark, "text", limit):
        return contamination_by_join(docs, benchmark, key, text)
    index = docs.sparkSession.sparkContext.broadcast(build_index(docs, benchmark))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            for part in slices(batch, text):
                rows = []
                for data in raw(part.column(text)):
                    w = words(data)
                    spans, items = known.hits(w)
                    rows.append((len(w), covered(spans), sorted(known.ids[i] for i in items)))
                yield pa.record_batch({
                    key: part.column(key),
                    "n_words": pa.array([n for n, _, _ in rows], pa.int64()),
                    "n_hit": pa.array([h for _, h, _ in rows], pa.int64()),
                    "n_items": pa.array([len(x) for _, _, x in rows], pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for _, _, x in rows]),
                    "contaminated": pa.array([h > 0 for _, h, _ in rows]),
                    "items": pa.array([x for _, _, x in rows], pa.list_(pa.string())),
                })

    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """The documents that contain no window, with all their columns."""
    if not fits(benchmark, "text", limit):
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("mark"), F.col(text).alias("text"))
        hit = contamination_by_join(rows.select("mark", "text").dropDuplicates(["mark"]), benchmark, "mark").where("contaminated").select("mark")
        hit = cut(hit)
        if small(hit, BROADCAST_MARKS):
            left = rows.join(F.broadcast(hit), "mark", "left_anti")
        else:  # copies of a text are dealt over salts, each of which has all marks
            left = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).join(_salted(hit), ["mark", "salt"], "left_anti")
        return left.select(*(F.col("row")[c].alias(c) for c in docs.columns))
    index = docs.sparkSession.sparkContext.broadcast(build_index(docs, benchmark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array([not known.hits(words(data))[0] for data in raw(part.column(text))], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def contamination_by_join(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same for benchmarks of any size: windows and hits meet in a shuffle join on the rarest word.

    A hit carries the words around it, so it is verified where it lands.
    """
    doc_words = docs.withColumn("_row", F.monotonically_increasing_id()).select("_row", F.col(key), split(F.col(text)).alias("w"))
    doc_words = cut(doc_words)  # row numbers hold from here on
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), split(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (WINDOW - 1)))
    windows = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, WINDOW))).alias("window")).distinct()
    counts = doc_words.select(F.explode("w").alias("word")).groupBy("word").count().join(windows.select(F.explode("window").alias("word")).distinct(), "word", "left_semi")
    ranked = windows.select("item", "window", F.posexplode("window").alias("offset", "word")).join(counts, "word", "left")
    best = ranked.groupBy("item", "window").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "offset")).alias("b"))
    indexed = cut(best.select("item", "window", F.col("b.word").alias("word"), F.col("b.offset").alias("offset")))
    salt = F.pmod(F.xxhash64("_row", "p"), F.lit(SALTS)).alias("salt")
    # only the places of index words leave the documents; then each takes the words around it along
    places = doc_words.select("_row", F.posexplode("w").alias("p", "word")).select("*", salt).join(_salted(indexed.select("word").distinct()), ["word", "salt"], "left_semi")
    places = places.groupBy("_row").agg(F.collect_list("p").alias("places"))
    w = F.col("w")
    taken = F.transform("places", lambda p: F.struct(p.alias("p"), F.get(w, p).alias("word"), F.slice(w, F.greatest(F.lit(1), p + 2 - WINDOW), F.lit(2 * WINDOW - 1)).alias("around"), F.least(p, F.lit(WINDOW - 1)).alias("before")))
    hits = doc_words.join(places, "_row").select("_row", F.size("w").alias("n"), taken.alias("taken")).select("_row", "n", F.explode("taken").alias("x")).select("_row", "n", "x.*").select("*", salt)
    met = hits.join(_salted(indexed), ["word", "salt"]).where("p >= offset AND p - offset + size(window) <= n")
    met = met.where(F.slice("around", F.col("before") - F.col("offset") + 1, F.size("window")) == F.col("window"))
    spans = met.select("_row", "item", F.explode(F.sequence(F.col("p") - F.col("offset"), F.col("p") - F.col("offset") + F.size("window") - 1)).alias("at"))
    n_hit = spans.select("_row", "at").distinct().groupBy("_row").agg(F.count("*").alias("n_hit"))
    found = spans.select("_row", "item").distinct().groupBy("_row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    whole = doc_words.join(n_hit, "_row", "left").join(found, "_row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return whole.select(key, F.size("w").cast("long").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "items")


def oracle_sql() -> str:
    """The same for DuckDB, on the tables documents and benchmark."""
    split = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, {split} AS w FROM documents),
    b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {split} AS w FROM benchmark),
    win AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[k:k + {WINDOW - 1}], ' ') AS g FROM b, unnest(range(1, CAST(greatest(2, len(w) - {WINDOW - 2}) AS BIGINT))) AS r(k) WHERE len(w) > 0),
    met AS (SELECT i, k, n, item FROM (SELECT i, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS r(k)) JOIN win USING (n, g)),
    hit AS (SELECT i, count(DISTINCT p) AS n_hit FROM (SELECT i, unnest(range(k, k + n)) AS p FROM met) GROUP BY i),
    it AS (SELECT i, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY i)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (i) LEFT JOIN it USING (i)"""
