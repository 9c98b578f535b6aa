"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

A first pass counts the pre-tokens of all documents, summed in each task and then
over tasks, and keeps the most frequent ones; how documents are dealt to tasks
makes no difference. They and their ids are compiled into a deterministic acyclic
automaton that shares prefixes and suffixes; the sum of the numbers along a
word's path is the row of its ids. Executors memory-map the file. Words outside
the lexicon are merged exactly, many at a time: in each step every word of a
block replaces its leftmost pair of the lowest rank.

Null text counts as empty text: no ids, and the decoded text is empty. Repeated
rows give repeated results; other columns are ignored. An empty table gives an
empty lexicon and an empty result. Texts of any length are encoded whole; a word
of any length is merged in time n log n.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, map_arrow, raw, ship, slices

#: Words in the lexicon at most, and bytes of one.
LEXICON_WORDS = 65_536
LEXICON_BYTES = 40
#: Different words that a task counts before it passes the counts on; they are added up later.
COUNT_WORDS = 200_000
#: Words remembered by a Python worker, from task to task.
CACHE_WORDS = 500_000
#: Words longer than this many bytes are merged one by one with a heap.
BLOCK_BYTES = 64

_NEVER = np.int32(2**31 - 1)

#: White space of Unicode, which the tokenizer's pattern means by \s.
_WHITE = r"\t-\r \x85\xa0  -     　"
_UNICODE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: Texts of ASCII and the letters U+00C0 to U+024F take a pattern over bytes: there each byte over 127 is part of a letter.
_UNUSUAL = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ɏ]")
_BYTES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\x80-\xff]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9\x80-\xff]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Of characters beyond the basic plane and of newly assigned ones, the edition of Unicode decides which are letters; the library splits those texts itself.
_BEYOND = re.compile("[\U00010000-\U0010ffff" + "".join(c for i in range(0x250, 0xD800) if unicodedata.category(c := chr(i)) == "Cn") + "]")
_SPLITTER = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def pre_tokens(data: bytes) -> list[bytes]:
    """The pieces of a text that are merged by themselves."""
    if data.isascii() or not _UNUSUAL.search(text := data.decode()):
        return _BYTES.findall(data)
    if _BEYOND.search(text):
        return [text[a:b].encode() for _, (a, b) in _SPLITTER.pre_tokenize_str(text)]
    return [x.encode() for x in _UNICODE.findall(text)]


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """A byte-level BPE vocabulary read from a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_id = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.token_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self.token_bytes |= {i: t for t, i in self.special.items()}
        self.token_csv = {i: b"%d," % i for i in self.token_bytes}
        self.split_special = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in self.rank.values()], np.int32)[order]
        self.made = np.array([m for _, m in self.rank.values()], np.int32)[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; pairs that never merge have the rank _NEVER."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], _NEVER), np.where(hit, self.made[at], -1)

    def merge_long(self, word: bytes) -> list[int]:
        """One word of any length, by a heap of (rank, place)."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p][0], i, *p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.rank[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (ids[k], ids[after[k]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], k, *p))
        return [x for x in ids if x >= 0]

    def merge_block(self, words: list[bytes]) -> list[list[int]]:
        """Words of at most BLOCK_BYTES bytes, all in step."""
        n, sizes = len(words), np.array([len(w) for w in words])
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        ids = np.full((n, width), -1, np.int32)
        ids[inside] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int16), (n, width)).copy()
        before = after - np.int16(2)
        rank, made = np.full((n, width), _NEVER, np.int32), np.full((n, width), -1, np.int32)
        rank[:, :-1], made[:, :-1] = self.look_up(ids[:, :-1], ids[:, 1:])
        rows = np.arange(n)
        while width > 1 and len(rows):
            part = rank[rows]
            at = part.argmin(1)
            live = part[np.arange(len(rows)), at] != _NEVER
            rows, at = rows[live], at[live]
            if not len(rows):
                break
            gone = after[rows, at].astype(np.int64)
            ids[rows, at] = made[rows, at]
            ids[rows, gone] = -1
            rank[rows, gone] = _NEVER
            then = after[rows, gone].astype(np.int64)
            after[rows, at] = then
            has = then < sizes[rows]
            before[rows[has], then[has]] = at[has]
            right = np.where(has, ids[rows, np.minimum(then, width - 1)], -1)
            rank[rows, at], made[rows, at] = self.look_up(ids[rows, at], right)
            prior = before[rows, at].astype(np.int64)
            has = prior >= 0
            r, p = rows[has], prior[has]
            rank[r, p], made[r, p] = self.look_up(ids[r, p], ids[r, at[has]])
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        out: list[list[int] | None] = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        block: list[int] = []
        for i in order:
            if len(words[i]) > BLOCK_BYTES:
                out[i] = self.merge_long(words[i])
                continue
            block.append(i)
            if len(block) == 20_000:
                for k, ids in zip(block, self.merge_block([words[k] for k in block]), strict=True):
                    out[k] = ids
                block = []
        if block:
            for k, ids in zip(block, self.merge_block([words[k] for k in block]), strict=True):
                out[k] = ids
        return out


class Transducer:
    """A minimal acyclic automaton over bytes whose paths add up to the row of a word's ids."""

    ARRAYS = (("keys", np.int64), ("target", np.int32), ("number", np.int32), ("final", np.uint8), ("start", np.int32), ("ids", np.int32))

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: Iterable[bytes], ids: Iterable[Iterable[int]]) -> Transducer:
        """From distinct words in ascending order. A state is frozen once no later word can pass it; equal states become one."""
        frozen: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        open_: list[list] = [[False, []]]  # the path of the last word: [is final, edges to frozen states]
        last = b""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                final, edges = open_.pop()
                state = (final, tuple(edges))
                at = frozen.setdefault(state, len(states))
                if at == len(states):
                    states.append(state)
                open_[-1][1].append((last[len(open_) - 1], at))

        rows, start = [], [0]
        for word, row in zip(words, ids, strict=True):
            same = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            close(same)
            open_.extend([False, []] for _ in word[same:])
            open_[-1][0] = True
            last = word
            rows.extend(row)
            start.append(len(rows))
        close(0)
        states.append((open_[0][0], tuple(open_[0][1])))  # the root comes last
        below = [0] * len(states)
        edges = []
        for s, (final, out) in enumerate(states):
            count = int(final)
            for byte, t in out:
                edges.append((s << 8 | byte, t, count))
                count += below[t]
            below[s] = count
        edges.sort()
        key, target, number = zip(*edges) if edges else ((), (), ())
        arrays = {"keys": key, "target": target, "number": number, "final": [f for f, _ in states], "start": start, "ids": rows}
        return cls(**{k: np.array(arrays[k], t) for k, t in cls.ARRAYS})

    def to_bytes(self) -> bytes:
        parts = [getattr(self, k).tobytes() for k, _ in self.ARRAYS]
        head = struct.pack("<6q", *(len(p) for p in parts))
        return head + b"".join(p + b"\0" * (-len(p) % 8) for p in parts)

    @classmethod
    def map(cls, path: str) -> Transducer:
        """The arrays in a file, mapped into memory and not read."""
        whole = np.memmap(path, np.uint8, "r").view(np.ndarray)  # still mapped; plain arrays are faster to slice
        at, arrays = 48, {}
        for (k, t), n in zip(cls.ARRAYS, struct.unpack("<6q", bytes(whole[:48])), strict=True):
            arrays[k] = whole[at : at + n].view(t)
            at += n + -n % 8
        return cls(**arrays)

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The row of each word's ids, -1 for unknown words; all words walk in step."""
        out = np.full(len(words), -1, np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        if not len(self.keys) or not len(words):
            return out
        data = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        begin = np.cumsum(sizes) - sizes
        who = np.arange(len(words))
        who = who[(sizes <= LEXICON_BYTES) & (sizes > 0)]
        state, total = np.full(len(who), len(self.final) - 1, np.int64), np.zeros(len(who), np.int64)
        for j in range(LEXICON_BYTES):
            over = sizes[who] == j
            if over.any():
                good = over & (self.final[state] == 1)
                out[who[good]] = total[good]
                who, state, total = who[~over], state[~over], total[~over]
            if not len(who):
                break
            key = state << 8 | data[begin[who] + j]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            who, at, total = who[hit], at[hit], total[hit]
            state, total = self.target[at].astype(np.int64), total + self.number[at]
        if len(who):
            good = (sizes[who] == LEXICON_BYTES) & (self.final[state] == 1)
            out[who[good]] = total[good]
        return out

    def outputs(self, rows: np.ndarray) -> list[list[int]]:
        """The ids in each of these rows."""
        begin, sizes = self.start[rows], self.start[rows + 1] - self.start[rows]
        ends = np.cumsum(sizes)
        flat, ends = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)].tolist(), ends.tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


@functools.lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


@functools.lru_cache(maxsize=2)
def lexicon(name: str) -> Transducer:
    return Transducer.map(SparkFiles.get(name))


class Codec:
    """Encodes texts word by word: lexicon first, exact merging for the rest, and a bounded memory of recent words."""

    def __init__(self, model: Merges, known: Transducer) -> None:
        self.model, self.known = model, known
        self.forget()

    def forget(self) -> None:
        """csv: ids as text, each followed by a comma; back: bytes that the ids decode to."""
        self.csv = {t: self.model.token_csv[i] for t, i in self.model.special.items()}
        self.back = {t: self.model.token_bytes[i] for t, i in self.model.special.items()}

    def words(self, data: bytes) -> list[bytes]:
        if self.model.split_special is None or not self.model.split_special.search(data):
            return pre_tokens(data)
        return [w for part in self.model.split_special.split(data) if part for w in ([part] if part in self.model.special else pre_tokens(part))]

    def learn(self, words: set[bytes]) -> None:
        if len(self.csv) + len(words) > CACHE_WORDS:
            self.forget()
        fresh = list(words.difference(self.csv))
        if not fresh:
            return
        rows = self.known.rows(fresh)
        found = iter(self.known.outputs(rows[rows >= 0]))
        other = iter(self.model.merge([w for w, r in zip(fresh, rows.tolist()) if r < 0]))
        csv, back, as_text, as_bytes = self.csv, self.back, self.model.token_csv.__getitem__, self.model.token_bytes.__getitem__
        for w, r in zip(fresh, (rows >= 0).tolist()):
            ids = next(found if r else other)
            csv[w] = b"".join(map(as_text, ids))
            back[w] = w if (out := b"".join(map(as_bytes, ids))) == w else out

    def encode(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids, comma-joined, and the text that they decode to."""
        split = [self.words(x) for x in texts]
        self.learn(set().union(*split))
        csv, back = self.csv.__getitem__, self.back.__getitem__
        for words in split:
            yield b"".join(map(csv, words))[:-1], b"".join(map(back, words)).decode("utf-8", "replace").encode()


@functools.lru_cache(maxsize=1)
def codec(path: str, name: str) -> Codec:
    """The worker's codec for a vocabulary and a lexicon; what it has learned serves the next task too."""
    return Codec(merges(path), lexicon(name))


def frequent_words(docs: DataFrame, path: str, text: str = "text", limit: int = LEXICON_WORDS) -> list[bytes]:
    """The pre-tokens of all documents that are met at least so often that no more than ``limit`` are, of at most LEXICON_BYTES bytes; ascending.

    Counts over 64 are told apart in steps of about a hundredth, so that a few
    thousand sums say how often that is; only the words kept go to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = Codec(merges(path), None), Counter()

        def rows() -> pa.RecordBatch:
            kept = [w for w in found if len(w) <= LEXICON_BYTES]
            return pa.record_batch({"word": pa.array(kept, pa.binary()), "n": pa.array([found[w] for w in kept], pa.int64())})

        for batch in batches:
            for part in slices(batch, text):
                for data in raw(part.column(text)):
                    found.update(own.words(data))
                if len(found) > COUNT_WORDS:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    counts = cut(map_arrow(docs.select(text), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2("n") * 64))
    left, least = limit, 1 << 62
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if r["count"] > left:
            break
        left, least = left - r["count"], r["level"]
    special = set(merges(path).special)
    return sorted(w for r in counts.where(level >= least).select("word").collect() if (w := bytes(r.word)) not in special)


def build_lexicon(spark: SparkSession, docs: DataFrame, path: str, text: str = "text", limit: int = LEXICON_WORDS) -> str:
    """Compile the frequent words of ``docs``; returns the name of the shipped file."""
    words = frequent_words(docs, path, text, limit)
    return ship(spark, Transducer.compile(words, merges(path).merge(words)).to_bytes(), "lexicon")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each text and decode it again.

    Returns key, n_tokens, ids_sha256 and decoded_sha256; ``with_ids`` adds the
    ids as array<int> and the decoded text.
    """
    name = build_lexicon(docs.sparkSession, docs, path, text)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, name)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for part in slices(batch, text):
                both = list(own.encode(raw(part.column(text))))
                cols = {
                    key: part.column(key),
                    "n_tokens": pa.array([c.count(b",") + 1 if c else 0 for c, _ in both], pa.int64()),
                    "ids_sha256": pa.array([sha(c) for c, _ in both]),
                    "decoded_sha256": pa.array([sha(d) for _, d in both]),
                }
                if with_ids:
                    cols["ids"] = pa.array([np.fromstring(c, np.int32, sep=",") if c else [] for c, _ in both], pa.list_(pa.int32()))
                    cols["decoded"] = pa.array([d.decode() for _, d in both])
                yield pa.record_batch(cols)

    more = ", ids array<int>, decoded string" if with_ids else ""
    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
