"""Token counts, with overlap resynchronisation for huge documents.

Texts of up to ``CHUNK_CHARS`` characters are encoded in one piece. Longer ones
are encoded as overlapping chunks with offsets, so that memory stays bounded,
and are spliced at stable boundaries: places behind white space where a token
starts in both chunks that cover it. There the splice is proven: the tokenizer
drops white space and matches its pattern anew behind it, its normaliser never
joins characters across white space, so what precedes can't change the tokens
that follow. If the overlap of two chunks has no such place, the overlap is
doubled, at most until one chunk reaches the end of the text.

Shorter texts of ASCII and Latin letters are split into the tokenizer's words
first; the library encodes each distinct word once. Words are encoded
independently of each other, so the sum is that of the whole text.

Null text counts as empty text. Repeated rows give repeated results, an empty
table an empty one. Rows are counted each for itself, so there are no ties.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark.sql import DataFrame

from ledgerloom.llm.common import map_arrow, slices, texts

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
LIMIT_TOKENS = 2048
#: Words whose counts a task remembers.
CACHE_WORDS = 300_000

#: What a plain text may hold: ASCII and the letters U+00C0 to U+024F but U+0130, which are letters in every edition of Unicode and normalised already.
_UNUSUAL = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]|<\\|")
_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\t-\r a-z0-9\x80-\xff]+")

#: White space as the tokenizer means it: that of Unicode, without the separators U+001C to U+001F.
_SPACE = frozenset(c for c in map(chr, range(0x3001)) if c.isspace()) - frozenset("\x1c\x1d\x1e\x1f")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> tokenizers.Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    model = tokenizers.Tokenizer.from_file(path)
    model.no_padding()
    model.no_truncation()
    return model


class Counter:
    """Counts the tokens of texts; words of plain texts are looked up."""

    def __init__(self, model: tokenizers.Tokenizer) -> None:
        self.model, self.known = model, {}

    def count(self, whole: list[str]) -> list[int]:
        split, out = {}, [0] * len(whole)
        for i, text in enumerate(whole):
            if len(text) > CHUNK_CHARS:
                out[i] = count(self.model, text)
            elif _UNUSUAL.search(text):
                out[i] = len(self.model.encode_batch_fast([text], add_special_tokens=False)[0])
            else:
                split[i] = _WORDS.findall(text.lower().encode())
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        fresh = list(set().union(*split.values()).difference(self.known))
        for k in range(0, len(fresh), 10_000):
            part = fresh[k : k + 10_000]
            made = self.model.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            self.known.update(zip(part, map(len, made)))
        for i, words in split.items():
            out[i] = sum(map(self.known.__getitem__, words))
        return out


def stable(text: str, left: list[int], right: list[int], begin: int, end: int) -> int | None:
    """The last place in [begin, end) behind white space at which tokens of both chunks start."""
    return max((p for p in set(left).intersection(right) if begin < p < end and text[p - 1] in _SPACE), default=None)


def count(model: tokenizers.Tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """The number of tokens of one text, encoded in overlapping chunks."""
    at = total = 0  # tokens that start before `at` are counted
    while len(text) - at > chunk:
        # the chunk that begins at `at` begins at a stable boundary
        first = [a + at for a, _ in model.encode(text[at : at + chunk], add_special_tokens=False).offsets]
        end, wide, cut = at + chunk, overlap, None
        while cut is None:
            begin = max(at, end - wide)
            if begin == at:  # the overlap has grown to the whole chunk: take a longer chunk, and a longer overlap with it
                end = min(len(text), at + 2 * (end - at))
                if end == len(text):
                    return total + len(model.encode(text[at:], add_special_tokens=False))
                first = [a + at for a, _ in model.encode(text[at:end], add_special_tokens=False).offsets]
                begin = max(at + 1, end - wide)
            # the second chunk starts behind white space where it can, and reaches beyond the end of the first
            start = next((p for p in range(begin, end) if text[p - 1] in _SPACE), None)
            if start is not None:
                second = [a + start for a, _ in model.encode(text[start : end + wide], add_special_tokens=False).offsets]
                cut = stable(text, first, second, at, end)
            wide *= 2
        total += sum(1 for a in first if a < cut)
        at = cut
    return total + len(model.encode(text[at:], add_special_tokens=False))


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT_TOKENS) -> DataFrame:
    """Bytes and tokens of each text; returns key, n_bytes, n_tokens, over_limit."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer(path))
        for batch in batches:
            for part in slices(batch, text):
                n = pa.array(counter.count(texts(part.column(text))), pa.int64())
                size = pc.fill_null(pc.binary_length(part.column(text)), 0).cast(pa.int64())
                yield pa.record_batch({key: part.column(key), "n_bytes": size, "n_tokens": n, "over_limit": pc.greater(n, limit)})

    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
