"""Operators against brute force, the libraries themselves, or held-out labels."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, language, merkle, quality_classifier, quality_rules, secrets, simhash, token_counts, toxicity
from ledgerloom.llm.common import table
from ledgerloom.llm.labelled import fit_sigmoid, labelled_features
from ledgerloom.llm.queries import ORACLES, QUERIES, vocabulary
from tests.oracle import check

ODD = ["a", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "ª", "²", "½", "Ⅷ", "٣", "中", "😀", "́", "é", "'s", "'S", "'ll", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "0", "12", "_", "-", "...", "​", "　", "Σ", "ΑΣ", "İ", "ſ", "x" * 90, "՘", "\U00018d80"]


def odd_texts(n: int, most: int = 40, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    check(QUERIES[name](spark, sf), ORACLES[name], sf)


# BPE.


def test_bpe_equals_the_library(spark, sf):
    path = vocabulary("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    docs = table(spark, sf, "documents").select("doc_id", "text").unionAll(spark.createDataFrame(list(enumerate(odd_texts(1500), 10_000)), "doc_id long, text string"))
    want = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode(docs, path).collect():
        ids = library.encode(want[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), repr(want[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_merging_in_blocks_equals_merging_one_by_one():
    m = bpe.merges(vocabulary("byte_bpe_50k.json"))
    r = random.Random(4)
    words = [bytes(r.choice(b"aeinrst \xc3\xa9th") for _ in range(r.randint(1, 64))) for _ in range(3000)]
    assert m.merge(words) == [m.merge_long(w) for w in words]


def test_the_lexicon_does_not_depend_on_partitions(spark, sf, monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    docs = table(spark, sf, "documents").select("text")
    one = bpe.frequent_words(docs.coalesce(1), path)
    assert bpe.frequent_words(docs.repartition(37), path) == one
    library = Counter(w for r in docs.collect() for w in bpe.pre_tokens((r.text or "").encode()) if len(w) <= bpe.LEXICON_BYTES)
    level = lambda n: n if n < 64 else math.floor(math.log2(n) * 64)

    def want(limit):
        kept = [w for w in library if sum(level(n) >= level(library[w]) for n in library.values()) <= limit] if len(library) > limit else list(library)
        return sorted(kept)

    assert one == want(bpe.LEXICON_WORDS) and len(one) > 1000
    monkeypatch.setattr(bpe, "COUNT_WORDS", 100)
    library = Counter(dict(library.most_common(3000)))
    for limit in (10, 500):
        assert bpe.frequent_words(docs.repartition(3), path, limit=limit) == want(limit)
    assert bpe.frequent_words(docs.limit(0), path) == []


def test_transducer_is_minimal_and_finds_what_it_holds():
    r = random.Random(2)
    words = sorted({bytes(r.choice(b"abc") for _ in range(r.randint(1, 8))) for _ in range(700)})
    t = bpe.Transducer.compile(words, [[i, i + 1] for i in range(len(words))])
    assert t.rows(words).tolist() == list(range(len(words)))
    other = [w for w in {bytes(r.choice(b"abcd") for _ in range(r.randint(1, 9))) for _ in range(700)} if w not in set(words)]
    assert set(t.rows([*other, b"x" * 99]).tolist()) == {-1}
    assert t.outputs(np.array([3, 0])) == [[3, 4], [0, 1]]
    # minimal: no two states accept the same words
    out = {}
    for key, to in zip(t.keys.tolist(), t.target.tolist()):
        out.setdefault(key >> 8, {})[key & 255] = to
    memo = {}

    def language_of(s):
        if s not in memo:
            memo[s] = frozenset({b""} if t.final[s] else ()) | {bytes([b]) + w for b, to in out.get(s, {}).items() for w in language_of(to)}
        return memo[s]

    found = [language_of(s) for s in range(len(t.final))]
    assert len(set(found)) == len(found)


# Token counts.


def test_token_counts_equal_the_library():
    m = token_counts.tokenizer(vocabulary("word_bpe_49k.json"))
    whole = odd_texts(3000, 60)
    want = [len(m.encode(x, add_special_tokens=False)) for x in whole]
    assert token_counts.Counter(m).count(whole) == want
    r = random.Random(3)
    for x, n in zip(whole, want):
        assert token_counts.count(m, x, r.choice([8, 20, 50]), r.choice([2, 4, 16])) == n, repr(x)


def test_huge_texts_without_boundaries_widen_to_the_whole():
    m = token_counts.tokenizer(vocabulary("word_bpe_49k.json"))
    for x in ("x" * 70_000, "ab" * 20_000 + " " + "cd" * 40_000, ("word " * 30_000).strip()):
        assert token_counts.count(m, x) == len(m.encode(x, add_special_tokens=False))


def test_a_table_of_long_texts_equals_the_library(spark):
    """Texts over CHUNK_CHARS characters, all of which are spliced, through the operator."""
    r = random.Random(11)
    pieces = [*ODD, "word ", "longer words ", "中文 ", "12,345.67 ", "x" * 700, " " * 300, "don't "]
    whole = ["".join(r.choice(pieces) for _ in range(r.randint(6000, 12000))) for _ in range(24)]
    whole = [x * (1 + token_counts.CHUNK_CHARS // len(x)) for x in whole]
    assert all(len(x) > token_counts.CHUNK_CHARS for x in whole)
    m = token_counts.tokenizer(vocabulary("word_bpe_49k.json"))
    docs = spark.createDataFrame(list(enumerate(whole)), "doc_id long, text string").repartition(4)
    rows = token_counts.token_counts(docs, vocabulary("word_bpe_49k.json")).collect()
    assert {x.doc_id: (x.n_bytes, x.n_tokens) for x in rows} == {i: (len(t.encode()), len(m.encode(t, add_special_tokens=False))) for i, t in enumerate(whole)}


# SimHash.


def slow_fingerprint(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    whole = [*odd_texts(200, 60), "", "A B c d E", "one two"]
    docs = spark.createDataFrame(list(enumerate(whole)), "doc_id long, text string")
    got = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.fingerprints(docs).collect()}
    assert got == {i: slow_fingerprint(x) for i, x in enumerate(whole)}


def clouds(seed: int, n: int) -> list[int]:
    """Fingerprints with dense clouds, chains and strangers."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    flip = lambda x, k: x ^ sum(1 << b for b in r.sample(range(64), k))
    centre = r.getrandbits(64)
    out += [flip(centre, r.randint(0, 5)) for _ in range(n)]
    x = r.getrandbits(64)
    for _ in range(40):
        x = flip(x, 4)
        out.append(x)
    return out + [flip(x, 5), 0, 1, 2**63]


@pytest.mark.parametrize("block", [16, 2048])
@pytest.mark.parametrize("thresholds", [(0, 0, 0, 0, 0), (1, 0, 0), (1, 1), (2,), None])
def test_components_equal_brute_force(spark, thresholds, block):
    fps = sorted(set(clouds(block, 300)))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    if thresholds is None:
        parts = simhash.plan(df, len(fps))
        assert sum(2 * t + 1 for _, t in parts) >= 5
    else:
        edges = [round(i * 64 / len(thresholds)) for i in range(len(thresholds) + 1)]
        parts = [(list(range(a, b)), t) for a, b, t in zip(edges, edges[1:], thresholds)]
    got = {r.hi: r.lo for r in simhash.stars(simhash.links(df, parts, block)).collect()}
    a = np.array(fps, np.uint64)
    up = list(range(len(a)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a) <= 4, 1))):
        x, y = root(i), root(j)
        up[x] = y
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    least = {}
    for i, x in enumerate(signed):
        least[root(i)] = min(least.get(root(i), x), x)
    assert {x: got.get(x, x) for x in signed} == {x: least[root(i)] for i, x in enumerate(signed)}


def slow_signature(text: str, shingle: int = 5, extra: int = 4) -> tuple[int, ...]:
    low, m = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text), 2**64 - 1
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ([" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else []))]

    def mixed(x, k):
        x = x + k * 0x9E3779B97F4A7C15 & m
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    of = lambda hs: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    return (of(hashes), *(of([mixed(h, k) for h in hashes]) for k in range(1, extra + 1)))


def near_groups(signatures: dict) -> dict:
    """Key to the smallest key that it reaches by links of the near-duplicate rule."""
    group = {k: k for k in signatures}
    keys = sorted(signatures)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = signatures[a], signatures[b]
            if group[a] != group[b] and (x[0] ^ y[0]).bit_count() <= simhash.NEAR_DISTANCE and sum((p ^ q).bit_count() for p, q in zip(x, y)) <= simhash.NEAR_BITS:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    return group


def near_texts(seed: int = 4) -> list[str]:
    """Texts, copies of each with one word after another replaced, and a crowd of copies of one text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    out = []
    for n in (8, 60, 150, 300):
        w = [word() for _ in range(n)]
        for _ in range(12):
            out.append(" ".join(w))
            w[r.randrange(n)] = word()
    w = [word() for _ in range(120)]
    return out + [" ".join(x if r.random() > 0.02 else word() for x in w) for _ in range(60)] + ["", "one", "ONE"]


def test_deduplication_equals_brute_force(spark, sf):
    whole = dict(enumerate(near_texts())) | {r.doc_id + 1000: r.text or "" for r in table(spark, sf, "documents").collect()}
    docs = spark.createDataFrame(list(whole.items()), "doc_id long, text string").repartition(5)
    want = near_groups({k: slow_signature(t) for k, t in whole.items()})
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == sorted(set(want.values()))


def test_near_duplicates_of_0_8_are_found(spark):
    """Pairs by the share of five-word shingles that they have in common: nine in ten of 0.85 or more are linked, none under 0.5."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, share = [], {}
    for i in range(300):
        a = [word() for _ in range(r.randint(100, 400))]
        b = list(a)
        for _ in range(r.choice([1, 2, 3, 5, 8, 40])):
            b[r.randrange(len(b))] = word()
        x, y = shingles(a), shingles(b)
        share[i] = len(x & y) / len(x | y)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * i in kept for i in share)
    linked = {i for i in share if 2 * i + 1 not in kept}
    high, low = [i for i in share if share[i] >= 0.85], [i for i in share if share[i] < 0.5]
    assert len(linked.intersection(high)) >= 0.9 * len(high) > 90 and not linked.intersection(low) and len(low) > 20


@pytest.mark.parametrize("block", [8, 2048])
def test_links_by_several_fingerprints_equal_brute_force(spark, block):
    found = {tuple(slow_signature(t)) for t in near_texts(7)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = {k: v for k, v in enumerate(sorted(found))}
    df = spark.createDataFrame([(k, *map(signed, v)) for k, v in rows.items()], "node long, fp long, fp1 long, fp2 long, fp3 long, fp4 long")
    parts = simhash.plan(df, len(rows), simhash.NEAR_DISTANCE)
    assert sum(2 * f + 1 for _, f in parts) > simhash.NEAR_DISTANCE
    got = {r.hi: r.lo for r in simhash.stars(simhash.links(df, parts, block, simhash.NEAR_DISTANCE, simhash.NEAR_BITS)).collect()}
    assert {k: got.get(k, k) for k in rows} == near_groups(rows)


def test_meetings_and_plans():
    """Two values at most 2 f bits apart share a value within f flips; plans spend the budget whatever the sample."""
    for width in (3, 6):
        for flips in (0, 1, 2):
            near = [z for z in range(1 << width) if z.bit_count() <= flips]
            for x in range(1 << width):
                assert len({x ^ z for z in near}.intersection(near)) == simhash.meetings(width, x.bit_count(), flips)
    r = np.random.default_rng(2)
    even = r.integers(0, 2**64, 500, np.uint64)
    for sample in (even, even & np.uint64(0xFFFF), even | np.uint64(2**40 - 1), np.zeros(3, np.uint64)):
        for n in (100, 10**6, 10**11):
            parts = simhash.allocate(list(range(64)), sample, n)
            assert sum(2 * f + 1 for _, f in parts) >= 5 and len({b for p, _ in parts for b in p}) == sum(len(p) for p, _ in parts)
    half = even & np.uint64(2**32 - 1) | even >> np.uint64(20) & np.uint64(0xFFF) << np.uint64(32)
    plans = [simhash.allocate(list(range(64)), half, 10**k) for k in range(3, 12)]
    assert any(len({len(p) for p, _ in parts}) > 1 for parts in plans) and any(len({f for _, f in parts}) > 1 for parts in plans)


def test_frequent_labels_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FREQUENT", 3)
    rows = spark.range(4000).selectExpr("id", "IF(id % 2 = 0, 7L, id) AS fp")
    labels = rows.groupBy("fp").count().selectExpr("fp", "fp * 10 AS label", "count AS members")
    assert sorted((r.id, r.label) for r in simhash.spread_join(rows, labels, "fp", 4000).collect()) == [(i, 70 if i % 2 == 0 else i * 10) for i in range(4000)]


def test_the_row_that_stays_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(1, "the very same text", f"s{i}") for i in range(40)], "doc_id long, text string, source string")
    assert len({tuple(simhash.deduplicate(docs.repartition(n)).collect()) for n in (1, 3, 8)}) == 1


def test_near_duplicates_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    whole = {r.doc_id: slow_fingerprint(r.text or "") for r in docs.collect()}
    comp = {k: k for k in whole}
    for k in sorted(whole):
        for j in sorted(whole):
            if (whole[k] ^ whole[j]).bit_count() <= 4 and comp[k] != comp[j]:
                old, new = max(comp[k], comp[j]), min(comp[k], comp[j])
                comp = {x: new if c == old else c for x, c in comp.items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {k: (f"{f:016x}", comp[k]) for k, f in whole.items()}
    assert sorted(r.doc_id for r in simhash.deduplicate(docs, shingle=4, distance=4, within=None).select("doc_id").collect()) == sorted(set(comp.values()))


# Decontamination.


def test_contamination_equals_brute_force_in_both_ways(spark):
    r = random.Random(6)
    vocabulary_ = [f"w{i}" for i in range(6)] + ["É", "é", "中"]
    text = lambda n: " ".join(r.choice(vocabulary_).upper() if r.random() < 0.2 else r.choice(vocabulary_) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 3, 5, 11, 12]))) for i in range(12)]
    docs = [(i, text(r.randint(0, 60)) + (" " + items[i % 12][1] if i % 3 == 0 else "")) for i in range(80)]
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x))
    want = {}
    for k, x in docs:
        w, hit, found = split(x), set(), set()
        for item, y in items:
            v = split(y)
            for s in range(max(1, len(v) - 9)):
                win = v[s : s + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add(str(item))
        want[k] = (len(w), len(hit), sorted(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.items_sha256) for r in decontaminate.contamination(d, b, limit=limit).collect()}
        assert got == want


def test_windows_decide_whether_a_benchmark_is_broadcast(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30))), (2, "a b"), (3, None), (4, "..")], "item_id long, text string")
    assert decontaminate.fits(items, "text", 22) and not decontaminate.fits(items, "text", 21) and decontaminate.fits(items.limit(0), "text", 0)


def test_a_frequent_word_in_the_join(spark, monkeypatch):
    """An item of one word that every document has; marks of contaminated texts in both kinds of join."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same text', concat('the word ', id)) AS text")
    items = spark.createDataFrame([(1, "the"), (2, "word 17")], "item_id long, text string")
    rows = decontaminate.contamination_by_join(docs, items).collect()
    assert len(rows) == 3000 and all(r.n_hit == 1 and list(r["items"]) == ["1"] for r in rows if r.doc_id != 17) and [list(r["items"]) for r in rows if r.doc_id == 17] == [["1", "2"]]
    one = spark.createDataFrame([(1, "same text"), (2, "word 17")], "item_id long, text string")
    for marks in (decontaminate.BROADCAST_MARKS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_MARKS", marks)
        assert decontaminate.clean(docs, one, limit=0).count() == 1999


# Language.


def test_out_of_place_distances():
    german, english = "der die und das ist nicht ein wir sie " * 5, "the and of to in that is was he for it " * 5
    profiles = language.Profiles({k: language.most_frequent(*language.ngrams(t)).tolist() for k, t in (("de", german), ("en", english))})
    for text in ("das ist die", "that was the end of it", "x"):
        letters = re.sub(r"[^a-z]+", " ", text.lower()).split()
        grams = Counter()
        code = lambda g: sum((language.EDGE if c == "_" else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        for w in letters:
            for n in (1, 2, 3):
                s = w if n == 1 else f"_{w}_"
                grams.update(code(s[i : i + n]) for i in range(len(s) - n + 1))
        # the edge between two words is shared: each word still has both of its own
        own = [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))][: language.PROFILE]
        for k, name in enumerate(profiles.langs):
            ranks = {g: i for i, g in enumerate(language.most_frequent(*language.ngrams(german if name == "de" else english)).tolist())}
            want = sum(abs(ranks[g] - i) if g in ranks else language.PROFILE for i, g in enumerate(own)) / (language.PROFILE * len(own))
            mine = language.most_frequent(*language.ngrams(text))
            assert mine.tolist() == own
            assert profiles.distances(mine)[k] == pytest.approx(want)
    assert profiles.predict("das ist nicht der")[0] == "de" and profiles.predict("12 ?")[0] == "und"


def test_language_of_held_out_documents(spark, sf):
    docs = table(spark, sf, "documents")
    r = QUERIES["op5_language"](spark, sf).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND length(text) >= 100")
    assert r.where("lang_pred = lang").count() >= 0.98 * r.count() > 0


@pytest.mark.parametrize("text", ["alpha beta gamma delta " * 50, "ab" * 600, " .. " * 300, "x" + " " * 250 + "Yz", "ΑΣ" * 99 + " " + "Ünï" * 70])
def test_pieces_count_what_the_whole_does(monkeypatch, text):
    whole = language.ngrams(text)
    for size in (1, 2, 7, 100):
        monkeypatch.setattr(language, "PIECE", size)
        assert [x.tolist() for x in whole] == [x.tolist() for x in language.ngrams(text)]


def test_edges_are_told_from_shorter_ngrams():
    codes, counts = language.ngrams("ab a")
    found = {tuple(x for x in (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF) if x): n for c, n in zip(codes.tolist(), counts.tolist())}
    e, a, b = language.EDGE, ord("a"), ord("b")
    assert found == {(a,): 2, (b,): 1, (e, a): 2, (a, b): 1, (b, e): 1, (a, e): 1, (e, a, b): 1, (a, b, e): 1, (e, a, e): 1}


# Merkle trees.


def record(key, url, body) -> bytes:
    key, url, body = "" if key is None else str(key), url or "", body or ""
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{key}>\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n".encode()


def pages_(n: int, seed: int = 8) -> list[tuple]:
    r = random.Random(seed)
    return [(i, f"u{i}", "".join(r.choice("abc<>é") for _ in range(r.randint(0, 50)))) for i in range(n)]


def findings(spark, ours: list[tuple], theirs: list[tuple]) -> tuple[list, list]:
    columns = "page_id long, url string, html string"
    rows = merkle.audit_replica(spark.createDataFrame(ours, columns), spark.createDataFrame(theirs, columns).repartition(5)).collect()
    return rows, sorted(((f.kind, f.key, f.lost, f.found) for x in rows for f in x.findings or ()), key=str)


def test_one_missing_page_is_one_finding(spark):
    pages = pages_(250)
    rows, found = findings(spark, pages, pages[1:])
    assert found == [("missing", 0, 1, 0)] and sum(x.n_missing for x in rows) == 1 and sum(x.n_changed + x.n_extra for x in rows) == 0
    assert max(x.n_compared for x in rows) < 100


def test_audit_finds_exactly_what_differs(spark):
    """Changed, missing, new, moved (under another key) and doubled records, and nothing else; offsets and the root by hand."""
    pages = pages_(1500)
    changed, missing, moved, doubled = {5, 600, 1400}, {7, 8, 900}, {11, 700}, {13}
    theirs = [(k + 10_000 if k in moved else k, u, h + "!" if k in changed else h) for k, u, h in pages if k not in missing]
    theirs += [p for p in pages if p[0] in doubled] + [(20_000, "new", "x")]
    rows, found = findings(spark, pages, theirs)
    want = [("changed", k, 1, 1) for k in changed] + [("missing", k, 1, 0) for k in missing | moved] + [("extra", k + 10_000, 0, 1) for k in moved] + [("extra", 13, 0, 1), ("extra", 20_000, 0, 1)]
    assert found == sorted(want, key=str)
    assert sum(x.n_records for x in rows) == 1500 and all(x.intact == (not x.findings) for x in rows)
    assert all(x.n_compared == 1 for x in rows if x.intact)
    n, slots = -(-1500 // merkle.ARCHIVE_RECORDS), merkle.FANOUT**merkle.LEVELS
    digits = lambda k, a, b: int(hashlib.md5(str(k).encode()).hexdigest()[a:b], 16)
    for x in rows:
        mine = sorted((digits(k, 8, 12) % slots, k, record(k, u, h)) for k, u, h in pages if digits(k, 0, 8) % n == x.archive)
        at, offset, nodes = {}, 0, []
        for slot, k, data in mine:
            at[k] = offset
            nodes.append((slot, offset, len(data), hashlib.sha256(data).hexdigest() + "*1"))
            offset += len(data)
        for step in (1, *[merkle.FANOUT] * merkle.LEVELS):
            up = {}
            for place, *rest in nodes:
                up.setdefault(place // step, []).append(rest)
            nodes = [(p, c[0][0], sum(s for _, s, _ in c), hashlib.sha256(",".join(f"{o - c[0][0]}:{s}:{h}" for o, s, h in c).encode()).hexdigest()) for p, c in sorted(up.items())]
        assert x.root == nodes[0][3] and x.n_bytes == offset
        assert all(f.offset == at[f.key] for f in x.findings or () if f.kind != "extra")


def test_a_key_of_many_records_is_spread(spark, monkeypatch):
    """A third of the pages has one key: archives stay small, and the audit exact, with both kinds of join."""
    pages = pages_(2000) + [(5, f"v{i}", f"body {i}") for i in range(1000)] + [(None, "w", f"null {i}") for i in range(400)] + [(9, "same", "same")] * 500
    theirs = [p for p in pages if p not in ((5, "v17", "body 17"), (None, "w", "null 3"))]
    theirs[theirs.index((5, "v400", "body 400"))] = (5, "v400", "other")
    for limit in (merkle.BROADCAST_KEYS, 0):
        monkeypatch.setattr(merkle, "BROADCAST_KEYS", limit)
        rows, found = findings(spark, pages, [p for p in theirs if p[0] is not None])
        assert sum(f[2] for f in found if f[1] is None) == 400
        rows, found = findings(spark, pages, theirs)
        assert (sum(x.n_missing + x.n_changed for x in rows), sum(x.n_extra + x.n_changed for x in rows)) == (3, 1)
        assert {(f[1], f[2], f[3]) for f in found if f[0] != "changed"} <= {(5, 1, 0), (5, 0, 1), (None, 1, 0)}
        columns = "page_id long, url string, html string"
        kept = merkle.records(spark.createDataFrame(pages, columns))
        sizes = merkle.leaves(kept, 16, merkle.crowded(kept, kept)).groupBy("archive").count().collect()
        assert len(sizes) == 16 and max(r["count"] for r in sizes) < 2 * merkle.ARCHIVE_RECORDS


# Secrets.


def slow_secrets(text: str) -> list[tuple]:
    spans = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.ASCII):
        if len(m.group(2)) >= 12:
            spans.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if m.end() - m.start() >= 18:
            spans.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer(r"[0-9a-f]+", text):
        if m.end() - m.start() >= 16:
            spans.append((m.start(), 2, m.end(), "hex"))
    for k, c in enumerate(secrets.CLASSES, 3):
        for m in re.finditer(c.candidate, text):
            s = m.group()
            if all(re.search(p, s) for p in c.holds) and not any(re.search(p, s) for p in secrets.ALLOWED):
                good = [i for i in range(len(s) - secrets.WINDOW + 1) if sum(secrets.SCALED[n] for n in Counter(s[i : i + secrets.WINDOW]).values()) <= c.most]
                if good:
                    spans.append((m.start() + good[0], k, m.start() + good[-1] + secrets.WINDOW, c.name))
    return sorted(spans)


def secret_texts() -> list[str]:
    r = random.Random(9)
    parts = ["password=", "PassWd : '", "api_key\":\"", "APIKEY=", "token: token = ", "secret", "AKIA", "AKIAAKIA", " ", "\n", "é", "\u0001", "ſecret=", "Key", "0123456789", "deadbeef", "==", "example"]
    chars = ["abcdef0123456789", "ABCDEF0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    return ["".join(r.choice(parts) if r.random() < 0.6 else "".join(r.choice(c) for _ in range(r.choice([5, 11, 12, 15, 16, 22, 40]))) for c in [r.choice(chars) for _ in range(r.randint(0, 14))]) for _ in range(400)]


def test_secrets_equal_brute_force(spark):
    whole = [*secret_texts(), "hex " + "0a1b2c3d4e5f6071 " * 600]
    docs = spark.createDataFrame(list(enumerate(whole)), "doc_id long, text string")
    found = 0
    for x in secrets.scan(docs).collect():
        spans = slow_secrets(whole[x.doc_id])
        text = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        assert x.spans == text(spans), repr(whole[x.doc_id])
        assert x.base_sha256 == hashlib.sha256(text([s for s in spans if s[1] < 3]).encode()).hexdigest()
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        found += len([s for s in spans if s[1] >= 3])
    assert found > 20


def test_redaction_masks_spans_and_nothing_else(spark):
    whole = secret_texts()
    docs = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(whole)], "doc_id long, text string, n_chars long")
    for x in secrets.redact(docs).collect():
        text, out, at = whole[x.doc_id], "", 0
        for a, _, b, _ in slow_secrets(text):
            if a >= at:
                out += text[at:a] + "[REDACTED]"
            at = max(at, b)
        assert x.text == out + text[at:] and x.n_chars == len(x.text)


# Quality rules.


def test_measures_equal_brute_force(spark):
    r = random.Random(12)
    parts = ["a", "b", "the", "A", "#x", "$$", "x|y", " ", " ", "  ", "\n", "\n", "\t", "\u000b", " ", "é", "中文"]
    whole = ["".join(r.choice(parts) + r.choice(["", " ", "\n"]) for _ in range(r.randint(0, 80))) for _ in range(300)]
    docs = spark.createDataFrame([(i, x, "en", "s") for i, x in enumerate(whole)], "doc_id long, text string, lang string, source string")
    for x in quality_rules.rate(docs).collect():
        text = whole[x.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [y for y in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (x.base_failed and x.kept)


def test_sketch_quantiles_are_accurate_and_merge(spark):
    r = random.Random(1)
    rows = [("en", f"s{i % 3}", 1000, r.randint(0, 200), 0, 0, 0, 10, 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, source string, word_chars long, n_symbols long, n_words long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long")
    sketch = quality_rules.sketches(df)
    whole = quality_rules.quantiles(sketch, ["lang"]).where("rule = 'symbols'").first()
    q, factor = quality_rules.RULES["symbols"]
    exact = sorted(x[3] for x in rows)[math.floor(q * 2999)]
    assert whole.limit / factor == pytest.approx(exact, rel=2 * quality_rules.ACCURACY) and whole.total == 3000


# Classifiers.


def test_coordinate_descent_reaches_the_optimum():
    random_ = np.random.default_rng(3)
    rows = [np.sort(random_.choice(30, 6, replace=False)) for _ in range(60)]
    y = np.array([int(7 in x or 3 in x) for x in rows])
    r = np.zeros(quality_classifier.FEATURES)
    r[:30] = random_.normal(size=30)
    w, bias = quality_classifier.coordinate_descent(rows, y, r, rounds=5000, tolerance=1e-9)
    sign = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    x = np.zeros((60, 31))
    for i, f in enumerate(rows):
        x[i, f] = r[f] / np.sqrt((r[f] ** 2).sum())
    x[:, 30] = 1

    def loss(v):
        return 0.5 * v @ v + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()

    v = np.append(w[:30], bias)
    base = loss(v)
    for _ in range(300):
        assert loss(v + random_.normal(size=31) * 10 ** random_.uniform(-4, 0)) >= base - 1e-3


def test_quality_scores_equal_brute_force(spark, sf):
    """Features by loops, ratios by dictionaries, margins by sums, for the whole query; the optimiser has a test of its own."""
    q = quality_classifier
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {x.doc_id: x for x in q.score(docs, labels).collect()}
    whole, mark = {x.doc_id: (x.text or "").encode() for x in docs.collect()}, {x.doc_id: x.quality for x in labels.collect() if x.quality is not None}

    def features(data):
        w, found = data.split(), set()
        names = [zlib.crc32(x.lower()) % q.WORD_BUCKETS for x in w]
        shapes = [q.shape(x) + 64 * (i > 0 and (names[i], q.shape(x)) == (names[i - 1], q.shape(w[i - 1]))) for i, x in enumerate(w)]
        pair = lambda i: shapes[i] * q.SHAPES + shapes[i + 1]
        signed = lambda x: (x + 2**63) % 2**64 - 2**63
        for i in range(len(w)):
            found.add(names[i])
            if i + 1 < len(w):
                found.add(q.WORD_PAIRS + (signed((names[i] * 1_000_003 + names[i + 1]) * 2654435761) >> 9) % q.WORD_PAIR_BUCKETS)
                found.add(q.PAIRS + pair(i))
            if i + 2 < len(w):
                found.add(q.TRIPLES + (signed((pair(i) * q.SHAPES + shapes[i + 2]) * 2654435761) >> 7) % q.TRIPLE_BUCKETS)
        return np.array(sorted(found), np.int64)

    keys = sorted(k for k in mark if zlib.crc32(str(k).encode()) % 5 and k in whole)
    rows, y = [features(whole[k]) for k in keys], np.array([mark[k] for k in keys])

    def model(part):
        n = [Counter(f for i in part if y[i] == k for f in rows[i].tolist()) for k in (0, 1)]
        seen = len(n[0] | n[1])
        r = np.zeros(q.FEATURES)
        for f in n[0] | n[1]:
            r[f] = math.log((n[1][f] + 1) / (sum(n[1].values()) + seen)) - math.log((n[0][f] + 1) / (sum(n[0].values()) + seen))
        w, bias = q.coordinate_descent([rows[i] for i in part], y[part], r)

        def margin(x):
            norm = math.sqrt(sum(r[f] ** 2 for f in x))
            return (sum(w[f] * r[f] for f in x) / norm if norm else 0.0) + bias

        return margin

    margins = [0.0] * len(keys)
    for k in range(3):
        m = model([i for i in range(len(keys)) if i % 3 != k])
        for i in range(k, len(keys), 3):
            margins[i] = m(rows[i])
    a, b = fit_sigmoid(margins, y)
    m = model(list(range(len(keys))))
    for k, data in whole.items():
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-(a * m(features(data)) + b))), abs=1e-4)
        assert got[k].predicted == int(got[k].score >= 0.3)


def test_toxicity_equals_brute_force(spark):
    """Examples, weights, cosines, votes and the sigmoid by dictionaries and loops, for the whole query."""
    r = random.Random(5)
    vocabulary_ = [f"w{'abcdefghijklmnopqrst'[i % 20]}{'abcdefghij'[i // 20]}" for i in range(200)]
    some = lambda n: [vocabulary_[min(199, int(r.expovariate(0.02)))] for _ in range(n)]
    docs = [(i, " ".join([*some(r.randint(0, 30)), *(["bad"] if i % 7 == 0 else []), *(["Worse"] if i % 21 == 0 else [])])) for i in range(900)]
    docs += [(900 + i, docs[i][1]) for i in range(0, 60, 3)] + [(990, None), (991, "unseen words only")]
    labels = [(k, int(k % 7 == 0 and k < 900) if r.random() < 0.95 else 1) for k, _ in docs if k % 3]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(d, y).collect()}
    bag = lambda t: Counter(re.findall(r"[a-z]+", (t or "").lower()))
    mark, whole = dict(labels), dict(docs)
    keys = sorted(k for k in mark if zlib.crc32(str(k).encode()) % 5)

    def entropy(a, b):
        return -sum(x / (a + b) * math.log2(x / (a + b)) for x in (a, b) if x)

    def model(names):
        once = {(mark[k], tuple(sorted(bag(whole[k]).items()))) for k in names}
        n, pos = len(once), sum(m for m, _ in once)
        df, n1 = Counter(t for _, c in once for t, _ in c), Counter(t for m, c in once for t, _ in c if m)
        h = entropy(pos, n - pos)
        weight = {}
        for t in df:
            rest = df[t] / n * entropy(n1[t], df[t] - n1[t]) + ((n - df[t]) / n * entropy(pos - n1[t], n - df[t] - pos + n1[t]) if n > df[t] else 0)
            weight[t] = (math.log((n + 1) / (df[t] + 1)) + 1) * (toxicity.FLOOR + max(0, (h - rest) / h))

        def vector(t):
            w = {k: (1 + math.log(c)) * weight[k] for k, c in bag(t).items() if k in weight}
            norm = math.sqrt(sum(x * x for x in w.values()))
            return {k: x / norm for k, x in w.items()}

        vectors = {k: vector(whole[k]) for k in names}
        base = sum(mark[k] for k in names) / len(names)

        def near(t):
            own = vector(t)
            s = sorted(((sum(x * v[k] for k, x in own.items() if k in v), k) for k, v in vectors.items()), reverse=True)
            s = [x for x in s if x[0] > 0]
            return [x for x in s if x[0] >= s[: toxicity.NEIGHBOURS][-1][0] - 1e-6], own

        def vote(found):
            w = [1 / (1.1 - min(1, x)) for x, _ in found]
            return (sum(a * mark[k] for a, (_, k) in zip(w, found)) + base / 1.1) / (sum(w) + 1 / 1.1)

        empty = [mark[k] for k in names if not vectors[k]]
        return near, vote, (sum(empty) + base) / (len(empty) + 1)

    x, y_ = [], []
    for p in range(toxicity.PARTS):
        near, vote, _ = model([k for i, k in enumerate(keys) if i % toxicity.PARTS != p])
        for k in keys[p :: toxicity.PARTS]:
            found, own = near(whole[k])
            if own:
                x.append(vote(found))
                y_.append(mark[k])
    a, b = fit_sigmoid(x, y_)
    near, vote, empty = model(keys)
    for k, t in docs[::5] + docs[-22:]:
        found, own = near(t)
        want = 1 / (1 + math.exp(-(a * vote(found) + b))) if own else empty
        assert got[k].score == pytest.approx(want, abs=1e-4), k
        assert {e.key for e in got[k].evidence} == {j for _, j in found} and bool(found) == bool(own)
        assert got[k].predicted == int(got[k].score >= 0.5) and got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)


def test_all_that_know_a_word_have_evidence(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = toxicity.score(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect()
    known = set(toxicity.words(" ".join(r.text or "" for r in docs.join(labels, "doc_id").where("crc32(string(doc_id)) % 5 <> 0").collect())))
    with_word = [r for r in rows if known.intersection(toxicity.words(r.text or ""))]
    assert len(with_word) > 100 and all(r.evidence for r in with_word)


def test_repeated_labelled_keys_stay_bounded(spark):
    """One key with 20,000 different texts is one row of the sample, the same one however rows are dealt."""
    import pyarrow as pa

    docs = spark.range(20_000).selectExpr("0L AS doc_id", "concat('text ', id) AS text").unionAll(spark.range(1, 9).selectExpr("id", "concat('other ', id)"))
    labels = spark.range(9).selectExpr("id AS doc_id", "int(id % 2) AS toxic")
    take = lambda n: labelled_features(docs.repartition(n), labels, "toxic", 8, lambda: lambda data: {"n": [len(data), *data]}, {"n": pa.list_(pa.int32())})
    one, many = take(1), take(13)
    assert len(one) <= 8 and one.to_pylist() == many.to_pylist()


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.85), ("op10_quality_classifier", "quality", 0.9)])
def test_held_out_labels(spark, name, label, least):
    folder = "/root/testdata/sf0.1"
    r = QUERIES[name](spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out")
    n = {(x[label], x.predicted): x["count"] for x in r.groupBy(label, "predicted").count().collect()}
    for k in (0, 1):
        assert n.get((k, k), 0) >= least * (n.get((k, 0), 0) + n.get((k, 1), 0))


def test_labels_of_held_out_documents_are_never_read(spark, sf):
    """Turning the labels of the held-out fold around changes no score."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumns({c: F.when(held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for f in (toxicity.score, quality_classifier.score):
        a, b = (sorted((x.doc_id, x.score, x.held_out) for x in f(docs, y).collect()) for y in (labels, turned))
        assert a == b
