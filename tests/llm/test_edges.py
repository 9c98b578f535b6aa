"""Every operator on awkward tables: nulls in any column, empty and very long texts, repeated rows, clashing extra columns, and no rows at all."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, language, merkle, quality_classifier, quality_rules, secrets, simhash, token_counts, toxicity
from ledgerloom.llm.queries import vocabulary

EMPTY = hashlib.sha256(b"").hexdigest()
LONG = "lorem ipsum dolor sit amet " * 8000
DOCS = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \t\n\u000b\f\r ", None, "a"),
    (4, LONG, "en", "a"),
    (5, "x" * 200_000, "de", "b"),
    (6, "one two three four five six seven eight nine ten", "en", "a"),
    (6, "one two three four five six seven eight nine ten", "en", "a"),
    (7, "one two three four five six seven eight nine ten", None, None),
    (None, "Über den Wolken 中文 😀 <|endoftext|> token=abcdefghijkl", "de", "b"),
    (None, None, None, None),
    (8, "…\u0000\u0001 secret: 'A1b2C3d4E5f6G7h8' \x1c", "fr", "c"),
]
CLASH = "score fp row w t h s b key label k n lang_key held_out predicted n_words kept limit n_tokens spans items fingerprint component_id _loom_mark count value part archive".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").repartition(3)
    return df.withColumns({"n_chars": F.length("text").cast("long")} | {c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 1), (6, 0, 1), (6, 1, 1), (7, None, None), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "two three four five"), (1, "nine ten"), (None, "lorem ipsum dolor"), (3, None), (4, ""), (5, "..."), (12, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda d, l, b: toxicity.score(d, l),
    "bpe": lambda d, l, b: bpe.encode(d, vocabulary("byte_bpe_50k.json"), with_ids=True),
    "simhash": lambda d, l, b: simhash.near_duplicates(d),
    "decontaminate": lambda d, l, b: decontaminate.contamination(d, b),
    "decontaminate_join": lambda d, l, b: decontaminate.contamination(d, b, limit=-1),
    "language": lambda d, l, b: language.identify(d),
    "token_counts": lambda d, l, b: token_counts.token_counts(d, vocabulary("word_bpe_49k.json")),
    "secrets": lambda d, l, b: secrets.scan(d),
    "quality_rules": lambda d, l, b: quality_rules.rate(d),
    "quality_classifier": lambda d, l, b: quality_classifier.score(d, l),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, labels, benchmark, name):
    rows = OPERATORS[name](docs, labels, benchmark).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows) == sorted((r[0] is None, r[0]) for r in DOCS)
    same = [str(r) for r in rows if r.doc_id == 6]
    assert same[0] == same[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(docs, labels, benchmark, name):
    out = OPERATORS[name](docs.limit(0), labels.limit(0), benchmark.limit(0))
    assert out.collect() == [] and out.columns[0] == "doc_id"


@pytest.mark.parametrize("name", ["toxicity", "quality_classifier"])
def test_without_labels(docs, labels, benchmark, name):
    assert {r.score for r in OPERATORS[name](docs, labels.limit(0), benchmark).collect()} == {0.5}


@pytest.mark.parametrize("name", ["toxicity", "quality_classifier", "language"])
def test_scores_lie_between_0_and_1(docs, labels, benchmark, name):
    assert all(0 <= r.score <= 1 for r in OPERATORS[name](docs, labels, benchmark).collect())


def test_defined_results(docs, labels, benchmark):
    by = lambda name: {r.doc_id: r for r in OPERATORS[name](docs, labels, benchmark).collect() if r.doc_id}
    e = by("bpe")
    assert all((e[k].n_tokens, e[k].ids_sha256, e[k].decoded_sha256) == (0, EMPTY, EMPTY) for k in (1, 2))
    assert e[4].decoded == LONG
    t = by("token_counts")
    assert (t[1].n_tokens, t[3].n_tokens, t[4].over_limit) == (0, 0, True)
    s = by("simhash")
    assert {s[k].fingerprint for k in (1, 2, 3)} == {"0" * 16} and {s[k].component_id for k in (1, 2, 3)} == {1}
    assert s[7].component_id == 6
    d = by("decontaminate")
    assert (d[6].n_hit, d[6].n_items, d[6].items_sha256) == (6, 1, hashlib.sha256(b"1").hexdigest())
    assert (d[1].n_words, d[1].items_sha256, d[1].contaminated) == (0, EMPTY, False)
    assert d[4].items == [""] and d[4].n_hit == 3 * 8000
    language_ = by("language")
    assert all((language_[k].lang_pred, language_[k].score) == ("und", 0.0) for k in (1, 2, 3))
    q = by("quality_rules")
    assert (q[1].n_words, q[1].base_failed, q[1].kept) == (0, True, False) and q[4].n_repeat_words == 40000
    x = by("secrets")
    assert (x[1].spans, x[1].base_sha256) == ("", EMPTY) and x[8].n_assign == 1


def test_stages_keep_all_columns(docs, benchmark):
    for out in (quality_rules.keep_good(docs), simhash.deduplicate(docs), decontaminate.clean(docs, benchmark), decontaminate.clean(docs, benchmark, limit=-1), secrets.redact(docs)):
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.collect()


def test_stages_on_no_rows(docs, benchmark):
    none = docs.limit(0)
    for out in (quality_rules.keep_good(none), simhash.deduplicate(none), decontaminate.clean(none, benchmark), secrets.redact(none)):
        assert out.collect() == []


def test_deduplication_keeps_one_row_of_each_component(docs):
    kept = simhash.deduplicate(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 5, 6, 8]
    assert [r.text[:4] for r in kept if r.doc_id is None] == ["Über"]


def test_clean_drops_contaminated_rows_only(docs, benchmark):
    for limit in (decontaminate.BROADCAST_WINDOWS, -1):
        kept = decontaminate.clean(docs, benchmark, limit=limit).collect()
        assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 3, 5, 8] and sum(r.doc_id is None for r in kept) == 2


def test_pages_with_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(1, "u", "<a>"), (1, "u", "<a>"), (2, None, None), (None, "v", "x" * 100_000), (None, None, None), (3, "w", "")], "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("offset", F.lit(2))
    same = merkle.audit_replica(pages, pages).collect()
    assert all(r.intact and r.n_compared == 1 and r.n_changed == r.n_missing == r.n_extra == 0 for r in same) and sum(r.n_records for r in same) == 6
    assert merkle.digest(merkle.audit_replica(pages.limit(0), pages.limit(0))).collect() == []
    kinds = lambda rows: [(f.kind, f.key, f.lost, f.found) for r in rows for f in r.findings or ()]
    assert kinds(merkle.audit_replica(pages, pages.where("page_id <> 3 OR page_id IS NULL")).collect()) == [("missing", 3, 1, 0)]
    assert kinds(merkle.audit_replica(pages, pages.where("page_id <> 1 OR page_id IS NULL")).collect()) == [("missing", 1, 2, 0)]
    assert sorted(kinds(merkle.audit_replica(pages, pages.limit(0)).collect()), key=str) == sorted([("missing", 1, 2, 0), ("missing", 2, 1, 0), ("missing", 3, 1, 0), ("missing", None, 1, 0), ("missing", None, 1, 0)], key=str)
    assert sum(f[3] for f in kinds(merkle.audit_replica(pages.limit(0), pages).collect())) == 6
    merkle.digest(merkle.audit_replica(pages, merkle.damaged(pages, one_in=4))).collect()
