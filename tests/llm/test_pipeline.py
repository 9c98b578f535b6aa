"""The pipeline's stages against the operators' own verdicts and brute force."""

from __future__ import annotations

import hashlib

import tokenizers

import corpus_pipeline
from ledgerloom.llm import quality_rules
from ledgerloom.llm.common import table
from ledgerloom.llm.queries import vocabulary
from tests.llm.test_exact import near_groups, slow_secrets, slow_signature


def test_run_equals_stages_done_by_hand(spark, sf):
    docs = table(spark, sf, "documents")
    left = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality_rules.rate(docs).where("kept").collect()}
    left = {k: t for k, t in left.items() if k in good}
    # one document of each group of near-duplicates
    fps = {k: slow_signature(t or "") for k, t in left.items()}
    left = {k: left[k] for k in set(near_groups(fps).values())}
    # no benchmark window
    from ledgerloom.llm.decontaminate import item_windows, words

    windows = {w for r in table(spark, sf, "benchmark").collect() for w in item_windows(r.text.encode())}
    sizes = {len(w) for w in windows}

    def clean(text):
        w = words(text.encode())
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    left = {k: t for k, t in left.items() if clean(t)}
    # secrets masked, then encoded
    library = tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = {}
    for k, text in left.items():
        out, at = "", 0
        for a, _, b, _ in slow_secrets(text):
            if a >= at:
                out += text[at:a] + "[REDACTED]"
            at = max(at, b)
        ids = library.encode(out + text[at:], add_special_tokens=False).ids
        want[k] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < len(fps)


def test_stages_return_the_columns_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "secret scans", "BPE encoding and decoding"]
