"""Keys of one case, of letters only, and beside words of the allow-list."""

from __future__ import annotations

import random
import string

from ledgerloom.llm import secrets

LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits


def key(chars: str, n: int, seed: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(chars) for _ in range(n))


def test_keys_are_found_and_masked(spark):
    keys = [key(LOWER + DIGITS, 36, 1), key(UPPER + "234567", 32, 2), key(LOWER + UPPER, 40, 3), key(LOWER + UPPER + DIGITS, 24, 4), key(LOWER + UPPER + DIGITS, 32, 5)]
    whole = [f"note {keys[0]} end", f"note {keys[1]} end", f"note {keys[2]} end", f"xoxb-123456789012-{keys[3]} end", f"see /srv/example/keys/{keys[4]} end"]
    docs = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(whole)], "doc_id long, text string, n_chars long")
    for x in secrets.redact(docs).collect():
        assert keys[x.doc_id] not in x.text and "[REDACTED]" in x.text and x.text.endswith(" end"), x.text
        assert keys[x.doc_id][:8] not in x.text or keys[x.doc_id][-8:] not in x.text


def test_names_and_placeholders_stay(spark):
    whole = ["Donaudampfschifffahrtsgesellschaft", "getUserAuthenticationTokenProvider", "123e4567-e89b-12d3-a456-426614174000", "EXAMPLEEXAMPLE1234EXAMPLE", "abcdefghij0123456789klmnop", "INTERNATIONALISATIONS"]
    docs = spark.createDataFrame(list(enumerate(whole)), "doc_id long, text string")
    assert [x.spans for x in secrets.scan(docs).collect()] == [""] * len(whole)
