"""Quality verdicts follow a group's own distribution."""

from __future__ import annotations

from ledgerloom.llm import quality_rules


def text(i: int, symbols: int = 0, upper: int = 0, length: int = 6, lines: int = 0, phrases: int = 0) -> str:
    """About 200 different words, of which some carry symbols or capitals; then the same line, and the same phrase, several times."""
    words = [f"{i * 1000 + k:0{length}d}" for k in range(200)]
    words = [("#" + w[1:]) if k < symbols else w for k, w in enumerate(words)]
    words = [("A" + w[1:]) if len(words) - k <= upper else w for k, w in enumerate(words)]
    text = "\n".join(" ".join(words[k : k + 10]) for k in range(0, 200, 10)) + "\nx" * lines
    return text + "".join(f"\none two three four five six {i}-{k}" for k in range(phrases))


USUAL = {"plain": {}, "symbols": {"symbols": 24}, "upper": {"upper": 40}, "long": {"length": 12}, "lines": {"lines": 4}, "phrases": {"phrases": 5}}
ODD = {"symbols": {"symbols": 60}, "upper": {"upper": 100}, "long": {"length": 12}, "lines": {"lines": 8}, "phrases": {"phrases": 9}}


def verdicts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    return {r.doc_id: r.kept for r in quality_rules.rate(docs).collect()}


def test_the_same_text_is_judged_by_its_group(spark):
    n = quality_rules.LEAST_ROWS + 20
    rows = [(f"{g}-{i}", text(i, **how), "en", g) for g, how in USUAL.items() for i in range(n)]
    rows += [(f"{g}-odd-{o}", text(500, **how), "en", g) for g in USUAL for o, how in ODD.items()]
    kept = verdicts(spark, rows)
    assert all(kept[f"{g}-{i}"] for g in USUAL for i in range(n))
    for o in ODD:
        assert not kept[f"plain-odd-{o}"] and kept[f"{o}-odd-{o}"], o


def test_small_groups_use_their_language(spark):
    n = quality_rules.LEAST_ROWS
    rows = [(f"{i}", text(i, symbols=24), "de", f"s{i % 9}") for i in range(n)] + [(f"p{i}", text(i), "en", "s1") for i in range(n)]
    kept = verdicts(spark, [*rows, ("de-odd", text(500, symbols=60), "de", "s1"), ("en-odd", text(500, symbols=60), "en", "s1"), ("fr-odd", text(500, symbols=900), "fr", "s1")])
    assert kept["de-odd"] and not kept["en-odd"] and all(kept[r[0]] for r in rows)


def test_limits_are_shares_that_can_exist(spark):
    """In a source of nothing but repeats the limit stays below a thousand; one repeated line is no reason to reject."""
    rows = [(f"{i}", "x\n" * 30 + text(i), "en", "lines") for i in range(quality_rules.LEAST_ROWS)] + [(f"p{i}", text(i), "en", "plain") for i in range(quality_rules.LEAST_ROWS)]
    rows += [("one line", "some line of words that is repeated\n" + text(700) + "\nsome line of words that is repeated", "en", "plain")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    limits = quality_rules.thresholds(quality_rules.measured(docs, ["doc_id"])).collect()
    assert all(r[f"limit_{rule}"] < 1000 for r in limits for rule in quality_rules.RULES if rule != "mean_chars")
    assert verdicts(spark, rows)["one line"]
