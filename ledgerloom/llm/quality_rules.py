"""Quality rules with adaptive thresholds, with DataFrame functions only.

Each document gets measures of its text. For every language and source a
quantile sketch of each measure is made: counts of logarithmic buckets, whose
relative error is bounded by ``ACCURACY``. Sketches are sums of counts, so they
merge in any order with the same result, before and after the shuffle, and a hot
source costs no more than its buckets. A threshold is a quantile of the sketch
times a factor, and never a share that can't exist; groups of fewer than
``LEAST_ROWS`` documents use their language's sketch, and that of all documents if
it is small too. A document is kept if it passes the fixed base rules and none of
its measures exceeds its group's threshold by more than ``GUARDS``, a few
characters, lines or words: what one repeated line or formula amounts to, which in
a short document is a large share but no sign of anything.

Null and empty texts have no words and fail the base rules. Null languages and
sources are groups of their own. Repeated rows are judged alike. An empty table
gives an empty result; texts of any length are measured whole, in memory that is
a multiple of the longest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, small, stored

BASE_WORDS, BASE_REPEAT = 50, 50
ACCURACY = 0.02
LEAST_ROWS = 200
#: Thresholds are broadcast up to this many rows, else joined.
BROADCAST_ROWS = 50_000
#: measure: (quantile, factor). Measures are shares of a thousand, but for mean_chars, the mean length of a word in hundredths of a character.
RULES = {"symbols": (0.90, 4.0), "dup_lines": (0.90, 4.0), "repeat_words": (0.90, 4.0), "upper": (0.90, 4.0), "mean_chars": (0.90, 1.25)}
#: How many characters, lines or words beyond the threshold a document may have.
GUARDS = {"symbols": 5, "dup_lines": 2, "repeat_words": 24, "upper": 5, "mean_chars": 0}
_LOG_GAMMA = math.log((1 + ACCURACY) / (1 - ACCURACY))
_SPACE = r"[\x20\x09-\x0D]+"


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def measured(docs: DataFrame, carry: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """row (a struct of the columns ``carry``), lang, source, and the MEASURES as longs.

    Repeated words are those inside any three-word shingle that occurs twice: shingles are sorted by a 64-bit
    hash, neighbours with equal hashes are repeated, and the places that their starts cover are added up.
    """
    t = F.coalesce(F.col("t"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("t"))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumns({"w": F.filter(F.split(t, _SPACE), lambda x: x != ""), "lines": lines})
    w, h, s, b = (F.col(c) for c in "whsb")
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    rows = rows.withColumn("h", F.when(F.size(w) > 3, hashes))
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct(h)) < F.size(h), placed))
    # an element and the one before it, the same shifted by one: starts of shingles that have an equal neighbour
    same = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
    rows = rows.withColumn("same", same)
    starts = F.filter(s, lambda x, i: F.get("same", i) | F.coalesce(F.get("same", i - 1), F.lit(False)))
    rows = rows.withColumn("b", F.sort_array(F.transform(starts, lambda x: x["i"])))
    gaps = F.zip_with(b, F.slice(b, F.lit(2), F.size(b)), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x), F.lit(0))
    without = lambda p: F.when(t.rlike(p), F.length(t) - F.length(F.regexp_replace(t, p, ""))).otherwise(0)
    values = (F.size(w), F.length(F.regexp_replace(t, _SPACE, "")), without("[#*$%&|<>]"), F.size("lines") - F.size(F.array_distinct("lines")), covered, F.size("lines"), without("[A-Z]"))
    return rows.select("row", "lang", "source", *(v.cast("long").alias(n) for n, v in zip(MEASURES, values)))


def _share(part: str, whole: str, scale: int = 1000) -> Column:
    return F.expr(f"{part} * {scale} div greatest({whole}, 1)")


SHARES = {
    "symbols": ("n_symbols", "word_chars", 1000),
    "dup_lines": ("n_dup_lines", "n_lines", 1000),
    "repeat_words": ("n_repeat_words", "n_words", 1000),
    "upper": ("n_upper", "word_chars", 1000),
    "mean_chars": ("word_chars", "n_words", 100),
}


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: the mergeable sketch of each rule's share, for every language and source."""
    bucket = lambda v: F.when(v > 0, F.ceil(F.log(v.cast("double")) / F.lit(_LOG_GAMMA))).otherwise(F.lit(-1)).cast("int")
    each = F.array(*(F.struct(F.lit(r).alias("rule"), bucket(_share(*a)).alias("bucket")) for r, a in SHARES.items()))
    return rows.select("lang", "source", F.explode(each).alias("x")).groupBy("lang", "source", "x.rule", "x.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, rule, total, limit: the threshold of each group, after merging its sketches."""
    merged = sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rule")
    merged = merged.withColumns({"total": F.sum("n").over(group), "upto": F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))})
    q, factor = (F.create_map(*(x for r, v in RULES.items() for x in (F.lit(r), F.lit(float(v[k])))))[F.col("rule")] for k in range(2))
    at = F.min(F.when(F.col("upto") > F.floor(q * (F.col("total") - 1)), F.col("bucket"))).alias("bucket")
    value = F.when(F.col("bucket") < 0, 0.0).otherwise(2 * F.exp(F.col("bucket") * _LOG_GAMMA) / (math.exp(_LOG_GAMMA) + 1))
    limit = F.floor(factor * value).cast("long")
    limit = F.when(F.col("rule") == "mean_chars", limit).otherwise(F.least(limit, F.lit(999).cast("long")))
    return merged.groupBy(*by, "rule").agg(F.max("total").alias("total"), at).select(*by, "rule", "total", limit.alias("limit"))


def thresholds(rows: DataFrame) -> DataFrame:
    """lang_key, source_key and one limit for each rule, from the group's sketch or a wider one if the group is small."""
    sketch = cut(sketches(rows))
    own = quantiles(sketch, ["lang", "source"])
    wide = quantiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("rule").alias("r"), F.col("total").alias("lang_total"), F.col("limit").alias("lang_limit"))
    every = quantiles(sketch, []).select("rule", F.col("limit").alias("any_limit"))
    found = own.join(wide, (F.col("rule") == F.col("r")) & F.col("lang").eqNullSafe(F.col("l"))).join(every, "rule")
    limit = F.when(F.col("total") >= LEAST_ROWS, F.col("limit")).when(F.col("lang_total") >= LEAST_ROWS, F.col("lang_limit")).otherwise(F.col("any_limit"))
    return found.groupBy(F.col("lang").alias("lang_key"), F.col("source").alias("source_key")).agg(*(F.max(F.when(F.col("rule") == r, limit)).alias(f"limit_{r}") for r in RULES))


def judged(docs: DataFrame, carry: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """row, MEASURES, base_failed, kept, and the names of the adaptive rules that failed."""
    rows = stored(measured(docs, carry, text, lang, source))
    limits = cut(thresholds(rows))
    if small(limits, BROADCAST_ROWS):
        limits = F.broadcast(limits)
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("lang_key")) & F.col("source").eqNullSafe(F.col("source_key")))
    base = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))
    beyond = lambda r: F.expr("{0} * {2} > limit_{3} * {1} + {4}".format(*SHARES[r], r, GUARDS[r] * SHARES[r][2]))
    failed = F.filter(F.array(*(F.when(beyond(r), F.lit(r)) for r in RULES)), lambda x: x.isNotNull())
    out = joined.select("row", *MEASURES, base.alias("base_failed"), failed.alias("failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def rate(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judged(docs, [key]).select(F.col("row")[key].alias(key), *MEASURES[:5], "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    found = judged(docs, docs.columns).where("kept")
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def oracle_sql() -> str:
    """The same for DuckDB, on the table documents."""
    shares = ", ".join(f"{p} * {k} // greatest({w}, 1) AS {r}" for r, (p, w, k) in SHARES.items())
    params = ", ".join(f"('{r}', {q!r}, {f!r}, {'NULL' if r == 'mean_chars' else 999})" for r, (q, f) in RULES.items())
    beyond = " OR ".join(f"(l.rule = '{r}' AND {p} * {k} > lim * {w} + {GUARDS[r] * k})" for r, (p, w, k) in SHARES.items())
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def level(name: str, by: str) -> str:
        pre = f"{by}, " if by else ""
        return f"""{name} AS (SELECT {pre}rule, max(total) AS total, CAST(least(any_value(m), floor(any_value(f) * CASE WHEN min(b) < 0 THEN 0 ELSE 2 * exp(min(b) * {_LOG_GAMMA!r}) / {math.exp(_LOG_GAMMA) + 1!r} END)) AS BIGINT) AS lim
            FROM (SELECT {pre}rule, total, q, f, m, CASE WHEN upto > floor(q * (total - 1)) THEN bucket END AS b FROM (
                SELECT {pre}rule, bucket, sum(n) OVER (PARTITION BY {pre}rule) AS total, sum(n) OVER (PARTITION BY {pre}rule ORDER BY bucket) AS upto FROM (
                    SELECT {pre}rule, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) JOIN params USING (rule)) GROUP BY {pre}rule)"""

    return f"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
    s AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: trim(x, {space}) <> '') AS lines FROM d),
    g AS (SELECT i, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g FROM s, unnest(range(1, CAST(len(w) - 1 AS BIGINT))) AS r(k)),
    twice AS (SELECT i, unnest([k, k + 1, k + 2]) AS p FROM (SELECT i, k, count(*) OVER (PARTITION BY i, g) AS c FROM g) WHERE c > 1),
    covered AS (SELECT i, count(DISTINCT p) AS c FROM twice GROUP BY i),
    m AS (SELECT i, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines, CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
        FROM s LEFT JOIN covered USING (i)),
    shares AS (SELECT *, {shares} FROM m),
    params AS (SELECT * FROM (VALUES {params}) AS v(rule, q, f, m)),
    sketch AS (SELECT lang, source, rule, CASE WHEN v > 0 THEN CAST(ceil(ln(v) / {_LOG_GAMMA!r}) AS INT) ELSE -1 END AS bucket, count(*) AS n FROM (UNPIVOT shares ON {', '.join(RULES)} INTO NAME rule VALUE v) GROUP BY ALL),
    {level('own', 'lang, source')}, {level('wide', 'lang')}, {level('every', '')},
    limits AS (SELECT own.lang, own.source, own.rule, CASE WHEN own.total >= {LEAST_ROWS} THEN own.lim WHEN wide.total >= {LEAST_ROWS} THEN wide.lim ELSE every.lim END AS lim
        FROM own JOIN wide ON own.rule = wide.rule AND own.lang IS NOT DISTINCT FROM wide.lang JOIN every ON own.rule = every.rule),
    failed AS (SELECT DISTINCT m.i FROM m JOIN limits AS l ON m.lang IS NOT DISTINCT FROM l.lang AND m.source IS NOT DISTINCT FROM l.source WHERE {beyond}),
    b AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT} * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed.i IS NULL AS kept FROM b LEFT JOIN failed USING (i)"""
