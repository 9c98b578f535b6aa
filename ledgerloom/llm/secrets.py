"""Secret scans with DataFrame functions only.

Base kinds are patterns: assignments of credentials, access keys, and hex runs.
On top of these, candidate strings of a character class are scanned with a
sliding window: the number of each character in the window is kept up to date as
one character enters and one leaves, and with it the sum of n * log2(n), from
which the Shannon entropy follows. A candidate with a window of at least the
class's entropy gives one span, from its first such window to its last. Strings
on the allow-list (identifiers and placeholders) are suppressed.

Positions are code points, ends exclusive. Null text counts as empty text.
Repeated rows give repeated results; an empty table gives an empty one. Texts of
any length are scanned whole; spans that start at the same place come in the
order of their kinds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the base kinds, in the order in which they are listed.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]"
BASE = (("assign", f"{ASSIGN}{VALUE}+"), ("access", "AKIA[A-Z0-9]{14,}"), ("hex", "[0-9a-f]{16,}"))
#: Characters that an assigned value has at least.
ASSIGN_LEAST = 12

WINDOW = 20
#: n * log2(n) for n = 0 to WINDOW, in millionths, so that sums are exact.
SCALED = tuple(round(n * math.log2(n) * 1e6) if n else 0 for n in range(WINDOW + 1))


@dataclass(frozen=True)
class CharacterClass:
    """name; pattern of candidates (WINDOW characters at least); what a candidate must also hold; bits per character in a window."""

    name: str
    candidate: str
    holds: tuple[str, ...]
    bits: float

    @property
    def most(self) -> int:
        """The largest sum of n * log2(n), in millionths, that a window of this entropy has."""
        return math.floor(WINDOW * (math.log2(WINDOW) - self.bits) * 1e6)


CLASSES = (
    CharacterClass("entropy_hex", "[0-9A-F]{%d,}" % WINDOW, ("[0-9]", "[A-F]"), 3.0),
    CharacterClass("entropy_base64", "[A-Za-z0-9+/_=-]{%d,}" % WINDOW, ("[0-9]", "[A-Z]", "[a-z]"), 3.7),
    # pieces between separators, so that a word of the allow-list beside a key doesn't suppress it
    CharacterClass("entropy_lower", "[0-9a-z]{%d,}" % WINDOW, ("[0-9]", "[g-z]"), 3.5),
    CharacterClass("entropy_upper", "[0-9A-Z]{%d,}" % WINDOW, ("[0-9]", "[G-Z]"), 3.5),
    CharacterClass("entropy_mixed", "[0-9A-Za-z]{%d,}" % WINDOW, ("[0-9]", "[A-Z]", "[a-z]"), 3.7),
    # capitals in pairs and inside: long words and names in camel case have no such mixture
    CharacterClass("entropy_letters", "[A-Za-z]{%d,}" % WINDOW, ("[a-z][A-Z]", "[A-Z][A-Z]"), 3.9),
)
#: Candidates that match one of these are suppressed.
ALLOWED = (
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    "(?:EXAMPLE|[Ee]xample|PLACEHOLDER|[Pp]laceholder|CHANGEME|[Cc]hange_?me|REDACTED|[Dd]ummy)",
    "(?:abcdefghij|ABCDEFGHIJ|0123456789)",
)

#: Marks matches; in the text itself it is replaced, which changes no match and no position.
_MARK, _OTHER = "\u0001", "\u0002"


def _prefix_sums(lengths: Column) -> Column:
    """0, a, a + b, ... for an array of longs; in two levels, so that long arrays aren't copied for each element."""
    zero, step = F.array(F.lit(0).cast("long")), 256
    sums = lambda a: F.aggregate(a, zero, lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    starts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / step).cast("int"))
    inner = F.transform(starts, lambda i: sums(F.slice(lengths, i * step + 1, F.lit(step))))
    outer = sums(F.transform(inner, lambda s: F.element_at(s, -1)))
    # all but the last of each block, moved by what precedes the block
    return F.flatten(F.zip_with(inner, F.slice(outer, F.lit(1), F.size(inner)), lambda s, base: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda x: x + base)))


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, value>> of all matches, leftmost and not overlapping; null if there is none."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)
    starts = _prefix_sums(F.transform(parts, lambda p: F.length(p).cast("long")))
    all_ = F.zip_with(starts, parts, lambda a, p: F.struct(a.alias("start"), p.alias("value")))
    return F.when(text.rlike(pattern), F.filter(all_, lambda _, i: i % 2 == 1))


def _span(kind: str, order: int, start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(order).alias("nth"), end.alias("end"), F.lit(kind).alias("kind"))


def _base_spans(text: Column) -> dict[str, Column]:
    found = {}
    for order, (kind, pattern) in enumerate(BASE):
        hits = _matches(text, pattern)
        if kind == "assign":
            hits = F.filter(hits, lambda m: F.length(F.regexp_extract(m["value"], f"^{ASSIGN}({VALUE}+)", 1)) >= ASSIGN_LEAST)
        found[kind] = _placed(hits, kind, order)
    return found


def _placed(hits: Column, kind: str, order: int) -> Column:
    return F.transform(hits, lambda m: _span(kind, order, m["start"], m["start"] + F.length(m["value"])))


def _windows(value: Column, most: int) -> Column:
    """struct<first, last>: where the first window of enough entropy starts and the last one ends; nulls if there is none.

    Counts are characters of a string, one for each ASCII code, updated in place by each event: a character leaves, a character enters.
    """
    table, size = F.array(*map(F.lit, SCALED)), WINDOW
    chars = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    enter = lambda c: F.struct(c.alias("c"), F.lit(1).alias("d"), F.lit(-1).alias("at"))
    leave = lambda i: F.struct(F.element_at(chars, i - size + 1).alias("c"), F.lit(-1).alias("d"), i.alias("at"))
    events = F.flatten(F.transform(chars, lambda c, i: F.when(i < size, F.array(enter(c))).otherwise(F.array(leave(i), enter(c)))))

    def step(acc: Column, e: Column) -> Column:
        n = F.ascii(F.substring(acc["counts"], e["c"] + 1, F.lit(1))) - 48
        good = (e["d"] < 0) & (acc["sum"] <= most)  # the window that ends before place e.at
        return F.struct(
            F.overlay(acc["counts"], F.char(n + e["d"] + 48), e["c"] + 1, F.lit(1)).alias("counts"),
            (acc["sum"] + F.element_at(table, n + e["d"] + 1) - F.element_at(table, n + 1)).cast("long").alias("sum"),
            F.when(good, F.coalesce(acc["first"], e["at"] - size)).otherwise(acc["first"]).alias("first"),
            F.when(good, e["at"]).otherwise(acc["last"]).alias("last"),
        )

    none = F.lit(None).cast("int")
    start = F.struct(F.lit("0" * 128).alias("counts"), F.lit(0).cast("long").alias("sum"), none.alias("first"), none.alias("last"))

    def finish(acc: Column) -> Column:
        good = acc["sum"] <= most
        n = F.length(value)
        return F.struct(F.when(good, F.coalesce(acc["first"], n - size)).otherwise(acc["first"]).alias("first"), F.when(good, n).otherwise(acc["last"]).alias("last"))

    return F.aggregate(events, start, step, finish)


def _class_spans(text: Column, c: CharacterClass, order: int) -> Column:
    def wanted(m: Column) -> Column:
        ok = F.lit(True)
        for p in c.holds:
            ok = ok & m["value"].rlike(p)
        for p in ALLOWED:
            ok = ok & ~m["value"].rlike(p)
        return ok

    hits = F.filter(_matches(text, c.candidate), wanted)
    scanned = F.transform(hits, lambda m: F.struct(m["start"].alias("start"), _windows(m["value"], c.most).alias("w")))
    scanned = F.filter(scanned, lambda s: s["w"]["first"].isNotNull())
    return F.transform(scanned, lambda s: _span(c.name, order, s["start"] + s["w"]["first"], s["start"] + s["w"]["last"]))


def _entropy_spans(text: Column) -> list[Column]:
    return [_class_spans(text, c, order) for order, c in enumerate(CLASSES, len(BASE))]


_NO_SPANS = "array<struct<start:bigint,nth:int,end:bigint,kind:string>>"


def with_spans(docs: DataFrame, text: str = "text", to: str = "spans", per_kind: tuple[str, str, str] | None = None) -> DataFrame:
    """``docs`` with a sorted array<struct<start, nth, end, kind>> of all spans, and the base kinds' arrays if ``per_kind`` names them.

    Rows without any candidate are told by one search for each pattern and build nothing.
    """
    t = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(_MARK), F.lit(_OTHER))
    none = F.array().cast(_NO_SPANS)
    base = {k: F.coalesce(v, none) for k, v in _base_spans(t).items()}
    names = per_kind or ("_loom_assign", "_loom_access", "_loom_hex")
    out = docs.withColumns(dict(zip(names, base.values())) | {"_loom_entropy": F.concat(*(F.coalesce(e, none) for e in _entropy_spans(t)))})
    out = out.withColumn(to, F.sort_array(F.concat(*map(F.col, names), F.col("_loom_entropy"))))
    return out.drop("_loom_entropy", *(() if per_kind else names))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans."""
    names = ("_loom_assign", "_loom_access", "_loom_hex")
    found = with_spans(docs.select(key, text), text, "_loom_all", names)
    count = [F.size(n).cast("long").alias(f"n_{k}") for n, (k, _) in zip(names, BASE)]
    base = joined(F.filter("_loom_all", lambda s: s["nth"] < len(BASE)))
    return found.select(key, *count, F.sha2(base, 256).alias("base_sha256"), joined(F.col("_loom_all")).alias("spans"))


def redacted(text: Column, spans: Column, marker: str = "[REDACTED]") -> Column:
    """``text`` with each run of overlapping spans (sorted) replaced by ``marker``."""

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(marker))
        return F.struct(F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced, and ``length`` set to the new length where text changed."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text"))
    spans = F.col("spans")
    found = with_spans(rows, "text", "spans").withColumn("text", redacted(F.col("text"), spans))
    new = {text: F.col("text")}
    if length in docs.columns:
        count = F.length("text").cast(docs.schema[length].dataType)
        new[length] = F.when(F.size(spans) > 0, count).otherwise(F.col("row")[length])
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


# The same in SQL, for DuckDB.


def oracle_sql() -> str:
    table = "[" + ", ".join(map(str, SCALED)) + "]"

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def spans(kind: str, order: int, pattern: str) -> str:
        """Matches with places: each match is found again from where the one before it ended."""
        return f"""SELECT i AS doc, '{kind}' AS kind, {order} AS nth, before + sum(length(gap)) OVER w + sum(coalesce(length(value), 0)) OVER w - coalesce(length(value), 0) AS start, value FROM (
            SELECT i, 0 AS before, k, parts[2 * k + 1] AS gap, parts[2 * k + 2] AS value FROM (
                SELECT i, string_split(regexp_replace(t, {quoted('(' + pattern + ')')}, chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS parts FROM d WHERE regexp_matches(t, {quoted(pattern)})
            ), unnest(range(CAST((len(parts) + 1) // 2 AS BIGINT))) AS r(k)
        ) WINDOW w AS (PARTITION BY i ORDER BY k ROWS UNBOUNDED PRECEDING)"""

    base = {k: spans(k, n, p) for n, (k, p) in enumerate(BASE)}
    kinds = " UNION ALL ".join(f"SELECT doc, kind, nth, start, start + length(value) AS fin FROM ({q}) WHERE value IS NOT NULL" + (f" AND length(regexp_extract(value, {quoted(f'^{ASSIGN}({VALUE}+)')}, 1)) >= {ASSIGN_LEAST}" if k == "assign" else "") for k, q in base.items())
    entropy = []
    for n, c in enumerate(CLASSES, len(BASE)):
        tests = "".join(f" AND regexp_matches(value, {quoted(p)})" for p in c.holds) + "".join(f" AND NOT regexp_matches(value, {quoted(p)})" for p in ALLOWED)
        entropy.append(f"""SELECT doc, kind, nth, start + min(o) AS start, start + max(o) + {WINDOW} AS fin FROM (
            SELECT doc, kind, nth, start, o, list_sum(list_transform(list_distinct(cs), lambda x: {table}[len(list_filter(cs, lambda y: y = x)) + 1])) AS s FROM (
                SELECT doc, kind, nth, start, o, string_split(substr(value, CAST(o + 1 AS BIGINT), {WINDOW}), '') AS cs
                FROM ({spans(c.name, n, c.candidate)}) AS m, unnest(range(CAST(length(value) - {WINDOW - 1} AS BIGINT))) AS r(o) WHERE value IS NOT NULL{tests}
            )) WHERE s <= {c.most} GROUP BY doc, kind, nth, start""")
    return f"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
    base AS ({kinds}),
    every AS (SELECT * FROM base UNION ALL {' UNION ALL '.join(entropy)}),
    one AS (SELECT doc, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(fin AS BIGINT), ',' ORDER BY start, nth) FILTER (nth < {len(BASE)}) AS base,
        string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(fin AS BIGINT), ',' ORDER BY start, nth, fin) AS spans FROM every GROUP BY doc)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN one ON i = doc"""
