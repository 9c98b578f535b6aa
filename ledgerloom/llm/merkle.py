"""Fixity audit of WARC archives with Merkle trees.

Pages become WARC records, dealt to archives of about ``ARCHIVE_RECORDS``
records. Within an archive a record's slot, 0 to FANOUT ** LEVELS - 1, comes from
its key, and records lie in the order of slot, key and hash, at byte offsets. A
leaf is a record's SHA-256 with the number of its copies. A slot's node covers
the range of bytes of its leaves, the node above the ranges of ``FANOUT`` nodes,
and so on to the root; each node hashes where in its range its children begin,
how long they are, and their hashes. Offsets count from the start of the node,
and slots don't depend on other records, so a record that is missing, new or of
another length changes the nodes above it and no others.

Two replicas are audited by comparing roots; only where they differ are the nodes
below compared, level by level, down to the records. A record that only one side
has is missing or extra; one of each under the same key is a changed record. A
record under a new key is missing under the old and extra under the new.

No group grows with the input: equal records are one leaf with a count, and a key
of more than ``ARCHIVE_RECORDS`` different records is spread over as many
archives and slots as they need, by hash (there a changed record is missing in
one place and extra in another). Null urls and bodies count as empty, null keys
as a key of their own. An empty table has no archives; bodies of any
length are hashed where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, small

ARCHIVE_RECORDS, FANOUT = 256, 16
LEVELS = 2  # levels between the leaves and the root
#: Keys of many records are broadcast up to this number, else joined with salts.
BROADCAST_KEYS, SALTS = 100_000, 64


def warc_record(key: Column, url: Column, body: Column) -> Column:
    """One resource record, without a date, as text."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        _text(key),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def _text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def _digits(hexadecimal: Column, start: int, count: int) -> Column:
    return F.conv(F.substring(hexadecimal, start, count), 16, 10).cast("long")


def number(key: Column) -> Column:
    """A key as an evenly spread number below 2**32; a null key counts as the empty text."""
    return _digits(F.md5(_text(key)), 1, 8)


def records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """key, hash, length, copies of each different record. Bodies are hashed where they are read and don't move."""
    record = warc_record(F.col(key), F.col(url), F.col(body))
    rows = pages.select(F.col(key).alias("key"), F.sha2(record, 256).alias("hash"), F.octet_length(record).cast("long").alias("length"))
    return rows.groupBy("key", "hash", "length").agg(F.count("*").alias("copies"))


def crowded(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """crowd, spread: keys that have more different records than an archive should, and over how many archives they go."""
    each = [side.groupBy("key").agg(F.count("*").alias("n")) for side in (primary, replica)]
    most = each[0].unionAll(each[1]).groupBy(F.col("key").alias("crowd")).agg(F.max("n").alias("n"))
    return most.where(F.col("n") > ARCHIVE_RECORDS).select("crowd", F.ceil(F.col("n") / ARCHIVE_RECORDS).cast("long").alias("spread"))


def leaves(found: DataFrame, archives: int, crowds: DataFrame | None = None) -> DataFrame:
    """archive, place (the slot), key, hash, copies, length, offset, size of the leaves made of ``records``."""
    content = _digits(F.col("hash"), 1, 8)
    if crowds is None:
        rows = found.withColumn("spread", F.lit(1).cast("long"))
    elif small(crowds, BROADCAST_KEYS):
        rows = found.join(F.broadcast(crowds), F.col("key").eqNullSafe(F.col("crowd")), "left")
    else:  # many such keys: each meets its rows in SALTS tasks
        salted = crowds.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = found.withColumn("salt", content % SALTS).join(salted, F.col("key").eqNullSafe(F.col("crowd")) & (F.col("salt") == F.col("part")), "left")
    spread = F.coalesce(F.col("spread"), F.lit(1).cast("long"))
    slots = FANOUT**LEVELS
    slot = F.when(spread > 1, _digits(F.col("hash"), 9, 4)).otherwise(_digits(F.md5(_text(F.col("key"))), 9, 4)) % slots
    rows = rows.select(((number(F.col("key")) + content % spread) % archives).alias("archive"), slot.alias("place"), "key", "hash", "copies", "length", (F.col("length") * F.col("copies")).alias("size"))
    upto = F.sum("size").over(Window.partitionBy("archive").orderBy("place", F.col("key").asc_nulls_first(), "hash").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("offset", upto - F.col("size"))


def parents(nodes: DataFrame, place: Column) -> DataFrame:
    """archive, place, offset, size, hash of the nodes above: the hash of where the children begin, their sizes and hashes, in order."""
    children = F.sort_array(F.collect_list(F.struct("offset", "size", "hash")))
    up = nodes.groupBy("archive", place.alias("place")).agg(F.min("offset").alias("offset"), F.sum("size").alias("size"), children.alias("c"))
    text = F.array_join(F.transform("c", lambda c: F.concat_ws(":", (c["offset"] - F.col("offset")).cast("string"), c["size"].cast("string"), c["hash"])), ",")
    return up.select("archive", "place", "offset", "size", F.sha2(text, 256).alias("hash"))


def tree(level: DataFrame) -> list[DataFrame]:
    """The nodes of the slots first, then each level above, and last the roots."""
    own = level.select("archive", "place", "offset", "size", F.concat_ws("*", "hash", F.col("copies").cast("string")).alias("hash"))
    levels = [parents(own, F.col("place"))]
    for _ in range(LEVELS):
        levels.append(parents(levels[-1], F.floor(F.col("place") / FANOUT)))
    return levels


def _both(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """archive, place, h, g: the hashes of the nodes of both sides."""
    none = F.lit(None).cast("string")
    rows = ours.select("archive", "place", F.col("hash").alias("h"), none.alias("g")).unionAll(theirs.select("archive", "place", none, "hash"))
    return rows.groupBy("archive", "place").agg(F.max("h").alias("h"), F.max("g").alias("g"))


def _differ() -> Column:
    return ~F.col("h").eqNullSafe(F.col("g"))


def _differences(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """archive, place, key, hash, length, lost, found, offset: leaves with copies that only one side has, and all others with 0 and 0."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    columns = ("archive", "place", "key", "hash", "length")
    rows = ours.select(*columns, F.col("copies").alias("a"), zero.alias("b"), F.col("offset").alias("x"), none.alias("y")).unionAll(theirs.select(*columns, zero, "copies", none, "offset"))
    n = rows.groupBy(*columns).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("x").alias("x"), F.max("y").alias("y"))
    return n.select(*columns, F.greatest(F.col("a") - F.col("b"), zero).alias("lost"), F.greatest(F.col("b") - F.col("a"), zero).alias("found"), F.coalesce("x", "y").alias("offset"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """One row for each archive of two tables of leaves.

    archive, n_records, n_bytes, root, replica_root, intact, n_compared (nodes and
    leaves compared on the way down), n_changed, n_missing, n_extra (records), and
    findings: an array, in order, of struct<offset, length, key, kind, lost, found>.
    kind is changed, missing or extra; lost copies of the primary's record aren't
    in the replica, found ones are only there. Offsets are the primary's, those of
    extra records the replica's.
    """
    primary, replica = cut(primary), cut(replica)
    ours, theirs = tree(primary), tree(replica)
    roots = cut(_both(ours[-1], theirs[-1]))
    bad = roots.where(_differ()).select("archive", "place")
    compared = []
    for depth in range(LEVELS - 1, -2, -1):  # the nodes below each level that differs; -1: leaves
        above = F.floor(F.col("place") / FANOUT) if depth >= 0 else F.col("place")
        x, y = (side.withColumn("above", above).join(bad.withColumnRenamed("place", "above"), ["archive", "above"], "left_semi") for side in ((ours[depth], theirs[depth]) if depth >= 0 else (primary, replica)))
        level = cut(_both(x, y) if depth >= 0 else _differences(x, y))
        compared.append(level.groupBy("archive").agg(F.count("*").alias("n")))
        bad = level.where(_differ()).select("archive", "place") if depth >= 0 else level.where("lost > 0 OR found > 0")
    total = compared[0]
    for c in compared[1:]:
        total = total.unionAll(c)
    total = total.groupBy("archive").agg(F.sum("n").alias("n_compared"))
    # a record that only the primary has and one that only the replica has are a pair if their key is the same
    nth = F.row_number().over(Window.partitionBy("archive", "place", "key", F.col("lost") > 0).orderBy("hash"))
    pairs = bad.withColumn("nth", nth).groupBy("archive", "place", "key", "nth")
    first = lambda c: F.coalesce(F.max(F.when(F.col("lost") > 0, F.col(c))), F.max(c)).alias(c)
    pairs = pairs.agg(first("offset"), first("length"), F.sum("lost").alias("lost"), F.sum("found").alias("found"))
    kind = F.when((F.col("lost") > 0) & (F.col("found") > 0), "changed").when(F.col("lost") > 0, "missing").otherwise("extra")
    pairs = pairs.withColumn("kind", kind)
    zero = F.lit(0).cast("long")
    found = pairs.groupBy("archive").agg(
        F.sum(F.least("lost", "found")).alias("n_changed"),
        F.sum(F.greatest(F.col("lost") - F.col("found"), zero)).alias("n_missing"),
        F.sum(F.greatest(F.col("found") - F.col("lost"), zero)).alias("n_extra"),
        F.sort_array(F.collect_list(F.struct("offset", "length", "key", "kind", "lost", "found"))).alias("findings"),
    )
    sizes = primary.groupBy("archive").agg(F.sum("copies").alias("n_records"), F.sum("size").alias("n_bytes"))
    whole = roots.join(sizes, "archive", "left").join(total, "archive", "left").join(found, "archive", "left")
    n = lambda c: F.coalesce(c, zero).alias(c)
    return whole.select("archive", n("n_records"), n("n_bytes"), F.col("h").alias("root"), F.col("g").alias("replica_root"), (~_differ()).alias("intact"), (F.coalesce("n_compared", zero) + 1).alias("n_compared"), n("n_changed"), n("n_missing"), n("n_extra"), "findings")


def archives_for(pages: DataFrame) -> int:
    return max(1, -(-pages.count() // ARCHIVE_RECORDS))


def audit_replica(pages: DataFrame, replica: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``audit`` of two tables of pages. Both are laid out alike: the number of archives and the spread of keys come from both."""
    n = archives_for(pages)
    ours, theirs = cut(records(pages, key, url, body)), cut(records(replica, key, url, body))
    crowds = cut(crowded(ours, theirs))
    crowds = None if crowds.isEmpty() else crowds
    return audit(leaves(ours, n, crowds), leaves(theirs, n, crowds))


def damaged(pages: DataFrame, key: str = "page_id", body: str = "html", one_in: int = 97) -> DataFrame:
    """A replica for trials, of pages with whole numbers as keys.

    By ``number`` of the key modulo ``one_in``: 0, the first character of the body
    is another; 1, the page is missing; 2, it has another key; 3, it is there twice.
    """
    hit = number(F.col(key)) % one_in
    times = F.when(hit == 1, F.array().cast("array<int>")).when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    other = F.concat(F.lit("~"), F.substring(F.coalesce(F.col(body), F.lit("")), 2, 2**31 - 1))
    new = {key: F.when(hit == 2, -1 - F.col(key)).otherwise(F.col(key)), body: F.when(hit == 0, other).otherwise(F.col(body))}
    return pages.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in pages.columns), F.explode(times).alias("_loom_copy")).drop("_loom_copy")


def digest(found: DataFrame) -> DataFrame:
    """The audit with its nested column as text: kind:offset:length:key:lost:found, comma-joined."""
    each = lambda c: F.concat_ws(":", c["kind"], c["offset"].cast("string"), c["length"].cast("string"), F.coalesce(c["key"].cast("string"), F.lit("")), c["lost"].cast("string"), c["found"].cast("string"))
    text = F.array_join(F.transform(F.coalesce("findings", F.array().cast(found.schema["findings"].dataType)), each), ",")
    return found.withColumn("findings", text)


def oracle_sql(one_in: int = 97) -> str:
    """The audit of ``damaged`` pages for DuckDB, on the table pages."""
    md5, digits = "md5(coalesce(CAST({} AS VARCHAR), ''))", "CAST('0x' || substr({}, {}, {}) AS BIGINT)"
    num = lambda c: digits.format(md5.format(c), 1, 8)
    record = "'WARC/1.1' || crlf || 'WARC-Type: resource' || crlf || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(key AS VARCHAR), '') || '>' || crlf || 'WARC-Target-URI: ' || coalesce(url, '') || crlf || 'Content-Type: text/html' || crlf || 'Content-Length: ' || octet_length(encode(body)) || crlf || crlf || body || crlf || crlf"

    def up(level: str, below: str, place: str) -> str:
        return f"""{level} AS (SELECT side, archive, up AS place, min(o) AS o, CAST(sum(size) AS BIGINT) AS size, sha256(string_agg((o - lo) || ':' || size || ':' || h, ',' ORDER BY o)) AS h
            FROM (SELECT *, min(o) OVER (PARTITION BY side, archive, up) AS lo FROM (SELECT *, {place} AS up FROM {below})) GROUP BY side, archive, up)"""

    def both(name: str, level: str, above: str = "") -> str:
        under = f" WHERE EXISTS (FROM {above} AS u WHERE u.h IS DISTINCT FROM u.g AND u.archive = l.archive AND u.place = l.place // {FANOUT})" if above else ""
        return f"{name} AS (SELECT archive, place, max(h) FILTER (side = 0) AS h, max(h) FILTER (side = 1) AS g FROM {level} AS l{under} GROUP BY archive, place)"

    slots = FANOUT**LEVELS
    slot = f"(CASE WHEN spread > 1 THEN {digits.format('hash', 9, 4)} ELSE {digits.format(md5.format('key'), 9, 4)} END) % {slots}"
    return f"""WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / {float(ARCHIVE_RECORDS)}) AS BIGINT)) AS n FROM pages),
    p AS (SELECT page_id AS key, url, coalesce(html, '') AS body, {num('page_id')} % {one_in} AS hit, chr(13) || chr(10) AS crlf FROM pages),
    q AS (SELECT 0 AS side, key, url, body, crlf FROM p
        UNION ALL SELECT 1, CASE WHEN hit = 2 THEN -1 - key ELSE key END, url, CASE WHEN hit = 0 THEN '~' || substr(body, 2) ELSE body END, crlf FROM p WHERE hit <> 1
        UNION ALL SELECT 1, key, url, body, crlf FROM p WHERE hit = 3),
    r AS (SELECT side, key, sha256(record) AS hash, CAST(octet_length(encode(record)) AS BIGINT) AS length, count(*) AS copies FROM (SELECT side, key, {record} AS record FROM q) GROUP BY ALL),
    crowds AS (SELECT key AS crowd, CAST(ceil(max(n) / {float(ARCHIVE_RECORDS)}) AS BIGINT) AS spread FROM (SELECT side, key, count(*) AS n FROM r GROUP BY ALL) GROUP BY key HAVING max(n) > {ARCHIVE_RECORDS}),
    s AS (SELECT side, key, hash, length, copies, length * copies AS size, coalesce(spread, 1) AS spread FROM r LEFT JOIN crowds ON key IS NOT DISTINCT FROM crowd),
    t AS (SELECT *, ({num('key')} + {digits.format('hash', 1, 8)} % spread) % n AS archive, {slot} AS place FROM s, n),
    l0 AS (SELECT *, CAST(sum(size) OVER (PARTITION BY side, archive ORDER BY place, key NULLS FIRST, hash ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS o, hash || '*' || copies AS h FROM t),
    {up('l1', 'l0', 'place')}, {up('l2', 'l1', f'place // {FANOUT}')}, {up('l3', 'l2', f'place // {FANOUT}')},
    {both('b3', 'l3')}, {both('b2', 'l2', 'b3')}, {both('b1', 'l1', 'b2')},
    b0 AS (SELECT archive, place, key, hash, length, greatest(sum(CASE WHEN side = 0 THEN copies ELSE -copies END), 0) AS lost, greatest(sum(CASE WHEN side = 1 THEN copies ELSE -copies END), 0) AS found, coalesce(max(o) FILTER (side = 0), max(o) FILTER (side = 1)) AS o
        FROM l0 AS l WHERE EXISTS (FROM b1 AS u WHERE u.h IS DISTINCT FROM u.g AND u.archive = l.archive AND u.place = l.place) GROUP BY ALL),
    c AS (SELECT archive, count(*) AS n FROM (SELECT archive FROM b2 UNION ALL SELECT archive FROM b1 UNION ALL SELECT archive FROM b0) GROUP BY archive),
    d AS (SELECT archive, key, coalesce(max(o) FILTER (lost > 0), max(o)) AS o, coalesce(max(length) FILTER (lost > 0), max(length)) AS length, CAST(sum(lost) AS BIGINT) AS lost, CAST(sum(found) AS BIGINT) AS found
        FROM (SELECT *, row_number() OVER (PARTITION BY archive, place, key, lost > 0 ORDER BY hash) AS nth FROM b0 WHERE lost > 0 OR found > 0) GROUP BY archive, place, key, nth),
    e AS (SELECT archive, CAST(sum(least(lost, found)) AS BIGINT) AS n_changed, CAST(sum(greatest(lost - found, 0)) AS BIGINT) AS n_missing, CAST(sum(greatest(found - lost, 0)) AS BIGINT) AS n_extra,
        string_agg((CASE WHEN lost > 0 AND found > 0 THEN 'changed' WHEN lost > 0 THEN 'missing' ELSE 'extra' END) || ':' || o || ':' || length || ':' || coalesce(CAST(key AS VARCHAR), '') || ':' || lost || ':' || found, ',' ORDER BY o, length, key NULLS FIRST) AS findings FROM d GROUP BY archive),
    z AS (SELECT archive, CAST(sum(copies) AS BIGINT) AS n_records, CAST(sum(size) AS BIGINT) AS n_bytes FROM l0 WHERE side = 0 GROUP BY archive)
    SELECT b3.archive, coalesce(n_records, 0) AS n_records, coalesce(n_bytes, 0) AS n_bytes, b3.h AS root, b3.g AS replica_root, b3.h IS NOT DISTINCT FROM b3.g AS intact, coalesce(c.n, 0) + 1 AS n_compared,
        coalesce(n_changed, 0) AS n_changed, coalesce(n_missing, 0) AS n_missing, coalesce(n_extra, 0) AS n_extra, coalesce(findings, '') AS findings
    FROM b3 LEFT JOIN z USING (archive) LEFT JOIN c USING (archive) LEFT JOIN e USING (archive)"""
