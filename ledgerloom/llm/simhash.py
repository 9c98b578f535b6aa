"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints link at ``DISTANCE`` or fewer differing bits. The 64 bits are
dealt into parts of correlated bits; part i has a threshold t_i, and the
t_i + 1 add up to DISTANCE + 1 or more, so two linked fingerprints differ in at
most t_i bits of some part i. Widths and thresholds, both unequal, come from a
dynamic program over estimated numbers of probes and candidates. Every distinct
fingerprint is then put under its value in each part, and under the values at up
to t_i / 2 flipped bits: two that differ in t_i bits meet half way. What meets
under a value is verified on all 64 bits.

Within a value only a spanning forest of the links is kept, found by flooding
from one fingerprint to those not reached yet: a dense group of k fingerprints
takes about k steps and gives k - 1 links, not k * k / 2. Values that many
fingerprints share are cut into blocks, and each pair of blocks is a group of
its own, so no task has to hold more than two blocks. No link between different
components of the forest is lost; components join with alternating star
contractions over checkpointed tables. Components and fingerprints with many
members (a 500th of all; there are 500 at most) reach these by broadcast.

Deduplication (``deduplicate``) takes shingles of five words and links documents
of a similarity of 0.8 or more. So alike texts differ in about 10 of 64 bits, at
which unrelated ones would meet too; so each document gets four more fingerprints
of the same shingles, candidates come from ``NEAR_DISTANCE`` bits of the first one
by the same plan, and are verified on all 320 bits, by which the similarity is
estimated.

Null text and text without words have the fingerprint zero and link like any
other. Rows with a null key are fingerprinted and linked; a component's id is
the smallest key that isn't null, null if there is none. Repeated rows give
repeated results, an empty table an empty one; texts of any length are read
whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, map_arrow, raw, slices

WORDS, SEED, BITS, DISTANCE = 4, 42, 64, 4
#: Deduplication: words of a shingle, further fingerprints, differing bits of the first one, and of all 320 bits together. Of two
#: texts with a share J of their shingles in common, a bit differs with a chance of arccos(2 J / (1 + J)) / pi: at 0.8 48.5 of 320
#: bits, with a deviation of 6.
NEAR_WORDS, NEAR_EXTRA, NEAR_DISTANCE, NEAR_BITS = 5, 4, 12, 54
#: Fingerprints (smallest hash first) from which the plan's costs are estimated. They never decide what links.
PLAN_SAMPLE = 1024
#: Parts begin and end at multiples of this many bits; values of a part that one fingerprint is put under at most, which bounds what is shuffled for a document.
STEP, MOST_VALUES = 4, 72
#: Fingerprints in a block of a value that many share.
BLOCK = 2048
#: Cost of a probe row against that of comparing a candidate.
PROBE_COST = 40.0
#: A key with more than one in so many of all rows (and over a thousand) is broadcast.
FREQUENT = 500


def _bits(hashes: np.ndarray) -> int:
    """A fingerprint bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same shingles: a round of multiplying and shifting, after a k-th constant is added."""
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def signature(data: bytes, shingle: int = WORDS, extra: int = 0) -> list[int]:
    """The SimHash of a text's word shingles as a signed 64-bit integer, and ``extra`` more of the same shingles by other hashes."""
    words = data.lower().split()  # on bytes, both know ASCII only
    if not words:
        return [0] * (1 + extra)
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    h = xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[:-1])]
    values = np.array([h(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])] if len(words) >= shingle else [h(line, SEED)], np.uint64)
    return [_bits(values), *(_bits(_mixed(values, k)) for k in range(1, extra + 1))]


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = WORDS, extra: int = 0) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long, and fp1, fp2, ..., the ``extra`` ones."""
    names = ["fp", *(f"fp{k}" for k in range(1, extra + 1))]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{c} long" for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = np.array([signature(x, shingle, extra) for x in raw(part.column(text))], np.int64).reshape(-1, 1 + extra)
                yield pa.record_batch({c: part.column(c) for c in keep} | {c: pa.array(found[:, k], pa.int64()) for k, c in enumerate(names)})

    return map_arrow(docs.select(*keep, text), run, schema)


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# The plan: parts of bits with thresholds.


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set, over all of them; summed where the rows are, then 64 x 64 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            bits = np.unpackbits(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
            total += bits.T @ bits
        i, j = np.nonzero(total)
        yield pa.record_batch({"cell": pa.array(i * BITS + j, pa.int32()), "n": pa.array(total[i, j])})

    total = np.zeros(BITS * BITS)
    for r in map_arrow(fps.select("fp"), run, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[r.cell] = r.n
    return total.reshape(BITS, BITS)


def correlated_order(counts: np.ndarray, n: int) -> list[int]:
    """The bits in an order in which each follows the one most correlated with those just before it."""
    p = np.diag(counts) / max(n, 1)
    cov = counts / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(corr, 0)
    order = [int(corr.sum(0).argmax())]
    left = set(range(BITS)) - set(order)
    while left:
        near = corr[order[-8:]].sum(0)
        order.append(max(left, key=lambda b: (near[b], -b)))
        left.discard(order[-1])
    return order


def variants(width: int, flips: int) -> int:
    """Values within so many flipped bits."""
    return sum(comb(width, i) for i in range(flips + 1))


def meetings(width: int, apart: int, flips: int) -> int:
    """Under how many values two fingerprints meet that differ in ``apart`` of a part's bits."""
    return sum(comb(apart, i) * comb(width - apart, j) for i in range(apart + 1) for j in range(flips + 1) if max(i, apart - i) + j <= flips)


def allocate(order: list[int], sample: np.ndarray, n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Parts of the ordered bits with the flips of each, of the least estimated cost.

    Dynamic programming over the place in the order and the budget spent: a part
    with f flips has the threshold 2 f and spends 2 f + 1 of distance + 1.
    """
    steps, budget, m = BITS // STEP, distance + 1, len(sample)
    apart = np.zeros((steps + 1, m, m), np.uint8)  # differing bits of each pair in the first k steps
    for k in range(steps):
        cells = sample & np.uint64(sum(1 << b for b in order[k * STEP : (k + 1) * STEP]))
        apart[k + 1] = apart[k] + np.bitwise_count(cells[:, None] ^ cells)

    def costs(a: int, b: int) -> list[tuple[int, float]]:
        """(flips, cost) of the part from step a to step b."""
        width = (b - a) * STEP
        near = np.bincount((apart[b] - apart[a]).ravel(), minlength=width + 1).astype(float)
        near[0] -= m
        share = near / max(1, m * (m - 1))
        found = []
        for flips in range(distance // 2 + 1):
            if variants(width, flips) > MOST_VALUES or 2 * flips > width:
                break
            # unseen pairs: at least what independent even bits would give
            pairs = sum(max(share[d], comb(width, d) / 2.0**width) * meetings(width, d, flips) for d in range(2 * flips + 1))
            found.append((flips, n * variants(width, flips) * PROBE_COST + pairs * n * n / 2))
        return found

    best: list[list[tuple[float, tuple]]] = [[(np.inf, ())] * (budget + 1) for _ in range(steps + 1)]
    best[0][0] = (0.0, ())
    for a in range(steps):
        for spent, (cost, chosen) in enumerate(best[a]):  # leave a step out
            best[a + 1][spent] = min(best[a + 1][spent], (cost, chosen))
        for b in range(a + 1, steps + 1):
            for flips, more in costs(a, b):
                for spent, (cost, chosen) in enumerate(best[a]):
                    to = min(budget, spent + 2 * flips + 1)
                    best[b][to] = min(best[b][to], (cost + more, (*chosen, (a, b, flips))))
    return [(order[a * STEP : b * STEP], flips) for a, b, flips in best[steps][budget][1]]


def plan(fps: DataFrame, n: int, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """Parts with their flips, for ``n`` distinct fingerprints."""
    order = correlated_order(bit_counts(fps), n)
    rows = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE).collect()
    return allocate(order, np.array([r.fp for r in rows], np.int64).view(np.uint64), n, distance)


# Links.


def probes(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Each fingerprint under every value at which it can meet another: part, value, and the columns of ``fps``."""
    return fps.select("*", F.explode(F.concat(*(_part_values(k, bits, t) for k, (bits, t) in enumerate(parts)))).alias("at")).select("at.part", "at.value", *fps.columns)


def _part_values(part: int, bits: list[int], t: int) -> Column:
    flips = [sum(1 << b for b in some) for n in range(t + 1) for some in combinations(bits, n)]
    own = F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))
    return F.transform(F.array(*(F.lit(_signed(f)) for f in flips)), lambda f: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(f).alias("value")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_pairs(a: np.ndarray, distance: int = DISTANCE, within: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among fingerprints, by flooding; pairs of rows of ``a``.

    The first column links at ``distance`` bits or fewer, all columns together at ``within`` or fewer if that is given.
    """
    if len(a) <= 256 and not np.triu(np.bitwise_count(a[:, None, 0] ^ a[:, 0]) <= distance, 1).any():
        return []
    links, left = [], np.arange(len(a))
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = np.bitwise_count(a[left, 0] ^ a[x, 0]) <= distance
            if within is not None and near.any():
                near[near] = np.bitwise_count(a[left[near]] ^ a[x]).sum(1) <= within
            if near.any():
                links += [(x, y) for y in left[near].tolist()]
                reached.extend(left[near].tolist())
                left = left[~near]
    return links


class Forest:
    """Union-find over the nodes that a task has linked."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def batch(self) -> pa.RecordBatch:
        rows = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        return pa.record_batch({"hi": pa.array([x for x, _ in rows], pa.int64()), "lo": pa.array([r for _, r in rows], pa.int64())})


def forests(names: list[str], distance: int = DISTANCE, within: int | None = None) -> Callable:
    """The function that links the groups in a task, whose rows come sorted by group; links are emitted as stars. names: node, then fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, current = Forest(), [], None

        def close() -> None:
            if sum(map(len, held)) > 1:
                rows = np.concatenate(held)
                nodes, first = np.unique(rows[:, 0], return_index=True)
                for x, y in near_pairs(rows[first, 1:].view(np.uint64), distance, within):
                    forest.link(int(nodes[x]), int(nodes[y]))

        for batch in batches:
            group = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("part", "value", "block")], 1)
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], 1)
            ends = [*(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1).tolist(), len(rows)]
            for a, b in zip([0, *ends], ends):
                if a == b:
                    continue
                if (key := tuple(group[a].tolist())) != current:
                    close()
                    held, current = [], key
                held.append(rows[a:b])
            if len(forest.up) > 1_000_000:
                yield forest.batch()
                forest = Forest()
        close()
        yield forest.batch()

    return run


def links(fps: DataFrame, parts: list[tuple[list[int], int]], block: int = BLOCK, distance: int = DISTANCE, within: int | None = None) -> DataFrame:
    """A forest with the components of all links: hi, lo, which are nodes. ``fps``: fp, which is the node, or node, fp, fp1, ...; one row for each node."""
    node = fps.columns[0]
    rows = probes(fps, parts)
    crowded = rows.groupBy("part", "value").count().where(F.col("count") > block).select("part", "value", F.ceil(F.col("count") / block).cast("long").alias("blocks"))
    crowded = cut(crowded)
    own = F.pmod(F.xxhash64(node, "value"), F.col("blocks"))
    # a fingerprint of block b belongs to the pairs {b, o} for every block o
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, own) * F.col("blocks") + F.greatest(o, own))
    if crowded.isEmpty():
        rows = rows.withColumn("block", F.lit(0).cast("long"))
    else:
        rows = rows.join(crowded, ["part", "value"], "left")
        rows = rows.select("part", "value", *fps.columns, F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair)).alias("block"))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "part", "value", "block").sortWithinPartitions("part", "value", "block")
    names = [node, *(c for c in fps.columns if c != "node")]
    return map_arrow(dealt, forests(names, distance, within), "hi long, lo long")


# Components.


def stars(edges: DataFrame) -> DataFrame:
    """Connected components of (hi, lo) pairs with hi > lo: each node that isn't its component's smallest, with that."""

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        return tuple(r)

    edges = cut(edges.distinct())
    seen = mark(edges)
    while seen[0]:
        # large star: greater neighbours go to the smallest neighbour
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("members")))
        large = spread_join(both.where("v > u"), least, "u", 2 * seen[0]).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of these
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = cut(moved.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges


def spread_join(rows: DataFrame, labels: DataFrame, on: str, total: int) -> DataFrame:
    """``rows`` with the label of their ``on``; labels that many of the ``total`` rows have (column members) are broadcast, the rest is shuffled.

    Not more than FREQUENT labels can have over total / FREQUENT rows each.
    """
    many = F.col("members") > max(1000, total // FREQUENT)
    frequent, rare = F.broadcast(labels.where(many).drop("members")), labels.where(~many).drop("members")
    return rows.join(frequent, on).unionByName(rows.join(frequent.select(on), on, "left_anti").join(rare, on))


def components(keyed: DataFrame, key: str = "doc_id", distance: int = DISTANCE, within: int | None = None) -> DataFrame:
    """``keyed`` (key, fp, and fp1, ... where all of them have to be ``within`` so many bits) with ``component_id``, the smallest key of the component."""
    more = [c for c in keyed.columns if c.startswith("fp") and c[2:].isdigit()]
    node = "node" if more else "fp"
    keyed = cut(keyed.withColumn("node", F.xxhash64("fp", *more)) if more else keyed)
    nodes = cut(keyed.groupBy(*(["node"] if more else []), "fp", *more).agg(F.min(key).alias("least"), F.count("*").alias("members")))
    n, total = nodes.agg(F.count("*"), F.coalesce(F.sum("members"), F.lit(0))).first()
    if n < 2:
        whole = nodes.select(node, "members", F.col(node).alias("root"), F.col("least").alias("component_id"))
    else:
        fps = nodes.select(*(["node"] if more else []), "fp", *more)
        roots = stars(links(fps, plan(fps, n, distance), distance=distance, within=within)).select(F.col("hi").alias(node), F.col("lo").alias("root"))
        rooted = cut(nodes.join(roots, node, "left").select(node, "least", "members", F.coalesce("root", node).alias("root")))
        ids = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")))
        whole = cut(spread_join(rooted.select(node, F.col("members").alias("rows"), "root"), ids, "root", n).select(node, F.col("rows").alias("members"), "root", "component_id"))
    return spread_join(keyed, whole, node, total)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hexadecimal digits), component_id."""
    found = components(fingerprints(docs, text, (key,)), key)
    return found.select(key, hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = NEAR_WORDS, distance: int = NEAR_DISTANCE, within: int | None = NEAR_BITS) -> DataFrame:
    """One row of each component of near-duplicates, with all its columns: the one with the smallest key (null keys last, then the smallest hash of the text).

    Without ``within`` documents link by ``distance`` bits of one fingerprint alone.

    Rows that agree in key and text are copies of each other; one of them stays,
    that with the smallest hash of all columns.
    """
    own, mark = F.col(key), F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(own.alias("own"), mark.alias("mark"), F.col(text).alias("text"))
    found = cut(components(fingerprints(rows, "text", ("own", "mark"), shingle, NEAR_EXTRA if within is not None else 0), "own", distance, within))
    alone = F.when(F.col("component_id").isNull(), F.col("root"))  # components without any key count by their root
    first = F.min(F.struct(F.col("own").isNull().alias("none"), F.col("own").alias("k"), F.col("mark").alias("m")))
    kept = found.groupBy("component_id", alone.alias("alone")).agg(first.alias("first")).select(F.col("first.k").alias("k"), F.col("first.m").alias("m"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), own.alias("own"), mark.alias("mark"))
    rows = rows.join(kept, (F.col("mark") == F.col("m")) & F.col("own").eqNullSafe(F.col("k")), "left_semi")
    if not found.groupBy("own", "mark").count().where("count > 1").isEmpty():
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("mark", "own").orderBy(F.xxhash64("row")))).where("nth <= 1")
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))
