"""Graph features that need iteration.

Windows are independent graphs. A window whose edges fit in a Python worker
(``Config.local_edges``) goes to one as a whole and is worked on with numpy;
PageRank, HITS, k-core, components and betweenness of larger windows run as
distributed loops, with each round's table checkpointed. Both ways agree; the
tests compare them. Leiden communities are always found in one worker a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT, Config
from ledgerloom.session import durable, import_path

W = "window_id"
#: Rounds of PageRank and HITS before their tolerance is asked for.
LEAST_ROUNDS = 20


class Graph:
    """A window's graph with entities numbered in ascending order; edges sorted by source, then target."""

    def __init__(self, part: pd.DataFrame, weight: str | None = None) -> None:
        self.ids = np.unique(np.concatenate([part["source"].to_numpy(), part["target"].to_numpy()]))
        s, t = np.searchsorted(self.ids, part["source"].to_numpy()), np.searchsorted(self.ids, part["target"].to_numpy())
        order = np.lexsort((t, s))
        self.s, self.t, self.n = s[order], t[order], len(self.ids)
        self.w = np.nan_to_num(part[weight].to_numpy(float)[order]) if weight else np.ones(len(order))

    def undirected(self) -> tuple[np.ndarray, np.ndarray]:
        """Both directions of each pair of different entities, sorted."""
        keep = self.s != self.t
        a, b = np.concatenate([self.s[keep], self.t[keep]]), np.concatenate([self.t[keep], self.s[keep]])
        code = np.unique(a.astype(np.int64) * self.n + b)
        return code // self.n, code % self.n

    def frame(self, window: int, **columns: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({W: window, "entity_id": self.ids} | columns)


#: Windows that get a task each; more of them share tasks.
MOST_TASKS = 2000


def per_window(edges: DataFrame, function: Callable[[int, pd.DataFrame], pd.DataFrame], schema: str, columns: tuple[str, ...] = (W, "source", "target", "volume", "count")) -> DataFrame:
    """``function`` on each window's rows, which it gives columns keyed by entity. One shuffle, and one task a window: hashed, some tasks would get several and others none."""
    from pyspark.sql.types import StructType

    kind = edges.schema["source"].dataType.simpleString() if "source" in edges.columns else None
    schema = "window_id long, " + (f"entity_id {kind}, " if kind else "") + schema
    last = edges.agg(F.max(W).alias("m")).first().m
    names = StructType.fromDDL(schema).names

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if held and sum(map(len, held)):
            whole = pd.concat(held, ignore_index=True)
            held.clear()
            for key, part in whole.groupby(W):
                yield function(int(key), part.reset_index(drop=True))[names]

    tasks = min(int(last or 0) + 1, MOST_TASKS)
    rows = edges.select(*(c for c in columns if c in edges.columns)).repartitionById(tasks, F.pmod(F.col(W), F.lit(tasks)).cast("int"))
    return import_path(rows).mapInPandas(run, schema)


def fits(edges: DataFrame, config: Config = DEFAULT) -> bool:
    """Whether every window's edges fit in a Python worker."""
    return edges.groupBy(W).count().where(F.col("count") > config.local_edges).isEmpty()


def not_reached(what: str, rounds: int, window: int | None = None) -> RuntimeError:
    return RuntimeError(f"{what} didn't reach its tolerance in {rounds} rounds" + ("" if window is None else f" in window {window}"))


# PageRank.


def pagerank(edges: DataFrame, alpha: float = 0.85, weight: str = "volume", name: str = "pagerank", rounds: int | None = None, config: Config = DEFAULT, local: bool | None = None) -> DataFrame:
    """Weighted PageRank; rank of entities without weighted edges is spread evenly.

    Iterates until a round changes a window's ranks by less than ``Config.pagerank_tolerance`` times its entities in
    sum; raises if ``Config.pagerank_rounds`` don't reach that. ``rounds`` asks for just so many instead.
    """
    if fits(edges, config) if local is None else local:

        def one(window: int, part: pd.DataFrame) -> pd.DataFrame:
            g = Graph(part, weight)
            out = np.bincount(g.s, g.w, g.n)
            share = np.divide(g.w, out[g.s], out=np.zeros(len(g.s)), where=out[g.s] > 0)
            r = np.full(g.n, 1 / g.n)
            for k in range(config.pagerank_rounds if rounds is None else rounds):
                flow = np.bincount(g.t, r[g.s] * share, g.n)
                r, before = alpha * (flow + r[out == 0].sum() / g.n) + (1 - alpha) / g.n, r
                if rounds is None and k + 1 >= LEAST_ROUNDS and np.abs(r - before).sum() < config.pagerank_tolerance * g.n:
                    break
            else:
                if rounds is None:
                    raise not_reached("PageRank", config.pagerank_rounds, window)
            return g.frame(window, **{name: r})

        return per_window(edges, one, f"{name} double")
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    e = edges.select(W, "source", "target", w.alias("w"))
    out = e.groupBy(W, "source").agg(F.sum("w").alias("out"))
    shares = durable(e.join(out.where("out > 0"), [W, "source"]).select(W, "source", "target", (F.col("w") / F.col("out")).alias("share")))
    nodes = e.select(W, F.explode(F.array("source", "target")).alias("entity_id")).distinct()
    sizes = nodes.groupBy(W).agg(F.count("*").alias("n"))
    nodes = durable(nodes.join(sizes, W))
    ranks = nodes.select(W, "entity_id", "n", (1 / F.col("n")).alias("rank"))
    for k in range(config.pagerank_rounds if rounds is None else rounds):
        before = ranks
        flow = ranks.withColumnRenamed("entity_id", "source").join(shares, [W, "source"]).groupBy(W, F.col("target").alias("entity_id")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        # ranks add up to 1, so what didn't flow was on entities without weighted edges: the ranks are read once a round
        lost = flow.groupBy(W).agg((1 - F.sum("flow")).alias("lost"))
        joined = nodes.join(flow, [W, "entity_id"], "left").join(lost, W, "left")
        rank = alpha * (F.coalesce("flow", F.lit(0.0)) + F.coalesce("lost", F.lit(1.0)) / F.col("n")) + (1 - alpha) / F.col("n")
        ranks = joined.select(W, "entity_id", "n", rank.alias("rank"))
        if k % 4 == 3:
            ranks = durable(ranks)
            if rounds is None and k + 1 >= LEAST_ROUNDS:
                moved = ranks.join(before.select(W, "entity_id", F.col("rank").alias("before")), [W, "entity_id"]).groupBy(W, "n").agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("moved"))
                if moved.where(F.col("moved") >= config.pagerank_tolerance * F.col("n")).isEmpty():
                    break
    else:
        if rounds is None:
            raise not_reached("PageRank", config.pagerank_rounds)
    return ranks.select(W, "entity_id", F.col("rank").alias(name))


# Hubs and authorities.


def hits(edges: DataFrame, rounds: int | None = None, config: Config = DEFAULT, local: bool | None = None) -> DataFrame:
    """hits_hub and hits_auth on unweighted edges, each adding up to 1 in a window.

    Iterates until a round changes a window's hub scores by less than ``Config.hits_tolerance`` in sum; raises if
    ``Config.hits_rounds`` don't reach that. ``rounds`` asks for just so many instead.
    """
    if fits(edges, config) if local is None else local:

        def one(window: int, part: pd.DataFrame) -> pd.DataFrame:
            g = Graph(part)
            hub = np.full(g.n, 1 / g.n)
            for k in range(config.hits_rounds if rounds is None else rounds):
                before = hub
                auth = np.bincount(g.t, hub[g.s], g.n)
                hub = np.bincount(g.s, auth[g.t], g.n)
                auth, hub = auth / auth.sum(), hub / hub.sum()
                if rounds is None and k + 1 >= LEAST_ROUNDS and np.abs(hub - before).sum() < config.hits_tolerance:
                    break
            else:
                if rounds is None:
                    raise not_reached("HITS", config.hits_rounds, window)
            return g.frame(window, hits_hub=hub, hits_auth=auth)

        return per_window(edges, one, "hits_hub double, hits_auth double")
    e = durable(edges.select(W, "source", "target"))
    nodes = durable(e.select(W, F.explode(F.array("source", "target")).alias("entity_id")).distinct())

    def scaled(values: DataFrame) -> DataFrame:
        return values.join(values.groupBy(W).agg(F.sum("x").alias("total")), W).select(W, "entity_id", (F.col("x") / F.col("total")).alias("x"))

    hub = nodes.withColumn("x", F.lit(1.0))
    auth = hub
    for k in range(config.hits_rounds if rounds is None else rounds):
        before = hub
        auth = durable(e.join(hub.withColumnRenamed("entity_id", "source"), [W, "source"]).groupBy(W, F.col("target").alias("entity_id")).agg(F.sum("x").alias("x")))
        hub = durable(scaled(e.join(auth.withColumnRenamed("entity_id", "target"), [W, "target"]).groupBy(W, F.col("source").alias("entity_id")).agg(F.sum("x").alias("x"))))
        if rounds is None and k + 1 >= LEAST_ROUNDS:
            moved = hub.join(before.withColumnRenamed("x", "before"), [W, "entity_id"]).groupBy(W).agg(F.sum(F.abs(F.col("x") - F.col("before"))).alias("moved"))
            if moved.where(F.col("moved") >= config.hits_tolerance).isEmpty():
                break
    else:
        if rounds is None:
            raise not_reached("HITS", config.hits_rounds)
    auth = scaled(auth)
    both = nodes.join(hub.withColumnRenamed("x", "hits_hub"), [W, "entity_id"], "left").join(auth.withColumnRenamed("x", "hits_auth"), [W, "entity_id"], "left")
    return both.fillna(0.0, ["hits_hub", "hits_auth"])


# Cores and components.


def _core_numbers(g: Graph) -> np.ndarray:
    a, b = g.undirected()
    core = np.bincount(a, minlength=g.n)
    while len(a):
        # h-index of the neighbours' numbers: sort them downwards within each entity, then count those above their place
        order = np.lexsort((-core[b], a))
        first = np.searchsorted(a, np.arange(g.n))
        place = np.arange(len(a)) - first[a] + 1
        new = np.minimum(core, np.bincount(a, core[b][order] >= place, g.n).astype(np.int64))
        if (new == core).all():
            break
        core = new
    return core


def k_core(edges: DataFrame, config: Config = DEFAULT, local: bool | None = None) -> DataFrame:
    """k_core: the largest k for which the entity is in a subgraph with k neighbours each; undirected, without self-loops."""
    if fits(edges, config) if local is None else local:

        def one(window: int, part: pd.DataFrame) -> pd.DataFrame:
            g = Graph(part)
            return g.frame(window, k_core=_core_numbers(g).astype(np.int64))

        return per_window(edges, one, "k_core long")
    e = edges.where("source <> target").select(W, F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))).alias("x")).select(W, "x.*").distinct()
    e = durable(e)
    nodes = edges.select(W, F.explode(F.array("source", "target")).alias("entity_id")).distinct()
    core = durable(e.groupBy(W, F.col("a").alias("entity_id")).agg(F.count("*").alias("k")))
    while True:
        # h-index from counts of each number, so that a hub's neighbours aren't gathered in one row
        counts = e.join(core.select(W, F.col("entity_id").alias("b"), "k"), [W, "b"]).join(core.select(W, F.col("entity_id").alias("a"), F.col("k").alias("own")), [W, "a"])
        counts = counts.groupBy(W, "a", "own", F.least("k", "own").alias("k")).agg(F.count("*").alias("n"))
        above = F.sum("n").over(Window.partitionBy(W, "a").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
        h = counts.withColumn("at_least", above).groupBy(W, F.col("a").alias("entity_id")).agg(F.max("own").alias("own"), F.max(F.least("k", "at_least")).alias("k"))
        h = durable(h)
        done = h.where("k <> own").isEmpty()
        core = h.select(W, "entity_id", "k")
        if done:
            break
    return nodes.join(core, [W, "entity_id"], "left").select(W, "entity_id", F.coalesce("k", F.lit(0)).cast("long").alias("k_core"))


def components(edges: DataFrame, config: Config = DEFAULT, local: bool | None = None) -> DataFrame:
    """component_id: the smallest entity that can be reached, edges taken both ways."""
    kind = edges.schema["source"].dataType.simpleString()
    if fits(edges, config) if local is None else local:

        def one(window: int, part: pd.DataFrame) -> pd.DataFrame:
            g = Graph(part)
            root = np.arange(g.n)
            while True:
                new = root.copy()
                np.minimum.at(new, g.s, root[g.t])
                np.minimum.at(new, g.t, root[g.s])
                new = new[new]
                if (new == root).all():
                    break
                root = new
            return g.frame(window, component_id=g.ids[root])

        return per_window(edges, one, f"component_id {kind}")
    e = edges.select(W, F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))).alias("x")).select(W, "x.*").distinct()
    e = durable(e)
    root = durable(e.select(W, F.col("a").alias("entity_id")).distinct().withColumn("root", F.col("entity_id")))
    while True:
        near = e.join(root.select(W, F.col("entity_id").alias("b"), "root"), [W, "b"]).groupBy(W, F.col("a").alias("entity_id")).agg(F.min("root").alias("least"))
        hooked = durable(root.join(near, [W, "entity_id"]).select(W, "entity_id", "root", F.least("root", "least").alias("new")))
        jump = hooked.select(W, F.col("entity_id").alias("new"), F.col("new").alias("over"))
        now = durable(hooked.join(jump, [W, "new"]).select(W, "entity_id", F.col("root").alias("was"), F.col("over").alias("root")))
        done = now.where("was <> root").isEmpty()
        root = now.select(W, "entity_id", "root")
        if done:
            return root.select(W, "entity_id", F.col("root").alias("component_id"))


# Betweenness.


def _betweenness(g: Graph, pivots: np.ndarray) -> np.ndarray:
    """Dependencies summed over the pivots, level by level."""
    total = np.zeros(g.n)
    s, t = g.s[g.s != g.t], g.t[g.s != g.t]
    for p in pivots:
        depth, paths = np.full(g.n, -1), np.zeros(g.n)
        depth[p], paths[p], level, steps = 0, 1.0, 0, []
        while True:
            at = (depth[s] == level) & ((depth[t] == -1) | (depth[t] == level + 1))
            if not at.any():
                break
            a, b = s[at], t[at]
            depth[b] = level + 1
            paths += np.bincount(b, paths[a], g.n)
            steps.append((a, b))
            level += 1
        gain = np.zeros(g.n)
        for a, b in reversed(steps):
            gain += np.bincount(a, paths[a] / paths[b] * (1 + gain[b]), g.n)
        gain[p] = 0
        total += gain
    return total


def _order(window: int, entity: object, seed: int) -> str:
    return hashlib.md5(f"{window}:{entity}:{seed}".encode()).hexdigest()


def betweenness(edges: DataFrame, config: Config = DEFAULT, seed: int = 42, local: bool | None = None) -> DataFrame:
    """betweenness on shortest paths by hops, from the ``pivots`` entities with the smallest hash (all, if there are no more), scaled to all and normalised."""
    if fits(edges, config) if local is None else local:

        def one(window: int, part: pd.DataFrame) -> pd.DataFrame:
            g = Graph(part)
            k = min(config.pivots, g.n)
            pivots = np.array(sorted(range(g.n), key=lambda i: _order(window, g.ids[i], seed))[:k])
            scale = g.n / k / ((g.n - 1) * (g.n - 2)) if g.n > 2 else 0.0
            return g.frame(window, betweenness=_betweenness(g, np.sort(pivots)) * scale)

        return per_window(edges, one, "betweenness double")
    e = durable(edges.where("source <> target").select(W, "source", "target"))
    nodes = durable(edges.select(W, F.explode(F.array("source", "target")).alias("entity_id")).distinct())
    order = Window.partitionBy(W).orderBy(F.md5(F.concat_ws(":", W, "entity_id", F.lit(seed))))
    pivots = nodes.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= config.pivots)
    # forward: a level holds, for each pivot, the entities at that distance and the number of shortest paths to them
    level = durable(pivots.select(W, F.col("entity_id").alias("pivot"), F.col("entity_id").alias("source"), F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select(W, "pivot", "source")
    while True:
        grown = level.join(e, [W, "source"]).groupBy(W, "pivot", F.col("target").alias("source")).agg(F.sum("paths").alias("paths"))
        level = durable(grown.join(seen, [W, "pivot", "source"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = durable(seen.unionAll(level.select(W, "pivot", "source")))
    # backward: an entity passes on to those before it a share of what it has, by their paths
    gains = levels[-1].withColumn("gain", F.lit(0.0))
    total = gains.limit(0)
    for before in reversed(levels[:-1]):
        total = total.unionByName(gains)
        to = gains.select(W, "pivot", F.col("source").alias("target"), F.col("paths").alias("to_paths"), "gain").join(e, [W, "target"])
        given = to.join(before, [W, "pivot", "source"]).groupBy(W, "pivot", "source").agg(F.sum(F.col("paths") / F.col("to_paths") * (1 + F.col("gain"))).alias("gain"))
        gains = durable(before.join(given, [W, "pivot", "source"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0))))
    n = nodes.groupBy(W).agg(F.count("*").alias("n"))
    sums = total.groupBy(W, F.col("source").alias("entity_id")).agg(F.sum("gain").alias("gain"))
    k = F.least(F.col("n"), F.lit(config.pivots))
    scale = F.when(F.col("n") > 2, F.col("n") / k / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0)
    return nodes.join(n, W).join(sums, [W, "entity_id"], "left").select(W, "entity_id", (F.coalesce("gain", F.lit(0.0)) * scale).alias("betweenness"))


# Communities.


class Links:
    """An undirected weighted graph: for node v its neighbours to[first[v]:first[v + 1]], in order, and the weights of the links to them; whole numbers, so that sums are exact."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray | None = None) -> None:
        """Both directions of each pair, sorted."""
        self.first = np.searchsorted(a, np.arange(n + 1))
        self.to = b.astype(np.int32 if n < 2**31 else np.int64)
        self.w = w
        self.degree = np.bincount(a, w, n) if w is not None else np.diff(self.first).astype(float)

    def __len__(self) -> int:
        return len(self.degree)

    def of(self, v: int) -> tuple[list[int], list[float] | None]:
        """The neighbours of v; None for weights of 1."""
        at = slice(self.first[v], self.first[v + 1])
        return self.to[at].tolist(), None if self.w is None else self.w[at].tolist()

    def merged(self, part: np.ndarray, n: int) -> tuple[Links, np.ndarray]:
        """The graph of n parts, and the weight within each."""
        a, b = np.repeat(part, np.diff(self.first)), part[self.to]
        inner = a == b
        within = np.bincount(a[inner], None if self.w is None else self.w[inner], n).astype(float)
        code = a[~inner] * n + b[~inner]
        del a, b
        pairs, at = np.unique(code, return_inverse=True)
        return Links(n, pairs // n, pairs % n, np.bincount(at, None if self.w is None else self.w[~inner], len(pairs)).astype(float)), within


def _gain_moves(links: Links, degree: np.ndarray, total: float, gamma: float, start: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
    """Local moving: entities go to the neighbouring community with the best gain until none gains. ``within`` limits moves to equal marks, and to entities that are alone."""
    n = len(links)
    most = max(n, int(start.max()) + 1)
    weight, size = np.bincount(start, degree, most).tolist(), np.bincount(start, minlength=most).tolist()
    community, own = start.tolist(), degree.tolist()
    marks = None if within is None else within.tolist()
    queue, waiting = range(n), bytearray(b"\1" * n)
    while queue:
        later = []
        for v in queue:
            waiting[v] = 0
            c = community[v]
            if marks is not None and size[c] > 1:
                continue
            near, w = links.of(v)
            sums = {c: 0.0}
            for i, u in enumerate(near):
                if marks is None or marks[u] == marks[v]:
                    d = community[u]
                    sums[d] = sums.get(d, 0.0) + (1.0 if w is None else w[i])
            weight[c] -= own[v]
            best, best_gain = c, sums[c] - gamma * own[v] * weight[c] / total
            for d in sorted(sums):
                gain = sums[d] - gamma * own[v] * weight[d] / total
                if gain > best_gain + 1e-12:
                    best, best_gain = d, gain
            weight[best] += own[v]
            if best != c:
                size[c] -= 1
                size[best] += 1
                community[v] = best
                if marks is None:
                    for u in near:
                        if community[u] != best and not waiting[u]:
                            waiting[u] = 1
                            later.append(u)
        queue = sorted(later)
    return np.array(community, np.int64)


def leiden(n: int, a: np.ndarray, b: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    """Communities of an unweighted undirected graph (both directions of each pair given): local moving, refinement, aggregation.

    Deterministic: entities are visited in order, and the smallest community wins ties.
    """
    loops, total = np.zeros(n), float(len(a))
    if not total:
        return np.arange(n)
    order = np.lexsort((b, a))
    links = Links(n, a[order], b[order])
    top = np.arange(n)  # the node of the aggregated graph that holds each entity
    community = np.arange(n)
    while True:
        size = len(links)
        degree = links.degree + loops
        community = _gain_moves(links, degree, total, gamma, community)
        parts, community = np.unique(community, return_inverse=True)
        if len(parts) == size:
            return community[top]
        fine = _gain_moves(links, degree, total, gamma, np.arange(size), within=community)
        kept, fine = np.unique(fine, return_inverse=True)
        if len(kept) == size:  # refinement joined nothing: aggregate the communities themselves
            kept, fine = np.arange(len(parts)), community
        up = np.zeros(len(kept), np.int64)
        up[fine] = community
        links, inner = links.merged(fine, len(kept))
        loops = np.bincount(fine, loops, len(kept)) + inner
        community, top = up, fine[top]


def modularity_of(a: np.ndarray, b: np.ndarray, community: np.ndarray) -> float:
    if not len(a):
        return 0.0
    degree = np.bincount(community[a], minlength=int(community.max()) + 1).astype(float)
    return float((community[a] == community[b]).sum() / len(a) - ((degree / len(a)) ** 2).sum())


def communities(edges: DataFrame, gamma: float = 1.0, config: Config = DEFAULT, local: bool | None = None) -> DataFrame:
    """leiden_id (numbered from 0 by smallest entity), leiden_size and leiden_modularity (of the window's whole partition).

    Every window goes to one Python worker, whatever its size and ``config``: entities move one after the other. It holds some
    40 bytes for each edge there.
    """

    def one(window: int, part: pd.DataFrame) -> pd.DataFrame:
        g = Graph(part)
        a, b = g.undirected()
        found = leiden(g.n, a, b, gamma)
        _, first, back = np.unique(found, return_index=True, return_inverse=True)
        number = np.argsort(np.argsort(first))[back]
        return g.frame(window, leiden_id=number.astype(np.int64), leiden_size=np.bincount(number)[number].astype(np.int64), leiden_modularity=np.full(g.n, modularity_of(a, b, number)))

    return per_window(edges, one, "leiden_id long, leiden_size long, leiden_modularity double", (W, "source", "target"))


def modularity(edges: DataFrame, labels: DataFrame, label: str = "component_id") -> DataFrame:
    """window_id, modularity of a given partition (window_id, entity_id, label) of the undirected graph without self-loops."""
    pairs = edges.where("source <> target").select(W, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    at = lambda c, n: labels.select(W, F.col("entity_id").alias(c), F.col(label).alias(n))
    joined = pairs.join(at("a", "la"), [W, "a"]).join(at("b", "lb"), [W, "b"])
    m = joined.groupBy(W).agg(F.count("*").alias("m"), F.count_if(F.col("la") == F.col("lb")).alias("inside"))
    k = joined.select(W, F.explode(F.array("la", "lb")).alias("l")).groupBy(W, "l").agg(F.count("*").alias("k"))
    squares = k.groupBy(W).agg(F.sum(F.col("k").cast("double") ** 2).alias("k2"))
    return m.join(squares, W).select(W, (F.col("inside") / F.col("m") - F.col("k2") / (4.0 * F.col("m").cast("double") ** 2)).alias("modularity"))
