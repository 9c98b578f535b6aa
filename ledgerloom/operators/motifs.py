"""Graph features that are joins and aggregations over the edges of all windows at once.

Edges are distinct by (window_id, source, target). Every function returns rows
keyed by window_id and entity_id; entities without a value have no row.

Pairs over a mid, cycles and triangles are found from many more paths than there
are results. Windows that fit in a Python worker (``Config.local_edges``) are
searched there, a block of paths at a time; in larger ones the paths are joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT, Config
from ledgerloom.operators.iterative import Graph, fits, per_window

W = "window_id"


def degrees(edges: DataFrame) -> DataFrame:
    """window_id, entity_id, out_n, in_n: neighbours in each direction, a self-loop being one in both."""
    ends = F.array(F.struct(F.col("source").alias("entity_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("entity_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    each = edges.select(W, F.explode(ends).alias("x")).select(W, "x.*")
    return each.groupBy(W, "entity_id").agg(F.sum("o").alias("out_n"), F.sum("i").alias("in_n"))


def fans(edges: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """fan_out_count and fan_in_count: 1 if the degree lies between the bounds."""
    flag = lambda c: F.col(c).between(config.fan_least, config.degree_most).cast("long")
    return degrees(edges).select(W, "entity_id", flag("out_n").alias("fan_out_count"), flag("in_n").alias("fan_in_count"))


#: Entities whose paths a worker follows at once.
BLOCK = 1024


class Steps:
    """Edges between numbered entities, by their first end."""

    def __init__(self, s: np.ndarray, t: np.ndarray, n: int) -> None:
        order = np.lexsort((t, s))
        self.to, self.size = t[order], np.bincount(s, minlength=n)
        self.start = np.cumsum(self.size) - self.size

    def spread(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``at`` each step comes from, and the step's number."""
        size = self.size[at]
        came = np.repeat(np.arange(len(at)), size)
        return came, np.arange(len(came)) - np.repeat(np.cumsum(size) - size - self.start[at], size)


def _pairs_over_mids(g: Graph, most: int) -> tuple[np.ndarray, np.ndarray]:
    """scatter_gather_count and gather_scatter_count of each entity."""
    out, inn = np.bincount(g.s, minlength=g.n), np.bincount(g.t, minlength=g.n)
    ends = (inn >= 2) & (inn <= most)
    all_steps = Steps(g.s, g.t, g.n)
    into = Steps(g.s[ends[g.t]], g.t[ends[g.t]], g.n)
    keys = np.sort(g.s * np.int64(g.n) + g.t)
    scatters, gathers = np.zeros(g.n, np.int64), np.zeros(g.n, np.int64)
    starts = np.flatnonzero((out >= 2) & (out <= most))
    for b in range(0, len(starts), BLOCK):
        u = starts[b : b + BLOCK]
        came, step = all_steps.spread(u)
        u, mid = u[came], all_steps.to[step]
        low = out[mid] <= most
        came, step = into.spread(mid[low])
        first, v = u[low][came], into.to[step]
        code, count = np.unique((first * np.int64(g.n) + v)[first != v], return_counts=True)
        if len(code) and not low.all():  # mids with many edges out find no pair, but count in those that others find
            big = Steps(u[~low], mid[~low], g.n)
            came, step = big.spread(code // g.n)
            want = big.to[step] * np.int64(g.n) + code[came] % g.n
            count += np.bincount(came, keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want, len(code)).astype(np.int64)
        code = code[count >= 2]
        scatters += np.bincount(code // g.n, minlength=g.n)
        gathers += np.bincount(code % g.n, minlength=g.n)
    return scatters, gathers


def scatter_gather(edges: DataFrame, config: Config = DEFAULT, local: bool | None = None) -> DataFrame:
    """scatter_gather_count for sources and gather_scatter_count for targets of pairs with two or more shared mids.

    A pair is found over a mid of limited out-degree; then all successors of its
    source count as mids. Sources, targets and finding mids have at most
    ``degree_most`` edges, so each edge meets a bounded number of others, and no
    hub multiplies rows.
    """
    most = config.degree_most
    if fits(edges, config) if local is None else local:

        def one(window: int, part: pd.DataFrame) -> pd.DataFrame:
            g = Graph(part)
            scatters, gathers = _pairs_over_mids(g, most)
            found = g.frame(window, scatter_gather_count=scatters, gather_scatter_count=gathers)
            return found[(scatters > 0) | (gathers > 0)]

        return per_window(edges, one, "scatter_gather_count long, gather_scatter_count long")
    d = degrees(edges)
    out = d.select(W, F.col("entity_id").alias("source"), F.col("out_n").alias("n")).where(F.col("n") <= most)
    inn = d.select(W, F.col("entity_id").alias("target"), F.col("in_n").alias("n")).where(F.col("n").between(2, most))
    e = edges.select(W, "source", "target")
    low = e.join(out, [W, "source"], "left_semi")
    scatter = e.join(out.where("n >= 2"), [W, "source"], "left_semi").select(W, F.col("source").alias("u"), F.col("target").alias("mid"))
    gather = e.join(inn, [W, "target"], "left_semi").select(W, F.col("source").alias("mid"), F.col("target").alias("v"))
    mids = low.select(W, F.col("source").alias("mid"), F.col("target").alias("v")).join(inn.select(W, F.col("target").alias("v")), [W, "v"], "left_semi")
    pairs = scatter.join(mids, [W, "mid"]).where("u <> v").select(W, "u", "v").distinct()
    shared = pairs.join(scatter, [W, "u"]).join(gather, [W, "mid", "v"], "left_semi").groupBy(W, "u", "v").count().where("count >= 2")
    ends = F.array(F.struct(F.col("u").alias("entity_id"), F.lit(1).alias("s"), F.lit(0).alias("g")), F.struct(F.col("v").alias("entity_id"), F.lit(0).alias("s"), F.lit(1).alias("g")))
    return shared.select(W, F.explode(ends).alias("x")).groupBy(W, F.col("x.entity_id").alias("entity_id")).agg(F.sum("x.s").alias("scatter_gather_count"), F.sum("x.g").alias("gather_scatter_count"))


def _halves(steps: Steps, starts: np.ndarray, longest: int) -> list[np.ndarray]:
    """Simple paths of 1 to ``longest`` steps from each start over larger entities: arrays with a column for each entity."""
    paths, found = starts[:, None], []
    for _ in range(longest):
        came, step = steps.spread(paths[:, -1])
        after = steps.to[step]
        ok = after > paths[came, 0]
        for k in range(1, paths.shape[1]):
            ok &= after != paths[came, k]
        paths = np.concatenate([paths[came[ok]], after[ok, None]], 1)
        found.append(paths)
    return found


def _cycle_counts(g: Graph, length: int, most: int) -> np.ndarray:
    """Cycles through each entity. Each is met once: at its smallest entity, as a path along the edges and one against them with the same end and nothing else in common."""
    out, inn = np.bincount(g.s, minlength=g.n), np.bincount(g.t, minlength=g.n)
    ok = (out > 0) & (inn > 0) & (out + inn <= most)
    keep = ok[g.s] & ok[g.t]
    s, t = g.s[keep], g.t[keep]
    counts = np.bincount(s[s == t], minlength=g.n)
    if length < 1:
        return np.zeros(g.n, np.int64)
    s, t = s[s != t], t[s != t]
    there, back = Steps(s, t, g.n), Steps(t, s, g.n)
    starts = np.unique(s)
    for b in range(0, len(starts), BLOCK):
        forward = _halves(there, starts[b : b + BLOCK], (length + 1) // 2)
        backward = _halves(back, starts[b : b + BLOCK], length // 2)
        for n in range(2, length + 1):
            f, r = forward[(n + 1) // 2 - 1], backward[n // 2 - 1]
            end = r[:, 0] * np.int64(g.n) + r[:, -1]
            order = np.argsort(end, kind="stable")
            end, want = end[order], f[:, 0] * np.int64(g.n) + f[:, -1]
            low = np.searchsorted(end, want, "left")
            size = np.searchsorted(end, want, "right") - low
            came = np.repeat(np.arange(len(f)), size)
            met = order[np.arange(len(came)) - np.repeat(np.cumsum(size) - size - low, size)]
            f, r = f[came], r[met][:, 1:-1]
            apart = ~(f[:, :, None] == r[:, None, :]).any((1, 2))
            counts += np.bincount(f[apart].ravel(), minlength=g.n) + np.bincount(r[apart].ravel(), minlength=g.n)
    return counts


def cycles(edges: DataFrame, length: int = DEFAULT.cycle_length, config: Config = DEFAULT, local: bool | None = None) -> DataFrame:
    """cycle_count: simple directed cycles of up to ``length`` edges through entities with at most ``degree_most`` edges.

    Paths start at a cycle's smallest entity and grow by one edge a step; the
    bound on degrees bounds how often a path forks.
    """
    if fits(edges, config) if local is None else local:
        most = config.degree_most

        def one(window: int, part: pd.DataFrame) -> pd.DataFrame:
            g = Graph(part)
            found = g.frame(window, cycle_count=_cycle_counts(g, length, most))
            return found[found["cycle_count"] > 0]

        return per_window(edges, one, "cycle_count long")
    ok = degrees(edges).where((F.col("in_n") > 0) & (F.col("out_n") > 0) & (F.col("in_n") + F.col("out_n") <= config.degree_most)).select(W, "entity_id")
    e = edges.select(W, "source", "target").join(ok.withColumnRenamed("entity_id", "source"), [W, "source"], "left_semi").join(ok.withColumnRenamed("entity_id", "target"), [W, "target"], "left_semi")
    step = e.select(W, F.col("source").alias("last"), F.col("target").alias("next"))
    paths = e.where("source < target").select(W, F.array("source", "target").alias("path"), F.col("target").alias("last"))
    found = e.where("source = target").select(W, F.array("source").alias("path"))
    for n in range(2, length + 1):
        grown = paths.join(step, [W, "last"])
        found = found.unionAll(grown.where(F.col("next") == F.col("path")[0]).select(W, "path"))
        if n < length:
            more = grown.where((F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next")))
            paths = more.select(W, F.concat("path", F.array("next")).alias("path"), F.col("next").alias("last"))
    return found.select(W, F.explode("path").alias("entity_id")).groupBy(W, "entity_id").agg(F.count("*").alias("cycle_count"))


def egonets(edges: DataFrame, triangles: DataFrame | None = None) -> DataFrame:
    """Entity with its successors: nodes, edges among them, density, and total volume.

    Edges between two successors close a triangle with the ego, so they are read
    off the triangles, each found once from its end with the fewest neighbours;
    all others touch the ego or are self-loops of a successor. No row is made for
    each path over a hub.
    """
    e = edges.select(W, "source", "target", F.coalesce("volume", F.lit(0.0)).alias("volume"))
    loops = e.where("source = target").select(W, F.col("source").alias("target"), F.col("volume").alias("loop"))
    pairs = _pairs(edges)
    both = pairs.where("ways = 2").select(W, "a", "b", "ab", "ba")
    # to the ego: its edges out, its own loop, edges back from successors, and their loops
    one = F.lit(1).cast("long")
    out = e.select(W, F.col("source").alias("ego"), one.alias("m"), "volume", (F.col("source") != F.col("target")).cast("long").alias("n"))
    back = both.select(W, F.explode(F.array(F.struct(F.col("a").alias("ego"), F.col("ba").alias("volume")), F.struct(F.col("b").alias("ego"), F.col("ab").alias("volume")))).alias("x"))
    back = back.select(W, "x.ego", one.alias("m"), "x.volume", F.lit(0).cast("long").alias("n"))
    theirs = e.where("source <> target").join(loops, [W, "target"]).select(W, F.col("source").alias("ego"), one.alias("m"), F.col("loop").alias("volume"), F.lit(0).cast("long").alias("n"))
    # x, y, z: an ego that has edges to both others gets the edges between them
    t = triangles_of(pairs) if triangles is None else triangles

    def seen(ego: str, a: str, b: str) -> list:
        ok = F.col(ego + a).isNotNull() & F.col(ego + b).isNotNull()
        return [F.when(ok & F.col(c).isNotNull(), F.struct(F.col(ego).alias("ego"), F.col(c).alias("volume"))) for c in (a + b, b + a)]

    inner = t.select(W, F.explode(F.filter(F.array(*seen("x", "y", "z"), *seen("y", "x", "z"), *seen("z", "x", "y")), lambda s: s.isNotNull())).alias("s"))
    inner = inner.select(W, "s.ego", one.alias("m"), "s.volume", F.lit(0).cast("long").alias("n"))
    ends = degrees(edges).select(W, F.col("entity_id").alias("ego"), F.lit(0).cast("long").alias("m"), F.lit(0.0).alias("volume"), one.alias("n"))
    sums = ends.unionAll(out).unionAll(back).unionAll(theirs).unionAll(inner).groupBy(W, "ego").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("volume").alias("volume"))
    density = F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return sums.select(W, F.col("ego").alias("entity_id"), F.col("n").alias("egonet_node_count"), F.col("m").alias("egonet_edge_count"), density.alias("egonet_density"), F.col("volume").alias("egonet_total_weight"))


def _pairs(edges: DataFrame) -> DataFrame:
    """Undirected pairs a < b: the volumes ab and ba (null without that edge), their number, and g, the sum of the cube roots of both over the window's largest."""
    e = edges.select(W, "source", "target", F.coalesce("volume", F.lit(0.0)).alias("volume"))
    top = e.groupBy(W).agg(F.max("volume").alias("top"))
    scaled = e.where("source <> target").join(top, W).withColumn("g", F.cbrt(F.coalesce(F.try_divide("volume", "top"), F.lit(0.0))))
    way = lambda a, b: F.max(F.when(F.col("source") == F.least("source", "target"), F.col("volume")) if a < b else F.when(F.col("source") == F.greatest("source", "target"), F.col("volume"))).alias(a + b)
    return scaled.groupBy(W, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum("g").alias("g"), F.count("*").alias("ways"), way("a", "b"), way("b", "a"))


def _closed(part: pd.DataFrame, kind: list[str]) -> pd.DataFrame:
    """The triangles of one window's pairs."""
    ids, both = np.unique(np.concatenate([part["a"].to_numpy(), part["b"].to_numpy()]), return_inverse=True)
    n, a, b = len(ids), both[: len(part)], both[len(part) :]
    near = np.bincount(both, minlength=n)
    first = (near[a] < near[b]) | ((near[a] == near[b]) & (a < b))
    s, t = np.where(first, a, b), np.where(first, b, a)
    order = np.lexsort((t, s))
    s, t, first = s[order], t[order], first[order]
    g, ab, ba = (part[c].to_numpy(float)[order] for c in ("g", "ab", "ba"))
    st, ts = np.where(first, ab, ba), np.where(first, ba, ab)
    keys = s * np.int64(n) + t
    steps = Steps(s, t, n)
    found = []
    for c in range(0, len(s), 64 * BLOCK):  # a pair and each later one from the same end; their other ends may be a pair either way
        one, two = steps.spread(s[c : c + 64 * BLOCK])
        one += c
        one, two = one[two > one], two[two > one]
        m, t2 = t[one], t[two]
        turned = (near[t2] < near[m]) | ((near[t2] == near[m]) & (t2 < m))
        one, two = np.where(turned, two, one), np.where(turned, one, two)
        want = t[one] * np.int64(n) + t[two]
        third = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        ok = keys[third] == want
        found.append((one[ok], two[ok], third[ok]))
    one, two, third = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
    columns = {"x": ids[s[one]], "y": ids[t[one]], "z": ids[t[two]], "xy": st[one], "yx": ts[one], "xz": st[two], "zx": ts[two], "yz": st[third], "zy": ts[third], "p": g[one] * g[two] * g[third]}
    return pd.DataFrame({c: columns[c] for c in kind})


def triangles_of(pairs: DataFrame, config: Config = DEFAULT, local: bool | None = None) -> DataFrame:
    """window_id, x, y, z, the volumes xy, yx, xz, zx, yz, zy (null without that edge) and p, the product of the three weights, once for each triangle.

    Pairs point from the end with fewer neighbours to the other, so the wedges
    at a hub are those of its few out-edges.
    """
    if fits(pairs, config) if local is None else local:
        names = ["x", "y", "z", "xy", "yx", "xz", "zx", "yz", "zy", "p"]
        kind = pairs.schema["a"].dataType.simpleString()

        def one(window: int, part: pd.DataFrame) -> pd.DataFrame:
            return _closed(part, names).assign(**{W: window})

        schema = f"x {kind}, y {kind}, z {kind}, " + ", ".join(f"{c} double" for c in names[3:])
        found = per_window(pairs, one, schema, (W, "a", "b", "g", "ab", "ba"))
        return found.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in names[3:9]})
    ends = F.array("a", "b")
    n = pairs.select(W, F.explode(ends).alias("x")).groupBy(W, "x").agg(F.count("*").alias("n"))
    r = pairs.join(n.select(W, F.col("x").alias("a"), F.col("n").alias("na")), [W, "a"]).join(n.select(W, F.col("x").alias("b"), F.col("n").alias("nb")), [W, "b"])
    first = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    at = lambda c, k: F.struct(F.col(f"n{c}").alias("n"), F.col(c).alias("id")).alias(k)
    o = r.select(W, F.when(first, at("a", "s")).otherwise(at("b", "s")).alias("s"), F.when(first, at("b", "t")).otherwise(at("a", "t")).alias("t"), "g", F.when(first, F.col("ab")).otherwise(F.col("ba")).alias("st"), F.when(first, F.col("ba")).otherwise(F.col("ab")).alias("ts"))
    one = o.select(W, "s", F.col("t").alias("m"), F.col("g").alias("g1"), F.col("st").alias("xy"), F.col("ts").alias("yx"))
    two = o.select(W, "s", F.col("t").alias("t2"), F.col("g").alias("g2"), F.col("st").alias("xz"), F.col("ts").alias("zx"))
    wedges = one.join(two, [W, "s"]).where("m < t2")
    third = o.select(W, F.col("s").alias("m"), F.col("t").alias("t2"), F.col("g").alias("g3"), F.col("st").alias("yz"), F.col("ts").alias("zy"))
    closed = wedges.join(third, [W, "m", "t2"])
    return closed.select(W, F.col("s.id").alias("x"), F.col("m.id").alias("y"), F.col("t2.id").alias("z"), "xy", "yx", "xz", "zx", "yz", "zy", (F.col("g1") * F.col("g2") * F.col("g3")).alias("p"))


def triangle_counts(edges: DataFrame, triangles: DataFrame | None = None) -> DataFrame:
    """triangle_count: undirected triangles through the entity."""
    t = triangles_of(_pairs(edges)) if triangles is None else triangles
    return t.select(W, F.explode(F.array("x", "y", "z")).alias("entity_id")).groupBy(W, "entity_id").agg(F.count("*").alias("triangle_count"))


def clustering(edges: DataFrame, triangles: DataFrame | None = None) -> DataFrame:
    """local_clustering_coefficient: weighted and directed, as the geometric mean of triangle volumes over possible triangles."""
    pairs = _pairs(edges)
    t = (triangles_of(pairs) if triangles is None else triangles).select(W, F.explode(F.array("x", "y", "z")).alias("entity_id"), "p").groupBy(W, "entity_id").agg(F.sum("p").alias("p"))
    d = pairs.select(W, F.explode(F.array("a", "b")).alias("entity_id"), "ways").groupBy(W, "entity_id").agg(F.sum("ways").alias("total"), F.count_if(F.col("ways") == 2).alias("mutual"))
    possible = F.col("total") * (F.col("total") - 1) - 2 * F.col("mutual")
    return d.join(t, [W, "entity_id"]).select(W, "entity_id", F.coalesce(F.try_divide("p", possible), F.lit(0.0)).alias("local_clustering_coefficient"))


def neighbours(edges: DataFrame) -> DataFrame:
    """average_neighbor_degree (mean out-degree of successors), successor_avg_volume, successor_max_volume."""
    out = edges.groupBy(W, F.col("source").alias("target")).agg(F.count("*").alias("n"))
    joined = edges.select(W, "source", "target", F.coalesce("volume", F.lit(0.0)).alias("volume")).join(out, [W, "target"], "left")
    return joined.groupBy(W, F.col("source").alias("entity_id")).agg(F.avg(F.coalesce("n", F.lit(0))).alias("average_neighbor_degree"), F.avg("volume").alias("successor_avg_volume"), F.max("volume").alias("successor_max_volume"))
