"""Graph operators on small graphs, against brute force and each other."""

from __future__ import annotations

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from ledgerloom.operators import iterative, motifs

SHAPES = {
    "self_loop": [(1, 1, 5.0)],
    "two_cycle": [(1, 2, 1.0), (2, 1, 3.0)],
    "triangle": [(1, 2, 1.0), (2, 3, 2.0), (3, 1, 4.0)],
    "dangling": [(1, 2, 1.0)],
    "scatter": [(0, 1, 1.0), (0, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)],
    "scatter_hub": [(0, 1, 1.0), (0, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)] + [(1, k, 1.0) for k in range(4, 21)],
    "cliques": [(a, b, 1.0) for g in ((0, 1, 2, 3), (4, 5, 6, 7)) for a, b in itertools.combinations(g, 2)] + [(3, 4, 1.0)],
}
for n in (5, 6, 16, 17):
    SHAPES[f"star_{n}"] = [(0, k, 1.0) for k in range(1, n + 1)]
NAMES = list(SHAPES)
RANDOM = random.Random(5)
for k in range(8):
    size = RANDOM.randint(4, 9)
    SHAPES[f"random_{k}"] = [(a, b, float(RANDOM.randint(1, 9))) for a in range(size) for b in range(size) if RANDOM.random() < 0.3] or [(0, 1, 1.0)]
ALL = list(SHAPES)


@pytest.fixture(scope="module")
def edges(spark):
    """All graphs at once, a window each."""
    rows = [(w, a, b, v, 1) for w, name in enumerate(ALL) for a, b, v in SHAPES[name]]
    return spark.createDataFrame(rows, "window_id long, source long, target long, volume double, count long").repartition(3)


def of(df, *columns):
    out = defaultdict(dict)
    for r in df.collect():
        out[ALL[r.window_id]][r.entity_id] = tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]]
    return out


def test_fans(edges):
    got = of(motifs.fans(edges), "fan_out_count", "fan_in_count")
    assert [got[f"star_{n}"][0] for n in (5, 6, 16, 17)] == [(0, 0), (1, 0), (1, 0), (0, 0)]


def test_scatter_gather(edges):
    got = of(motifs.scatter_gather(edges), "scatter_gather_count", "gather_scatter_count")
    for shape in ("scatter", "scatter_hub"):
        assert got[shape] == {0: (1, 0), 3: (0, 1)}


def test_cycles(edges):
    got = of(motifs.cycles(edges, 6), "cycle_count")
    for name, shape in SHAPES.items():
        next_, want = defaultdict(set), defaultdict(int)
        out, inn = defaultdict(int), defaultdict(int)
        for a, b, _ in shape:
            out[a] += 1
            inn[b] += 1
        ok = {v for v in out if inn[v] and out[v] + inn[v] <= 16}
        for a, b, _ in shape:
            if a in ok and b in ok:
                next_[a].add(b)

        def walk(path, next_=next_, want=want):
            for b in next_[path[-1]]:
                if b == path[0]:
                    for v in path:
                        want[v] += 1
                elif b > path[0] and b not in path and len(path) < 6:
                    walk([*path, b])

        for v in list(next_):
            walk([v])
        assert got.get(name, {}) == dict(want), name


def test_egonets(edges):
    got = of(motifs.egonets(edges), "egonet_node_count", "egonet_edge_count", "egonet_density", "egonet_total_weight")
    assert got["self_loop"][1] == (1, 1, 0.0, 5.0)
    for name, shape in SHAPES.items():
        for v in {x for a, b, _ in shape for x in (a, b)}:
            m = {v} | {b for a, b, _ in shape if a == v}
            inner = [w for a, b, w in shape if a in m and b in m]
            n = len(m)
            assert got[name][v] == pytest.approx((n, len(inner), len(inner) / (n * (n - 1)) if n > 1 else 0, sum(inner)))


def test_triangles_and_clustering(edges):
    counts, coefficients = of(motifs.triangle_counts(edges), "triangle_count"), of(motifs.clustering(edges), "local_clustering_coefficient")
    for name, shape in SHAPES.items():
        top = max(w for _, _, w in shape)
        w = {(a, b): v for a, b, v in shape if a != b}
        ids = sorted({x for p in w for x in p})
        g = lambda a, b, w=w, top=top: (w[a, b] / top) ** (1 / 3) * ((a, b) in w) if (a, b) in w else 0.0
        for v in ids:
            pairs = [(a, b) for a, b in itertools.combinations(ids, 2) if v not in (a, b) and all((x, y) in w or (y, x) in w for x, y in ((v, a), (v, b), (a, b)))]
            assert counts.get(name, {}).get(v, 0) == len(pairs)
            total = 0.0
            for a, b in pairs:
                for f in itertools.product((0, 1), repeat=3):
                    e = [(v, a), (a, b), (b, v)]
                    total += math.prod(g(*(p if k else p[::-1])) for p, k in zip(e, f))
            d = sum(v in p for p in w)
            mutual = sum((b, a) in w for a, b in w if a == v)
            want = total / (d * (d - 1) - 2 * mutual) if pairs else 0.0
            assert coefficients.get(name, {}).get(v, 0.0) == pytest.approx(want)


@pytest.mark.parametrize("name", ["pagerank", "hits", "k_core", "components", "betweenness"])
def test_local_and_distributed_agree(edges, name):
    f = getattr(iterative, name)
    extra = {"rounds": 6} if name in ("pagerank", "hits") else {}
    a, b = (f(edges, local=x, **extra) for x in (True, False))
    columns = [c for c in a.columns if c not in ("window_id", "entity_id")]
    one, two = of(a, *columns), of(b, *columns)
    assert one.keys() == two.keys()
    for w in one:
        assert one[w].keys() == two[w].keys()
        for v in one[w]:
            assert one[w][v] == pytest.approx(two[w][v])


def test_pagerank_adds_up(edges):
    for w in of(iterative.pagerank(edges), "pagerank").values():
        assert sum(w.values()) == pytest.approx(1)


def test_cores_and_components(edges):
    core, part = of(iterative.k_core(edges), "k_core"), of(iterative.components(edges), "component_id")
    assert core["cliques"] == {v: 3 for v in range(8)}
    assert core["self_loop"] == {1: 0}
    assert part["cliques"] == {v: 0 for v in range(8)}


def test_betweenness_is_exact_with_all_pivots(edges):
    got = of(iterative.betweenness(edges), "betweenness")
    for name, shape in SHAPES.items():
        ids = sorted({x for a, b, _ in shape for x in (a, b)})
        next_ = defaultdict(set)
        for a, b, _ in shape:
            if a != b:
                next_[a].add(b)
        want = dict.fromkeys(ids, 0.0)
        for s in ids:
            paths = {s: [[s]]}
            frontier = {s: [[s]]}
            while frontier:
                step = defaultdict(list)
                for v, ps in frontier.items():
                    for b in next_[v]:
                        if b not in paths:
                            step[b] += [[*p, b] for p in ps]
                paths |= step
                frontier = step
            for t, ps in paths.items():
                for v in ids:
                    if v not in (s, t) and t != s:
                        want[v] += sum(v in p for p in ps) / len(ps)
        n = len(ids)
        for v in ids:
            assert got[name][v] == pytest.approx(want[v] / ((n - 1) * (n - 2)) if n > 2 else 0.0), name


def test_communities_find_planted_groups(edges):
    got = of(iterative.communities(edges), "leiden_id", "leiden_size", "leiden_modularity")
    assert {v: r[0] for v, r in got["cliques"].items()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1}
    assert all(r[1] == 4 and 0.3 < r[2] < 0.5 for r in got["cliques"].values())
    assert got["self_loop"][1][1] == 1


def test_leiden_on_planted_partition():
    random = np.random.default_rng(1)
    mark = np.arange(60) // 15
    a, b = np.nonzero(np.triu(random.random((60, 60)) < np.where(mark[:, None] == mark, 0.6, 0.03), 1))
    found = iterative.leiden(60, np.concatenate([a, b]), np.concatenate([b, a]))
    assert len({(m, f) for m, f in zip(mark, found)}) == 4


def test_modularity_of_a_partition(spark, edges):
    labels = spark.createDataFrame([(ALL.index("cliques"), v, v // 4) for v in range(8)], "window_id long, entity_id long, component_id long")
    got = iterative.modularity(edges.where(edges.window_id == ALL.index("cliques")), labels).first().modularity
    assert got == pytest.approx(12 / 13 - 2 * (13 / 26) ** 2)
