"""Graph queries over all transfers, against brute force."""

from __future__ import annotations

from collections import defaultdict

import pytest

from ledgerloom.plans.registry import QUERIES


@pytest.fixture(scope="module")
def graphs(spark, sf):
    out = defaultdict(set)
    for r in QUERIES["window_edges"](spark, sf).collect():
        out[r.window_id].add((r.source, r.target))
    return out


def near(pairs):
    found = defaultdict(set)
    for a, b in pairs:
        found[a], found[b]
        if a != b:
            found[a].add(b)
            found[b].add(a)
    return found


def by_entity(df, column):
    return {(r.window_id, r.entity_id): r[column] for r in df.collect()}


@pytest.mark.parametrize("name", ["betweenness", "leiden_macro", "leiden_micro"])
def test_every_entity_is_there(spark, sf, graphs, name):
    got = QUERIES[name](spark, sf).select("window_id", "entity_id").collect()
    assert sorted(map(tuple, got)) == sorted((w, v) for w, pairs in graphs.items() for v in near(pairs))


def test_betweenness_of_all_transfers(spark, sf, graphs):
    got = by_entity(QUERIES["betweenness"](spark, sf), "betweenness")
    for w in (0, 13, 27):
        nodes, want = sorted(near(graphs[w])), defaultdict(float)
        for s in nodes:
            paths, frontier = {s: [[s]]}, {s: [[s]]}
            while frontier:
                step = defaultdict(list)
                for a, b in graphs[w]:
                    if a in frontier and b not in paths:
                        step[b] += [[*p, b] for p in frontier[a]]
                paths |= step
                frontier = step
            for t, ps in paths.items():
                for p in ps:
                    for v in p[1:-1]:
                        want[v] += 1 / len(ps)
        n = len(nodes)
        for v in nodes:
            assert got[w, v] == pytest.approx(want[v] / ((n - 1) * (n - 2)), abs=1e-7)


def test_cores_and_components_of_all_transfers(spark, sf, graphs):
    core, part, labelled = {}, {}, {}
    for w, pairs in graphs.items():
        for v in (links := near(pairs)):
            seen, todo = {v}, [v]
            while todo:
                todo += (new := links[todo.pop()] - seen)
                seen |= new
            part[w, v] = min(seen)
        left, k = {v: set(x) for v, x in links.items()}, 0
        while left:
            v = min(left, key=lambda x, left=left: len(left[x]))
            core[w, v] = k = max(k, len(left[v]))
            for u in left.pop(v):
                left[u].discard(v)
        undirected = {(min(p), max(p)) for p in pairs if p[0] != p[1]}
        m, weight = len(undirected), defaultdict(int)
        for a, b in undirected:
            weight[a % 5] += 1
            weight[b % 5] += 1
        labelled[w] = sum(a % 5 == b % 5 for a, b in undirected) / m - sum((x / 2 / m) ** 2 for x in weight.values())
    assert by_entity(QUERIES["k_core"](spark, sf), "k_core") == core
    assert by_entity(QUERIES["components"](spark, sf), "component_id") == part
    assert {r.window_id: r.modularity for r in QUERIES["modularity"](spark, sf).collect()} == pytest.approx(labelled, abs=1e-7)
    sizes = defaultdict(int)
    for (w, _), c in part.items():
        sizes[w, c] += 1
    assert {(r.window_id, r.community): r["size"] for r in QUERIES["community_stats"](spark, sf).collect()} == sizes
    bands, rings = (QUERIES[n](spark, sf).collect() for n in ("community_size_bands", "fraud_rings"))
    for w in graphs:
        assert sum(r.nodes for r in bands if r.window_id == w) == len(near(graphs[w]))
        assert [r.communities for r in rings if r.window_id == w] == [sum(x == w for x, _ in sizes)]


def test_long_cycles_of_all_transfers(spark, sf, graphs):
    want = defaultdict(int)
    for w, pairs in graphs.items():
        out, inn, next_ = defaultdict(int), defaultdict(int), defaultdict(set)
        for a, b in pairs:
            out[a] += 1
            inn[b] += 1
        ok = {v for v in out if inn[v] and out[v] + inn[v] <= 16}
        for a, b in pairs:
            if a in ok and b in ok:
                next_[a].add(b)

        def walk(path, w=w, next_=next_):
            for b in next_[path[-1]]:
                if b == path[0]:
                    for v in path:
                        want[w, v] += 1
                elif b > path[0] and b not in path and len(path) < 6:
                    walk([*path, b])

        for v in list(next_):
            walk([v])
    assert by_entity(QUERIES["cycles_le6"](spark, sf), "cycle_count") == want


def test_leiden_reports_add_up(spark, sf, graphs):
    """Communities are checked by their modularity; the reports by their sums over them."""
    found = by_entity(QUERIES["leiden_macro"](spark, sf), "leiden_id")
    marks = by_entity(QUERIES["entity_fraud"](spark, sf), "is_fraud")
    sizes, fraud = defaultdict(int), defaultdict(int)
    for (w, v), c in found.items():
        sizes[w, c] += 1
        fraud[w, c] += marks[w, v]
    stats = {(r.window_id, r.community): (r["size"], r.fraud_count) for r in QUERIES["leiden_stats"](spark, sf).collect()}
    assert stats == {k: (n, fraud[k]) for k, n in sizes.items()}
    of = lambda name: [r.asDict() for r in QUERIES[name](spark, sf).collect()]
    bands, rings, top, conc = of("leiden_size_bands"), of("leiden_rings"), of("leiden_top"), of("leiden_concentration")
    for w in graphs:
        mine = {k: n for k, n in sizes.items() if k[0] == w}
        assert sum(r["nodes"] for r in bands if r["window_id"] == w) == sum(mine.values())
        assert [r["communities"] for r in rings + conc if r["window_id"] == w] == [len(mine)] * 2
        order = sorted((k for k, n in mine.items() if n >= 3), key=lambda k: (-fraud[k] / mine[k], -mine[k], k[1]))[:10]
        assert [r["community"] for r in sorted((r for r in top if r["window_id"] == w), key=lambda r: r["rank"])] == [c for _, c in order]
        assert [r["fraud"] for r in conc if r["window_id"] == w] == [sum(fraud[k] for k in mine)]


def test_entities_without_a_community_are_left_out(spark):
    from ledgerloom.operators import reports

    rows = spark.createDataFrame([(0, 1, 4, 1), (0, 2, 4, 0), (0, 3, -1, 1)], "window_id long, entity_id long, leiden_macro_id long, is_fraud int")
    r = reports.concentration(rows, "leiden_macro_id").first()
    assert (r.nodes, r.fraud, r.communities, r.with_fraud, r.fraud_only, r.communities_pct) == (2, 1, 1, 1, 0, 50.0)
