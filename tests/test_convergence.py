"""PageRank and HITS iterate until they have converged."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerloom.config import Config
from ledgerloom.operators import iterative

SCHEMA = "window_id long, source long, target long, volume double, count long"
#: Two stars of almost the same weight, tied by a long path: HITS needs hundreds of rounds.
SPARSE = [(0, k) for k in range(1, 7)] + [(10, k) for k in range(11, 16)] + [(0, 20), (21, 20), (21, 22), (10, 22)]


@pytest.fixture(scope="module")
def sparse(spark):
    return spark.createDataFrame([(0, a, b, 1.0, 1) for a, b in SPARSE], SCHEMA)


def test_hits_are_the_principal_eigenvectors(sparse):
    ids = sorted({v for e in SPARSE for v in e})
    m = np.zeros((len(ids), len(ids)))
    for a, b in SPARSE:
        m[ids.index(a), ids.index(b)] = 1
    hub, auth = (np.abs(np.linalg.eigh(x)[1][:, -1]) for x in (m @ m.T, m.T @ m))
    got = {r.entity_id: r for r in iterative.hits(sparse).collect()}
    for v, h, a in zip(ids, hub / hub.sum(), auth / auth.sum()):
        assert got[v].hits_hub == pytest.approx(h, abs=1e-6) and got[v].hits_auth == pytest.approx(a, abs=1e-6)


@pytest.mark.parametrize("local", [True, False])
def test_too_few_rounds_raise(sparse, local):
    config = Config(hits_rounds=21, pagerank_rounds=20, pagerank_tolerance=0.0)
    for f in (iterative.hits, iterative.pagerank):
        with pytest.raises(Exception, match="didn't reach its tolerance"):
            f(sparse, config=config, local=local).collect()


def test_both_ways_agree_when_converged(spark):
    edges = spark.createDataFrame([(0, 1, 2, 1.0, 1), (0, 2, 3, 2.0, 1), (0, 3, 1, 4.0, 1), (0, 1, 3, 1.0, 1)], SCHEMA)
    for f in (iterative.hits, iterative.pagerank):
        one, two = ({r.entity_id: tuple(r)[2:] for r in f(edges, local=x).collect()} for x in (True, False))
        assert one.keys() == two.keys()
        for v in one:
            assert one[v] == pytest.approx(two[v], abs=1e-5)
