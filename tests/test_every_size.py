"""The models and communities take one way at every size of the input."""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from ledgerloom.config import Config
from ledgerloom.models import forward
from ledgerloom.models.boosting import Booster
from ledgerloom.models.packed import Packed
from ledgerloom.operators import iterative
from tests.test_parts import SMALL, _features


def test_packed_rows_train_like_an_array():
    r = np.random.default_rng(5)
    x = np.column_stack([r.normal(size=700), r.poisson(2, 700), r.exponential(size=700)]).astype(np.float32)
    y = (x[:, 0] + x[:, 1] > 2).astype(float)
    p = Packed(3, block=64)
    for a in range(0, 700, 50):
        p.append(x[a : a + 50])
    assert p.shape == x.shape and all((p.column(j) == x[:, j]).all() for j in range(3))
    assert (p[130:500].column(1) == x[130:500, 1]).all() and (np.concatenate(list(p[130:500][10:].parts())) == x[140:500]).all()
    assert (p.chosen(y > 0).column(2) == x[y > 0, 2]).all() and not len(p[700:]) and not len(p[700:].column(0))
    for train, rest in ((slice(0, 560), slice(560, 700)), (slice(3, 130), slice(0, 700))):
        one, two = (Booster(SMALL).fit(t[train], y[train]) for t in (x, p))
        assert (one.predict(x[rest]) == two.predict(p[rest])).all() and (one.fitted == two.fitted).all()


def test_the_cascade_has_no_bound(spark, monkeypatch):
    """it raised where the table was larger than Config's bound."""
    monkeypatch.setattr(forward, "fits", lambda *a: False)
    assert len(forward.cascade(_features(spark), ["signal", "noise"], replace(SMALL, trees=2)).collect()) == 160


def test_attributions_have_no_bound(spark, monkeypatch):
    """they raised where the table was larger than Config's bound."""
    monkeypatch.setattr(forward, "fits", lambda *a: False)
    few = replace(SMALL, trees=2)
    assert len(forward.importance(_features(spark), ["signal", "noise"], few).collect()) == 2
    assert forward.judged(_features(spark), ["signal", "noise"], few).where("feature IS NULL").count() == 160


def test_forward_chaining_is_the_same_at_every_size(spark, monkeypatch):
    """beyond Config's bound other models were trained, one after the other."""
    few = replace(SMALL, trees=2)
    one = sorted(map(tuple, forward.forward_chain(_features(spark), ["signal", "noise"], few).collect()))
    monkeypatch.setattr(forward, "fits", lambda *a: False)
    two = sorted(map(tuple, forward.forward_chain(_features(spark), ["signal", "noise"], few).collect()))
    assert one == two and len(one) == 160


def test_leiden_communities_are_the_same_at_every_size(spark):
    """F11 to F17: windows over local_edges had their components as communities. Two triangles with a bridge are one component."""
    e = spark.createDataFrame([(0, a, b, 1.0, 1) for a, b in ((1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4))], "window_id long, source long, target long, volume double, count long")
    for config, local in ((Config(), None), (Config(local_edges=2), None), (Config(), False)):
        found = {r.entity_id: (r.leiden_id, r.leiden_size) for r in iterative.communities(e, config=config, local=local).collect()}
        assert found == {1: (0, 3), 2: (0, 3), 3: (0, 3), 4: (1, 3), 5: (1, 3), 6: (1, 3)}


def test_weights_of_merged_nodes_add_up():
    r = np.random.default_rng(2)
    code = np.unique(r.integers(0, 40 * 40, 300))
    code = code[code // 40 != code % 40]
    a, b = np.unique(np.concatenate([code, code % 40 * 40 + code // 40])) // 40, np.unique(np.concatenate([code, code % 40 * 40 + code // 40])) % 40
    links, part = iterative.Links(40, a, b), r.integers(0, 6, 40)
    part[:6] = range(6)
    merged, within = links.merged(part, 6)
    want = np.zeros((6, 6))
    np.add.at(want, (part[a], part[b]), 1)
    got = np.diag(within)
    for v in range(6):
        to, w = merged.of(v)
        got[v, to] += w
    assert (got == want).all() and (merged.degree + within == want.sum(1)).all()
