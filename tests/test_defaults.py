"""Queries run with the operators' own parameters."""

from __future__ import annotations

from ledgerloom.config import DEFAULT
from ledgerloom.operators import features
from ledgerloom.plans import queries
from ledgerloom.plans.registry import QUERIES


def test_feature_table_counts_long_cycles(spark, sf):
    want = {(r.window_id, r.entity_id): r.cycle_count for r in QUERIES["cycles_le6"](spark, sf).collect()}
    got = {(r.window_id, r.entity_id): r.cycle_count for r in QUERIES["feature_table"](spark, sf).collect() if r.cycle_count}
    short = {(r.window_id, r.entity_id): r.cycle_count for r in QUERIES["cycles_le3"](spark, sf).collect()}
    assert got == want != short


def test_rankings_have_every_k_and_graph_scores(spark, sf):
    m = QUERIES["ranking_metrics_all"](spark, sf)
    assert {f"precision_at_{k}" for k in DEFAULT.top_k} <= set(m.columns)
    assert {r.algorithm for r in m.select("algorithm").distinct().collect()} == set(features.RANKED) and len(features.RANKED) == 38


def test_undersampling_takes_twenty_others(spark, sf):
    n = {r.is_fraud: r["count"] for r in queries.nodes(spark, sf).groupBy("is_fraud").count().collect()}
    got = {r.is_fraud: r["count"] for r in QUERIES["undersample"](spark, sf).groupBy("is_fraud").count().collect()}
    assert got == {1: n[1], 0: min(n[0], 20 * n[1])}


def test_models_use_the_defaults(spark, sf, monkeypatch):
    from ledgerloom.models import forward
    from ledgerloom.models.boosting import Params

    seen = []
    for name in ("forward_chain", "importance", "cascade"):
        monkeypatch.setattr(forward, name, lambda f, columns, params=Params(): seen.append((set(columns), params, set(f.columns))))
    for name in ("forward_chain", "shap_importance", "cascade_predictions"):
        QUERIES[name](spark, sf)
    assert len(seen) == 3
    for columns, params, there in seen:
        assert columns == {*features.BEHAVIOURAL, *features.TOPOLOGICAL} and params == Params() and columns <= there
