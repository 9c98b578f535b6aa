"""Plans and paths for large inputs."""

from __future__ import annotations

import subprocess
import sys

import pytest

from ledgerloom.config import Config
from ledgerloom.operators import evaluate, iterative, motifs
from ledgerloom.plans import queries
from tests.conftest import ROOT

SCHEMA = "window_id long, source long, target long, volume double, count long"


def _edges(spark, n=60, seed=3):
    import random

    r = random.Random(seed)
    rows = {(w, r.randrange(n), r.randrange(n)) for w in (0, 1) for _ in range(150)}
    return spark.createDataFrame([(w, a, b, float(a + 1), 1) for w, a, b in rows], SCHEMA)


@pytest.mark.parametrize("pivots", [7, 80])
def test_betweenness_is_the_same_both_ways(spark, pivots):
    e, config = _edges(spark), Config(pivots=pivots)
    one, two = ({(r.window_id, r.entity_id): r.betweenness for r in iterative.betweenness(e, config, local=x).collect()} for x in (True, False))
    assert one == pytest.approx(two, abs=1e-12) and sum(one.values()) > 0


def test_large_windows_have_components_as_communities(spark):
    e = spark.createDataFrame([(0, 1, 2, 1.0, 1), (0, 2, 3, 1.0, 1), (0, 8, 9, 1.0, 1), (1, 5, 6, 1.0, 1)], SCHEMA)
    rows = {(r.window_id, r.entity_id): (r.leiden_id, r.leiden_size) for r in iterative.communities(e, config=Config(local_edges=2)).collect()}
    assert rows == {(0, 1): (0, 3), (0, 2): (0, 3), (0, 3): (0, 3), (0, 8): (1, 2), (0, 9): (1, 2), (1, 5): (0, 2), (1, 6): (0, 2)}
    assert iterative.communities(e, local=False).where("window_id = 0").first().leiden_modularity == pytest.approx(4 / 9)


def test_a_hub_multiplies_no_rows_in_egonets(spark):
    """A hub with 3,000 edges in and 3,000 out has 9 million paths; the query reads edges and triangles only."""
    e = spark.range(3000).selectExpr("0L AS window_id", "id AS source", "-1L AS target", "1.0D AS volume").unionAll(spark.range(3000).selectExpr("0L", "-1L", "10000 + id", "2.0D"))
    rows = {r.entity_id: (r.egonet_node_count, r.egonet_edge_count, r.egonet_total_weight) for r in motifs.egonets(e).collect()}
    assert rows[-1] == (3001, 3000, 6000.0) and rows[5] == (2, 1, 1.0) and rows[10005] == (1, 0, 0.0)
    assert motifs.triangles_of(motifs._pairs(e)).isEmpty()


@pytest.mark.parametrize("most", [6, 16])
def test_motifs_are_the_same_in_workers_and_by_joins(spark, most):
    config = Config(degree_most=most)
    e = _edges(spark).unionAll(spark.range(25).selectExpr("1L", "0L", "id + 60", "1.0D", "1L")).unionAll(spark.range(25).selectExpr("0L", "id + 60", "1L", "1.0D", "1L")).localCheckpoint()
    for f in (lambda x: motifs.scatter_gather(e, config, local=x), lambda x: motifs.cycles(e, 6, config, local=x), lambda x: motifs.cycles(e, 3, config, local=x)):
        one, two = (sorted(map(tuple, f(x).collect())) for x in (True, False))
        assert one == two and one
    pairs = motifs._pairs(e).localCheckpoint()
    one, two = ({(r.window_id, r.x, r.y, r.z): tuple(-1.0 if v is None else v for v in r[4:]) for r in motifs.triangles_of(pairs, local=x).collect()} for x in (True, False))
    assert one.keys() == two.keys() and one and all(one[k] == pytest.approx(two[k]) for k in one)


def test_cycles_make_no_rows_for_paths(spark):
    """Paths of cycles of 6 are followed in workers: no join, and one shuffle."""
    plan = motifs.cycles(_edges(spark), 6)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 1


def test_curves_and_cutoffs_equal_brute_force(spark):
    import random

    r = random.Random(4)
    rows = [(w, "a", i, int(r.random() < 0.3), r.choice([0.0, -3.5, 1e-12, 2.0, r.uniform(-5, 5), r.uniform(0, 1e9)])) for w in (0, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "window_id int, algorithm string, entity_id int, is_fraud int, score double")
    for c in evaluate.curves(df).collect():
        mine = [x for x in rows if x[0] == c.window_id]
        assert (c.tp, c.fp) == tuple(sum(x[3] == k for x in mine if x[4] >= c.score) for k in (1, 0))
        assert (c.pos, c.neg) == (sum(x[3] for x in mine), sum(1 - x[3] for x in mine))
    for k in evaluate.at_k(df, (1, 10, 500), clamp=True).collect():
        mine = sorted((x for x in rows if x[0] == k.window_id), key=lambda x: (-x[4], x[2]))
        assert k.fraud_found == sum(x[3] for x in mine[: k.k])


def test_scores_that_are_no_numbers_count_as_0(spark):
    df = spark.createDataFrame([(0, 1, 0, float("nan")), (0, 2, 1, float("inf")), (0, 3, 1, None), (0, 4, 0, 2.0)], "window_id int, entity_id int, is_fraud int, s double")
    assert sorted(r.score for r in evaluate.long_scores(df, ["s"]).collect()) == [0.0, 0.0, 0.0, 2.0]


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    plan = evaluate.at_k(queries.scores(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_dates_are_no_subqueries(spark, sf):
    plan = queries.edges(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "last_date" not in plan and plan.count("max(user_id") <= plan.count("scalar-subquery")


def test_queries_without_the_tokenizers():
    """The other queries are listed where a library that the training-data operators need can't be imported."""
    code = "import sys; sys.modules['tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'op2_bpe' not in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
