"""Queries over the ledger that is derived from events and customer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT, Config
from ledgerloom.functions.scalar import flow_ratio as ratio
from ledgerloom.operators import evaluate, features, iterative, ledger, motifs, profiles, reports, windows
from ledgerloom.session import durable
from ledgerloom.sources import fixture
from ledgerloom.sources.tables import up_to

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Scores that SQL can rank too: those of the profiles, with the decimals that make them the same in every engine.
SCORES = {c: {"vol_sent": 6, "vol_recv": 6, "time_variance": 3}.get(c, 0) for c in (*(c for c in features.RANKED if c in features.BEHAVIOURAL or c in ("in_degree", "out_degree")), "degree", "temporal_fan_out_count", "temporal_fan_in_count")}
CUTOFF = "2024-01-20"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


# Bases.


def resolved(spark: SparkSession, sf: str) -> DataFrame:
    rates = ledger.fill_rates(fixture.closes(spark, sf))
    return ledger.resolve(ledger.convert(fixture.ledger(spark, sf), rates), fixture.accounts(spark, sf))


def assigned(spark: SparkSession, sf: str, config: Config = DEFAULT) -> DataFrame:
    rows = resolved(spark, sf)
    return windows.assign(rows, windows.bounds(rows), config)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return windows.edges(assigned(spark, sf))


def edges_once(spark: SparkSession, sf: str) -> DataFrame:
    """The edges, computed once: for operators that read them several times, which would else aggregate the transfers anew each time."""
    return durable(edges(spark, sf))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = durable(resolved(spark, sf))  # read six times
    return profiles.nodes(rows, windows.bounds(rows))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    n = rounded(nodes(spark, sf), **{c: d for c, d in SCORES.items() if d})
    return durable(evaluate.long_scores(n, list(SCORES)))


def all_scores(spark: SparkSession, sf: str, columns: tuple[str, ...] = features.RANKED) -> DataFrame:
    """The scores of profiles and those of the graph."""
    return durable(evaluate.long_scores(feature_table(spark, sf), list(columns)))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.fraud(assigned(spark, sf))


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of the graph with their component and label."""
    return iterative.components(edges_once(spark, sf)).join(labels(spark, sf), ["window_id", "entity_id"])


def leiden_members(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of the profiles with their Leiden community (-1 without one) and label."""
    found = iterative.communities(edges_once(spark, sf), 1.0).withColumnRenamed("leiden_id", "leiden_macro_id")
    return features.join_features(labels(spark, sf), [found.select("window_id", "entity_id", "leiden_macro_id")])


# Relational core.


@query
def cutoff_filter(spark: SparkSession, sf: str) -> DataFrame:
    return up_to(fixture.ledger(spark, sf), CUTOFF).select("tx_id", "from_account", "to_account", "amount_sent_c")


@query
def fx_fill(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ledger.fill_rates(fixture.closes(spark, sf)), rate=6).withColumn("date", text(F.col("date")))


@query
def fx_convert(spark: SparkSession, sf: str) -> DataFrame:
    out = ledger.convert(fixture.ledger(spark, sf), ledger.fill_rates(fixture.closes(spark, sf)))
    return rounded(out.select("tx_id", "payment_currency", "adj_sent"), adj_sent=6)


@query
def resolve_entities(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(resolved(spark, sf).select("tx_id", "source", "target", "adj_sent", "is_laundering", "payment_format"), adj_sent=6)


@query
def window_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return windows.calendar(resolved(spark, sf)).select("window_id", text(F.col("window_start")).alias("window_start"), text(F.col("window_end")).alias("window_end"))


@query
def tumbling_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of a week that don't overlap: size and stride are parameters."""
    c = windows.calendar(resolved(spark, sf), Config(window_days=7, stride_days=7))
    return c.select("window_id", text(F.col("window_start")).alias("window_start"), text(F.col("window_end")).alias("window_end"))


@query
def window_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = edges(spark, sf).withColumns({"window_start": text(F.col("window_start")), "window_end": text(F.col("window_end"))})
    return rounded(e, volume=6, time_variance=3)


@query
def node_sent(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiles.sent(assigned(spark, sf)).drop("window_start", "window_end"), vol_sent=6, time_variance=3)


@query
def node_recv(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiles.received(assigned(spark, sf)).drop("window_start", "window_end"), vol_recv=6)


@query
def entity_fraud(spark: SparkSession, sf: str) -> DataFrame:
    return profiles.fraud(assigned(spark, sf))


@query
def temporal_fan(spark: SparkSession, sf: str) -> DataFrame:
    rows = resolved(spark, sf)
    within = windows.span(windows.bounds(rows))
    both = [profiles.temporal_fan(rows, within, outgoing=o) for o in (True, False)]
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return both[0].join(both[1], ["window_id", "entity_id"], "full").select("window_id", "entity_id", n("temporal_fan_out_count"), n("temporal_fan_in_count"))


@query
def node_profile(spark: SparkSession, sf: str) -> DataFrame:
    n = nodes(spark, sf).withColumns({"window_start": text(F.col("window_start")), "window_end": text(F.col("window_end"))})
    return rounded(n, vol_sent=6, vol_recv=6, time_variance=3)


@query
def flow_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return nodes(spark, sf).select("window_id", "entity_id", F.round(ratio(F.col("vol_sent"), F.col("vol_recv")), 6).alias("flow_ratio"))


@query
def tx_fraud_rate(spark: SparkSession, sf: str) -> DataFrame:
    return reports.transaction_rate(fixture.ledger(spark, sf))


@query
def account_fraud_rate(spark: SparkSession, sf: str) -> DataFrame:
    return reports.account_rate(fixture.ledger(spark, sf))


@query
def entity_fraud_rate(spark: SparkSession, sf: str) -> DataFrame:
    return reports.entity_rate(fixture.ledger(spark, sf), fixture.accounts(spark, sf))


@query
def fraud_entities(spark: SparkSession, sf: str) -> DataFrame:
    return reports.fraud_entities(fixture.ledger(spark, sf), fixture.accounts(spark, sf))


# Graph operators.


@query
def fan_motifs(spark: SparkSession, sf: str) -> DataFrame:
    return motifs.fans(edges(spark, sf))


@query
def scatter_gather(spark: SparkSession, sf: str) -> DataFrame:
    return motifs.scatter_gather(edges_once(spark, sf))


@query
def cycles_le3(spark: SparkSession, sf: str) -> DataFrame:
    return motifs.cycles(edges_once(spark, sf), 3)


@query
def cycles_le6(spark: SparkSession, sf: str) -> DataFrame:
    return motifs.cycles(edges_once(spark, sf), 6)


@query
def egonet(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(motifs.egonets(edges_once(spark, sf)), egonet_density=6, egonet_total_weight=6)


@query
def clustering(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(motifs.clustering(edges_once(spark, sf)), local_clustering_coefficient=6)


@query
def triangles(spark: SparkSession, sf: str) -> DataFrame:
    return motifs.triangle_counts(edges_once(spark, sf))


@query
def avg_nbr_degree(spark: SparkSession, sf: str) -> DataFrame:
    return motifs.neighbours(edges_once(spark, sf)).select("window_id", "entity_id", F.round("average_neighbor_degree", 6).alias("average_neighbor_degree"))


@query
def successor_volume(spark: SparkSession, sf: str) -> DataFrame:
    n = motifs.neighbours(edges_once(spark, sf)).drop("average_neighbor_degree")
    return rounded(n, successor_avg_volume=9, successor_max_volume=6)


@query
def pagerank_volume(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(iterative.pagerank(edges_once(spark, sf), 0.85, "volume", "pr_vol_deep"), pr_vol_deep=8)


@query
def pagerank_shallow(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(iterative.pagerank(edges_once(spark, sf), 0.75, "volume", "pr_vol_shallow"), pr_vol_shallow=8)


@query
def pagerank_count(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(iterative.pagerank(edges_once(spark, sf), 0.85, "count", "pr_count"), pr_count=8)


@query
def hits(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(iterative.hits(edges_once(spark, sf)), hits_hub=8, hits_auth=8)


@query
def k_core(spark: SparkSession, sf: str) -> DataFrame:
    return iterative.k_core(edges_once(spark, sf))


@query
def components(spark: SparkSession, sf: str) -> DataFrame:
    return iterative.components(edges_once(spark, sf))


def _modularity(e: DataFrame) -> DataFrame:
    labels = e.select("window_id", F.explode(F.array("source", "target")).alias("entity_id")).distinct().withColumn("label", F.col("entity_id") % 5)
    return rounded(iterative.modularity(e, labels, "label"), modularity=8)


@query
def modularity(spark: SparkSession, sf: str) -> DataFrame:
    return _modularity(edges_once(spark, sf))


@query
def betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(iterative.betweenness(edges_once(spark, sf)), betweenness=8)


@query
def leiden_macro(spark: SparkSession, sf: str) -> DataFrame:
    return iterative.communities(edges_once(spark, sf), 1.0)


@query
def leiden_micro(spark: SparkSession, sf: str) -> DataFrame:
    return iterative.communities(edges_once(spark, sf), 2.0)


@query
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    return features.extract(nodes(spark, sf), edges(spark, sf))


# Evaluation.


@query
def precision_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.at_k(scores(spark, sf)), precision=6, recall=6, lift=6)


@query
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.roc_auc(scores(spark, sf)), roc_auc=6)


@query
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.average_precision(scores(spark, sf)), average_precision=6)


# The names that end in _all rank the scores of the graph too; the others those that SQL has.


@query
def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.ranking_metrics(scores(spark, sf))
    return rounded(m, **{f.name: 6 for f in m.schema if f.dataType.simpleString() == "double"})


@query
def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = reports.metric_summary(evaluate.ranking_metrics(scores(spark, sf)))
    return rounded(m, **{f.name: 6 for f in m.schema if f.dataType.simpleString() == "double"})


@query
def heuristic_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.heuristic_metrics(scores(spark, sf))
    return rounded(m, **{f.name: 6 for f in m.schema if f.dataType.simpleString() == "double"})


def _doubles(m: DataFrame, digits: int = 6) -> DataFrame:
    return rounded(m, **{f.name: digits for f in m.schema if f.dataType.simpleString() == "double"})


@query
def ranking_metrics_all(spark: SparkSession, sf: str) -> DataFrame:
    """All 38 scores at all six K."""
    return _doubles(evaluate.ranking_metrics(all_scores(spark, sf)))


@query
def metric_summary_all(spark: SparkSession, sf: str) -> DataFrame:
    return _doubles(reports.metric_summary(evaluate.ranking_metrics(all_scores(spark, sf))))


@query
def heuristic_metrics_all(spark: SparkSession, sf: str) -> DataFrame:
    """All 19 features of the graph that are judged by themselves."""
    return _doubles(evaluate.heuristic_metrics(all_scores(spark, sf, features.HEURISTICS)))


@query
def heuristic_stats_all(spark: SparkSession, sf: str) -> DataFrame:
    return _doubles(evaluate.heuristic_stats(evaluate.heuristic_metrics(all_scores(spark, sf, features.HEURISTICS))))


@query
def heuristic_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.heuristic_stats(evaluate.heuristic_metrics(scores(spark, sf)))
    return rounded(m, **{f.name: 6 for f in m.schema if f.dataType.simpleString() == "double"})


@query
def calibrate_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.calibrate(scores(spark, sf))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels predicted by each score's calibrated threshold."""
    s = scores(spark, sf)
    t = evaluate.calibrate(s)
    joined = s.join(t, ["window_id", "algorithm"])
    return joined.select("window_id", "algorithm", "entity_id", F.col("is_fraud").alias("y_true"), (F.col("score") >= F.col("threshold")).cast("int").alias("y_pred"))


@query
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.confusion(_predictions(spark, sf), ["window_id", "algorithm"]), accuracy=6, precision=6, recall=6, f1=6)


@query
def pooled_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.summary(evaluate.confusion(_predictions(spark, sf), ["window_id", "algorithm"]))
    return rounded(m, **{f.name: 6 for f in m.schema if f.dataType.simpleString() == "double"})


@query
def heuristic_pivot(spark: SparkSession, sf: str) -> DataFrame:
    m = evaluate.pivoted(evaluate.heuristic_metrics(scores(spark, sf)), list(SCORES))
    return rounded(m, **dict.fromkeys(SCORES, 6))


@query
def entity_recall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(evaluate.entity_recall(_predictions(spark, sf), ["algorithm"]), entity_recall=6)


@query
def fwd_chain_split(spark: SparkSession, sf: str) -> DataFrame:
    """For each window from the third on: rows and flagged rows of all windows before it, which a model may learn from."""
    from pyspark.sql import Window

    n = nodes(spark, sf).groupBy("window_id").agg(F.count("*").alias("test_rows"), F.sum("is_fraud").cast("long").alias("test_fraud"))
    before = Window.orderBy("window_id").rowsBetween(Window.unboundedPreceding, -1)  # one row for each window
    return n.select("window_id", "test_rows", "test_fraud", F.sum("test_rows").over(before).alias("train_rows"), F.sum("test_fraud").over(before).alias("train_fraud")).where("window_id >= 2")


#: Measures that an ablation compares.
ABLATION = ("accuracy", "precision", "recall", "f1_score", "roc_auc", "auprc", "P_at_100", "P_at_200", "P_at_300", "P_at_500")


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    """The score by volume sent as the base and by degree as the full model, window by window."""
    s = scores(spark, sf).where(F.col("algorithm").isin("vol_sent", "degree"))
    joined = s.join(evaluate.calibrate(s), ["window_id", "algorithm"])
    predicted = durable(joined.select("window_id", "algorithm", "entity_id", F.col("is_fraud").alias("y_true"), F.col("score").alias("y_prob"), (F.col("score") >= F.col("threshold")).cast("int").alias("y_pred")))
    base, full = (evaluate.window_metrics(predicted.where(F.col("algorithm") == a)) for a in ("vol_sent", "degree"))
    return reports.ablation(base, full, ABLATION)


@query
def ablation_delta(spark: SparkSession, sf: str) -> DataFrame:
    d = _compared(spark, sf)
    return rounded(d, **{c: 2 if c.startswith("lift_") else 5 for c in d.columns if c != "window_id"})


@query
def ablation_tests(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.ablation_tests(_compared(spark, sf), ABLATION), mean_delta=6, std_delta=6, t_statistic=5, p_value=5)


# Reports.


@query
def community_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.community_stats(members(spark, sf)), fraud_rate=6)


@query
def community_size_bands(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.community_size_bands(reports.community_stats(members(spark, sf))), fraud_rate=6, lift=6)


@query
def fraud_rings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.fraud_rings(reports.community_stats(members(spark, sf))), mean_rate_with_fraud=6, high_risk_share=6)


@query
def component_top(spark: SparkSession, sf: str) -> DataFrame:
    """The ten components of each window with the highest rates."""
    return rounded(reports.top_communities(reports.community_stats(members(spark, sf))), fraud_rate=6, lift=6)


@query
def component_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return _doubles(reports.concentration(members(spark, sf), "component_id"))


@query
def leiden_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Size and fraud of each Leiden community."""
    return rounded(reports.community_stats(leiden_members(spark, sf).where("leiden_macro_id <> -1"), "leiden_macro_id"), fraud_rate=6)


@query
def leiden_size_bands(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.community_size_bands(leiden_stats(spark, sf)), fraud_rate=6, lift=6)


@query
def leiden_rings(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.fraud_rings(leiden_stats(spark, sf)), mean_rate_with_fraud=6, high_risk_share=6)


@query
def leiden_top(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.top_communities(leiden_stats(spark, sf)), fraud_rate=6, lift=6)


@query
def leiden_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return _doubles(reports.concentration(leiden_members(spark, sf), "leiden_macro_id"))


def _motif_features(spark: SparkSession, sf: str) -> DataFrame:
    e = edges_once(spark, sf)
    return features.join_features(labels(spark, sf), [motifs.fans(e), motifs.scatter_gather(e), motifs.cycles(e, 3)])


@query
def motif_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.motif_prevalence(_motif_features(spark, sf)), mean_per_entity=6, fraud_mean=6, other_mean=6, ratio=6)


@query
def topk_motif(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_motifs(_motif_features(spark, sf))


@query
def cycle_lift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.cycle_lift(_motif_features(spark, sf)), cycle_fraud_rate=6, cycle_lift=6)


# Models.


MODEL_COLUMNS = [c for c in features.BEHAVIOURAL if c != "flow_ratio"] + ["degree", "in_degree", "out_degree", "temporal_fan_out_count", "temporal_fan_in_count"]
ALL_COLUMNS = [*features.BEHAVIOURAL, *features.TOPOLOGICAL]
PRUNED_COLUMNS = [*features.BEHAVIOURAL, *features.PRUNED_TOPOLOGICAL]


@query
def forward_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Each window scored by a model of the windows before it."""
    from ledgerloom.models import forward

    return forward.forward_chain(durable(feature_table(spark, sf)), ALL_COLUMNS)


@query
def forward_chain_base(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the behavioural columns alone, which need no graph."""
    from ledgerloom.models import forward

    n = nodes(spark, sf)
    return forward.forward_chain(durable(n.withColumn("flow_ratio", ratio(F.col("vol_sent"), F.col("vol_recv")))), list(features.BEHAVIOURAL))


@query
def model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Measures by window of the forward-chained model."""
    p = durable(forward_chain(spark, sf))
    return evaluate.confusion(p, ["window_id"]).join(evaluate.window_metrics(p).select("window_id", *ABLATION[4:]), "window_id", "left")


@query
def model_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """What the graph features add to the behavioural model, measure by measure, with its significance."""
    base, full = (evaluate.window_metrics(durable(f(spark, sf))) for f in (forward_chain_base, forward_chain))
    return reports.ablation_tests(durable(reports.ablation(base, full, ABLATION)), ABLATION)


@query
def shap_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Mean absolute attributions of the forward-chained models."""
    from ledgerloom.models import forward

    return forward.importance(durable(feature_table(spark, sf)), ALL_COLUMNS)


def _pruned(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, float], list[str]]:
    """The features, their importance, and the columns that are left without collinear ones."""
    from ledgerloom.models import forward, pruning

    f = durable(feature_table(spark, sf))
    worth = {r.feature: r.mean_abs_shap for r in forward.importance(f, PRUNED_COLUMNS, sample=800).collect()}  # one row for each column
    dropped = pruning.collinear(pruning.spearman(f, PRUNED_COLUMNS), worth)
    return f, worth, [c for c in PRUNED_COLUMNS if c not in dropped]


@query
def pruned_columns(spark: SparkSession, sf: str) -> DataFrame:
    """For each column its importance, whether it is collinear with a more important one, and whether it is protected from elimination."""
    from ledgerloom.models import pruning

    _, worth, kept = _pruned(spark, sf)
    safe = pruning.protected({c: worth.get(c, 0.0) for c in kept}, features.BEHAVIOURAL)
    return spark.createDataFrame([(c, float(worth.get(c, 0.0)), c not in kept, c in safe) for c in PRUNED_COLUMNS], "feature string, mean_abs_shap double, collinear boolean, protected boolean")


@query
def feature_elimination(spark: SparkSession, sf: str) -> DataFrame:
    """Recursive elimination by importance: the columns dropped in each round, the score of the rest, and whether the round was chosen."""
    from ledgerloom.models import forward, pruning

    f, worth, kept = _pruned(spark, sf)
    safe = pruning.protected({c: worth.get(c, 0.0) for c in kept}, features.BEHAVIOURAL)

    def judge(columns: list[str]) -> tuple[float, dict[str, float]]:
        both = durable(forward.judged(f, columns))
        s = both.where("feature IS NULL").select("window_id", "entity_id", F.col("y_true").alias("is_fraud"), F.col("y_prob").alias("score"))
        score = evaluate.average_precision(evaluate.two_classes(s), ["window_id"]).agg(F.avg("average_precision")).first()[0]
        worth = both.where("feature IS NOT NULL").groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("m")).collect()  # one row for each column
        return score or 0.0, {r.feature: r.m for r in worth}

    best, history = pruning.eliminate(kept, judge, safe)
    rows = [(h["round"], len(h["columns"]), ",".join(h["dropped"]), float(h["score"]), h["columns"] == best) for h in history]
    return spark.createDataFrame(rows, "round int, n_columns int, dropped string, score double, selected boolean")


@query
def cascade_predictions(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerloom.models import forward

    return forward.cascade(durable(feature_table(spark, sf)), ALL_COLUMNS)


@query
def undersample(spark: SparkSession, sf: str) -> DataFrame:
    """All flagged rows, and twenty times as many others."""
    from ledgerloom.models import forward

    return forward.undersample(nodes(spark, sf)).select("window_id", "entity_id", "is_fraud")


@query
def spearman_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlations of the behavioural columns, pair by pair."""
    from ledgerloom.models import pruning

    corr = pruning.spearman(rounded(nodes(spark, sf), vol_sent=6, vol_recv=6, time_variance=3), MODEL_COLUMNS)
    rows = [(a, b, round(float(corr.loc[a, b]), 6)) for i, a in enumerate(MODEL_COLUMNS) for b in MODEL_COLUMNS[i + 1 :]]
    return spark.createDataFrame(rows, "a string, b string, rho double")
