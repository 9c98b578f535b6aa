"""The tables behind the reports: fraud rates, motifs, communities, ablation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import lift_percent, size_band
from ledgerloom.functions.stats import p_value, paired_t

MOTIFS = ("fan_out_count", "fan_in_count", "scatter_gather_count", "gather_scatter_count", "cycle_count")


def _percent(part: str, whole: str, digits: int = 4):
    return F.round(100.0 * F.col(part) / F.col(whole), digits)


def transaction_rate(transactions: DataFrame) -> DataFrame:
    n = transactions.agg(F.count("*").alias("total_transactions"), F.sum("is_laundering").cast("long").alias("fraudulent_transactions"))
    return n.withColumn("fraud_rate_pct", _percent("fraudulent_transactions", "total_transactions"))


def account_rate(transactions: DataFrame) -> DataFrame:
    ends = transactions.select(F.explode(F.array("from_account", "to_account")).alias("account"), "is_laundering")
    status = ends.groupBy("account").agg(F.max("is_laundering").alias("bad"))
    n = status.agg(F.count("*").alias("total_accounts"), F.sum("bad").cast("long").alias("fraudulent_accounts"))
    return n.withColumn("fraud_rate_pct", _percent("fraudulent_accounts", "total_accounts"))


def entity_status(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """entity_id, entity_name (the smallest), total_txns, fraud_txns, fraud_txn_pct, is_fraudulent; a transfer counts at both ends."""
    ends = transactions.select(F.explode(F.array("from_account", "to_account")).alias("account_number"), "is_laundering")
    joined = ends.join(accounts, "account_number")
    n = joined.groupBy("entity_id").agg(F.min("entity_name").alias("entity_name"), F.count("*").alias("total_txns"), F.sum("is_laundering").cast("long").alias("fraud_txns"), F.max("is_laundering").alias("is_fraudulent"))
    return n.withColumn("fraud_txn_pct", _percent("fraud_txns", "total_txns", 2))


def entity_rate(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    n = entity_status(transactions, accounts).agg(F.count("*").alias("total_entities"), F.sum("is_fraudulent").cast("long").alias("fraudulent_entities"))
    return n.withColumn("fraud_rate_pct", _percent("fraudulent_entities", "total_entities"))


def fraud_entities(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Flagged entities, those with most flagged transfers first."""
    return entity_status(transactions, accounts).where("is_fraudulent = 1").orderBy(F.desc("fraud_txns"), F.desc("total_txns"), "entity_id")


def motif_prevalence(features: DataFrame) -> DataFrame:
    """For each motif: entities with it, instances, mean, and the means of flagged and other entities with their ratio."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("motif"), F.col(m).cast("long").alias("n")) for m in MOTIFS))).alias("x")
    rows = features.select("is_fraud", each).select("is_fraud", "x.*")
    mean = lambda k: F.coalesce(F.avg(F.when(F.col("is_fraud") == k, F.col("n"))), F.lit(0.0))
    n = rows.groupBy("motif").agg(F.count("*").alias("total_entities"), F.count_if(F.col("n") > 0).alias("entities_with_motif"), F.sum("n").alias("instances"), F.avg("n").alias("mean_per_entity"), mean(1).alias("fraud_mean"), mean(0).alias("other_mean"))
    return n.withColumn("ratio", F.when(F.col("other_mean") > 0, F.col("fraud_mean") / F.col("other_mean")))


def top_motifs(features: DataFrame, k: int = 10) -> DataFrame:
    """The k rows with most motifs in all."""
    total = sum((F.col(m) for m in MOTIFS), F.lit(0)).cast("long").alias("total_motif_count")
    return features.select("window_id", "entity_id", total, *MOTIFS, "is_fraud").orderBy(F.desc("total_motif_count"), "window_id", "entity_id").limit(k)


def cycle_lift(features: DataFrame) -> DataFrame:
    """Entities with cycles, their rate of fraud, and its lift over all."""
    cyc = F.col("cycle_count") > 0
    n = features.agg(F.count_if(cyc).alias("entities_with_cycles"), F.avg(F.when(cyc, F.col("is_fraud"))).alias("cycle_fraud_rate"), F.avg("is_fraud").alias("rate"))
    return n.select("entities_with_cycles", "cycle_fraud_rate", F.try_divide("cycle_fraud_rate", "rate").alias("cycle_lift"))


def community_stats(members: DataFrame, label: str = "component_id") -> DataFrame:
    """window_id, community, size, fraud_count, fraud_rate."""
    return members.groupBy("window_id", F.col(label).alias("community")).agg(F.count("*").alias("size"), F.sum("is_fraud").cast("long").alias("fraud_count"), F.avg("is_fraud").alias("fraud_rate"))


def _with_window(stats: DataFrame) -> DataFrame:
    w = Window.partitionBy("window_id")
    return stats.withColumns({"window_nodes": F.sum("size").over(w), "window_fraud": F.sum("fraud_count").over(w)})


def community_size_bands(stats: DataFrame) -> DataFrame:
    """Communities, entities, flagged entities, their rate and its lift by band of size."""
    rows = _with_window(stats).withColumn("band", size_band(F.col("size")))
    n = rows.groupBy("window_id", "band").agg(F.count("*").alias("communities"), F.sum("size").alias("nodes"), F.sum("fraud_count").alias("fraud"), F.max("window_fraud").alias("wf"), F.max("window_nodes").alias("wn"))
    rate = F.col("fraud") / F.col("nodes")
    return n.select("window_id", "band", "communities", "nodes", "fraud", rate.alias("fraud_rate"), F.coalesce(F.try_divide(rate, F.col("wf") / F.col("wn")), F.lit(0.0)).alias("lift"))


def fraud_rings(stats: DataFrame) -> DataFrame:
    """By window: communities, those with fraud, pure rings (2 or more, all flagged), and what communities of over twice the window's rate catch."""
    rows = _with_window(stats).withColumn("high", F.col("fraud_rate") > 2 * F.col("window_fraud") / F.col("window_nodes"))
    ring = (F.col("fraud_rate") == 1.0) & (F.col("size") >= 2)
    n = rows.groupBy("window_id").agg(
        F.count("*").alias("communities"),
        F.count_if(F.col("fraud_count") > 0).alias("with_fraud"),
        F.avg(F.when(F.col("fraud_count") > 0, F.col("fraud_rate"))).alias("mean_rate_with_fraud"),
        F.count_if(ring).alias("rings"),
        F.coalesce(F.sum(F.when(ring, F.col("size"))), F.lit(0)).alias("ring_nodes"),
        F.count_if("high").alias("high_risk"),
        F.coalesce(F.sum(F.when(F.col("high"), F.col("fraud_count"))), F.lit(0)).alias("high_risk_fraud"),
        F.max("window_fraud").alias("total_fraud"),
    )
    return n.withColumn("high_risk_share", F.coalesce(F.try_divide("high_risk_fraud", "total_fraud"), F.lit(0.0)))


def top_communities(stats: DataFrame, k: int = 10, least: int = 3) -> DataFrame:
    """The k communities of each window with the highest rates, of ``least`` entities or more, with their lift over the window's rate."""
    order = Window.partitionBy("window_id").orderBy(F.desc("fraud_rate"), F.desc("size"), "community")
    top = _with_window(stats).where(F.col("size") >= least).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    lift = F.coalesce(F.try_divide("fraud_rate", F.col("window_fraud") / F.col("window_nodes")), F.lit(0.0))
    return top.select("window_id", "rank", "community", "size", "fraud_count", "fraud_rate", lift.alias("lift"))


def concentration(members: DataFrame, label: str) -> DataFrame:
    """How far communities concentrate fraud, by window: communities, those with fraud and their mean rate, those of nothing else, and entities for each community. Entities whose community is -1 have none and are left out."""
    stats = community_stats(members.where(F.col(label) != -1), label)
    n = stats.groupBy("window_id").agg(
        F.sum("size").alias("nodes"),
        F.sum("fraud_count").alias("fraud"),
        F.count("*").alias("communities"),
        F.count_if(F.col("fraud_count") > 0).alias("with_fraud"),
        F.count_if(F.col("fraud_rate") == 1.0).alias("fraud_only"),
        F.avg(F.when(F.col("fraud_count") > 0, F.col("fraud_rate"))).alias("mean_rate_with_fraud"),
        F.avg("size").alias("mean_size"),
        F.stddev_samp("size").alias("std_size"),
        F.min("size").alias("least_size"),
        F.max("size").alias("most_size"),
    )
    return n.withColumns({"fraud_rate": F.col("fraud") / F.col("nodes"), "with_fraud_share": F.col("with_fraud") / F.col("communities"), "communities_pct": 100.0 * F.col("communities") / F.col("nodes")})


def metric_summary(metrics: DataFrame) -> DataFrame:
    """Means and medians of the ranking measures by algorithm."""
    names = ("roc_auc", "average_precision", "precision_at_10", "lift_at_10")
    return metrics.groupBy("algorithm").agg(F.count("*").alias("windows"), *(g for c in names for g in (F.avg(c).alias(f"mean_{c}"), F.expr(f"percentile({c}, 0.5)").alias(f"median_{c}"))))


def ablation(base: DataFrame, full: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """By window: both models' measures, full minus base, and the change in percent."""
    b = base.select("window_id", *(F.col(m).alias(f"base_{m}") for m in measures))
    f = full.select("window_id", *(F.col(m).alias(f"full_{m}") for m in measures))
    cols = [c for m in measures for c in (F.col(f"base_{m}"), F.col(f"full_{m}"), (F.col(f"full_{m}") - F.col(f"base_{m}")).alias(f"delta_{m}"), lift_percent(F.col(f"full_{m}"), F.col(f"base_{m}")).alias(f"lift_{m}"))]
    return b.join(f, "window_id").select("window_id", *cols)


def ablation_tests(deltas: DataFrame, measures: tuple[str, ...], alpha: float = 0.05) -> DataFrame:
    """By measure: mean and standard deviation of full minus base, the paired t statistic of base minus full (against the sign of the deltas) with its degrees of freedom and two-sided p-value, and whether that is below ``alpha``."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"base_{m}").cast("double").alias("b"), F.col(f"full_{m}").cast("double").alias("f")) for m in measures))).alias("x")
    t, df = paired_t(F.col("b"), F.col("f"))
    d = F.col("f") - F.col("b")
    found = deltas.select(each).select("x.*").groupBy("measure").agg(F.avg(d).alias("mean_delta"), F.stddev_samp(d).alias("std_delta"), t.alias("t_statistic"), df.alias("df"))
    return found.withColumn("p_value", F.when(F.col("t_statistic").isNotNull(), p_value(F.col("t_statistic"), F.col("df")))).withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))
