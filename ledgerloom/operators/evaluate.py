"""Ranking and classification measures over many score columns and groups at once.

Scores are brought into long form first: a row for each group, algorithm and
entity. Ties of a score go to the smaller entity id wherever an order matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT
from ledgerloom.functions.scalar import finite

GROUP = ["window_id", "algorithm"]


def long_scores(features: DataFrame, scores: list[str], keep: tuple[str, ...] = ("window_id", "entity_id", "is_fraud")) -> DataFrame:
    """One row for each score of each row: the columns ``keep``, algorithm and score; 0 for scores that are null, NaN or infinite."""
    pairs = F.array(*(F.struct(F.lit(c).alias("algorithm"), finite(F.col(c)).alias("score")) for c in scores))
    return features.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.algorithm", "x.score")


def ranked(scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "entity_id")
    return scores.withColumn("rank", F.row_number().over(order))


def _rate(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def at_k(scores: DataFrame, ks: tuple[int, ...] = DEFAULT.top_k, group: list[str] = GROUP, clamp: bool = False) -> DataFrame:
    """group, k, fraud_found, precision, recall, lift.

    k beyond the group's size is left out, or taken as that size with ``clamp``.
    Lift is null where nothing is flagged.
    """
    # ranks beyond the largest k are dropped before the shuffle; totals are partial sums
    top = ranked(scores, group).where(F.col("rank") <= max(ks))
    found = top.groupBy(*group).agg(*(F.sum(F.when(F.col("rank") <= k, F.col("is_fraud")).otherwise(0)).alias(f"f{k}") for k in ks))
    sums = scores.groupBy(*group).agg(F.count("*").alias("n"), F.sum("is_fraud").alias("positives")).join(found, group)
    each = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.col(f"f{k}").cast("long").alias("fraud_found")) for k in ks))).alias("x")
    out = sums.select(*group, "n", "positives", each).select(*group, "n", "positives", "x.*")
    out = out.withColumn("of", F.least("k", "n")) if clamp else out.where("k <= n").withColumn("of", F.col("k"))
    precision = F.col("fraud_found") / F.col("of")
    lift = F.when(F.col("positives") > 0, precision / (F.col("positives") / F.col("n")))
    return out.select(*group, "k", "fraud_found", precision.alias("precision"), _rate(F.col("fraud_found"), F.col("positives")).alias("recall"), lift.alias("lift"))


def curves(scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """group, score, tp and fp at and above it, and the group's pos and neg: one row for each distinct score.

    Scores are binned by their logarithm, in order. Sums run over a group's few
    bins first, and then within each bin, so that no task sorts a whole group.
    """
    steps = scores.groupBy(*group, "score").agg(F.sum("is_fraud").alias("p"), F.sum(1 - F.col("is_fraud")).alias("q"))
    size = F.abs("score")
    steps = steps.withColumn("bin", F.when(size > 0, F.signum("score") * (F.floor(F.log(size) * 32) + 100_000)).otherwise(0.0).cast("int"))
    bins = steps.groupBy(*group, "bin").agg(F.sum("p").alias("bp"), F.sum("q").alias("bq"))
    above = Window.partitionBy(*group).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    all_, zero = Window.partitionBy(*group), F.lit(0).cast("long")
    sums = [F.coalesce(F.sum("bp").over(above), zero).alias("ap"), F.coalesce(F.sum("bq").over(above), zero).alias("aq"), F.sum("bp").over(all_).alias("pos"), F.sum("bq").over(all_).alias("neg")]
    down = Window.partitionBy(*group, "bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.select("*", F.sum("p").over(down).alias("wp"), F.sum("q").over(down).alias("wq")).join(bins.select(*group, "bin", *sums), [*group, "bin"])
    return rows.select(*group, "score", "p", "q", (F.col("wp") + F.col("ap")).alias("tp"), (F.col("wq") + F.col("aq")).alias("fp"), "pos", "neg")


def roc_auc(scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """group, roc_auc: the share of pairs in the right order, ties half; null with one class only."""
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0))  # each negative: positives above it, and half of those beside it
    return curves(scores, group).groupBy(*group).agg(F.when((F.max("pos") > 0) & (F.max("neg") > 0), F.try_divide(area, F.max("pos") * F.max("neg"))).alias("roc_auc"))


def average_precision(scores: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """group, average_precision: precision at each distinct score, weighted by the recall it adds; null without positives."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return curves(scores, group).groupBy(*group).agg(F.try_divide(F.sum(F.col("p") * precision), F.max("pos")).alias("average_precision"))


def ranking_metrics(scores: DataFrame, ks: tuple[int, ...] = DEFAULT.top_k) -> DataFrame:
    """One wide row for each window and algorithm: totals, roc_auc, average_precision, and four measures at each k, null beyond the group's size."""
    totals = scores.groupBy(*GROUP).agg(F.count("*").alias("total_nodes"), F.sum("is_fraud").alias("total_fraud"))
    totals = totals.withColumn("fraud_rate", F.col("total_fraud") / F.col("total_nodes"))
    k = at_k(scores, ks)
    at = lambda c, i: F.max(F.when(F.col("k") == i, F.col(c)))
    wide = k.groupBy(*GROUP).agg(*(at(c, i).alias(f"{n}_at_{i}") for c, n in (("precision", "precision"), ("recall", "recall"), ("lift", "lift"), ("fraud_found", "fraud_found")) for i in ks))
    return totals.join(roc_auc(scores), GROUP, "left").join(average_precision(scores), GROUP, "left").join(wide, GROUP, "left")


def two_classes(scores: DataFrame, by: str = "window_id") -> DataFrame:
    """The rows of windows in which both labels occur."""
    kinds = scores.groupBy(by).agg(F.min("is_fraud").alias("lo"), F.max("is_fraud").alias("hi")).where("lo <> hi").select(by)
    return scores.join(kinds, by, "left_semi")


def heuristic_metrics(scores: DataFrame, ks: tuple[int, ...] = (10, 50, 100, 500)) -> DataFrame:
    """window_id, feature, auprc, roc_auc and precision at each k (clamped), for windows with both labels."""
    s = two_classes(scores)
    p = at_k(s, ks, clamp=True).groupBy(*GROUP).agg(*(F.max(F.when(F.col("k") == k, F.col("precision"))).alias(f"p_at_{k}") for k in ks))
    joined = average_precision(s).join(roc_auc(s), GROUP).join(p, GROUP)
    return joined.select("window_id", F.col("algorithm").alias("feature"), F.col("average_precision").alias("auprc"), "roc_auc", *(f"p_at_{k}" for k in ks))


def heuristic_stats(metrics: DataFrame) -> DataFrame:
    """Mean, standard deviation, least and most of auprc and roc_auc by feature."""
    f = (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    return metrics.groupBy("feature").agg(*(g(c).alias(f"{c}_{n}") for c in ("auprc", "roc_auc") for n, g in f))


def calibrate(scores: DataFrame, target_recall: float = DEFAULT.target_recall, group: list[str] = GROUP) -> DataFrame:
    """group, threshold: the score of the highest precision among those with enough recall, the lowest such score on ties."""
    c = curves(scores, group).where("pos > 0").withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.col("tp") / F.col("pos")})
    good = c.where(F.col("recall") >= target_recall)
    return good.groupBy(*group).agg((-F.max(F.struct("precision", (-F.col("score")).alias("low")))["low"]).alias("threshold"))


def confusion(labelled: DataFrame, group: list[str], truth: str = "y_true", guess: str = "y_pred") -> DataFrame:
    """Counts, accuracy, precision, recall and F1; 0 where a measure isn't defined."""
    t, g = F.col(truth), F.col(guess)
    n = labelled.groupBy(*group).agg(F.count_if((t == 1) & (g == 1)).alias("tp"), F.count_if((t == 0) & (g == 1)).alias("fp"), F.count_if((t == 1) & (g == 0)).alias("fn"), F.count_if((t == 0) & (g == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.select("*", _rate(tp + tn, tp + fp + fn + tn).alias("accuracy"), _rate(tp, tp + fp).alias("precision"), _rate(tp, tp + fn).alias("recall"), _rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def entity_recall(predictions: DataFrame, group: list[str]) -> DataFrame:
    """Flagged entities (in any window) that were predicted at least once in a window where they were flagged."""
    bad = F.col("y_true") == 1
    n = predictions.groupBy(*group).agg(F.count_distinct(F.when(bad, F.col("entity_id"))).alias("fraud_entities"), F.count_distinct(F.when(bad & (F.col("y_pred") == 1), F.col("entity_id"))).alias("found_entities"))
    return n.withColumn("entity_recall", _rate(F.col("found_entities"), F.col("fraud_entities")))


def summary(by_window: DataFrame, measures: tuple[str, ...] = ("accuracy", "precision", "recall", "f1")) -> DataFrame:
    """Pooled measures of all windows (from summed counts), with the mean and standard deviation of each over windows."""
    tp, fp, fn, tn = (F.sum(c) for c in ("tp", "fp", "fn", "tn"))
    pooled = {"accuracy": _rate(tp + tn, tp + fp + fn + tn), "precision": _rate(tp, tp + fp), "recall": _rate(tp, tp + fn), "f1": _rate(2 * tp, 2 * tp + fp + fn)}
    return by_window.groupBy("algorithm").agg(F.count("*").alias("windows"), *(pooled[m].alias(f"pooled_{m}") for m in measures), *(F.avg(m).alias(f"mean_{m}") for m in measures), *(F.stddev_samp(m).alias(f"std_{m}") for m in measures))


def pivoted(metrics: DataFrame, features: list[str], value: str = "auprc") -> DataFrame:
    """A row for each window and a column for each feature, named beforehand so that no pass finds the names."""
    return metrics.groupBy("window_id").pivot("feature", features).agg(F.first(value))


def window_metrics(predictions: DataFrame, ks: tuple[int, ...] = (100, 200, 300, 500)) -> DataFrame:
    """By window with both labels: accuracy, precision, recall, f1_score, auprc, roc_auc and P_at_k (clamped) of predictions (y_true, y_prob, y_pred)."""
    group = ["window_id"]
    scores = two_classes(predictions.select("window_id", "entity_id", F.col("y_true").alias("is_fraud"), F.col("y_prob").alias("score"), "y_pred"))
    labels = confusion(scores, group, "is_fraud", "y_pred").select("window_id", "accuracy", "precision", "recall", F.col("f1").alias("f1_score"))
    p = at_k(scores, ks, group, clamp=True).groupBy(*group).agg(*(F.max(F.when(F.col("k") == k, F.col("precision"))).alias(f"P_at_{k}") for k in ks))
    areas = average_precision(scores, group).withColumnRenamed("average_precision", "auprc").join(roc_auc(scores, group), group)
    return labels.join(areas, group).join(p, group)
