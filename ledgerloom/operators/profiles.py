"""Behavioural profiles of entities in windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT, FORMATS, Config
from ledgerloom.operators.windows import assign, span, time_spread

KEYS = ["window_id", "window_start", "window_end", "entity_id"]


def _format_counts(side: str) -> list[Column]:
    return [F.count_if(F.col("payment_format") == name).alias(f"{prefix}_count_{side}") for name, prefix in FORMATS.items()]


def _currencies(side: str) -> Column:
    """A set of the few currencies, rather than a second distinct aggregate, which would double the rows."""
    return F.size(F.collect_set("payment_currency")).cast("long").alias(f"distinct_currencies_{side}")


def sent(assigned: DataFrame) -> DataFrame:
    keyed = assigned.withColumn("entity_id", F.col("source"))
    return keyed.groupBy(*KEYS).agg(F.count_distinct("target").alias("out_degree"), F.sum("adj_sent").alias("vol_sent"), F.count("*").alias("tx_count_sent"), time_spread(F.col("ts")).alias("time_variance"), _currencies("sent"), *_format_counts("sent"))


def received(assigned: DataFrame) -> DataFrame:
    keyed = assigned.withColumn("entity_id", F.col("target"))
    return keyed.groupBy(*KEYS).agg(F.count_distinct("source").alias("in_degree"), F.sum("adj_sent").alias("vol_recv"), F.count("*").alias("tx_count_recv"), _currencies("recv"), *_format_counts("recv"))


def fraud(assigned: DataFrame) -> DataFrame:
    """window_id, entity_id, is_fraud: whether any transfer of the entity in the window is flagged."""
    ends = assigned.select("window_id", F.explode(F.array("source", "target")).alias("entity_id"), "is_laundering").where("entity_id IS NOT NULL")
    return ends.groupBy("window_id", "entity_id").agg(F.max("is_laundering").alias("is_fraud"))


def temporal_fan(resolved: DataFrame, within: DataFrame, config: Config = DEFAULT, outgoing: bool = True) -> DataFrame:
    """window_id, entity_id and the largest number of counterparties on one day of the window. Days are counted once, then put into windows."""
    own, other, name = ("source", "target", "temporal_fan_out_count") if outgoing else ("target", "source", "temporal_fan_in_count")
    daily = resolved.groupBy(F.col(own).alias("entity_id"), "tx_date").agg(F.count_distinct(other).alias("n"))
    return assign(daily, within, config).groupBy("window_id", "entity_id").agg(F.max("n").alias(name))


def nodes(resolved: DataFrame, within: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The profile of each entity in each window: degrees, volumes, counts, currencies, formats, fraud, daily fans."""
    within = span(within) if isinstance(within, DataFrame) else within
    assigned = assign(resolved, within, config)
    joined = sent(assigned).join(received(assigned), KEYS, "full")
    for more in (fraud(assigned), temporal_fan(resolved, within, config), temporal_fan(resolved, within, config, outgoing=False)):
        joined = joined.join(more, ["window_id", "entity_id"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    x = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    counts = [n(f"{p}_count_{s}").alias(f"{p}_count_{s}") for p in FORMATS.values() for s in ("sent", "recv")]
    return joined.select(
        *KEYS,
        n("out_degree").alias("out_degree"),
        n("in_degree").alias("in_degree"),
        (n("out_degree") + n("in_degree")).alias("degree"),
        x("vol_sent").alias("vol_sent"),
        x("vol_recv").alias("vol_recv"),
        (n("tx_count_sent") + n("tx_count_recv")).alias("tx_count"),
        x("time_variance").alias("time_variance"),
        n("distinct_currencies_sent").alias("distinct_currencies_sent"),
        n("distinct_currencies_recv").alias("distinct_currencies_recv"),
        *counts,
        F.coalesce("is_fraud", F.lit(0)).alias("is_fraud"),
        n("temporal_fan_out_count").alias("temporal_fan_out_count"),
        n("temporal_fan_in_count").alias("temporal_fan_in_count"),
    )
