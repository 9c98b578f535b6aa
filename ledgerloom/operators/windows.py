"""Sliding windows over days, without a range join.

A day lies in at most size / stride windows, whose numbers follow from the day's
distance to the first day. Rows are exploded to these numbers, so windows cost
no join, and no row meets a window that it isn't in. Windows start at the first
day and every stride after it; those that would reach beyond the last day are
left out.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DEFAULT, Config
from ledgerloom.functions.scalar import epoch_seconds


def bounds(rows: DataFrame, day: str = "tx_date") -> DataFrame:
    return rows.agg(F.min(day).alias("first_date"), F.max(day).alias("last_date"))


def calendar(rows: DataFrame, config: Config = DEFAULT, day: str = "tx_date") -> DataFrame:
    """window_id, window_start, window_end (not included)."""
    size, stride = config.window_days, config.stride_days
    last_start = F.date_sub("last_date", size - 1)
    starts = F.when(last_start >= F.col("first_date"), F.sequence(F.col("first_date"), last_start, F.expr(f"interval {stride} day")))
    days = bounds(rows, day).select(F.posexplode(starts).alias("window_id", "window_start"))
    return days.select(F.col("window_id").cast("long").alias("window_id"), "window_start", F.date_add("window_start", size).alias("window_end"))


def span(within: DataFrame) -> tuple[date | None, date | None]:
    """The two dates of ``bounds``, found once: in a plan, each use of them would read the rows again."""
    return tuple(within.first())


def assign(rows: DataFrame, within: DataFrame | tuple[date | None, date | None], config: Config = DEFAULT, day: str = "tx_date") -> DataFrame:
    """``rows`` once for each window that holds their date, with window_id, window_start and window_end. ``within``: the result of ``bounds`` or ``span``."""
    size, stride = config.window_days, config.stride_days
    first, last = (F.lit(d).cast("date") for d in (span(within) if isinstance(within, DataFrame) else within))
    at = F.datediff(F.col(day), first)
    least = F.greatest(F.lit(0), F.ceil((at - (size - 1)) / stride).cast("int"))
    most = F.least(F.floor(at / stride), F.floor((F.datediff(last, first) - (size - 1)) / stride)).cast("int")
    numbers = F.when(most >= least, F.sequence(least.cast("long"), most.cast("long")))
    out = rows.withColumn("window_id", F.explode(numbers))
    start = F.date_add(first, (F.col("window_id") * stride).cast("int"))
    return out.withColumns({"window_start": start, "window_end": F.date_add(start, size)})


def time_spread(ts: Column) -> Column:
    """Aggregate: sample standard deviation of the time in seconds, 0 for one row."""
    return F.coalesce(F.stddev_samp(epoch_seconds(ts)), F.lit(0.0))


def edges(assigned: DataFrame) -> DataFrame:
    """One row for each window, source and target: volume, count, time_variance (a standard deviation, as its name came down)."""
    return assigned.groupBy("window_id", "window_start", "window_end", "source", "target").agg(
        F.sum("adj_sent").alias("volume"), F.count("*").alias("count"), time_spread(F.col("ts")).alias("time_variance")
    )
