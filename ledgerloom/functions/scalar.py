"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 with fractions; needs a session in UTC for time stamps without a zone."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def flow_ratio(sent: Column, received: Column) -> Column:
    """Sent over received; over itself if nothing was received, and 0 if nothing was sent either."""
    return F.coalesce(F.try_divide(sent, F.when(received > 0, received).otherwise(sent)), F.lit(0.0))


def finite(c: Column) -> Column:
    """NaN, infinite and null values as 0."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def lift_percent(new: Column, base: Column, epsilon: float = 1e-9) -> Column:
    return (new - base) / (base + epsilon) * 100


def label(score: Column, threshold: Column | float = 0.5) -> Column:
    return (score >= threshold).cast("int")


def size_band(size: Column) -> Column:
    """The band of a community's size: 1, 2-4, 5-9, 10-49, 50-99, 100-499, 500+."""
    bands = (("500+", 500), ("100-499", 100), ("50-99", 50), ("10-49", 10), ("5-9", 5), ("2-4", 2), ("1", 1))
    out = F
    for name, least in bands:
        out = out.when(size >= least, name)
    return out
