"""Currency conversion and entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import durable

#: Rates are broadcast up to this many rows (a century of days for fourteen currencies is half of it), else joined by shuffle.
BROADCAST_RATES = 1_000_000


def fill_rates(closes: DataFrame) -> DataFrame:
    """date, currency, rate: the last close up to a date, else the first one after it."""
    by_date = Window.partitionBy("currency").orderBy("date")
    before = F.last("close_rate", ignorenulls=True).over(by_date.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("close_rate", ignorenulls=True).over(by_date.rowsBetween(0, Window.unboundedFollowing))
    return closes.select("date", "currency", F.coalesce(before, after).alias("rate"))


def calendar_rates(prices: DataFrame, first: str, last: str, currencies: list[str], base: str = "US Dollar") -> DataFrame:
    """Rates for every calendar day from market prices (date, currency, close_rate), with the base currency at 1."""
    spark = prices.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    grid = days.select("date", F.explode(F.array(*map(F.lit, currencies))).alias("currency"))
    filled = fill_rates(grid.join(prices, ["date", "currency"], "left")).where(F.col("rate").isNotNull())
    return filled.unionByName(days.select("date", F.lit(base).alias("currency"), F.lit(1.0).alias("rate")))


def convert(transactions: DataFrame, rates: DataFrame) -> DataFrame:
    """Transactions with tx_date and adj_sent, the amount sent in the base currency; null without a rate.

    A shuffle on (currency, date) would move the whole ledger, most of it to the
    task of the commonest currency; so the rates, computed and counted first, are
    broadcast if there are few.
    """
    rates = durable(rates)
    dated = transactions.withColumn("tx_date", F.col("timestamp").cast("date"))
    r = rates.select(F.col("date").alias("rate_date"), F.col("currency").alias("rate_currency"), "rate")
    if rates.count() <= BROADCAST_RATES:
        r = F.broadcast(r)
    joined = dated.join(r, (F.col("payment_currency") == F.col("rate_currency")) & (F.col("tx_date") == F.col("rate_date")), "left")
    return joined.withColumn("adj_sent", F.col("amount_sent_c") * F.col("rate")).drop("rate_date", "rate_currency", "rate")


def resolve(converted: DataFrame, accounts: DataFrame) -> DataFrame:
    """Transfers between entities; transfers with an unknown account drop out, accounts listed twice count twice."""
    source = accounts.select(F.col("account_number").alias("from_account"), F.col("entity_id").alias("source"))
    target = accounts.select(F.col("account_number").alias("to_account"), F.col("entity_id").alias("target"))
    joined = converted.join(source, "from_account").join(target, "to_account")
    return joined.select("tx_id", F.col("timestamp").alias("ts"), "tx_date", "source", "target", "adj_sent", "is_laundering", "payment_currency", "payment_format", "event_type")


def repeated_accounts(accounts: DataFrame) -> DataFrame:
    """Account numbers that more than one row lists: these multiply transfers in ``resolve``."""
    return accounts.groupBy("account_number").count().where("count > 1")
