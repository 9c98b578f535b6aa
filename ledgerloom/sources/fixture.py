"""A ledger derived from the star-schema tables events and customer, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.tables import table

LEDGER = """WITH n AS (SELECT max(user_id) + 1 AS n FROM {events}),
e AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM {events})
SELECT event_id AS tx_id, ts AS timestamp,
    user_id * 10 + k % 10 AS from_account,
    ((user_id * 7 + event_id * 13 + 1) % (SELECT n FROM n)) * 10 + CAST(floor(k / 10) AS BIGINT) AS to_account,
    value AS amount_sent_c,
    split_part('Euro|UK Pound|Swiss Franc|Australian Dollar|Canadian Dollar|Brazil Real|Shekel|Saudi Riyal|Yuan|Mexican Peso|Ruble|Rupee|Yen|Bitcoin|US Dollar', '|', k % 15 + 1) AS payment_currency,
    split_part('Wire|Cash|Bitcoin|Cheque|Credit Card|ACH|Reinvestment', '|', k % 7 + 1) AS payment_format,
    CASE WHEN k % 50 = 0 THEN 1 ELSE 0 END AS is_laundering, event_type FROM e"""

ACCOUNTS = "SELECT c_custkey AS account_number, CAST(floor(c_custkey / 10) AS BIGINT) AS entity_id, c_name AS entity_name FROM {customer}"

CLOSES = """SELECT date, split_part('Euro|UK Pound|Swiss Franc|Australian Dollar|Canadian Dollar|Brazil Real|Shekel|Saudi Riyal|Yuan|Mexican Peso|Ruble|Rupee|Yen|Bitcoin|US Dollar', '|', cid + 1) AS currency,
    CASE WHEN cid = 14 THEN 1.0e0 WHEN (day(date) + cid) % 7 IN (5, 6) THEN NULL ELSE (cid + 1) * 0.1e0 + day(date) * 0.001e0 END AS close_rate
FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM {events}) AS d CROSS JOIN (SELECT DISTINCT CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 15 AS cid FROM {events}) AS c"""


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(LEDGER, events=table(spark, folder, "events"))


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(ACCOUNTS, customer=table(spark, folder, "customer"))


def closes(spark: SparkSession, folder: str) -> DataFrame:
    """Closing rates by date and currency, with holes."""
    return spark.sql(CLOSES, events=table(spark, folder, "events"))
