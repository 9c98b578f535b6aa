"""Command line: run stages on files, or a query on a folder of tables.

    python -m ledgerloom clean --transactions t.csv --accounts a.csv --output out [--cutoff 2022-09-11]
    python -m ledgerloom features --input out --rates rates.parquet --output features [--days 3 --stride 1] [--resume]
    python -m ledgerloom fraud-rate --input out [--output reports]
    python -m ledgerloom query NAME --input folder [--output path]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import Config
from ledgerloom.operators import ledger, profiles, reports, windows
from ledgerloom.operators.features import extract
from ledgerloom.session import durable, session
from ledgerloom.sources import tables


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("clean", help="CSV to Parquet, up to a cutoff")
    for name in ("--transactions", "--accounts", "--output"):
        c.add_argument(name, required=True)
    c.add_argument("--cutoff")
    c = sub.add_parser("features", help="window profiles and graph features")
    for name in ("--input", "--rates", "--output"):
        c.add_argument(name, required=True)
    c.add_argument("--days", type=int, default=3)
    c.add_argument("--stride", type=int, default=1)
    c.add_argument("--resume", action="store_true", help="add the windows that the output lacks")
    c = sub.add_parser("fraud-rate", help="rates by transaction, account and entity")
    c.add_argument("--input", required=True)
    c.add_argument("--output")
    c = sub.add_parser("query", help="a registered query")
    c.add_argument("name")
    c.add_argument("--input", required=True)
    c.add_argument("--output")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = session()
    if args.command == "clean":
        tables.write_table(tables.up_to(tables.transactions_csv(spark, args.transactions), args.cutoff), f"{args.output}/transactions.parquet")
        tables.write_table(tables.accounts_csv(spark, args.accounts).select("account_number", "entity_id", "entity_name"), f"{args.output}/accounts.parquet")
    elif args.command == "features":
        tx = tables.table(spark, args.input, "transactions")
        for name, default in (("tx_id", F.monotonically_increasing_id()), ("event_type", F.lit(None).cast("string"))):
            if name not in tx.columns:
                tx = tx.withColumn(name, default)
        rows = durable(ledger.resolve(ledger.convert(tx, spark.read.parquet(args.rates)), tables.table(spark, args.input, "accounts")))
        config, within = Config(window_days=args.days, stride_days=args.stride), windows.span(windows.bounds(rows))

        def compute(wanted: DataFrame | None) -> DataFrame:
            nodes, edges = profiles.nodes(rows, within, config), windows.edges(windows.assign(rows, within, config))
            if wanted is not None:
                nodes, edges = nodes.join(wanted, "window_id", "left_semi"), edges.join(wanted, "window_id", "left_semi")
            return extract(nodes, edges, config)

        if args.resume:
            tables.resume(spark, args.output, windows.calendar(rows, config).select("window_id"), compute)
        else:
            tables.write_table(compute(None), args.output, "window_id")
    elif args.command == "fraud-rate":
        tx, accounts = tables.table(spark, args.input, "transactions"), tables.table(spark, args.input, "accounts")
        found = {"transactions": reports.transaction_rate(tx), "accounts": reports.account_rate(tx), "entities": reports.entity_rate(tx, accounts), "fraud_entities": reports.fraud_entities(tx, accounts)}
        for name, df in found.items():
            df.show(20, truncate=False)
            if args.output:
                tables.write_csv(df, f"{args.output}/{name}")
    else:
        from ledgerloom.plans.registry import QUERIES

        df = QUERIES[args.name](spark, args.input)
        tables.write_table(df, args.output) if args.output else df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
