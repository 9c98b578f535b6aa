"""Readers and writers: CSV ledgers with fixed schemas, Parquet tables, partitioned and resumable output."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of a transaction file by position, and their types.
TRANSACTION = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("from_bank", T.StringType()),
    T.StructField("from_account", T.StringType()),
    T.StructField("to_bank", T.StringType()),
    T.StructField("to_account", T.StringType()),
    T.StructField("amount_received", T.DoubleType()),
    T.StructField("receiving_currency", T.StringType()),
    T.StructField("amount_sent_c", T.DoubleType()),
    T.StructField("payment_currency", T.StringType()),
    T.StructField("payment_format", T.StringType()),
    T.StructField("is_laundering", T.IntegerType()),
])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def transactions_csv(spark: SparkSession, path: str, timestamp_format: str = "yyyy/MM/dd HH:mm") -> DataFrame:
    """A transaction file with a header; columns are taken by position, so a repeated name in the header does no harm."""
    return spark.read.option("timestampNTZFormat", timestamp_format).csv(path, header=True, schema=TRANSACTION, enforceSchema=True)


def accounts_csv(spark: SparkSession, path: str) -> DataFrame:
    """An account file; all columns as text, and the three that are used under short names too."""
    raw = spark.read.csv(path, header=True)
    return raw.withColumns({"account_number": F.col("`Account Number`"), "entity_id": F.col("`Entity ID`"), "entity_name": F.col("`Entity Name`")})


def up_to(transactions: DataFrame, cutoff: str | None, column: str = "timestamp") -> DataFrame:
    """Rows up to midnight at the start of ``cutoff`` (yyyy-mm-dd): the day itself is left out but for its first instant. No cutoff, no filter."""
    return transactions if cutoff is None else transactions.where(F.col(column) <= F.lit(cutoff).cast("timestamp_ntz"))


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for small reports."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def _file(path: str):
    """Path and file system of ``path`` as the session's cluster sees them."""
    spark = SparkSession.active()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark._jvm


def write_json(value: object, path: str) -> None:
    """One JSON file, wherever Spark can write; for small values."""
    p, fs, _ = _file(path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def read_json(path: str) -> object:
    p, fs, jvm = _file(path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def write_array(array: np.ndarray, path: str) -> None:
    """A matrix that the driver holds, as a Parquet table of its rows."""
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(np.atleast_2d(array))]
    write_table(SparkSession.active().createDataFrame(rows, "row long, x array<double>"), path)


def read_array(path: str) -> np.ndarray:
    return np.array([r.x for r in SparkSession.active().read.parquet(path).orderBy("row").collect()])


def log_tee(path: str, name: str = "ledgerloom") -> logging.Logger:
    """A logger that writes to the terminal and to a file of the driver."""
    logger = logging.getLogger(name)
    logger.setLevel(logging.INFO)
    for handler in (logging.StreamHandler(), logging.FileHandler(path, encoding="utf-8")):
        handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        logger.addHandler(handler)
    return logger


def resume(spark: SparkSession, path: str, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "window_id") -> DataFrame:
    """Append the partitions of ``wanted`` (one column, ``key``) that ``path`` lacks, and return the whole table."""
    try:
        done = spark.read.parquet(path).select(key).distinct()
        wanted = wanted.join(done, key, "left_anti")
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    compute(wanted).write.mode("append").partitionBy(key).parquet(path)
    return spark.read.parquet(path)
