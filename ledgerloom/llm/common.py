"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\u000b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder; a cluster
    raises, as a machine-local folder would lose data with its executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(folder)
        return folder
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="loom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return folder


def map_arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``, with this package's folder on the path of the Python workers (on a cluster, ship the package with --py-files)."""
    environment = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))
    return df.mapInArrow(function, schema)


_written: list = []


def remember(spark: SparkSession, path: str) -> str:
    """``path``, which is removed when the driver's process ends: tables that only this run reads."""
    if not _written:
        atexit.register(_sweep)
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    _written.append((p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p))
    return path


def _sweep() -> None:
    for fs, path in _written:
        try:
            fs.delete(path, True)
        except Exception:  # the JVM may be gone already; what is left is in the shared folder
            return


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read from there: for wide rows, of which later steps read few columns."""
    spark = df.sparkSession
    path = remember(spark, f"{shared_dir(spark).rstrip('/')}/loom-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession, data: bytes, stem: str) -> str:
    """Put a file of bounded size into the shared folder and send it to every executor.

    Returns the name under which ``SparkFiles.get`` finds the local copy, which
    executors can memory-map; a replaced executor fetches it again.
    """
    name = f"{stem}-{uuid.uuid4().hex}.bin"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(remember(spark, f"{shared_dir(spark)}/{name}"))
    out = path.getFileSystem(conf).create(path, True)
    try:
        step = 1 << 20
        for i in range(0, len(data), step):
            out.write(bytearray(data[i : i + step]))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of a key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``budget`` bytes in ``column`` (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > budget:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """A text column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, counted up to there only."""
    return df.limit(rows + 1).count() <= rows
