"""A session with the settings that the engine assumes."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, name: str = "ledgerloom", **settings: str) -> SparkSession:
    """Time stamps in UTC, adaptive plans with skew handling. ``settings`` override, with underscores for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    values = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in settings.items()}
    return builder.config(map=values).getOrCreate()


def import_path(df: DataFrame) -> DataFrame:
    """``df`` itself, with this package's folder on the path of the session's Python workers."""
    environment = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))
    return df


def durable(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the folder of spark.checkpoint.dir (a temporary one in local sessions without it)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            import atexit
            import shutil
            import tempfile

            folder = tempfile.mkdtemp(prefix="loom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> DataFrame:
    """``durable``, and a request to drop the shuffle files that led to it: Spark removes them only when its driver collects garbage, which it may never do."""
    import gc

    df = durable(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df
