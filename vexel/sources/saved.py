"""Intermediate results in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset a temporary one is made, which only a local master may use."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="vexel-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder: later stages, and a retry after a lost executor, read them from there."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder for a stream's state or a written table."""
    return f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"
