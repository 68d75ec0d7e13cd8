"""Materialise an intermediate result in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or one of this session under the default file system.

    The fallback is for tests and trials: where the default file system is the machine's own disk, it is
    refused unless the master is local too.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    context = spark.sparkContext
    root = context._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/")
    if root.startswith("file:") and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{root}{'//' if root == 'file:' else ''}/tmp/loomframe/{context.applicationId}"


def _forget_at_exit(spark: SparkSession, folder: str) -> None:
    """Have the session's JVM remove ``folder`` when it ends."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and fixes partitioning and row order."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = checkpoint_dir(df.sparkSession)
        own = not df.sparkSession.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder)
        if own:
            _forget_at_exit(df.sparkSession, folder)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written intermediate; removed when the session ends."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/loomframe/{spark.sparkContext.applicationId}"
    _forget_at_exit(spark, folder)
    return f"{folder}/{uuid.uuid4().hex}/{name}"
