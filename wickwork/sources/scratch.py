"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where none is set a temporary one is made, but only for a local master: on
    a cluster each executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wickwork-"))
    return sc.getCheckpointDir()


def folder(spark: SparkSession, path: str):
    """(file system, path) of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = folder(spark, path)
    # A path is only noted for removal once it exists.
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def store(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back: no lineage, survives lost executors."""
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = folder(spark, path)
    fs.delete(at, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """A table written to the shared folder under a new name and read back."""
    return store(df, fresh(df.sparkSession, name))
