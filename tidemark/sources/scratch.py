"""Intermediate tables in the folder that the driver and all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; without that setting a local session has a folder of its own, and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what follows does not compute it again.

    Its ``saved_path`` can be deleted once its last reader is done.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.saved_path = path
    return made


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a path; false if the target is there already."""
    jvm = spark.sparkContext._jvm
    at, to = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not system.exists(to) and system.rename(at, to)
