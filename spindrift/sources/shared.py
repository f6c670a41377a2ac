"""Places in the folder that driver and executors share: tables that a later step reads."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spindrift-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path there; what is written to it is deleted when this process ends."""
    path = f"{folder(spark)}/spindrift-stores/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_forget)
    _written.append((spark, path))
    return path


def materialised(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read back."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """Length and time of a file or folder: one call, whatever it holds. Writers of a table change its folder's time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
    return status.getLen(), status.getModificationTime()


def _forget() -> None:
    while _written:
        spark, path = _written.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: the cluster's own cleaning of the folder is all that is left
            pass
