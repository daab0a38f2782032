"""Cutting lineage and scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []


def _shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without one (tests) gets a new temporary folder; on a cluster that would be a
    folder of one machine, so it raises there."""
    path = spark.conf.get(_CONF, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_CONF} names no folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-newsloom-")
        spark.conf.set(_CONF, path)
    return path.rstrip("/")


def _drop_made() -> None:
    for spark, path in _made:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may have ended; the folder is scratch anyway
            continue


atexit.register(_drop_made)


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has; it goes when the driver's process ends."""
    path = f"{_shared(spark)}/newsloom/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: later plans start there, prune its columns and know its size."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
