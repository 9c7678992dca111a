"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  One of our own only where the setting is missing and the master is local, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="feedloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new place in the shared folder, that ``release`` deletes with the tables."""
    path = f"{shared_dir(spark)}/feedloom-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many partitions as there are cores, where it comes in fewer: a small table in one file would keep a single core busy.  Larger tables, which come in more, stay as they are and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tidy(spark: SparkSession) -> None:
    """Have the shuffle files of plans that nothing refers to any more deleted now, not at the JVM's next collection.  For between the steps of a long job, whose results are tables by then."""
    for _ in range(2):  # what Python lets go of reaches the JVM a moment later
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that no plan still to run reads."""
    for t in tables:
        path = getattr(t, "_written_at", None)
        if path in _written:
            _written.remove(path)
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> int:
    """Delete the tables this process has written; for when every result built on them is saved.  Returns how many."""
    n = 0
    while _written:
        n += _delete(spark, _written.pop())
    return n
