"""Intermediate tables in the folder that driver and executors share, as the session names it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of files up to which an input is dealt among cores by a shuffle.
SMALL = 256 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a session that runs in this one process (a test) may go without one and gets a
    temporary folder; elsewhere executors would write to disks that others can't read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("intermediate tables need spark.checkpoint.dir, a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/gleaner/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written and read again: it is worked out once, and lost executors cost no recomputation."""
    path = f"{_own(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Removes all that this application has written() so far: for when its results are saved, as they are lazy and read those tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def few(rows: DataFrame, most: int) -> bool:
    """Whether there are ``most`` rows or fewer; no more than that are counted."""
    return rows.limit(most + 1).count() <= most


def spread(df: DataFrame) -> DataFrame:
    """A small input dealt evenly among all cores: its files often have one row group each, which one task reads. Larger ones and streams stay as they are."""
    if df.isStreaming or df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > SMALL:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
