"""Intermediate tables in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: rows that a task is to have at most where rows are dealt out by their number.
TASK_ROWS = 1 << 19


def dealt(spark: SparkSession, rows: int) -> int:
    """Partitions in which a task has some TASK_ROWS rows at most, whatever the size of the tables."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; with a local master and none set, a folder of our own, kept for the session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="axisloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as Parquet and read again, so that it is computed once and its lineage ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/axisloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
