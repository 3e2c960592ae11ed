"""Small helpers shared by the operators."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words, as the contracts fix them.
SPACE = " \t\n\x0b\f\r"
#: Java and RE2 pattern of runs of separators.
GAP = r"[\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_HASHED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            return jvm.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="axisloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there and lost executors cost nothing.

    The shuffles behind it go with the end of the write, and the folder with ``discard``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/axisloom-{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes saved tables that nothing lazy depends on any more."""
    for df in tables:
        path = getattr(df, "_saved_at", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that has one row a key and grows with the input.

    It gets no strategy by hint: the session lets adaptive execution build hashes of it where every partition has been
    measured to be under 64 MB (unless the user has set that bound), and sorts both sides, which can spill, where one is not.
    """
    conf = df.sparkSession.conf
    if conf.get(_HASHED) in ("0", "0b"):
        conf.set(_HASHED, "64m")
    return df


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns that begin with ``_`` under names that no other column has, and those names by the old ones.

    Operators keep such names for themselves meanwhile, and ``returned`` gives them back.
    """
    has = {c.lower() for c in df.columns}
    free = (c for c in map("aside{}".format, itertools.count()) if c not in has)
    names = {c: next(free) for c in df.columns if c.startswith("_")}
    return df.withColumnsRenamed(names), names


def returned(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({new: old for old, new in names.items()})


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))


def word_array(text: Column) -> Column:
    """Words of a text as an array (null: empty)."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, GAP))


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def small(df: DataFrame, rows: int) -> bool:
    """True if df has at most so many rows. df should be a saved table."""
    return df.limit(rows + 1).count() <= rows
