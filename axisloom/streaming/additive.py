"""Incremental maintenance of (sum, sumsq, n_expr), which are additive.

Each micro-batch adds a small table of sums under its number; every so often all of them become one, the base, so that readers read the base
and the batches after it. A batch that runs again overwrites its own table, and one that a base covers is ignored, so each counts once.

Where rows may come late, twice, amended or withdrawn, keyed state holds each row's newest version and turns what comes
into signed differences: the old version is taken away, the new one added. Sums of differences are sums of the newest versions, whatever the order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SUMS = ("sum", "sumsq", "n_expr")


def batch_stats(rows: DataFrame) -> DataFrame:
    """rows: (g, j, v) -> (g, j, sum, sumsq, n_expr). A column ``sign`` (1 or -1) takes rows away."""
    v = F.col("v").cast("double")
    sign = F.col("sign") if "sign" in rows.columns else F.lit(1)
    return rows.where("v <> 0").groupBy("g", "j").agg(F.sum(v * sign).alias("sum"), F.sum(v * v * sign).alias("sumsq"), F.sum(sign).cast("long").alias("n_expr"))


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("g", "j").agg(*(F.sum(c).alias(c) for c in SUMS))


def _parts(spark: SparkSession, path: str) -> tuple[int, dict[int, str], list[str]]:
    """(number of the newest base, batches after it, all that it has made superfluous)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    found = [(kind, int(k), n) for n in names for kind, _, k in [n.partition("=")] if kind in ("base", "batch") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    base = max((k for kind, k, _ in found if kind == "base"), default=-1)
    return base, {k: f"{path}/{n}" for kind, k, n in found if kind == "batch" and k > base}, [f"{path}/{n}" for kind, k, n in found if k < base or (kind == "batch" and k <= base)]


def compact(spark: SparkSession, path: str) -> None:
    """Makes the base and the batches after it a new base; readers that began before see what they saw, unless it takes them until the next one."""
    base, batches, old = _parts(spark, path)
    for p in old:  # superfluous since the compaction before this one
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if batches:
        current(spark, path).write.mode("overwrite").parquet(f"{path}/base={max(batches)}")


def maintain(stream: DataFrame, path: str, checkpoint: str, every: int = 16, **trigger: Any) -> StreamingQuery:
    """Adds each batch's statistics; after every so many batches they are compacted."""

    def put(batch: DataFrame, number: int) -> None:
        if number <= _parts(batch.sparkSession, path)[0]:
            return
        batch_stats(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if (number + 1) % every == 0:
            compact(batch.sparkSession, path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The statistics so far; groups and columns whose rows have all been withdrawn are left out."""
    base, batches, _ = _parts(spark, path)
    paths = [*([f"{path}/base={base}"] if base >= 0 else []), *batches.values()]
    if not paths:
        raise FileNotFoundError(f"no statistics at {path}")
    return merged(spark.read.parquet(*paths)).where("n_expr <> 0")


class Newest(StatefulProcessor):
    """Of each row's id the newest version, as state; out come signed differences."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "version long, g string, j long, v double, gone boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        old = self.held.get() if self.held.exists() else None
        new = old
        for part in rows:
            for r in zip(part["version"], part["g"], part["j"], part["v"], part["gone"]):
                if new is None or r[0] > new[0]:
                    new = (int(r[0]), None if pd.isna(r[1]) else r[1], None if pd.isna(r[2]) else int(r[2]), None if pd.isna(r[3]) else float(r[3]), bool(r[4]))
        if new is not old:
            self.held.update(tuple(new))
            out = [(x[1], x[2], x[3], sign) for x, sign in ((old, -1), (new, 1)) if x is not None and not x[4]]
            yield pd.DataFrame(out, columns=["g", "j", "v", "sign"]).astype({"g": "object", "j": "Int64", "v": "float64", "sign": "int32"})

    def close(self) -> None:
        pass


def differences(stream: DataFrame) -> DataFrame:
    """(id, version, g, j, v, gone) -> (g, j, v, sign). Of an id the largest version counts, the first seen of equal ones; ``gone`` withdraws it. State
    is kept by id, in RocksDB, as long as the stream runs."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select("id", F.col("version").cast("long").alias("version"), F.col("g").cast("string").alias("g"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"), F.coalesce("gone", F.lit(False)).alias("gone"))
    return rows.groupBy("id").transformWithStateInPandas(Newest(), "g string, j long, v double, sign int", "Update", "None")


def maintain_corrected(stream: DataFrame, path: str, checkpoint: str, every: int = 16, **trigger: Any) -> StreamingQuery:
    """``maintain`` for a stream of versions: late, repeated and withdrawn rows amend the sums."""
    return maintain(differences(stream), path, checkpoint, every, **trigger)
