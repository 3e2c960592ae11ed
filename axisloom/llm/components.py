"""Connected components of a graph of pairs, by alternating large and small stars.

Every graph takes the same rounds, each written to the shared folder. Hot nodes cost no more than
others: least neighbours are partial aggregates, and they are joined back by joins whose large
partitions Spark can split. Pairs that are already (node, component) of an earlier call cost one
round, so a graph that grows by links is settled again from its last labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    others = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v), longs. (node, component) of every node in an edge, component being the smallest node reachable."""
    e = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    was = _state(e)
    for _ in range(rounds):
        large = saved(_large(e), "large")
        discard(e)
        e = saved(_small(large), "small")
        discard(large)
        now = _state(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("the components have not settled")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = saved(nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    discard(e)
    return out
