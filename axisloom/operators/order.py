"""Locality order: group code, then the Hilbert index of two coordinates, then the row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import grid_cell, hilbert
from ..sources.shared import saved


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the dense position under ``order``, nulls last; of rows that are equal in all of it either may come first.

    A range exchange by sampled splitters sorts, counts of its partitions shift the numbers within each. What is sorted is saved
    first, so that both see the same partitions. Partitions are as even as the order is fine: end it with a unique column.
    """
    keys = [F.col(c).asc_nulls_last() for c in order]
    a = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    a = saved(a.withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}), "ordered")
    runs = a.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_nth").alias("_first"))  # a row for each partition
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    runs = runs.select("_part", "_first", before.alias("_before"))
    return a.join(runs, "_part").withColumn(name, F.col("_nth") - F.col("_first") + F.col("_before")).drop("_part", "_nth", "_first", "_before")


def hilbert_index(points: DataFrame, grid: int = 1024) -> DataFrame:
    """(i, x, y) -> plus h, by the extent of all points."""
    ends = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    p = points.crossJoin(F.broadcast(ends))  # one row: the extent
    return p.withColumn("h", hilbert(grid_cell(F.col("x"), F.col("x0"), F.col("x1"), grid), grid_cell(F.col("y"), F.col("y0"), F.col("y1"), grid), grid)).drop("x0", "x1", "y0", "y1")


def cell_order(points: DataFrame, groups: DataFrame, grid: int = 1024) -> DataFrame:
    """(i, new_pos): rows of a group together (no group last), neighbours on the curve near each other."""
    p = hilbert_index(points, grid).join(groups.select("i", "g"), "i", "left").select("i", "g", "h")
    return numbered(p, ["g", "h", "i"], "new_pos").select("i", "new_pos")


def group_order(groups: DataFrame) -> DataFrame:
    """(i, new_pos) by group code and row alone."""
    return numbered(groups.select("i", "g"), ["g", "i"], "new_pos").select("i", "new_pos")


def reordered(m: DataFrame, order: DataFrame, parts: int | None = None) -> DataFrame:
    """The measure with rows renumbered, clustered by row; parts: as many ranges, else as adaptive execution has it."""
    out = m.join(order, "i").select(F.col("new_pos").alias("i"), "j", "v")
    return (out.repartitionByRange(parts, "i") if parts else out.repartitionByRange("i")).sortWithinPartitions("i", "j")
