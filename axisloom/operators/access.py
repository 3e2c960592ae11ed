"""Point, range and gathered access, crossfilter selections, facets and samples.

All of them are predicates or joins, so that a layout clustered by the same key prunes row groups.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .measure import view
from .order import numbered


def column(m: DataFrame, j: int) -> DataFrame:
    return m.where(F.col("j") == j).select("i", "v")


def row(m: DataFrame, i: int) -> DataFrame:
    return m.where(F.col("i") == i).select("j", "v")


def column_range(m: DataFrame, lo: int, hi: int) -> DataFrame:
    """Columns lo .. hi - 1."""
    return m.where((F.col("j") >= lo) & (F.col("j") < hi))


def row_block(m: DataFrame, lo: int, hi: int) -> DataFrame:
    return m.where((F.col("i") >= lo) & (F.col("i") < hi))


def _request(spark: SparkSession, key: str, wanted: list[int]) -> DataFrame:
    """A local relation, whose size the planner knows when it chooses the join."""
    return spark.createDataFrame(pa.table({key: pa.array(wanted, pa.int64()), "ord": pa.array(range(len(wanted)), pa.int64())}))


def gather(m: DataFrame, wanted: list[int], key: str = "j") -> DataFrame:
    """The requested columns (or rows, key='i') with ord, their place in the request; a request may name one twice."""
    return m.join(_request(m.sparkSession, key, wanted), key)


def expression(m: DataFrame, rows: DataFrame, j: int, lognorm: bool = False) -> DataFrame:
    """(i, x) of one column over all rows (i), zeros filled in."""
    return rows.select("i").join(column(m, j), "i", "left").select("i", F.coalesce(view(F.col("v"), lognorm=lognorm), F.lit(0.0)).alias("x"))


def expression_max(x: DataFrame) -> DataFrame:
    return x.agg(F.greatest(F.max("x"), F.lit(0.0)).alias("max"))


def in_range(v: Column, lo: float, hi: float) -> Column:
    """Inclusive at both ends; NaN stays selected, as it fails both exclusions."""
    return F.isnan(v) | v.between(lo, hi)


@dataclass
class Crossfilter:
    """Conjunction of a category set or a range per dimension. Immutable: each call gives a new filter."""

    df: DataFrame
    tests: dict[str, Column] = field(default_factory=dict)

    def keep(self, name: str, values: list) -> Crossfilter:
        return Crossfilter(self.df, self.tests | {name: F.col(name).isin(*values)})

    def between(self, name: str, lo: float, hi: float) -> Crossfilter:
        return Crossfilter(self.df, self.tests | {name: in_range(F.col(name).cast("double"), lo, hi)})

    def reset(self, name: str | None = None) -> Crossfilter:
        return Crossfilter(self.df, {k: v for k, v in self.tests.items() if name is not None and k != name})

    def selected(self) -> DataFrame:
        out = self.df
        for test in self.tests.values():
            out = out.where(test)
        return out

    def count(self) -> int:
        return self.selected().count()


def first_seen_codes(labels: DataFrame) -> DataFrame:
    """(i, v) -> (i, code): labels numbered in the order of their first position; missing ones -1."""
    first = labels.where("v is not null").groupBy("v").agg(F.min("i").alias("first"))
    codes = numbered(first, ["first"], "code").select("v", F.col("code").cast("int").alias("code"))
    return labels.join(codes, "v", "left").select("i", F.coalesce("code", F.lit(-1)).alias("code"))


def factor_levels(labels: DataFrame) -> DataFrame:
    """(pos, label): distinct labels in code-point order."""
    levels = labels.where("v is not null").select(F.col("v").cast("string").alias("label")).distinct()
    return numbered(levels, ["label"], "pos").select("pos", "label")


def encoded(labels: DataFrame, levels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(i, v) -> (i, v: code) and the dictionary (pos, label) as a frame: the distinct labels in code-point order unless given.
    Null and unlisted labels have a null code. Nothing of it reaches the driver, however many labels there are."""
    levels = factor_levels(labels) if levels is None else levels
    table = levels.select(F.col("label").alias("_c"), F.col("pos").alias("_at"))
    return labels.select("i", F.col("v").cast("string").alias("_c")).join(table, "_c", "left").select("i", F.col("_at").alias("v")), levels


def stride_sample(rows: DataFrame, stride: int, offset: int = 0, pos: str = "pos") -> DataFrame:
    """Every stride-th position: a predicate on the position, no order needed."""
    return rows.where(F.pmod(F.col(pos) - offset, F.lit(stride)) == 0)


def window_sample(rows: DataFrame, n: int, windows: int, per_window: int, pos: str = "pos") -> DataFrame:
    """Evenly spaced runs of consecutive positions out of n: local reads of a clustered layout."""
    step = max(1, n // max(1, windows))
    return rows.where((F.pmod(F.col(pos), F.lit(step)) < per_window) & (F.floor(F.col(pos) / step) < windows))


def capped(ids: DataFrame, cap: int, group: str = "g") -> DataFrame:
    """The first ``cap`` ids of each group by position."""
    return ids.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("i"))).where(F.col("_n") <= cap).drop("_n")


def dense_slice(df: DataFrame, lo: int, hi: int, width: slice | None = None) -> DataFrame:
    out = df.where((F.col("i") >= lo) & (F.col("i") < hi))
    return out.withColumn("vec", F.slice("vec", width.start + 1, width.stop - width.start)) if width else out
