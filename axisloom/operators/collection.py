"""Collections: samples with axes of their own, joined by labels; no union matrix is ever made.

A collection is one long frame with a ``sample`` column. Rows are named ``sample:label`` where
``prefix`` is set, and a column that a sample doesn't have is absent there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Dataset, Field
from .order import numbered


def stacked(frames: dict[str, DataFrame]) -> DataFrame:
    """sample -> frame, as one frame with the sample's name and its place in the order given."""
    parts = [df.withColumns({"sample": F.lit(name), "sample_ord": F.lit(at)}) for at, (name, df) in enumerate(frames.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_axis(axes: DataFrame) -> DataFrame:
    """(sample_ord, pos, label) -> (pos, label): the union of labels in the order they are first seen."""
    first = axes.groupBy("label").agg(F.min(F.struct("sample_ord", "pos")).alias("at"))
    return numbered(first.select("label", "at.sample_ord", "at.pos"), ["sample_ord", "pos"], "new").select(F.col("new").alias("pos"), "label")


def union_rows(axes: DataFrame, prefix: bool = True) -> DataFrame:
    """(sample, sample_ord, pos, label) -> plus name: the label in the union of rows."""
    return axes.withColumn("name", F.concat_ws(":", "sample", "label") if prefix else F.col("label"))


def repeated_labels(axes: DataFrame, label: str = "name") -> DataFrame:
    return axes.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unmatched(labels: DataFrame, axis: DataFrame) -> DataFrame:
    """Labels without a place on the axis; an inner join would hide them."""
    return labels.join(axis.select("label"), "label", "left_anti")


def collection_from(measures: dict[str, DataFrame], rows: dict[str, DataFrame], columns: dict[str, DataFrame], prefix: bool = True) -> dict[str, DataFrame]:
    """measures: (i, j, v) by sample; rows, columns: (pos, label). Long measure (sample, row, col, v) by labels, row axis and column axis. An entry without a label fails the job that reads it."""
    r, c = union_rows(stacked(rows), prefix), stacked(columns)
    if not repeated_labels(r).isEmpty():
        raise ValueError("row labels repeat across samples; set prefix")
    m = stacked(measures).join(r.select("sample", F.col("pos").alias("i"), F.col("name").alias("row")), ["sample", "i"], "left").join(c.select("sample", F.col("pos").alias("j"), F.col("label").alias("col")), ["sample", "j"], "left")
    m = m.withColumns({x: F.when(F.col(x).isNull(), F.raise_error(F.concat_ws(" ", F.lit(f"no label for the {x} of an entry:"), "sample", "i", "j"))).otherwise(F.col(x)) for x in ("row", "col")})
    return {"measure": m.select("sample", "row", "col", "v"), "rows": r, "columns": union_axis(c)}


def sample_sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sample").agg(F.count(F.lit(1)).alias("n_rows"))


def collection_pseudobulk(measure: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, col, mean, frac): measure by labels (row, col, v), groups (row, g) over the union of rows.

    Sums are aggregated before labels are aligned; a column that a sample lacks counts as 0, and
    denominators count the group's rows in all samples.
    """
    sums = measure.join(groups.where("g is not null"), "row").groupBy("g", "col").agg(F.sum(F.col("v").cast("double")).alias("s"), F.count("v").alias("e"))
    sizes = groups.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return sums.join(sizes, "g").select("g", "col", (F.col("s") / F.col("n")).alias("mean"), (F.col("e") / F.col("n")).alias("frac"))


def flatten(measure: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(row, col, v) to positions (i, j, v) of the union axes; duplicates summed."""
    r, c = rows.select(F.col("label").alias("row"), F.col("pos").alias("i")), columns.select(F.col("label").alias("col"), F.col("pos").alias("j"))
    return measure.join(r, "row").join(c, "col").groupBy("i", "j").agg(F.sum("v").alias("v"))


def joint_kind(df: DataFrame) -> str:
    """Typing of a joint field: entries by two keys are a relation, dense rows an embedding, single values a label."""
    return "relation" if "j" in df.columns else "embedding" if "vec" in df.columns else "label"


def intersect_labels(*axes: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select("label"), "label", "left_semi"), axes)


def except_labels(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("label"), "label", "left_anti")


def same_axis(a: DataFrame, b: DataFrame) -> bool:
    """Equal ordered label sets."""
    a, b = a.select("pos", "label"), b.select("pos", "label")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def subset_of(a: DataFrame, b: DataFrame) -> bool:
    return except_labels(a, b).isEmpty()


def place(ds: Dataset, name: str, rows: DataFrame, shared: str = "cells") -> tuple[str, str, DataFrame]:
    """(axis, coverage, positions) of a modality's rows (pos, label): the shared axis in full, if its labels and their places are the
    same; in part, if all are among its labels; else an axis of the modality's own. positions: (i, at), where each row lies on the axis.
    One outer join counts what decides."""
    axis = ds.axes[shared]
    at = rows.select(F.col("pos").alias("i"), "label").join(axis.df.select(F.col("pos").alias("at"), "label"), "label", "left").select("i", "at")
    n, known, same = at.agg(F.count(F.lit(1)), F.count("at"), F.count_if(F.col("i") == F.col("at"))).first()
    if known == n:
        return shared, "full" if same == n == axis.length else "partial", at
    own = next(a for a in (f"{shared}.{name}", *(f"{shared}.{name}.{k}" for k in range(2, len(ds.axes) + 3))) if a not in ds.axes)
    ds.add_axis(own, rows, length=n)
    return own, "full", rows.select(F.col("pos").alias("i"), F.col("pos").alias("at"))


def add_modality(ds: Dataset, name: str, m: DataFrame, rows: DataFrame, columns: DataFrame, shared: str = "cells", **meta) -> Field:
    """A modality's measure (i, j, v) over the shared rows, all or some of them, or over rows of its own; its columns are an axis of its own."""
    axis, coverage, at = place(ds, name, rows, shared)
    ds.add_axis(f"{name}_features", columns, role="feature")
    index = {"coverage": coverage, "index_axis": axis if coverage == "partial" else None}
    return ds.add_field(name, m.join(at, "i").select(F.col("at").alias("i"), "j", "v"), span=(axis, f"{name}_features"), role="measure", encoding="coo", **index, **meta)


def degree(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """(src, degree, weight) of a relation (src, dst, weight)."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.sum(weight if weight is not None else F.col("weight")).alias("weight"))
