"""Building measures and moving between their forms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def measure(df: DataFrame, i: str | Column, j: str | Column, v: str | Column) -> DataFrame:
    """(i, j, v): duplicates summed, explicit zeros dropped, so that stored entries are the nonzeros."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return df.groupBy(c(i).alias("i"), c(j).alias("j")).agg(F.sum(c(v)).alias("v")).where("v <> 0 or isnan(v)")


def view(v: Column, depth: Column | None = None, scale: float = 1.0, lognorm: bool = False) -> Column:
    """The value of a nonzero under depth normalisation and log1p; both keep zeros zero."""
    x = v.cast("double")
    if depth is not None:
        x = x * F.lit(float(scale)) / depth
    return F.log1p(x) if lognorm else x


def dense_to_sparse(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(i, vec) -> (i, j, v) without zeros; null elements stay out, NaN stays in."""
    return df.select("i", F.posexplode(vec).alias("j", "v")).withColumn("j", F.col("j").cast("long")).where("v <> 0")


def sparse_to_dense(m: DataFrame, width: int) -> DataFrame:
    """(i, j, v) -> (i, vec) of a fixed width; rows without entries are absent, positions beyond the width are left out.
    A position named twice has one of its values; a null one is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // max(1, width))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                own = batch.slice(lo, step)
                entries = own.column("e").flatten()
                row = np.repeat(np.arange(own.num_rows), np.diff(own.column("e").offsets.to_numpy()))
                out = np.zeros(own.num_rows * width)
                out[row * width + entries.field("j").to_numpy()] = entries.field("v").to_numpy()
                yield pa.RecordBatch.from_arrays([own.column("i"), pa.ListArray.from_arrays(np.arange(own.num_rows + 1, dtype=np.int32) * width, pa.array(out))], names=["i", "vec"])

    j = F.col("j").cast("long")
    entry = F.when(j.between(0, width - 1), F.struct(j.alias("j"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v")))
    rows = m.groupBy(F.col("i").cast("long").alias("i")).agg(F.collect_list(entry).alias("e"))
    return rows.mapInArrow(run, "i long, vec array<double>")


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def clustered(m: DataFrame, by: str = "j", parts: int | None = None) -> DataFrame:
    """The same measure laid out by column (``j``, any column is cheap) or by row (``i``): a clustering, not another encoding."""
    other = "i" if by == "j" else "j"
    out = m.repartitionByRange(parts, by) if parts else m.repartitionByRange(by)
    return out.sortWithinPartitions(by, other)


def decode_mask(df: DataFrame, mask: DataFrame) -> DataFrame:
    """(i, v) with (i, m): null where m = 1."""
    return df.join(mask, "i", "left").select("i", F.when(F.col("m") == 1, None).otherwise(F.col("v")).alias("v"))


def covered(axis: DataFrame, field: DataFrame) -> DataFrame:
    """The covered labels of a partial field, with its values: (pos, label, v)."""
    return axis.join(field.withColumnRenamed("i", "pos"), "pos")


def with_coverage(axis: DataFrame, field: DataFrame) -> DataFrame:
    """Every label with value and whether it is covered: absent and null stay apart."""
    f = field.withColumnRenamed("i", "pos").withColumn("is_covered", F.lit(True))
    return axis.join(f, "pos", "left").withColumn("is_covered", F.coalesce("is_covered", F.lit(False)))


def total(m: DataFrame) -> DataFrame:
    return m.agg(F.sum(F.col("v").cast("double")).alias("total"))


def flat_position(shape: tuple[int, ...], keys: tuple[str, ...] = ("i", "j", "k")) -> Column:
    """C-order position of an element; ``unflat`` is its inverse."""
    at = F.lit(0).cast("long")
    for n, k in zip(shape, keys):
        at = at * n + F.col(k)
    return at


def unflat(at: Column, shape: tuple[int, ...]) -> list[Column]:
    out = []
    for n in reversed(shape):
        out.insert(0, F.pmod(at, F.lit(n)))
        at = F.floor(at / n).cast("long")
    return out
