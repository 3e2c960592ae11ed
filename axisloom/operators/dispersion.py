"""Overdispersion: residual of log variance over a LOWESS trend, scored by the tail of an F distribution.

The trend is a local linear fit at ``ANCHORS`` values of the log mean, evenly spaced over its range, and
straight lines between them. Each fit sees the columns next in rank to its anchor, with tricube weights. Ranks come from
a range exchange, the sums of a fit are partial aggregates of all columns in its window, and only the anchors reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import log_beta_inc
from ..sources.shared import saved
from .order import numbered

#: Anchors of the trend, the share of columns that a fit sees, and the columns that a trend needs.
ANCHORS, SPAN, LEAST = 200, 0.3, 11
_SUMS = ["w", "u", "y", "uu", "uy"]


def eligible(stats: DataFrame) -> DataFrame:
    return stats.where((F.col("nnz") >= 3) & (F.col("mean") > 0) & (F.col("var") > 0))


def points(stats: DataFrame) -> DataFrame:
    """(j, x, y, nnz): log mean and log variance of the columns that have a score."""
    return eligible(stats).select("j", F.log("mean").alias("x"), F.log("var").alias("y"), "nnz")


def trend(found: DataFrame, anchors: int = ANCHORS, span: float = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(x, fit) of the anchors over points (j, x, y); none for fewer than LEAST points."""
    n, low, high = found.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if n < LEAST:
        return np.zeros(0), np.zeros(0)
    at = low + (high - low) * np.arange(anchors) / (anchors - 1)
    above = lambda values, x: F.size(F.filter(F.array(*[F.lit(float(v)) for v in values]), lambda v: v <= x))
    ranked = numbered(found.select("j", "x", "y"), ["x", "j"], "rank")
    counts = {r[0]: r[1] for r in found.groupBy(above(at, F.col("x")).alias("a")).agg(F.count(F.lit(1))).collect()}
    below = np.cumsum([counts.get(a, 0) for a in range(anchors)])  # points under each anchor
    width = max(2, int(span * n))
    stop = np.minimum(n, np.maximum(0, below - width // 2) + width)
    start = np.maximum(0, stop - width)
    ends = {r[0]: r[1] for r in ranked.where(F.col("rank").isin([int(r) for r in {*start, *(stop - 1)}])).select("rank", "x").collect()}
    reach = np.maximum(1e-9, [max(abs(ends[int(a)] - x0), abs(ends[int(b) - 1] - x0)) for a, b, x0 in zip(start, stop, at)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((5, anchors))
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                rank, x, y = (batch.column(c).slice(lo, 4096).to_numpy() for c in ("rank", "x", "y"))
                u = x[:, None] - at
                w = np.where((rank[:, None] >= start) & (rank[:, None] < stop), (1 - (np.abs(u) / reach) ** 3) ** 3, 0.0)
                total += [w.sum(0), (w * u).sum(0), (w * y[:, None]).sum(0), (w * u * u).sum(0), (w * u * y[:, None]).sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(anchors)), *map(pa.array, total)], names=["a", *_SUMS])

    made = ranked.select("rank", "x", "y").mapInArrow(sums, "a long, " + ", ".join(f"{c} double" for c in _SUMS))
    made = made.groupBy("a").agg(*[F.sum(c).alias(c) for c in _SUMS]).orderBy("a").toPandas()
    w, u, y, uu, uy = (made[c].to_numpy() for c in _SUMS)
    spread = w * uu - u * u
    flat = np.abs(spread) < 1e-12
    return at, np.where(flat, y / w, (uu * y - u * uy) / np.where(flat, 1.0, spread))


def scores(x: np.ndarray, y: np.ndarray, nnz: np.ndarray, at: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """-log P(F > ratio to the trend) with nnz and nnz degrees of freedom."""
    out = -log_beta_inc(nnz / 2, nnz / 2, 1 / (1 + np.exp(y - np.interp(x, at, fit))))
    return np.where(np.isfinite(out), out, 0.0)


def overdispersion(stats: DataFrame) -> DataFrame:
    """stats: (j, mean, var, nnz), a row per column, var over the population. (j, od_score): 0 for columns
    with fewer than 3 entries or no spread, and for all if there are fewer than LEAST others."""
    stats = saved(stats.select("j", "mean", "var", "nnz"), "columns")  # read by each pass of the trend; a row per column
    at, fit = trend(points(stats))
    if not len(at):
        return stats.select("j", F.lit(0.0).alias("od_score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, var, nnz = (batch.column(c).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) for c in ("mean", "var", "nnz"))
            ok = (nnz >= 3) & (mean > 0) & (var > 0)
            out = np.zeros(len(mean))
            out[ok] = scores(np.log(mean[ok]), np.log(var[ok]), nnz[ok], at, fit)
            yield pa.RecordBatch.from_arrays([batch.column("j"), pa.array(out)], names=["j", "od_score"])

    return stats.select(F.col("j").cast("long").alias("j"), "mean", "var", "nnz").mapInArrow(run, "j long, od_score double")
