"""Scalar functions as Spark expressions, and naming rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of feature axes by modality.
MODALITY_AXES = {"rna": "genes", "adt": "proteins", "prot": "proteins", "atac": "peaks"}


def grid_cell(x: Column, lo: Column, hi: Column, grid: int = 1024) -> Column:
    """Cell of a min-max scaled coordinate in 0 .. grid - 1; a zero range counts as 1."""
    width = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    return F.least(F.lit(grid - 1), F.greatest(F.lit(0), F.floor((x - lo) / width * (grid - 1)))).cast("int")


def hilbert(x: Column, y: Column, grid: int = 1024) -> Column:
    """Distance along the Hilbert curve of a cell (x, y); grid is a power of two. One bit of both coordinates a step, no Python."""
    state = F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), F.lit(0).cast("long").alias("d"))
    steps = F.array(*[F.lit(1 << b) for b in range(grid.bit_length() - 2, -1, -1)])

    def step(s: Column, side: Column) -> Column:
        rx, ry = (s["x"].bitwiseAND(side) > 0).cast("int"), (s["y"].bitwiseAND(side) > 0).cast("int")
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, F.lit(grid - 1) - s["x"]).otherwise(s["x"]), F.when(flip, F.lit(grid - 1) - s["y"]).otherwise(s["y"])
        d = s["d"] + side.cast("long") * side.cast("long") * (F.lit(3) * rx).bitwiseXOR(ry).cast("long")
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    return F.aggregate(steps, state, step)["d"]


def rgba(v: Column, most: Column) -> Column:
    """Colour ramp of a value in 0 .. most: struct r, g, b, a in bytes. A maximum of 0 or less counts as 1."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / F.when(most > 0, most).otherwise(F.lit(1.0))))
    byte = lambda x: F.floor(x + 0.5).cast("int")
    return F.struct(byte(255 * t).alias("r"), byte(64 + 120 * t).alias("g"), byte(255 * (1 - t)).alias("b"), F.lit(255).alias("a"))


def strip_prefix(name: str) -> str:
    return name[2:] if name.startswith("X_") else name


def split_last(name: str) -> tuple[str, str]:
    """('a.b', 'c') of 'a.b.c'."""
    head, _, tail = name.rpartition(".")
    return head, tail


def state_by_name(name: str) -> str:
    """The last resort, where values can't tell."""
    low = name.lower()
    return "scaled" if "scale" in low else "raw" if "count" in low or "raw" in low else "lognorm"


def unique_name(name: str, axis: str, taken: set[str]) -> str:
    """name, else name.axis, name.axis2, ..."""
    if name not in taken:
        return name
    made, k = f"{name}.{axis}", 2
    while made in taken:
        made, k = f"{name}.{axis}{k}", k + 1
    return made


def modality_axis(modality: str) -> str:
    return MODALITY_AXES.get(modality.lower(), re.sub(r"\W+", "_", modality))
