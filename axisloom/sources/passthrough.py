"""Untyped leftovers: nested dicts and lists with array leaves, kept verbatim beside the typed fields.

A tree is JSON and small; its leaves may be arrays of any size. They are rows of chunks, (leaf, part, at, shape, longs, doubles, texts), made, written and
read by tasks: ``part`` orders the chunks of a leaf and ``at`` is the C-order position of a chunk's first element, so any range of a leaf
can be read alone. ``leaves_of`` brings leaves to the driver, for trees whose arrays are known to be small.
"""

from __future__ import annotations

import base64
import math
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.measure import flat_position

#: The tags of the tree's grammar.
OBJ, LIST, ARRAY, STRINGS, RECORD, BYTES, DROPPED = "$obj", "$list", "$array", "$strings", "$record", "$bytes", "$dropped"


def to_tree(value: Any, leaves: dict[str, np.ndarray]) -> Any:
    """JSON tree of a value; arrays go to ``leaves`` by id. What can't be kept is named, never lost in silence."""

    def leaf(x: np.ndarray, tag: str) -> dict:
        name = f"a{len(leaves)}"
        leaves[name] = x
        return {tag: name}

    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, np.generic):
        return to_tree(value.item(), leaves)
    if isinstance(value, bytes):
        return {BYTES: base64.b64encode(value).decode()}
    if isinstance(value, dict):
        return {OBJ: [[str(k), to_tree(v, leaves)] for k, v in value.items()]}
    if isinstance(value, (list, tuple)):
        return {LIST: [to_tree(v, leaves) for v in value]}
    if isinstance(value, np.ndarray):
        if value.dtype.names:
            return {RECORD: [[n, to_tree(np.ascontiguousarray(value[n]), leaves)] for n in value.dtype.names]}
        return leaf(value.astype(str), STRINGS) if value.dtype.kind in "OUS" else leaf(value, ARRAY)
    return {DROPPED: type(value).__name__}


def from_tree(tree: Any, leaves: dict[str, np.ndarray]) -> Any:
    if not isinstance(tree, dict):
        return tree
    (tag, x), *_ = tree.items()
    if tag == OBJ:
        return {k: from_tree(v, leaves) for k, v in x}
    if tag == LIST:
        return [from_tree(v, leaves) for v in x]
    if tag in (ARRAY, STRINGS):
        return leaves[x]
    if tag == BYTES:
        return base64.b64decode(x)
    if tag == RECORD:
        cols = [(k, from_tree(v, leaves)) for k, v in x]
        out = np.empty(len(cols[0][1]), [(k, v.dtype) for k, v in cols])
        for k, v in cols:
            out[k] = v
        return out
    return None


CHUNK = 1 << 16
LEAVES = "leaf string, part long, at long, dtype string, shape array<bigint>, longs array<bigint>, doubles array<double>, texts array<string>"
_COLUMN = {"long": "longs", "double": "doubles", "string": "texts"}


def _kind(dtype: np.dtype) -> str:
    return "string" if dtype.kind in "US" else "double" if dtype.kind == "f" else "long"


def leaf_chunks(values: DataFrame, leaf: str, dtype: str, shape: tuple[int, ...], chunk: int = CHUNK) -> DataFrame:
    """A leaf's chunks from its elements (i or i, j or i, j, k; v), of which none may be missing or stand twice: a job that
    meets such a chunk fails. A task holds one chunk at a time."""
    column, total = _COLUMN[_kind(np.dtype(dtype))], math.prod(shape)
    at = flat_position(shape, tuple(k for k in "ijk" if k in values.columns))
    one = values.select(at.alias("at"), F.col("v").cast({v: k for k, v in _COLUMN.items()}[column]).alias("v"))
    part = F.floor(F.col("at") / chunk).cast("long")
    held = one.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("e"))
    first = F.col("part") * chunk
    whole = (F.size("e") == F.least(F.lit(chunk), total - first)) & (F.element_at("e", 1)["at"] == first) & (F.size(F.array_distinct(F.col("e.at"))) == F.size("e"))
    e = F.when(whole, F.col("e.v")).otherwise(F.raise_error(F.concat(F.lit(f"leaf {leaf}: elements are missing or repeated in part "), F.col("part").cast("string"))))
    given = {c: e if c == column else F.lit(None) for c in _COLUMN.values()}
    shaped = F.array(*[F.lit(n).cast("long") for n in shape]).cast("array<bigint>")
    kinds = {"longs": "array<bigint>", "doubles": "array<double>", "texts": "array<string>"}
    return held.select(F.lit(leaf).alias("leaf"), "part", first.alias("at"), F.lit(dtype).alias("dtype"), shaped.alias("shape"), *(v.cast(kinds[c]).alias(c) for c, v in given.items()))


def leaf_values(leaves: DataFrame, leaf: str, kind: str = "double", lo: int = 0, hi: int | None = None) -> DataFrame:
    """(i, v) of a leaf's elements lo .. hi - 1 by C-order position; kind: long, double or string. Other chunks aren't read."""
    own = leaves.where(F.col("leaf") == leaf)
    if hi is not None:
        own = own.where(F.col("at") < hi)
    own = own.where(F.col("at") + F.size(_COLUMN[kind]) > lo).select("at", F.posexplode(_COLUMN[kind]).alias("p", "v")).select((F.col("at") + F.col("p")).alias("i"), "v")
    return own.where(F.col("i") >= lo) if hi is None else own.where((F.col("i") >= lo) & (F.col("i") < hi))


def leaves_frame(spark: SparkSession, leaves: dict[str, np.ndarray], chunk: int = CHUNK) -> DataFrame:
    """The chunks of arrays that the driver has."""
    rows = []
    for name, x in leaves.items():
        flat = x.ravel().astype(np.int64) if x.dtype.kind == "b" else x.ravel()
        for part, at in enumerate(range(0, max(1, flat.size), chunk)):
            held = {c: None for c in _COLUMN.values()} | {_COLUMN[_kind(x.dtype)]: flat[at : at + chunk].tolist()}
            rows.append((name, part, at, x.dtype.str, list(x.shape), *held.values()))
    return spark.createDataFrame(rows, LEAVES)


def leaves_of(df: DataFrame) -> dict[str, np.ndarray]:
    """Whole leaves as arrays on the driver."""
    parts: dict[str, list] = {}
    for r in df.toLocalIterator():
        parts.setdefault(r["leaf"], []).append(r)
    out = {}
    for name, own in parts.items():
        dtype = np.dtype(own[0]["dtype"])
        values = [v for r in sorted(own, key=lambda r: r["part"]) for v in r[_COLUMN[_kind(dtype)]]]
        out[name] = np.array(values, dtype).reshape(own[0]["shape"])
    return out
