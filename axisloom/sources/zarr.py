"""Chunked array stores of the Zarr family, versions 2 and 3: arrays, sharded arrays and whole axis-and-field stores.

Ranges and lists of positions, given with the read, choose the chunks that become partitions, small chunks together; positions
that a table holds choose them by a shuffle of chunk numbers. (Spark 4.1 keeps what pushed filters made of a Python source's reader
with the relation, so that a second use of one frame with another predicate lost rows; hence options, not ``pushFilters``.) Tasks read byte ranges: of a shard its index and the inner chunks asked for, of an uncompressed chunk the
rows asked for, of a zip file its directory once per process and then members by offset. A missing chunk is the fill
value. Paths are of a file system that executors mount; a store may also be one zip file of stored members. Codecs: gzip, zlib, zstd,
bytes (either endianness), transpose, crc32c, sharding_indexed.
"""

from __future__ import annotations

import gzip
import itertools
import json
import math
import os
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import Dataset
from .passthrough import leaf_chunks

_MISSING = (1 << 64) - 1
_open = open


@dataclass(frozen=True)
class Place:
    """Where a value's bytes lie, and when that file was written."""

    file: str
    offset: int
    size: int
    stamp: int

    def read(self, lo: int = 0, hi: int | None = None) -> bytes:
        hi = self.size if hi is None else hi
        with _open(self.file, "rb") as f:
            f.seek(self.offset + lo)
            return f.read(hi - lo)


@lru_cache(maxsize=16)
def _directory(root: str, stamp: int) -> dict[str, zipfile.ZipInfo]:
    with _open(root, "rb") as f, zipfile.ZipFile(f) as z:
        return {i.filename: i for i in z.infolist()}


@lru_cache(maxsize=1 << 16)
def _member(root: str, stamp: int, key: str) -> Place | None:
    info = _directory(root, stamp).get(key)
    if info is None:
        return None
    if info.compress_type != zipfile.ZIP_STORED:
        raise ValueError(f"{root}: member {key} is compressed; only stored members can be read by range")
    with _open(root, "rb") as f:
        f.seek(info.header_offset)
        name, extra = struct.unpack("<26xHH", f.read(30))
    return Place(root, info.header_offset + 30 + name + extra, info.file_size, stamp)


def locate(root: str, key: str) -> Place | None:
    """A value of the store: a file under a folder, or a member of a zip file, stored without compression."""
    if os.path.isfile(root):
        return _member(root, os.stat(root).st_mtime_ns, key)
    path = os.path.join(root, key)
    if not os.path.isfile(path):
        return None
    st = os.stat(path)
    return Place(path, 0, st.st_size, st.st_mtime_ns)


def get(root: str, key: str) -> bytes | None:
    place = locate(root, key)
    return None if place is None else place.read()


@lru_cache(maxsize=1)
def _crc_table() -> list[int]:
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0x82F63B78 if c & 1 else 0) for c in table]
    return table


def crc32c(data: bytes) -> int:
    table, crc = _crc_table(), 0xFFFFFFFF
    for b in data:
        crc = table[(crc ^ b) & 255] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def _unzstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


@dataclass
class Meta:
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: np.dtype
    fill: Any
    codecs: list[dict]
    version: int
    separator: str = "/"

    @property
    def grid(self) -> tuple[int, ...]:
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunks))

    def key(self, at: tuple[int, ...]) -> str:
        if self.version == 2:
            return self.separator.join(map(str, at)) if at else "0"
        return "/".join(["c", self.separator.join(map(str, at))]) if at else "c"


def meta(root: str, path: str) -> Meta:
    raw = get(root, f"{path}/zarr.json".lstrip("/"))
    if raw is not None:
        m = json.loads(raw)
        dtype = np.dtype({"bool": "?"}.get(m["data_type"], m["data_type"]))
        sep = m.get("chunk_key_encoding", {}).get("configuration", {}).get("separator", "/")
        return Meta(tuple(m["shape"]), tuple(m["chunk_grid"]["configuration"]["chunk_shape"]), dtype, m.get("fill_value") or 0, m["codecs"], 3, sep)
    raw = get(root, f"{path}/.zarray".lstrip("/"))
    if raw is None:
        raise FileNotFoundError(f"no array at {path} in {root}")
    m = json.loads(raw)
    codecs = [{"name": "transpose", "configuration": {"order": list(range(len(m["shape"])))[::-1]}}] if m.get("order") == "F" else []
    codecs += [{"name": "v2", "configuration": {}}]
    if m.get("filters"):
        raise ValueError(f"{path}: filters {m['filters']} are not supported")
    if m.get("compressor"):
        codecs.append({"name": m["compressor"]["id"], "configuration": m["compressor"]})
    return Meta(tuple(m["shape"]), tuple(m["chunks"]), np.dtype(m["dtype"]), m.get("fill_value") or 0, codecs, 2, m.get("dimension_separator", "."))


def attributes(root: str, path: str) -> dict[str, Any]:
    raw = get(root, f"{path}/zarr.json".lstrip("/"))
    if raw is not None:
        return json.loads(raw).get("attributes", {})
    raw = get(root, f"{path}/.zattrs".lstrip("/"))
    return json.loads(raw) if raw else {}


def decode(data: bytes, shape: tuple[int, ...], dtype: np.dtype, codecs: list[dict], fill: Any = 0) -> np.ndarray:
    order, endian = None, dtype
    for c in reversed(codecs):
        name, conf = c["name"], c.get("configuration") or {}
        if name == "gzip":
            data = gzip.decompress(data)
        elif name == "zlib":
            data = zlib.decompress(data)
        elif name == "zstd":
            data = _unzstd(data)
        elif name == "crc32c":
            if crc32c(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
                raise ValueError("checksum of a chunk does not match")
            data = data[:-4]
        elif name == "bytes":
            endian = dtype.newbyteorder(">" if conf.get("endian") == "big" else "<")
        elif name == "transpose":
            order = conf["order"]
        elif name == "sharding_indexed":
            grid = _grid(shape, tuple(conf["chunk_shape"]))
            lo, hi = _index_span(len(data), grid, conf)
            return _inner(lambda a, b: data[a:b], _places(data[lo:hi], grid, conf["index_codecs"]), shape, dtype, conf, fill, (0,) * len(shape), shape)
        elif name != "v2":
            raise ValueError(f"unknown codec '{name}'")
    if order is None:
        return np.frombuffer(data, endian).reshape(shape).astype(dtype, copy=False)
    stored = tuple(shape[i] for i in order)
    return np.frombuffer(data, endian).reshape(stored).transpose(np.argsort(order)).astype(dtype, copy=False)


def _grid(n: tuple[int, ...], size: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(-(-x // c) for x, c in zip(n, size))


def _places(index: bytes, grid: tuple[int, ...], codecs: list[dict]) -> np.ndarray:
    return decode(index, (*grid, 2), np.dtype("<u8"), codecs)


def _index_span(size: int, grid: tuple[int, ...], conf: dict) -> tuple[int, int]:
    n = 16 * math.prod(grid) + 4 * any(c["name"] == "crc32c" for c in conf["index_codecs"])
    return (size - n, size) if conf.get("index_location", "end") == "end" else (0, n)


@lru_cache(maxsize=256)
def _stored_index(place: Place, grid: tuple[int, ...], conf: str) -> np.ndarray:
    c = json.loads(conf)
    return _places(place.read(*_index_span(place.size, grid, c)), grid, c["index_codecs"])


def _inner(read: Any, places: np.ndarray, shape: tuple[int, ...], dtype: np.dtype, conf: dict, fill: Any, lo: tuple[int, ...], hi: tuple[int, ...]) -> np.ndarray:
    """Region lo .. hi of a shard; read: bytes by range. Inner chunks outside the region aren't read."""
    size = tuple(conf["chunk_shape"])
    out = np.full([b - a for a, b in zip(lo, hi)], fill, dtype)
    for at in itertools.product(*(range(a // c, -(-b // c)) for a, b, c in zip(lo, hi, size))):
        start, length = places[at].tolist()
        if start != _MISSING:
            x = decode(read(start, start + length), size, dtype, conf["codecs"], fill)
            _paste(out, x, [k * c for k, c in zip(at, size)], lo, hi)
    return out


def _paste(out: np.ndarray, x: np.ndarray, origin: Iterable[int], lo: tuple[int, ...], hi: tuple[int, ...]) -> None:
    """The part of x, which begins at origin, that lies in lo .. hi, into out, which begins at lo."""
    ends = [(max(o, a), min(o + n, b), o, a) for o, n, a, b in zip(origin, x.shape, lo, hi)]
    out[tuple(slice(s - a, e - a) for s, e, _, a in ends)] = x[tuple(slice(s - o, e - o) for s, e, o, _ in ends)]


def _of_chunk(place: Place, m: Meta, lo: tuple[int, ...], hi: tuple[int, ...]) -> np.ndarray:
    """Region lo .. hi of a chunk, by ranges where its codecs allow them."""
    names = [c["name"] for c in m.codecs]
    if names == ["sharding_indexed"]:
        conf = m.codecs[0]["configuration"]
        grid = _grid(m.chunks, tuple(conf["chunk_shape"]))
        return _inner(place.read, _stored_index(place, grid, json.dumps(conf)), m.chunks, m.dtype, conf, m.fill, lo, hi)
    if len(lo) and names in (["bytes"], ["v2"]):
        row = m.dtype.itemsize * math.prod(m.chunks[1:])
        x = decode(place.read(lo[0] * row, hi[0] * row), (hi[0] - lo[0], *m.chunks[1:]), m.dtype, m.codecs)
        return x[(slice(None), *(slice(a, b) for a, b in zip(lo[1:], hi[1:])))]
    x = decode(place.read(), m.chunks, m.dtype, m.codecs, m.fill)
    return x[tuple(slice(a, b) for a, b in zip(lo, hi))]


def read_region(root: str, path: str, lo: Iterable[int] | None = None, hi: Iterable[int] | None = None, m: Meta | None = None) -> np.ndarray:
    """Elements lo .. hi - 1 of an array in each dimension, cut to the array."""
    m = m or meta(root, path)
    lo = tuple(max(0, a) for a in (lo or [0] * len(m.shape)))
    hi = tuple(max(a, min(b, n)) for a, b, n in zip(lo, m.shape if hi is None else hi, m.shape))
    out = np.full([b - a for a, b in zip(lo, hi)], m.fill, m.dtype)
    if out.size == 0:
        return out
    for at in itertools.product(*(range(a // c, -(-b // c)) for a, b, c in zip(lo, hi, m.chunks))):
        place = locate(root, f"{path}/{m.key(at)}".lstrip("/"))
        if place is not None:
            origin = [k * c for k, c in zip(at, m.chunks)]
            first = tuple(max(0, a - o) for a, o in zip(lo, origin))
            x = _of_chunk(place, m, first, tuple(min(c, b - o) for b, o, c in zip(hi, origin, m.chunks)))
            _paste(out, x, [o + f for o, f in zip(origin, first)], lo, hi)
    return out


def read_array(root: str, path: str) -> np.ndarray:
    return read_region(root, path)


def read_range(root: str, path: str, lo: int, hi: int, m: Meta | None = None) -> np.ndarray:
    """Elements lo .. hi - 1 of a 1-D array."""
    return read_region(root, path, (lo,), (hi,), m)


def read_strings(root: str, path: str) -> list[str]:
    """Concatenated UTF-8 bytes with offsets."""
    raw, off = read_array(root, path).tobytes(), read_array(root, f"{path}_offsets")
    return [raw[a:b].decode("utf-8") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def spark_type(dtype: np.dtype) -> str:
    """Whole numbers stay whole; those beyond 64 bits with a sign are an error when read."""
    return "boolean" if dtype.kind == "b" else "long" if dtype.kind in "iu" else "double"


def _unit(m: Meta) -> tuple[int, ...]:
    """Shape of what is decoded at a time: an inner chunk of a shard, else a chunk."""
    sharded = [c["configuration"]["chunk_shape"] for c in m.codecs if c["name"] == "sharding_indexed"]
    return tuple(sharded[0]) if sharded else m.chunks


def _entries(x: np.ndarray, lo: list[int], kind: str, only: list[set[int] | None]) -> Iterator[pa.RecordBatch]:
    """Positions and values of a region that begins at lo."""
    n = x.ndim
    where = np.indices(x.shape).reshape(n, -1) + np.array(lo, np.int64).reshape(n, 1)
    x = x.ravel()
    for d, some in enumerate(only):
        if some is not None:
            keep = np.isin(where[d], np.fromiter(some, np.int64))
            where, x = where[:, keep], x[keep]
    to = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64()}[kind]
    for first in range(0, x.size, 1 << 20):
        cut = slice(first, first + (1 << 20))
        yield pa.RecordBatch.from_arrays([*(pa.array(w[cut].astype(np.int64)) for w in where), pa.array(x[cut]).cast(to)], names=[*"ijk"[:n], "v"])


class ArrayReader(DataSourceReader):
    """Positions and values under ``i``, ``j`` and ``k``: "lo:hi" (hi excluded) or positions set apart by commas. A partition has
    chunks of about ``bytes`` of rows."""

    def __init__(self, options: dict[str, str]):
        self.root, self.path = options["path"], options.get("array", "")
        self.meta = meta(self.root, self.path)
        self.least = int(options.get("bytes", 8 << 20))
        n = len(self.meta.shape)
        self.lo, self.hi, self.only = [0] * n, list(self.meta.shape), [None] * n
        for d, k in enumerate("ijk"[:n]):
            given = options.get(k)
            if given is not None and ":" in given:
                lo, hi = given.split(":")
                self.lo[d], self.hi[d] = max(0, int(lo or 0)), min(self.hi[d], int(hi or self.hi[d]))
            elif given is not None:
                self.only[d] = {int(v) for v in given.split(",") if v.strip()}

    def units(self) -> list[range | list[int]]:
        """In each dimension the units to read."""
        out = []
        for a, b, c, only, n in zip(self.lo, self.hi, _unit(self.meta), self.only, self.meta.shape):
            out.append(sorted({v // c for v in only if 0 <= v < n}) if only is not None else range(a // c, -(-b // c)) if a < b else [])
        return out

    def partitions(self) -> list[InputPartition]:
        unit = _unit(self.meta)
        total = math.prod(map(len, self.units()))
        per = max(1, self.least // max(1, math.prod(unit) * 8 * (len(unit) + 1)))
        return [InputPartition((lo, min(lo + per, total))) for lo in range(0, total, per)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        units = self.units()
        for at in range(*partition.value):
            place = np.unravel_index(at, [len(u) for u in units]) if units else ()
            corner = [int(u[k]) * c for u, k, c in zip(units, place, _unit(self.meta))]
            lo = [max(a, o) for a, o in zip(self.lo, corner)]
            hi = [min(b, o + c) for b, o, c in zip(self.hi, corner, _unit(self.meta))]
            yield from _entries(read_region(self.root, self.path, lo, hi, self.meta), lo, spark_type(self.meta.dtype), self.only)


class ArraySource(DataSource):
    """spark.read.format("zarr-array").option("array", path in the store).option("j", "500:540").load(store): positions and values."""

    @classmethod
    def name(cls) -> str:
        return "zarr-array"

    def schema(self) -> str:
        return _schema(meta(self.options["path"], self.options.get("array", "")))

    def reader(self, schema: Any) -> DataSourceReader:
        return ArrayReader(self.options)


def _schema(m: Meta) -> str:
    return ", ".join([*(f"{k} long" for k in "ijk"[: len(m.shape)]), f"v {spark_type(m.dtype)}"])


def array_frame(spark: SparkSession, root: str, path: str, **where: tuple[int | None, int | None] | list[int]) -> DataFrame:
    """Positions and values of an array. where: by dimension (i, j, k) a range (lo, hi), hi excluded, or a list of
    positions; only the chunks these touch are read."""
    spark.dataSource.register(ArraySource)
    reader = spark.read.format("zarr-array").option("array", path)
    for k, given in where.items():
        reader = reader.option(k, ":".join("" if v is None else str(v) for v in given) if isinstance(given, tuple) else ",".join(map(str, given)))
    return reader.load(root)


def array_at(wanted: DataFrame, root: str, path: str, key: str = "i") -> DataFrame:
    """The entries at the positions that ``wanted`` (key) holds, however many: chunks are chosen by its distinct chunk
    numbers, dealt to tasks, and entries beside the wanted ones are dropped by a join. Positions outside the array have none."""
    m = meta(root, path)
    unit, d = _unit(m), "ijk".index(key)
    n, grid = len(m.shape), _grid(m.shape, unit)
    touched = wanted.where(F.col(key).between(0, m.shape[d] - 1)).select(F.floor(F.col(key) / unit[d]).cast("long").alias("u0")).distinct()
    others = [e for e in range(n) if e != d]
    for k, e in enumerate(others, 1):
        touched = touched.withColumn(f"u{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid[e] - 1).cast("long"))))
    order = [0 if e == d else 1 + others.index(e) for e in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in zip(*(batch.column(k).to_pylist() for k in order)):
                lo = [k * c for k, c in zip(at, unit)]
                yield from _entries(read_region(root, path, lo, [o + c for o, c in zip(lo, unit)], m), lo, spark_type(m.dtype), [None] * n)

    out = touched.repartition(*touched.columns).mapInArrow(run, _schema(m))
    return out.join(wanted.select(key).distinct(), key, "left_semi").select(*"ijk"[:n], "v")


def string_frame(spark: SparkSession, root: str, path: str, block: int = 1 << 16) -> DataFrame:
    """(i, v) of concatenated strings; a task reads the offsets and bytes of ``block`` of them by range."""
    offsets, letters = meta(root, f"{path}_offsets"), meta(root, path)
    n = offsets.shape[0] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in batch.column("id").to_pylist():
                off = read_range(root, f"{path}_offsets", lo, min(lo + block, n) + 1, offsets).astype(np.int64)
                raw = read_range(root, path, int(off[0]), int(off[-1]), letters).tobytes() if len(off) else b""
                values = [raw[x:y].decode("utf-8") for x, y in zip((off[:-1] - off[0]).tolist(), (off[1:] - off[0]).tolist())] if len(off) else []
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(values))), pa.array(values, pa.string())], names=["i", "v"])

    return spark.range(0, max(n, 0), block, max(1, -(-n // block))).mapInArrow(run, "i long, v string")


def sparse_frame(spark: SparkSession, root: str, path: str, by_column: bool, block: int = 1 << 20) -> DataFrame:
    """(i, j, v) of compressed sparse arrays data, indices, indptr. Tasks read the pointers by range and cut the entries
    into runs of at most ``block``, which other tasks read by range, so neither a long row nor many rows meet in one."""
    m = {k: meta(root, f"{path}/{k}") for k in ("indptr", "indices", "data")}
    n = m["indptr"].shape[0] - 1
    many = 1 << 16

    def part(k: str, lo: int, hi: int) -> np.ndarray:
        return read_range(root, f"{path}/{k}", lo, hi, m[k])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in batch.column("id").to_pylist():
                ptr = part("indptr", lo, min(lo + many, n) + 1).astype(np.int64)
                a = np.arange(ptr[0], ptr[-1], block)
                b = np.minimum(a + block, ptr[-1])
                first, stop = np.searchsorted(ptr, a, side="right") - 1, np.searchsorted(ptr, b, side="left")
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, first + lo, stop + lo)], names=["a", "b", "first", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, first, stop in zip(*(c.to_pylist() for c in batch.columns)):
                ptr = part("indptr", first, stop + 1).astype(np.int64)
                inner = part("indices", a, b).astype(np.int64)
                outer = first + np.searchsorted(ptr, np.arange(a, b), side="right") - 1
                i, j = (inner, outer) if by_column else (outer, inner)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j.astype(np.int64)), pa.array(part("data", a, b).astype(np.float64))], names=["i", "j", "v"])

    starts = spark.range(0, max(n, 0), many, max(1, -(-n // many)))
    cuts = starts.mapInArrow(cut, "a long, b long, first long, stop long").repartition("a")
    return cuts.mapInArrow(run, "i long, j long, v double").where("v <> 0 or isnan(v)")


def namespace(root: str) -> str:
    """The key of the root attributes that holds the dataset's metadata."""
    for k, v in attributes(root, "").items():
        if isinstance(v, dict) and "spec_version" in v:
            return k
    raise ValueError(f"{root} has no dataset metadata in its root attributes")


def _placed(df: DataFrame, index: DataFrame | None, side: str = "i") -> DataFrame:
    """Positions of a partial field in place of those in its arrays."""
    if index is None:
        return df
    return df.join(index.select(F.col("i").alias(side), F.col("v").cast("long").alias("_p")), side).withColumn(side, F.col("_p")).drop("_p").select(*df.columns)


def _values(spark: SparkSession, root: str, path: str, m: dict, index: DataFrame | None) -> DataFrame:
    """The frame of a field by its encoding."""
    if m["encoding"] in ("csc", "csr"):
        side = "ij"[m["span"].index(m["index_axis"])] if index is not None else "i"
        return _placed(sparse_frame(spark, root, path, m["encoding"] == "csc"), index, side)
    if m["encoding"] == "categorical":
        codes = array_frame(spark, root, f"{path}/codes")
        return _placed(codes.select("i", F.when(F.col("v") >= 0, F.col("v").cast("int")).alias("v")), index)
    if m["encoding"] == "utf8":
        return _placed(string_frame(spark, root, f"{path}/values"), index)
    x = array_frame(spark, root, f"{path}/values")
    if "k" in x.columns:
        return x.withColumn("v", F.col("v").cast("double"))
    if "j" in x.columns:
        row = F.sort_array(F.collect_list(F.struct("j", F.col("v").cast("double").alias("v"))))
        return _placed(x.groupBy("i").agg(row.alias("_r")).select("i", F.col("_r.v").alias("vec")), index)
    if m.get("nullable"):
        gone = array_frame(spark, root, f"{path}/mask").select("i", F.col("v").cast("boolean").alias("_gone"))
        x = x.join(gone, "i").select("i", F.when(~F.col("_gone"), F.col("v")).alias("v"))
    return _placed(x, index)


def _tail(ds: Dataset, root: str, key: str, names: list[str]) -> None:
    """The untyped tail: trees as they are, and the arrays they refer to as chunks that tasks read, named by namespace and id."""
    frames = []
    for ns in names:
        a = attributes(root, f"passthrough/{ns}")[key]
        ds.aux[ns] = json.loads(a["tree"]) if isinstance(a["tree"], str) else a["tree"]
        for leaf in a.get("arrays", []):
            path = f"passthrough/{ns}/{leaf['id']}"
            if leaf["kind"] == "utf8":
                n = meta(root, f"{path}_offsets").shape[0] - 1
                frames.append(leaf_chunks(string_frame(ds.spark, root, path), f"{ns}/{leaf['id']}", "<U1", (n,)))
            else:
                m = meta(root, path)
                frames.append(leaf_chunks(array_frame(ds.spark, root, path), f"{ns}/{leaf['id']}", m.dtype.str, m.shape))
    if frames:
        ds.leaves = reduce(DataFrame.unionByName, frames)


def read_store(spark: SparkSession, root: str) -> Dataset:
    """An axis-and-field store as a Dataset. Arrays stay on disk until a plan reads them, each chunk or range in a task of
    its own; only metadata and the categories of a field are read here."""
    key = namespace(root)
    top = attributes(root, "")[key]
    ds = Dataset(spark, top["kind"])
    ds.profiles, ds.dropped = list(top.get("profiles", [])), list(top.get("dropped", []))
    for name in top["axes"]:
        a = attributes(root, f"axes/{name}")[key]
        labels = string_frame(spark, root, f"axes/{name}/labels").toDF("pos", "label")
        n = meta(root, f"axes/{name}/labels_offsets").shape[0] - 1
        ds.add_axis(name, labels, length=n, origin=a.get("origin", "observed"), role=a.get("role") or "observation", induced_by=a.get("induced_by"), provenance=a.get("provenance") or {})
    for name in top["fields"]:
        m = attributes(root, f"fields/{name}")[key]
        path = f"fields/{name}"
        index = array_frame(spark, root, f"{path}/index") if m.get("coverage") == "partial" else None
        categories = tuple(read_strings(root, f"{path}/categories")) if m["encoding"] == "categorical" else None
        meta_ = {k: m.get(k) for k in ("state", "subtype", "directed", "weighted", "uncertainty", "index_axis") if m.get(k) is not None}
        ds.add_field(name, _values(spark, root, path, m, index), span=tuple(m["span"]), induce=False, role=m.get("role"), encoding=m["encoding"], coverage=m.get("coverage") or "full", nullable=bool(m.get("nullable")), categories=categories, ordered=bool(m.get("ordered")), provenance=m.get("provenance") or {}, **meta_)
    _tail(ds, root, key, top.get("passthrough", []))
    return ds
