"""Parquet store: a folder per axis and field, and a manifest that is written last.

::

    <path>/axes/<name>/*.parquet      (pos, label), sorted by pos
    <path>/fields/<name>/<version>/   the field's frame, clustered by its layout
    <path>/leaves/<version>/          chunks of the untyped tail's arrays
    <path>/manifest/<version>/        one JSON row: the dataset's metadata, with the version of each field

Readers take the newest manifest, so fields may be appended while others read. Opening is lazy: only
the manifest is read, and each field's columns and row groups when a plan needs them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..model import Axis, Dataset, Field
from ..operators.measure import clustered

SPEC_VERSION = "0.1"
CODECS = {None: "uncompressed", "none": "uncompressed", "gzip": "gzip", "zlib": "gzip", "zstd": "zstd", "snappy": "snappy"}


def codec(name: str | None) -> str:
    if name not in CODECS:
        raise ValueError(f"unknown codec '{name}', known: {sorted(map(str, CODECS))}")
    return CODECS[name]


def _write(df: DataFrame, path: str, compressor: str | None, rows_per_file: int | None) -> None:
    w = df.write.mode("errorifexists").option("compression", codec(compressor))
    (w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w).parquet(path)


def _laid_out(f: Field) -> DataFrame:
    if f.encoding in ("csc", "coo"):
        return clustered(f.df, "j") if "j" in f.df.columns else f.df
    if f.encoding == "csr":
        return clustered(f.df, "i")
    return f.df.repartitionByRange(f.keys[0]).sortWithinPartitions(*f.keys)


def _field_meta(f: Field, version: str) -> dict[str, Any]:
    return {k: getattr(f, k) for k in ("role", "span", "state", "encoding", "shape", "subtype", "coverage", "index_axis", "directed", "weighted", "uncertainty", "nullable", "categories", "ordered", "provenance")} | {"version": version}


def _axis_meta(a: Axis) -> dict[str, Any]:
    return {k: getattr(a, k) for k in ("length", "origin", "role", "induced_by", "provenance")}


def _commit(spark: SparkSession, path: str, meta: dict[str, Any]) -> None:
    at = spark.sql("select cast(unix_micros(current_timestamp()) as bigint)").first()[0]
    spark.createDataFrame([(at, json.dumps(meta))], "written long, meta string").coalesce(1).write.parquet(f"{path}/manifest/{at:020d}-{uuid.uuid4().hex}")


def _meta(spark: SparkSession, path: str) -> dict[str, Any]:
    df = spark.read.schema("written long, meta string").option("recursiveFileLookup", "true").parquet(f"{path}/manifest")
    return json.loads(df.orderBy(F.desc("written")).first()["meta"])


def write(ds: Dataset, path: str, compressor: str | None = "zstd", layouts: dict[str, dict] | None = None, rows_per_file: int | None = None, progress: Callable[[str, int], None] | None = None) -> str:
    """layouts: per field {compressor, rows_per_file}, before the defaults. progress: called with the name and rows of each field when it is written."""
    meta: dict[str, Any] = {"spec_version": SPEC_VERSION, "kind": ds.kind, "profiles": ds.profiles, "dropped": ds.dropped, "aux": ds.aux, "axes": {}, "fields": {}}
    for a in ds.axes.values():
        _write(a.df.repartitionByRange("pos").sortWithinPartitions("pos"), f"{path}/axes/{a.name}", compressor, rows_per_file)
        meta["axes"][a.name] = _axis_meta(a)
    for f in ds.fields.values():
        meta["fields"][f.name] = _put(f, path, compressor, layouts, rows_per_file, progress)
    if ds.leaves is not None:
        meta["leaves"] = uuid.uuid4().hex
        _write(ds.leaves.repartition("leaf", "part").sortWithinPartitions("leaf", "part"), f"{path}/leaves/{meta['leaves']}", compressor, None)
    _commit(ds.spark, path, meta)
    return path


def _put(f: Field, path: str, compressor: str | None, layouts: dict[str, dict] | None, rows_per_file: int | None, progress: Callable[[str, int], None] | None = None) -> dict[str, Any]:
    own = (layouts or {}).get(f.name, {})
    version = uuid.uuid4().hex
    seen = Observation(f"rows-{version}")
    df = _laid_out(f)
    _write(df.observe(seen, F.count(F.lit(1)).alias("rows")) if progress else df, f"{path}/fields/{f.name}/{version}", own.get("compressor", compressor), own.get("rows_per_file", rows_per_file))
    if progress:
        progress(f.name, seen.get["rows"])
    return _field_meta(f, version)


def append(ds: Dataset, path: str, fields: list[str], compressor: str | None = "zstd", layouts: dict[str, dict] | None = None) -> None:
    """Adds or replaces fields (and axes they need) of an existing store; the new manifest makes them visible at once."""
    meta = _meta(ds.spark, path)
    for name in fields:
        f = ds.fields[name]
        for a in f.span:
            if a not in meta["axes"]:
                _write(ds.axes[a].df, f"{path}/axes/{a}", compressor, None)
                meta["axes"][a] = _axis_meta(ds.axes[a])
        meta["fields"][name] = _put(f, path, compressor, layouts, None)
    meta["profiles"] = ds.profiles
    _commit(ds.spark, path, meta)


def read(spark: SparkSession, path: str, lazy: bool = True) -> Dataset:
    meta = _meta(spark, path)
    if meta["spec_version"].split(".")[0] != SPEC_VERSION.split(".")[0]:
        raise ValueError(f"store has spec_version {meta['spec_version']}, this reads {SPEC_VERSION}")
    ds = Dataset(spark, meta["kind"])
    ds.profiles, ds.dropped, ds.aux = meta["profiles"], meta["dropped"], meta["aux"]
    if meta.get("leaves"):
        ds.leaves = spark.read.parquet(f"{path}/leaves/{meta['leaves']}")
    for name, a in meta["axes"].items():
        ds.axes[name] = Axis(name, spark.read.schema("pos long, label string").parquet(f"{path}/axes/{name}"), a["length"], a["origin"], a["role"], a["induced_by"], a["provenance"])
    for name, f in meta["fields"].items():
        df = spark.read.parquet(f"{path}/fields/{name}/{f.pop('version')}")
        f = {k: tuple(v) if k in ("span", "shape", "categories") and v is not None else v for k, v in f.items()}
        ds.fields[name] = Field(name, df if lazy else df.cache(), **f)
    return ds


def convert(ds: Dataset, path: str, report: bool = True, **kwargs: Any) -> dict[str, Any]:
    """Writes and reports what was kept and what was dropped."""
    write(ds, path, **kwargs)
    return fidelity(ds) if report else {}


def fidelity(ds: Dataset) -> dict[str, Any]:
    by_role: dict[str, int] = {}
    for f in ds.fields.values():
        by_role[f.role] = by_role.get(f.role, 0) + 1
    return {"axes": {a.name: a.length for a in ds.axes.values()}, "fields": by_role, "aux": sorted(ds.aux), "dropped": list(ds.dropped), "lossless": not ds.dropped}
