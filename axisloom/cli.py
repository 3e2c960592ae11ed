"""Command line: inspect, validate, convert and navigators.

    python -m axisloom.cli inspect STORE
    python -m axisloom.cli validate STORE
    python -m axisloom.cli convert SOURCE STORE [--codec zstd]
    python -m axisloom.cli navigators STORE
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .model import Dataset
from .operators.validate import validate
from .plans import navigators
from .sources import store, zarr


def detect(path: str) -> str:
    """zarr or parquet, by what lies at the path."""
    marks = ("zarr.json", ".zgroup", ".zmetadata", ".zattrs")
    return "zarr" if os.path.isfile(path) or any(os.path.exists(os.path.join(path, m)) for m in marks) else "parquet"


def open_any(spark: SparkSession, path: str) -> Dataset:
    return zarr.read_store(spark, path) if detect(path) == "zarr" else store.read(spark, path)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="axisloom")
    p.add_argument("action", choices=["inspect", "validate", "convert", "navigators"])
    p.add_argument("source")
    p.add_argument("target", nargs="?")
    p.add_argument("--codec", default="zstd")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("axisloom").getOrCreate()
    ds = open_any(spark, a.source)
    if a.action == "inspect":
        print(json.dumps(store.fidelity(ds) | {"kind": ds.kind, "profiles": ds.profiles}, indent=2))
    elif a.action == "validate":
        issues = validate(ds)
        print("\n".join(issues) or "sound")
        return int(any(i.startswith("ERROR") for i in issues))
    elif a.action == "convert":
        if not a.target:
            p.error("convert needs a target")
        print(json.dumps(store.convert(ds, a.target, compressor=a.codec), indent=2))
    else:
        was = set(ds.fields)
        navigators.extend(ds)
        store.append(ds, a.source, [n for n in ds.fields if n not in was])
    return 0


if __name__ == "__main__":
    sys.exit(main())
