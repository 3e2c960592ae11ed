"""The untyped tail's leaves as chunks, and reports of progress."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisloom.model import Dataset
from axisloom.sources import passthrough, store, zarr
from axisloom.streaming import progress
from tests import arrays


def test_leaves_by_chunks(spark):
    x = np.random.default_rng(0).normal(size=(7, 5, 3))
    leaves = passthrough.leaves_frame(spark, {"x": x, "s": np.array(["é", "", "c"]), "n": np.zeros(0, np.int32), "b": np.array([[True], [False]])}, chunk=4)
    back = passthrough.leaves_of(leaves)
    assert (back["x"] == x).all() and back["s"].tolist() == ["é", "", "c"] and back["n"].shape == (0,) and back["b"].tolist() == [[True], [False]] and back["b"].dtype == bool
    for lo, hi in ((0, None), (10, 30), (99, 105), (104, 200), (3, 3)):
        got = {r["i"]: r["v"] for r in passthrough.leaf_values(leaves, "x", "double", lo, hi).collect()}
        assert got == dict(list(enumerate(x.ravel().tolist()))[lo:hi])
    assert [r["v"] for r in passthrough.leaf_values(leaves, "s", "string").orderBy("i").collect()] == ["é", "", "c"]


def test_leaves_from_elements(spark):
    x = np.arange(60).reshape(6, 10)
    df = spark.createDataFrame([(int(i), int(j), int(v)) for (i, j), v in np.ndenumerate(x)], "i long, j long, v long").repartition(3)
    made = passthrough.leaf_chunks(df, "x", "<i4", (6, 10), chunk=16)
    assert made.count() == 4 and (passthrough.leaves_of(made)["x"] == x).all()
    for bad in (df.where("i <> 3 or j <> 4"), df.unionByName(df.where("i = 0 and j = 0")), df.where("i <> 5 or j <> 9").unionByName(df.where("i = 5 and j = 8"))):
        with pytest.raises(Exception, match="missing or repeated"):
            passthrough.leaf_chunks(bad, "x", "<i4", (6, 10), chunk=16).collect()


def test_the_tail_of_an_array_store_goes_through_tasks(spark, tmp_path):
    root = str(tmp_path / "z")
    cube = np.arange(24.0).reshape(2, 3, 4)
    arrays.write_array(root, "passthrough/uns/a0", cube, chunks=(1, 2, 2))
    arrays.write_strings(root, "passthrough/uns/a1", ["x", "", "é"], chunks=(2,))
    tree = {"$obj": {"z": {"$array": "a0"}, "a": {"$strings": "a1", "shape": [3]}, "n": 1}}
    attrs = {"": {"spec_version": "0.1", "kind": "sample", "axes": [], "fields": [], "passthrough": ["uns"]}, "passthrough/uns": {"kind": "passthrough", "tree": json.dumps(tree), "arrays": [{"id": "a0", "kind": "dense"}, {"id": "a1", "kind": "utf8"}]}}
    for path, meta in attrs.items():
        with open(os.path.join(root, path, "zarr.json"), "w") as f:
            json.dump({"zarr_format": 3, "node_type": "group", "attributes": {"meta": meta}}, f)
    ds = zarr.read_store(spark, root)
    back = store.read(spark, store.write(ds, str(tmp_path / "p")))
    assert back.aux == {"uns": tree} and list(back.aux["uns"]["$obj"]) == ["z", "a", "n"]
    leaves = passthrough.leaves_of(back.leaves)
    assert (leaves["uns/a0"] == cube).all() and [r["v"] for r in passthrough.leaf_values(back.leaves, "uns/a1", "string").orderBy("i").collect()] == ["x", "", "é"]


LARGE = """
import sys
from pyspark.sql import SparkSession, functions as F
from axisloom.model import Dataset
from axisloom.sources import passthrough, store
spark = SparkSession.builder.master("local[2]").config("spark.driver.maxResultSize", "1m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
n = 2_000_000
ds = Dataset(spark)
ds.aux["uns"] = {"$array": "big"}
ds.leaves = passthrough.leaf_chunks(spark.range(n).select(F.col("id").alias("i"), (F.xxhash64("id") / 7).alias("v")), "big", "<f8", (n,))
back = store.read(spark, store.write(ds, sys.argv[1]))
wrong = passthrough.leaf_values(back.leaves, "big").where(F.col("v") != F.xxhash64("i") / 7).count()
print("wrong", wrong, "rows", passthrough.leaf_values(back.leaves, "big").count())
try:
    back.leaves.collect()
except Exception as e:
    print("refused" if "maxResultSize" in str(e) else e)
"""


def test_a_leaf_larger_than_the_driver_takes(tmp_path):
    out = subprocess.run([sys.executable, "-c", LARGE, str(tmp_path / "s")], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.stdout.split("\n")[:2] == ["wrong 0 rows 2000000", "refused"], out.stderr[-2000:]


def test_progress_by_blocks(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 90).alias("i"), F.col("id").alias("v"))
    said, path = [], str(tmp_path / "out")
    progress.by_blocks(df, "i", 100, 7, lambda block: block.write.mode("append").parquet(path), lambda *x: said.append(x))
    assert [x[:2] for x in said] == [(k, 7) for k in range(1, 8)]
    rows = [x[2] for x in said]
    assert rows == sorted(rows) and rows[0] < rows[3] and rows[-1] == 1000 == spark.read.parquet(path).count()
    progress.by_blocks(df, "i", 0, 7, None, lambda *x: said.append(x))
    assert len(said) == 7


def test_progress_by_tasks(spark):
    said = []
    slow = spark.range(0, 40, 1, 12).select(F.expr("reflect('java.lang.Thread', 'sleep', cast(60 as bigint))"), "id")
    n = progress.by_tasks(spark, lambda: slow.selectExpr("count(*) as n").first()["n"], lambda *x: said.append(x), every=0.05)
    assert n == 40 and said == sorted(said) and said[-1][0] == said[-1][1] >= 12
    with pytest.raises(ZeroDivisionError):
        progress.by_tasks(spark, lambda: 1 // 0, lambda *x: None)


def test_progress_of_writes_and_streams(spark, tmp_path):
    ds = Dataset(spark)
    ds.add_axis("cells", ["a", "b", "c"])
    for k, name in enumerate(("x", "y")):
        ds.add_field(name, spark.createDataFrame([(i, i + k) for i in range(3)], "i long, v long"), span=("cells",), role="vector")
    said = []
    store.write(ds, str(tmp_path / "s"), progress=lambda *x: said.append(x))
    assert said == [("x", 3), ("y", 3)]
    source, rows = str(tmp_path / "in"), []
    for n in (5, 7, 11):
        spark.range(n).coalesce(1).write.mode("append").parquet(source)
    with progress.watching(spark, lambda *x: rows.append(x)):
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.queryName("counted").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [r[0] for r in rows] == ["counted"] * 3 and [r[2] for r in rows] == sorted(r[2] for r in rows) and rows[-1][2] == 23
