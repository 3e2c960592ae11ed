import numpy as np
import pytest

from axisloom.model import Dataset, as_categorical
from axisloom.operators.validate import RULES, issues, validate
from axisloom.plans import navigators
from axisloom.sources import passthrough, store, zarr
from tests import arrays


def sample(spark, n=60, k=20):
    rng = np.random.default_rng(4)
    ds = Dataset(spark)
    ds.add_axis("cells", [f"c{i}" for i in range(n)])
    ds.add_axis("genes", [f"g{j}" for j in range(k)])
    ds.add_axis("umap", ["u1", "u2"], origin="derived")
    x = rng.poisson(0.8, (n, k))
    ds.add_field("counts", spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "i long, j long, v double"), span=("cells", "genes"))
    ds.add_field("umap", spark.createDataFrame([(i, rng.normal(size=2).tolist()) for i in range(n)], "i long, vec array<double>"))
    coded, levels = as_categorical(spark.createDataFrame([(i, "abc"[i % 3] if i else None) for i in range(n)], "i long, v string"))
    ds.add_field("leiden", coded, span=("cells",), categories=levels, role="label")
    return ds, x


def test_inference_and_induction(spark):
    ds, _ = sample(spark)
    f = ds.fields["counts"]
    assert (f.role, f.state, f.encoding) == ("measure", "raw", "coo")
    assert ds.fields["umap"].span == ("cells", "umap") and ds.fields["umap"].role == "embedding"
    assert ds.axes["leiden"].role == "factor" and ds.axes["leiden"].length == 3
    assert [x.name for x in ds.fields_over("genes")] == ["counts"]
    assert ds.table("cells").columns == ["pos", "label", "leiden"]
    with pytest.raises(ValueError):
        ds.add_field("bad", spark.createDataFrame([(0, 1.0)], "i long, v double"))


def test_identifiers_do_not_induce(spark):
    ds = Dataset(spark)
    ds.add_axis("cells", [str(i) for i in range(300)])
    ids = spark.createDataFrame([(i, i) for i in range(300)], "i long, v int")
    ds.add_field("barcode", ids, span=("cells",), categories=tuple(str(i) for i in range(300)))
    assert "barcode" not in ds.axes


@pytest.mark.parametrize("values, state", [([1.0, 2.0, 3.0], "raw"), ([0.5, 1.25], "lognorm"), ([-1.5, 2.0], "scaled"), ([100000.5], "raw"), ([], "raw")])
def test_state(spark, values, state):
    ds = Dataset(spark)
    ds.add_axis("a", ["x"] * 5)
    ds.add_axis("b", ["y"] * 4)
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], "i long, j long, v double")
    assert ds.add_field("f", df, span=("a", "b")).state == state


def test_validation(spark):
    ds, _ = sample(spark)
    assert validate(ds) == []
    ds.add_field("bad_codes", spark.createDataFrame([(i, 7) for i in range(60)], "i long, v int"), span=("cells",), categories=("a", "b"), role="label")
    ds.add_field("far", spark.createDataFrame([(99, 0, 1.0)], "i long, j long, v double"), span=("cells", "genes"), state="odd")
    ds.add_field("lost", spark.createDataFrame([(0, 1.0)], "i long, v double"), span=("nowhere",), role="vector")
    text = "\n".join(validate(ds))
    assert "codes out of range" in text and "positions out of range" in text and "unknown axes" in text and "WARN: field 'far' has a state" in text
    with pytest.raises(ValueError):
        validate(ds, strict=True)


def test_every_rule_of_validation(spark):
    ds, _ = sample(spark)
    navigators.extend(ds)
    ds.add_axis("many", ["x", "y"], role="factor", induced_by="gone")
    ds.axes["leiden"].df = ds.axes["leiden"].df.where("pos < 2")
    ds.axes["leiden"].length = 2
    flat = spark.createDataFrame([(i, 0) for i in range(59)], "i long, v int")
    two = spark.createDataFrame([(0, 0, 1.0), (99, 0, 1.0)], "i long, j long, v double")
    ds.add_axis("clash", ["x"])
    for name, df, span, more in [
        ("codes", flat, ("cells",), {"categories": (), "role": "label", "induce": False}),
        ("far", two, ("cells", "genes"), {"state": "odd"}),
        ("lost", flat, ("nowhere",), {"role": "vector"}),
        ("part", flat, ("cells",), {"role": "vector", "index_axis": "genes"}),
        ("lone", flat, ("cells",), {"role": "vector", "encoding": "csr"}),
        ("edges", flat, ("cells",), {"role": "relation"}),
        ("shaped", flat, ("cells",), {"role": "vector", "shape": (7,)}),
        ("novel", flat, ("cells",), {"role": "novelty"}),
        ("clash", flat, ("cells",), {"categories": ("a", "b"), "role": "label", "induce": False}),
        ("wide", spark.createDataFrame([(i, [1.0]) for i in range(60)], "i long, vec array<double>"), ("cells", "umap"), {"role": "embedding"}),
        ("twice", flat.unionByName(flat.limit(1)), ("cells",), {"role": "vector", "coverage": "partial", "index_axis": "cells"}),
    ]:
        ds.add_field(name, df, span=span, **more)
    ds.fields["od_score"].span = ("cells",)
    ds.fields["counts_cellmajor"].encoding = "coo"
    ds.fields["counts_cellmajor_order"].span = ("genes",)
    ds.fields["markers_leiden_lfc"].span = ("leiden", "genes")
    ds.fields.pop("stats_leiden_sumsq")
    found = {(r["field"], r["rule"]) for r in issues(ds).collect()}
    want = {("codes", "code"), ("far", "position"), ("far", "state"), ("lost", "span_unknown"), ("part", "partial_axis"), ("lone", "sparse_arity"), ("edges", "relation_arity"), ("shaped", "shape"), ("novel", "role"), ("clash", "name_clash")}
    want |= {("wide", "width"), ("twice", "repeated_index"), ("edges", "length"), ("many", "inducer_missing"), ("leiden", "inducer_labels"), ("od_score", "navigator_span"), ("counts_cellmajor", "navigator_encoding")}
    want |= {("counts_cellmajor_order", "navigator_order"), ("markers_leiden_lfc", "navigator_span"), ("stats_leiden_sumsq", "navigator_missing")}
    assert want <= found and {rule for _, rule in found} | {"navigator_grouping"} == set(RULES)
    for name in [n for n in ds.fields if n.startswith("stats_")] + ["od_score", "counts_cellmajor"]:
        ds.fields.pop(name)
    found = {(r["field"], r["rule"]) for r in issues(ds).collect()}
    assert {("viewer@0.1", "navigator_grouping"), ("od_score", "navigator_missing"), ("counts_cellmajor", "navigator_missing")} <= found


def test_navigators(spark):
    ds, x = sample(spark)
    navigators.extend(ds)
    assert validate(ds) == []
    got = {(r["i"], r["j"]): r["v"] for r in ds.fields["stats_leiden_sum"].df.collect()}
    code = np.array([-1 if i == 0 else i % 3 for i in range(60)])
    for g in range(3):
        assert np.allclose([got[(g, j)] for j in range(20)], np.log1p(x[code == g]).sum(0))
    order = {r["i"]: r["v"] for r in ds.fields["counts_cellmajor_order"].df.collect()}
    assert sorted(order.values()) == list(range(60))
    cell = {(r["i"], r["j"]): r["v"] for r in ds.fields["counts_cellmajor"].df.collect()}
    assert all(cell[(order[i], j)] == x[i, j] for i, j in zip(*np.nonzero(x)))
    assert navigators.de_fields(ds).count() == 2
    ds.fields.pop("markers_leiden_lfc")
    assert any("markers_leiden_lfc" in m for m in validate(ds))
    navigators.drop_cache(ds)
    assert "od_score" not in ds.fields and "fields/od_score" in ds.dropped


@pytest.mark.parametrize("codec", [None, "gzip", "zstd"])
def test_store_round_trip(spark, tmp_path, codec):
    ds, x = sample(spark)
    ds.dropped.append("uns/x")
    path = store.write(ds, str(tmp_path / "s"), compressor=codec, layouts={"counts": {"compressor": "none"}})
    back = store.read(spark, path)
    assert list(back.fields) == list(ds.fields) and back.dropped == ["uns/x"] and validate(back) == []
    for name in ds.fields:
        assert ds.fields[name].df.exceptAll(back.fields[name].df).isEmpty() and back.fields[name].span == ds.fields[name].span
    back.add_field("extra", spark.createDataFrame([(i, 0.5 * i) for i in range(60)], "i long, v double"), span=("cells",))
    store.append(back, path, ["extra"])
    assert "extra" in store.read(spark, path).fields
    assert store.fidelity(back)["lossless"] is False
    with pytest.raises(ValueError):
        store.codec("lzma")


def test_passthrough_round_trip(spark):
    rec = np.array([(1, 2.5), (3, 4.5)], dtype=[("a", "<i4"), ("b", "<f8")])
    value = {"z": 1, "a": [None, True, "x", {"k": np.arange(6).reshape(2, 3)}], "s": np.array(["p", "q"]), "b": b"\x00\xff", "r": rec, "bad": object()}
    leaves = {}
    tree = passthrough.to_tree(value, leaves)
    back = passthrough.from_tree(tree, passthrough.leaves_of(passthrough.leaves_frame(spark, leaves)))
    assert list(back) == list(value) and back["b"] == b"\x00\xff" and back["bad"] is None
    assert (back["a"][3]["k"] == np.arange(6).reshape(2, 3)).all() and back["s"].tolist() == ["p", "q"] and (back["r"] == rec).all()


@pytest.mark.parametrize("version, codec, shard", [(2, None, None), (2, "gzip", None), (2, "zlib", None), (3, None, None), (3, "gzip", None), (3, "zstd", None), (3, "zstd", (8, 6))])
def test_array_codecs(spark, tmp_path, version, codec, shard):
    x = np.arange(91, dtype=np.int32).reshape(13, 7)
    arrays.write_array(str(tmp_path), "a", x, chunks=(4, 3), codec=codec, version=version, shard=shard)
    assert (zarr.read_array(str(tmp_path), "a") == x).all()
    assert arrays.pack_zip(str(tmp_path / "a"), str(tmp_path / "a.zip")) and (zarr.read_array(str(tmp_path / "a.zip"), "") == x).all()
    spark.dataSource.register(zarr.ArraySource)
    df = spark.read.format("zarr-array").option("array", "a").option("bytes", 1).load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 1 and {(r["i"], r["j"]): r["v"] for r in df.collect()} == {p: float(v) for p, v in np.ndenumerate(x)}


def test_ranges_and_missing_chunks(tmp_path):
    arrays.write_array(str(tmp_path), "v", np.arange(100), chunks=(16,))
    assert zarr.read_range(str(tmp_path), "v", 30, 50).tolist() == list(range(30, 50))
    (tmp_path / "v" / "c" / "1").unlink()
    assert zarr.read_range(str(tmp_path), "v", 14, 18).tolist() == [14, 15, 0, 0]


def test_absent_parts_of_a_shard_have_the_fill_value(tmp_path):
    import json
    import struct

    arrays.write_array(str(tmp_path), "a", np.arange(8), chunks=(2,), shard=(8,), codec=None)
    spec, blob = tmp_path / "a" / "zarr.json", tmp_path / "a" / "c" / "0"
    spec.write_text(json.dumps(json.loads(spec.read_text()) | {"fill_value": 7}))
    data = blob.read_bytes()
    index = data[-68:-4]
    index = index[:16] + b"\xff" * 16 + index[32:]
    blob.write_bytes(data[:-68] + index + struct.pack("<I", zarr.crc32c(index)))
    assert zarr.read_array(str(tmp_path), "a").tolist() == [0, 1, 7, 7, 4, 5, 6, 7]


def test_frames_of_arrays(spark, tmp_path):
    root = str(tmp_path)
    big = np.array([2**53 + 1, -5, 0])
    arrays.write_array(root, "big", big, chunks=(2,))
    assert [r["v"] for r in zarr.array_frame(spark, root, "big").orderBy("i").collect()] == big.tolist()
    texts = ["", "é", "abc", "", "zz"]
    arrays.write_strings(root, "s", texts, chunks=(2,))
    assert [tuple(r) for r in zarr.string_frame(spark, root, "s", block=2).orderBy("i").collect()] == list(enumerate(texts))
    arrays.write_strings(root, "none", [])
    assert zarr.string_frame(spark, root, "none").count() == 0
    x = np.zeros((9, 6))
    x[0, :], x[4, 2], x[8, 5] = np.arange(1, 7), 3.5, 2.0
    where = np.nonzero(x)
    arrays.write_array(root, "m/data", x[where], chunks=(3,))
    arrays.write_array(root, "m/indices", where[1], chunks=(3,))
    arrays.write_array(root, "m/indptr", np.searchsorted(where[0], np.arange(10)), chunks=(4,))
    for block in (1, 2, 5, 100):
        got = {(r["i"], r["j"]): r["v"] for r in zarr.sparse_frame(spark, root, "m", False, block=block).collect()}
        assert got == {(int(i), int(j)): x[i, j] for i, j in zip(*where)}


def test_dense_and_partial_fields_of_a_store(spark, tmp_path):
    import json

    wide, cube = np.arange(12.0).reshape(4, 3), np.arange(24.0).reshape(4, 3, 2)
    tree = {
        "": {"spec_version": "0.1", "kind": "sample", "axes": ["cells", "genes", "two"], "fields": ["wide", "cube", "note"]},
        "axes/cells": {}, "axes/genes": {}, "axes/two": {},
        "fields/wide": {"role": "embedding", "span": ["cells", "genes"], "encoding": "dense"},
        "fields/cube": {"role": "measure", "span": ["cells", "genes", "two"], "encoding": "dense", "state": "scaled"},
        "fields/note": {"role": "label", "span": ["cells"], "encoding": "utf8", "coverage": "partial", "index_axis": "cells"},
    }
    for path, meta in tree.items():
        (tmp_path / path).mkdir(parents=True, exist_ok=True)
        (tmp_path / path / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"meta": meta}}))
    root = str(tmp_path)
    for axis, n in (("cells", 4), ("genes", 3), ("two", 2)):
        arrays.write_strings(root, f"axes/{axis}/labels", [f"{axis}{i}" for i in range(n)], chunks=(2,))
    arrays.write_array(root, "fields/wide/values", wide, chunks=(3, 2))
    arrays.write_array(root, "fields/cube/values", cube, chunks=(2, 2, 1))
    arrays.write_strings(root, "fields/note/values", ["late", ""], chunks=(2,))
    arrays.write_array(root, "fields/note/index", np.array([3, 1]))
    ds = zarr.read_store(spark, root)
    assert [r["vec"] for r in ds.fields["wide"].df.orderBy("i").collect()] == wide.tolist()
    assert {(r["i"], r["j"], r["k"]): r["v"] for r in ds.fields["cube"].df.collect()} == {p: v for p, v in np.ndenumerate(cube)}
    assert {r["i"]: r["v"] for r in ds.fields["note"].df.collect()} == {3: "late", 1: ""}
    assert ds.axes["cells"].length == 4 and ds.fields["wide"].shape == (4, 3)


def test_axis_and_field_store(spark, tmp_path):
    import json

    root = tmp_path / "s"
    x = np.array([[0, 2, 0], [1, 0, 3], [0, 0, 0], [4, 5, 0]], np.float32)
    tree = {
        "": {"spec_version": "0.1", "kind": "sample", "profiles": [], "dropped": [], "axes": ["cells", "genes"], "fields": ["counts", "qc", "kind", "adt"]},
        "axes/cells": {"kind": "axis"}, "axes/genes": {"kind": "axis"},
        "fields/counts": {"role": "measure", "span": ["cells", "genes"], "state": "raw", "encoding": "csc", "shape": [4, 3]},
        "fields/qc": {"role": "label", "span": ["cells"], "encoding": "dense", "nullable": True},
        "fields/kind": {"role": "label", "span": ["cells"], "encoding": "categorical", "ordered": True},
        "fields/adt": {"role": "measure", "span": ["cells"], "encoding": "dense", "coverage": "partial", "index_axis": "cells"},
    }
    for path, meta in tree.items():
        (root / path).mkdir(parents=True, exist_ok=True)
        (root / path / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"meta": meta}}))
    put = lambda p, v: arrays.write_array(str(root), p, v, chunks=(2,))
    arrays.write_strings(str(root), "axes/cells/labels", ["a", "b", "c", "é"])
    arrays.write_strings(str(root), "axes/genes/labels", ["x", "y", "z"])
    rows, cols = np.nonzero(x.T)[1], np.nonzero(x.T)[0]
    put("fields/counts/data", x.T[np.nonzero(x.T)])
    put("fields/counts/indices", rows.astype(np.int32))
    put("fields/counts/indptr", np.searchsorted(cols, np.arange(4)).astype(np.int32))
    put("fields/qc/values", np.array([10, 0, 7, 0]))
    put("fields/qc/mask", np.array([0, 1, 0, 1], np.uint8))
    put("fields/kind/codes", np.array([1, -1, 0, 1], np.int32))
    arrays.write_strings(str(root), "fields/kind/categories", ["lo", "hi"])
    put("fields/adt/values", np.array([0.5, 1.5]))
    put("fields/adt/index", np.array([0, 2]))
    ds = zarr.read_store(spark, str(root))
    assert {(r["i"], r["j"]): r["v"] for r in ds.fields["counts"].df.collect()} == {(i, j): float(x[i, j]) for i, j in zip(*np.nonzero(x))}
    assert [r["v"] for r in ds.fields["qc"].df.orderBy("i").collect()] == [10, None, 7, None]
    assert [r["v"] for r in ds.fields["kind"].df.orderBy("i").collect()] == [1, None, 0, 1] and ds.fields["kind"].categories == ("lo", "hi")
    assert {r["i"]: r["v"] for r in ds.fields["adt"].df.collect()} == {0: 0.5, 2: 1.5}
    assert [r["label"] for r in ds.axes["cells"].df.orderBy("pos").collect()] == ["a", "b", "c", "é"]
    assert validate(ds) == []


def test_stream_equals_batch(spark, tmp_path):
    from axisloom.streaming import additive

    rows = spark.createDataFrame([("g%d" % (i % 3), i % 5, float(i % 4)) for i in range(400)], "g string, j long, v double")
    for part in range(4):
        rows.where(f"pmod(hash(j, v), 4) = {part}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    additive.maintain(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    a, b = additive.current(spark, str(tmp_path / "out")).select("g", "j", "sum", "sumsq", "n_expr"), additive.batch_stats(rows)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
