"""What the array source reads: partitions under predicates, and bytes of shards, plain chunks and zip members."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axisloom.sources import zarr
from tests import arrays


@pytest.fixture(scope="module")
def big(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("big"))
    x = np.arange(100 * 2000).reshape(100, 2000) % 977
    arrays.write_array(root, "x", x, chunks=(10, 20), codec="gzip")  # 1,000 chunks
    return root, x


def parts(root, path="x", least=1, **where):
    return len(zarr.ArrayReader({"path": root, "array": path, "bytes": str(least), **where}).partitions())


@pytest.mark.parametrize(
    "where, chunks",
    [
        ({}, 1000), ({"j": "500:540"}, 20), ({"j": "77:78"}, 10), ({"j": "1980:"}, 10), ({"i": ":10", "j": "1900:"}, 5), ({"i": "3:4", "j": "5,7,1999"}, 2), ({"j": "2000,-1"}, 1), ({"j": "31:30"}, 1),
        ({"j": "5,5,41"}, 30 - 10), ({"i": "-5:0"}, 1), ({"i": "90:200", "j": "0:20"}, 1), ({"j": ""}, 1),
    ],
)
def test_positions_choose_chunks(big, where, chunks):
    root, x = big
    reader = zarr.ArrayReader({"path": root, "array": "x", "bytes": "1", **where})
    got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    keep = np.ones(x.shape, bool)
    for d, n in enumerate(x.shape):
        given = where.get("ij"[d], ":")
        lo, _, hi = given.partition(":")
        own = range(*slice(max(0, int(lo or 0)), int(hi or n)).indices(n)) if ":" in given else [int(v) for v in given.split(",") if v and 0 <= int(v) < n]
        line = np.isin(np.arange(n), list(own))
        keep &= line[:, None] if d == 0 else line
    assert len(reader.partitions()) == chunks
    assert sorted(got) == [(i, j, x[i, j]) for i, j in np.argwhere(keep).tolist()]


def test_frames_read_only_their_chunks(spark, big):
    root, x = big
    whole = zarr.array_frame(spark, root, "x")
    some = zarr.array_frame(spark, root, "x", j=(500, 540), i=[3, 7])
    assert whole.rdd.getNumPartitions() < 20 and some.rdd.getNumPartitions() == 1  # small chunks share partitions
    assert whole.agg(F.count("v"), F.sum("v")).first() == (x.size, x.sum())
    assert sorted(map(tuple, some.collect())) == [(i, j, x[i, j]) for i in (3, 7) for j in range(500, 540)]
    assert whole.join(some.where("j < 502"), ["i", "j"]).count() == 4 and whole.where("j = 3").count() == 100  # a frame used again is whole


def test_positions_of_a_table(spark, big, tmp_path):
    root, x = big
    wanted = spark.createDataFrame([(5,), (5,), (1999,), (2000,), (-1,), (None,)], "j long")
    got = zarr.array_at(wanted, root, "x", "j").collect()
    assert sorted(map(tuple, got)) == [(i, j, x[i, j]) for i in range(100) for j in (5, 1999)]
    v = np.arange(10_000) * 3
    arrays.write_array(str(tmp_path), "v", v, chunks=(10,), shard=(1000,))
    got = zarr.array_at(spark.range(0, 10_000, 501).withColumnRenamed("id", "i"), str(tmp_path), "v").collect()
    assert sorted(map(tuple, got)) == [(i, 3 * i) for i in range(0, 10_000, 501)]
    assert zarr.array_at(wanted.where("j > 9999").withColumnRenamed("j", "i"), str(tmp_path), "v").count() == 0


class Counting:
    """open() that adds up what is read of files whose name has a certain part."""

    def __init__(self, part):
        self.part, self.bytes, self.opened = part, 0, 0

    def __call__(self, path, mode):
        f, me = open(path, mode), self
        if self.part not in str(path):
            return f
        self.opened += 1

        class Read:
            def read(self, *n):
                data = f.read(*n)
                me.bytes += len(data)
                return data

            def __getattr__(self, name):
                return getattr(f, name)

            def __enter__(self):
                return self

            def __exit__(self, *_):
                f.close()

        return Read()


@pytest.fixture()
def counting(monkeypatch):
    def start(part):
        c = Counting(part)
        monkeypatch.setattr(zarr, "_open", c)
        return c

    return start


def test_ranges_of_a_shard(tmp_path, counting):
    x = np.random.default_rng(0).integers(0, 1 << 60, 200_000)
    arrays.write_array(str(tmp_path), "s", x, chunks=(1000,), shard=(100_000,), codec="zstd")
    c = counting("/c/")
    for lo, hi in ((0, 2000), (54_000, 60_000), (99_500, 101_500)):
        c.bytes = 0
        assert (zarr.read_range(str(tmp_path), "s", lo, hi) == x[lo:hi]).all()
        first, last = lo // 1000 * 1000, -(-hi // 1000) * 1000
        assert c.bytes < 2 * 8 * (last - first)
    c.bytes = 0
    assert (zarr.read_range(str(tmp_path), "s", 54_000, 56_000) == x[54_000:56_000]).all()
    assert c.bytes < 1.1 * 16_000  # the index isn't read again


def test_ranges_of_a_shard_in_two_dimensions(tmp_path, counting):
    x = np.random.default_rng(1).normal(size=(300, 200))
    arrays.write_array(str(tmp_path), "s", x, chunks=(30, 20), shard=(150, 100), codec="gzip")
    c = counting("/c/")
    assert (zarr.read_region(str(tmp_path), "s", (30, 40), (60, 60)) == x[30:60, 40:60]).all()
    assert c.bytes < 2 * 8 * 30 * 20
    for lo, hi in (((0, 0), (300, 200)), ((149, 99), (151, 101)), ((7, 3), (8, 199)), ((5, 5), (5, 9)), ((290, 190), (999, 999))):
        assert (zarr.read_region(str(tmp_path), "s", lo, hi) == x[lo[0] : hi[0], lo[1] : hi[1]]).all()


def test_ranges_of_plain_chunks(tmp_path, counting):
    x = np.arange(50_000, dtype=np.int32).reshape(5000, 10)
    for version in (2, 3):
        arrays.write_array(str(tmp_path), f"r{version}", x, codec=None, version=version)
        c = counting(f"/r{version}/")
        assert (zarr.read_region(str(tmp_path), f"r{version}", (4000, 3), (4100, 7)) == x[4000:4100, 3:7]).all()
        assert c.bytes < 100 * 10 * 4 + 1000  # and the metadata


def test_ranges_of_a_zip(spark, tmp_path, counting):
    x = np.random.default_rng(2).integers(0, 1 << 60, 100_000)
    arrays.write_array(str(tmp_path / "z"), "a", x, chunks=(1000,), shard=(50_000,), codec="zstd")
    root = arrays.pack_zip(str(tmp_path / "z"), str(tmp_path / "z.zip"))
    c = counting("z.zip")
    m = zarr.meta(root, "a")
    c.bytes = c.opened = 0
    for lo in (3000, 61_000, 7000):
        assert (zarr.read_range(root, "a", lo, lo + 4000, m) == x[lo : lo + 4000]).all()
    assert c.bytes < 2 * 8 * 12_000 and c.opened <= 16  # the directory was read once
    df = zarr.array_frame(spark, root, "a", i=(61_000, 63_000))
    assert parts(root, "a", i="61000:63000") == 2 and [r["v"] for r in df.orderBy("i").collect()] == x[61_000:63_000].tolist()
    arrays.write_array(str(tmp_path / "z"), "a", x[:10], codec=None)
    arrays.pack_zip(str(tmp_path / "z"), root)
    assert zarr.read_array(root, "a").tolist() == x[:10].tolist()  # a file written anew is read anew
