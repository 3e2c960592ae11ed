"""Maintained statistics: batches that run again, compaction, and rows that come late, twice, amended or withdrawn."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axisloom.streaming import additive

SCHEMA = "id long, version long, g string, j long, v double, gone boolean"


def versions(seed, n):
    """Rows in the order they come: amendments before and after what they amend, repeats, withdrawals."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        for k in range(int(rng.integers(1, 4))):
            out.append((i, k, "abc"[int(rng.integers(3))], int(rng.integers(4)), float(rng.integers(-2, 5)), bool(k and rng.random() < 0.4)))
    out += [out[k] for k in rng.integers(0, len(out), n // 2)]
    return [out[k] for k in rng.permutation(len(out))] + [(n, 0, None, 1, 2.0, None), (n + 1, 0, "a", None, 3.0, False), (n + 2, 0, "a", 1, None, False)]


def newest(rows):
    held = {}
    for r in rows:
        if r[0] not in held or r[1] > held[r[0]][1]:
            held[r[0]] = r
    sums = {}
    for _, _, g, j, v, gone in held.values():
        if not gone and v:
            s = sums.setdefault((g, j), [0.0, 0.0, 0])
            sums[g, j] = [s[0] + v, s[1] + v * v, s[2] + 1]
    return sums


def read(spark, path):
    return {(r["g"], r["j"]): [r["sum"], r["sumsq"], r["n_expr"]] for r in additive.current(spark, path).collect()}


def test_corrections_amend_the_sums(spark, tmp_path):
    rows = versions(3, 40)
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for at in range(0, len(rows), 40):  # a file a batch, in two runs
        spark.createDataFrame(rows[at : at + 40], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if at == 40:
            additive.maintain_corrected(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), path, checkpoint, every=3).awaitTermination()
            assert read(spark, path) == newest(rows[:80])
    additive.maintain_corrected(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), path, checkpoint, every=3).awaitTermination()
    assert read(spark, path) == newest(rows)
    base, batches, old = additive._parts(spark, path)
    assert base >= 2 and len(batches) < 3 and len(old) <= 4  # compacted


def test_batches_count_once(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0), ("b", 2, 1.0), ("b", 2, 0.0)], "g string, j long, v double")
    with pytest.raises(FileNotFoundError):
        additive.current(spark, path)
    for number in (0, 1, 1):
        additive.batch_stats(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")
    want = {("a", 1): [10.0, 26.0, 4], ("b", 2): [2.0, 2.0, 2]}
    assert read(spark, path) == want
    additive.compact(spark, path)
    assert read(spark, path) == want
    additive.batch_stats(rows).write.mode("overwrite").parquet(f"{path}/batch=1")  # runs again after the base that has it
    assert read(spark, path) == want
    additive.batch_stats(rows.withColumn("sign", F.lit(-1))).write.parquet(f"{path}/batch=2")
    assert read(spark, path) == {("a", 1): [5.0, 13.0, 2], ("b", 2): [1.0, 1.0, 1]}
    additive.compact(spark, path)
    additive.compact(spark, path)
    base, batches, old = additive._parts(spark, path)
    assert (base, batches, old) == (2, {}, []) and read(spark, path) == {("a", 1): [5.0, 13.0, 2], ("b", 2): [1.0, 1.0, 1]}
