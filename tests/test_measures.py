"""A measure in both clusterings: what is read and moved for a question."""

import pytest
from pyspark.sql import functions as F

from axisloom import queries
from axisloom.operators import access, stats
from axisloom.sources import measures


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("m") / "entries")
    m = spark.range(400_000).select((F.col("id") * 7 % 4001).alias("i"), (F.xxhash64("id") % 500 + 499).alias("j"), (F.col("id") % 9 + 1).cast("double").alias("v"))
    m.groupBy("i", "j").agg(F.sum("v").alias("v")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def stored(entries, tmp_path_factory):
    return {b: measures.write(entries, str(tmp_path_factory.mktemp("m") / f"s{b}"), buckets=b, row_group=1 << 16) for b in (None, 8)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_rows(df):
    """Rows that the scans of a plan made when it ran: those of the row groups and pages that weren't left out."""
    qe = df._jdf.queryExecution()
    df._jdf.collect()
    p = qe.executedPlan()
    while p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        p = p.executedPlan()
    leaves, rows = p.collectLeaves(), 0
    for k in range(leaves.size()):
        rows += leaves.apply(k).metrics().apply("numOutputRows").value()
    return rows


@pytest.mark.parametrize("buckets", [None, 8])
def test_both_clusterings_are_the_measure(entries, stored, buckets):
    s = stored[buckets]
    assert s.layout == dict.fromkeys("ij", "bucket" if buckets else "range")
    for df in (s.by_column, s.by_row):
        assert df.exceptAll(entries).isEmpty() and df.count() == entries.count()


@pytest.mark.parametrize("buckets", [None, 8])
def test_access_reads_few_row_groups(spark, entries, stored, buckets):
    s, n = stored[buckets], entries.count()
    for df, want in (
        (access.column(s.by_column, 41), entries.where("j = 41").select("i", "v")), (access.row(s.by_row, 77), entries.where("i = 77").select("j", "v")),
        (access.column_range(s.by_column, 40, 44), entries.where("j >= 40 and j < 44")), (access.row_block(s.by_row, 100, 120), entries.where("i >= 100 and i < 120")),
    ):
        rows = read_rows(df)
        assert rows < 0.1 * n and "Exchange" not in plan(df)
        assert df.exceptAll(want).isEmpty() and df.count() == want.count()
    if buckets:
        spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task for each file
        try:
            assert s.by_column.rdd.getNumPartitions() == 8 and access.column(s.by_column, 41).rdd.getNumPartitions() == 1
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sums_where_they_lie(entries, stored):
    s = stored[8]
    by_column, by_row = stats.col_stats(s.by_column, 4001, lognorm=True), stats.depth_of(s.by_row)
    assert "Exchange" not in plan(by_column) and "Exchange" not in plan(by_row)
    assert "Exchange" in plan(stats.col_stats(entries, 4001, lognorm=True))
    near = lambda df: {r[0]: [round(x, 9) for x in r[1:]] for r in df.collect()}
    assert near(by_column) == near(stats.col_stats(entries, 4001, lognorm=True)) and near(by_row) == near(stats.depth_of(entries))


def test_a_hot_column_is_laid_out_by_ranges(spark, tmp_path):
    m = spark.range(20_000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 1000).alias("j"), F.lit(1.0).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        s = measures.write(m, str(tmp_path / "hot"), buckets=16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert s.layout == {"j": "range", "i": "bucket"}
    assert s.by_column.where("j = 5").select(F.input_file_name()).distinct().count() > 1  # one column, several files
    assert s.by_column.exceptAll(m).isEmpty() and s.by_column.count() == 20_000


def test_stores_open_again(spark, stored, tmp_path):
    path = stored[8].path
    measures.forget(spark, path)
    again = measures.read(spark, path)
    assert "Exchange" not in plan(stats.depth_of(again.by_row)) and again.by_row.count() == stored[None].by_row.count()
    none = measures.write(again.by_row.where("false"), str(tmp_path / "none"), buckets=4)
    assert none.by_column.count() == 0 and measures.read(spark, none.path).by_row.count() == 0
    with pytest.raises(Exception):
        measures.read(spark, str(tmp_path / "missing"))


def stages(spark):
    """Spark's record of each stage so far, by its number."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none, flat = sc._jvm.java.util.ArrayList(), sc._gateway.new_array(sc._jvm.double, 0)
    found = sc._jsc.sc().statusStore().stageList(none, False, False, flat, none)
    return {found.apply(k).stageId(): found.apply(k) for k in range(found.size())}


def moved(spark, run):
    """Rows that the shuffles of what it runs write."""
    before = stages(spark)
    run()
    return sum(s.shuffleWriteRecords() for k, s in stages(spark).items() if k not in before)


def test_entries_in_parts_are_summed_as_they_are_laid_out(spark, tmp_path):
    parts = spark.range(60_000).select((F.col("id") * 7 % 401).alias("i"), (F.col("id") % 50).alias("j"), (F.col("id") % 5 - 2).cast("double").alias("v"))
    want = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")
    for buckets in (None, 4):
        s = measures.write(parts, str(tmp_path / f"s{buckets}"), buckets=buckets, summed=False)
        assert s.layout == dict.fromkeys("ij", "bucket" if buckets else "range")
        for df in (s.by_column, s.by_row):
            assert df.exceptAll(want).isEmpty() and df.count() == want.count()
    hot = parts.withColumn("i", F.when(F.col("j") % 3 == 0, 5).otherwise(F.col("i")))
    s = measures.write(hot, str(tmp_path / "hot"), buckets=16, summed=False)
    want = hot.groupBy("i", "j").agg(F.sum("v").alias("v")).where("v <> 0")
    assert s.layout["i"] == "range" and s.by_row.exceptAll(want).isEmpty() and s.by_row.count() == s.by_column.count() == want.count()


def test_hot_keys_are_those_over_their_share(spark):
    m = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("j"))
    assert measures.hot_keys(m, "j", 16) == [5] and measures.hot_keys(m, "j", 4) == [] and measures.hot_keys(m.where("j <> 5"), "j", 16) == []
    assert moved(spark, lambda: measures.hot_keys(m, "j", 4)) <= 4 * m.rdd.getNumPartitions()


def test_a_stored_measure_moves_each_line_twice(spark):
    """Once to sum it where its row lies, once to its column: neither the layouts nor a copy of the sums cost another exchange."""
    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    queries._STORED.clear()
    assert moved(spark, lambda: queries.stored_measure(spark, sf)) < 2.2 * lines
    assert moved(spark, lambda: queries.stored_row_depth(spark, sf).collect()) == 0
