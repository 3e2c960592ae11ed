"""Positions by a range exchange, dictionaries that never reach the driver, and where a modality's rows belong."""

import pytest
from pyspark.sql import functions as F

from axisloom.model import Dataset
from axisloom.operators import access, collection, order
from axisloom.operators.validate import issues


@pytest.fixture()
def exact_partitions(spark):
    """As many partitions as asked for, which small tables don't get otherwise."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def sizes(spark, monkeypatch, make):
    """Rows of each partition of the tables that numbering saves."""
    kept, real = [], order.saved
    monkeypatch.setattr(order, "saved", lambda df, name: kept.append(real(df, name)) or kept[-1])
    out = make()
    return out, [sorted(r["count"] for r in t.groupBy("_part").count().collect()) for t in kept]


def test_ranks_of_labels_with_one_prefix(spark, monkeypatch, exact_partitions):
    labels = spark.range(20_000).select(F.col("id").alias("i"), F.concat(F.lit("Customer#"), F.lpad((F.col("id") * 7919 % 20_000).cast("string"), 9, "0")).alias("v"))
    levels, (held,) = sizes(spark, monkeypatch, lambda: access.factor_levels(labels))
    assert len(held) > 8 and held[-1] < 3 * held[len(held) // 2]
    got = levels.orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(20_000)) and [r["label"] for r in got] == sorted(r["label"] for r in got)


def test_ranks_on_a_curve_whose_cells_are_hot(spark, monkeypatch, exact_partitions):
    """Most rows have one place and one group; the row itself sets them apart."""
    points = spark.range(20_000).select(F.col("id").alias("i"), F.when(F.col("id") % 10 > 0, 0.5).otherwise(F.col("id") / 20_000).alias("x"), F.lit(0.5).alias("y"))
    groups = points.select("i", F.when(F.col("i") % 7 > 0, 1).alias("g"))
    out, (held,) = sizes(spark, monkeypatch, lambda: order.cell_order(points, groups))
    assert len(held) > 8 and held[-1] < 3 * held[len(held) // 2]
    assert sorted(r["new_pos"] for r in out.collect()) == list(range(20_000))
    first = out.join(groups, "i").groupBy("g").agg(F.min("new_pos").alias("lo"), F.max("new_pos").alias("hi")).collect()
    assert {r["g"]: (r["lo"], r["hi"]) for r in first} == {1: (0, 17_141), None: (17_142, 19_999)}  # no group comes last


def test_ranks_with_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3), ("b", 1), ("", 4)], "s string, k int")
    assert [tuple(r) for r in order.numbered(df, ["s", "k"], "at").orderBy("at").collect()] == [("", 4, 0), ("a", 3, 1), ("b", 1, 2), ("b", 1, 3), (None, 2, 4)]
    assert order.numbered(df.where("false"), ["s"], "at").count() == 0


def test_a_million_labels(spark, monkeypatch):
    labels = spark.range(1_000_000).select(F.col("id").alias("i"), F.when(F.col("id") % 100 > 0, F.concat(F.lit("label "), F.md5((F.col("id") % 990_000).cast("string")))).alias("v"))
    with monkeypatch.context() as m:
        for name in ("collect", "toPandas", "toLocalIterator", "take"):
            m.setattr(type(labels), name, lambda *_: pytest.fail("labels reached the driver"))
        codes, levels = access.encoded(labels)
    got = codes.join(levels, codes["v"] == levels["pos"], "left").join(labels.withColumnRenamed("v", "was"), "i")
    r = got.agg(F.count("*").alias("all"), F.count("pos").alias("known"), F.count_if(~F.col("label").eqNullSafe(F.col("was"))).alias("wrong"), F.max("pos").alias("last")).first()
    assert (levels.count(), r["all"], r["known"], r["wrong"], r["last"]) == (980_100, 1_000_000, 990_000, 0, 980_099)


def test_labels_of_a_dataset(spark):
    d = Dataset(spark)
    d.add_axis("cells", ["a", "b", "c"])
    f = d.add_labels("donor", spark.createDataFrame([(0, "y"), (1, None), (2, "x")], "i long, v string"), "cells")
    assert sorted(map(tuple, f.df.collect())) == [(0, 1), (1, None), (2, 0)] and d.axes["donor"].induced_by == "donor" and d.axes["donor"].length == 2
    assert [r["label"] for r in d.axes["donor"].df.orderBy("pos").collect()] == ["x", "y"]
    assert issues(d).where("severity = 'ERROR'").count() == 0
    d.fields["donor"].df = f.df.withColumn("v", F.col("v") + 1)
    assert [(r["field"], r["rule"]) for r in issues(d).where("severity = 'ERROR'").collect()] == [("donor", "code")]
    codes, _ = access.encoded(spark.createDataFrame([(0, "q"), (1, "p")], "i long, v string"), spark.createDataFrame([(5, "q")], "pos long, label string"))
    assert sorted(map(tuple, codes.collect())) == [(0, 5), (1, None)]  # a dictionary given, and a label it hasn't


@pytest.mark.parametrize(
    "labels, axis, coverage, at",
    [
        (["c0", "c1", "c2"], "cells", "full", [0, 1, 2]), (["c2", "c0"], "cells", "partial", [2, 0]), (["c1", "c0", "c2"], "cells", "partial", [1, 0, 2]), (["c0", "c1"], "cells", "partial", [0, 1]),
        (["c0", "zz"], "cells.m", "full", [0, 1]), ([], "cells", "partial", []), (["c0", None], "cells.m", "full", [0, 1]),
    ],
)
def test_where_a_modality_belongs(spark, labels, axis, coverage, at):
    d = Dataset(spark)
    d.add_axis("cells", ["c0", "c1", "c2"])
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "pos long, label string")
    m = spark.createDataFrame([(i, 0, i + 1.0) for i in range(len(labels))], "i long, j long, v double")
    f = collection.add_modality(d, "m", m, frame(labels), frame(["p0", "p1"]), state="raw")
    assert (f.span, f.coverage, f.index_axis) == ((axis, "m_features"), coverage, "cells" if coverage == "partial" else None)
    assert sorted(map(tuple, f.df.collect())) == sorted((k, 0, i + 1.0) for i, k in enumerate(at)) and d.axes[axis].length == (2 if axis != "cells" else 3)
    assert issues(d).where("severity = 'ERROR'").count() == 0
