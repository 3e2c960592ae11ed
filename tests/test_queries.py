"""Every registered query with SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from axisloom import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(tuple, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_partition_count_does_not_matter(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        made = []
        for n in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            made.append([rows(queries.QUERIES[q](spark, SF).toPandas()) for q in ("group_stats", "col_stats_depth", "cell_order_hilbert", "overdispersion")])
        assert made[0] == made[1] == made[2]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
