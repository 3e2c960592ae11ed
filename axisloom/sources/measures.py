"""A measure kept in both clusterings: by column and by row, so that either access reads little and moves nothing.

With buckets each clustering is a table of as many buckets of its key, sorted within: one column is in one bucket, and sums by column
or row are taken where they lie, without an exchange. A key that alone has more than ``HOT`` of a bucket's even share would make its
bucket's task the slowest of all; then that clustering is by ranges of both keys instead, which split any key, and sums move as
partial ones. Row groups are small, so that their statistics and page indexes leave out most of a file. What readers get is equal either way.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.measure import measure

HOT, ROW_GROUP = 3.0, 4 << 20


@dataclass
class StoredMeasure:
    """``by_column`` and ``by_row`` are the same entries (i, j, v); take the one whose key the question has."""

    path: str
    by_column: DataFrame
    by_row: DataFrame
    layout: dict[str, str]


def _name(path: str, key: str) -> str:
    return f"axisloom_{hashlib.md5(path.encode()).hexdigest()[:16]}_{key}"


def _columns(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


def hot_keys(m: DataFrame, key: str, parts: int) -> list:
    """Keys that alone have more than ``HOT`` of the even share of ``parts`` tasks; under ``parts / HOT`` of them. Cells of the hash that deals
    keys out are counted first, and keys only in cells that are over that, so that mostly nothing moves but a row for each cell and task."""
    cell = F.pmod(F.hash(key), F.lit(parts))
    sizes = m.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
    most = HOT * sum(r["n"] for r in sizes) / parts
    full = [r["cell"] for r in sizes if r["n"] > most]
    return [r[0] for r in m.where(cell.isin(full)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()] if full else []


def _put(m: DataFrame, path: str, key: str, buckets: int | None, row_group: int, summed: bool) -> tuple[DataFrame, str]:
    """Writes a clustering; what was written, and its layout. What is dealt out by its key is summed and sorted where it lies."""
    other = "j" if key == "i" else "i"
    layout = "bucket" if buckets and not hot_keys(m, key, buckets) else "range"
    if layout == "bucket":
        m = m.repartition(buckets, key)
    if not summed:
        m = measure(m, "i", "j", "v")
    if layout == "bucket":
        m.sparkSession.sql(f"drop table if exists {_name(path, key)}")
        w = m.write.bucketBy(buckets, key).sortBy(key, other).option("parquet.block.size", row_group).option("compression", "zstd")
        w.mode("overwrite").option("path", f"{path}/{key}").format("parquet").saveAsTable(_name(path, key))
    else:
        m.repartitionByRange(key, other).sortWithinPartitions(key, other).write.option("parquet.block.size", row_group).option("compression", "zstd").parquet(f"{path}/{key}")
    return _opened(m.sparkSession, path, key, layout, _columns(m), buckets), layout


def _opened(spark: SparkSession, path: str, key: str, layout: str, columns: str, buckets: int | None) -> DataFrame:
    if layout == "range":
        return spark.read.schema(columns).parquet(f"{path}/{key}")
    other = "j" if key == "i" else "i"
    spark.sql(f"create table if not exists {_name(path, key)} ({columns}) using parquet clustered by ({key}) sorted by ({key}, {other}) into {buckets} buckets location '{path}/{key}'")
    return spark.table(_name(path, key))


def write(m: DataFrame, path: str, buckets: int | None = None, row_group: int = ROW_GROUP, summed: bool = True) -> StoredMeasure:
    """m: (i, j, v), read twice, so save it before if it is dear. buckets: None for ranges. summed: False if entries may stand in parts,
    which are then added up as they are laid out by row. The clustering by column is made from that by row."""
    spark = m.sparkSession
    by_row, row_layout = _put(m.select("i", "j", "v"), path, "i", buckets, row_group, summed)
    _, column_layout = _put(by_row, path, "j", buckets, row_group, True)
    meta = {"columns": _columns(by_row), "buckets": buckets, "layout": {"j": column_layout, "i": row_layout}}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.parquet(f"{path}/meta")  # last: a store without it isn't one
    return read(spark, path)


def rows(m: DataFrame, path: str, buckets: int | None = None, row_group: int = ROW_GROUP, summed: bool = True) -> DataFrame:
    """The clustering by row alone, for a measure that a session reads several times: joins by row move only their other side."""
    return _put(m.select("i", "j", "v"), path, "i", buckets, row_group, summed)[0]


def read(spark: SparkSession, path: str) -> StoredMeasure:
    """Opens a store; the catalog learns of its buckets if this session doesn't know them."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    frames = {key: _opened(spark, path, key, meta["layout"][key], meta["columns"], meta["buckets"]) for key in "ji"}
    return StoredMeasure(path, frames["j"], frames["i"], meta["layout"])


def forget(spark: SparkSession, path: str) -> None:
    """Takes the store's tables out of the catalog; its files stay."""
    for key in "ij":
        spark.sql(f"drop table if exists {_name(path, key)}")
