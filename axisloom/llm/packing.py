"""Variable-capacity best-fit packing of documents into sequences.

Documents longer than the largest capacity are cut into pieces of that capacity and a rest.
Pieces are dealt at random into shards of bounded size; each shard is packed by itself, in
falling length: into the open bin with the least room that suffices, else into a new bin of
the capacity whose cost per expected token is least, given the tokens of shorter pieces that
could still fill it. At last each bin takes the smallest permitted capacity that holds it.

Defined results: pieces are spans [start, start + length) of a document; documents of null or
no length have one row with null bin columns. Rows with the same id are separate documents. Shards
follow the order in which rows are read, so bins are the same in reruns over the same files, not over
others with the same rows. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SHARD_ROWS = 2048
CAPACITIES = (512, 1024, 2048, 4096)


def bin_cost(capacity: int, overhead: int = 64, span: int = 8192) -> float:
    """Cost of a sequence: linear and attention work of its capacity, and a fixed overhead."""
    return overhead + capacity + capacity * capacity / span


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lengths: falling, at most max(capacities). (bin of each item, offset in it, capacity of each bin)."""
    caps = sorted(capacities)
    n = len(lengths)
    behind = np.concatenate([np.cumsum(lengths[::-1])[::-1], [0]])
    rising = lengths[::-1]
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    used: list[int] = []
    size: list[int] = []
    open_at: dict[int, list[int]] = {}
    mask, room = 0, 0
    for i, s in enumerate(lengths.tolist()):
        fits = mask >> s
        if fits:
            left = s + (fits & -fits).bit_length() - 1
            b = open_at[left].pop()
            if not open_at[left]:
                mask ^= 1 << left
            room -= left
        else:
            best = None
            for c in caps:
                if c >= s:
                    first = max(i + 1, n - int(np.searchsorted(rising, c - s, side="right")))
                    content = s + min(c - s, max(0, int(behind[first]) - room))
                    best = min(best or (np.inf, 0), (bin_cost(c) / content, c))
            b, left = len(used), best[1]
            used.append(0)
            size.append(left)
        bins[i], offsets[i] = b, used[b]
        used[b] += s
        left -= s
        if left:
            open_at.setdefault(left, []).append(b)
            mask |= 1 << left
            room += left
    closed = [next(c for c in caps if c >= u) for u in used]
    return bins, offsets, np.array(closed, np.int64)


def pack(df: DataFrame, doc_id: str = "doc_id", length: str = "n_words", capacities: tuple[int, ...] = CAPACITIES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, bin_capacity, bin_used, bin_offset."""
    top = max(capacities)
    n = F.coalesce(F.col(length), F.lit(0)).cast("long")
    pieces = df.select(F.col(doc_id).cast("long").alias("doc_id"), n.alias("_n")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("_n") / top) - 1).cast("int"))))
    pieces = pieces.withColumns({"start": F.col("piece").cast("long") * top, "length": F.least(F.lit(top), F.col("_n") - F.col("piece").cast("long") * top).cast("long")}).drop("_n")
    pieces = saved(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard_rows))
    kinds = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("bin_id", pa.int64()), ("bin_capacity", pa.int64()), ("bin_used", pa.int64()), ("bin_offset", pa.int64())])

    def shard(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table.column("length").to_numpy()
        full = int((lengths > 0).sum())
        bins, offsets, caps = best_fit(lengths[:full], capacities)
        used = np.bincount(bins, weights=lengths[:full], minlength=len(caps)).astype(np.int64)
        gap = np.arange(len(lengths)) >= full
        rest = np.zeros(len(lengths) - full, np.int64)
        fill = lambda x: pa.array(np.concatenate([x, rest]), mask=gap)
        number = (key[0].as_py() << 24) + bins
        cols = [table.column(c) for c in ("doc_id", "piece", "start", "length")]
        return pa.table([*cols, fill(number), fill(caps[bins] if full else rest[:0]), fill(used[bins] if full else rest[:0]), fill(offsets)], schema=kinds)

    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("_shard").applyInArrow(shard, "doc_id long, piece int, start long, length long, bin_id long, bin_capacity long, bin_used long, bin_offset long")


def bins_of(packed: DataFrame) -> DataFrame:
    """One row per bin: bin_id, bin_capacity, bin_used, doc_ids in the order of their offsets."""
    items = F.sort_array(F.collect_list(F.struct("bin_offset", "doc_id")))
    return packed.where("bin_id is not null").groupBy("bin_id", "bin_capacity", "bin_used").agg(F.transform(items, lambda x: x["doc_id"]).alias("doc_ids"))


__all__ = ["CAPACITIES", "best_fit", "bin_cost", "bins_of", "pack"]
