"""Keyed exchange of packed arrays between blocks of rows and buckets of keys.

A block is a run of rows that one task reads. Its entries (key, row of the block) are packed
by bucket of the key's hash, so that the shuffle moves a few large rows rather than one for
each key and row. ``reduce`` sees one bucket of all blocks and answers with numbers for rows,
whose sums come back to the blocks. Block numbers follow from the partition and the order in
it, so a task that runs again after a lost executor makes the same ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import pieces

_ROW = "bucket long, block long, n int, a binary, b binary"
_TYPES = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
#: One bucket for about so many bytes of text, and at least MIN_BUCKETS.
BUCKET_BYTES, MIN_BUCKETS = 1 << 20, 256
#: Rows of a block are numbered in 16 bits; the last number is free for marks.
BLOCK_ROWS = 60_000

Entry = tuple[int, int, bytes, bytes]
Answer = tuple[int, int, np.ndarray, np.ndarray]


def buckets_for(df: DataFrame, text: str = "text") -> int:
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(MIN_BUCKETS, -(-size // BUCKET_BYTES))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES.types)], schema=_TYPES)


def gathered(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes of text: small ones joined, large ones cut between rows."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    join = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        for lo, part in pieces(batch.column(column), limit):
            for at in range(0, len(part), BLOCK_ROWS):
                piece = batch.slice(lo + at, min(BLOCK_ROWS, len(part) - at))
                n = piece.nbytes
                if held and (size + n > limit or rows + piece.num_rows > BLOCK_ROWS):
                    yield join()
                    held, size, rows = [], 0, 0
                held.append(piece)
                size += n
                rows += piece.num_rows
    if held:
        yield join()


def exchange(
    df: DataFrame,
    pack: Callable[[pa.RecordBatch, int], tuple[bytes, list[tuple[int, bytes, bytes]]]],
    reduce: Callable[[list[Entry], dict], Iterable[Answer]],
    finish: Callable[[bytes, np.ndarray], pa.RecordBatch],
    schema: str,
    text: str = "text",
    block_bytes: int = 8 << 20,
    hold: int = 24 << 20,
    running: bool = False,
) -> DataFrame:
    """pack: a block's rows and its number -> (what to keep, [(bucket, a, b)]). reduce: [(block, rows of it, a, b)] of one
    bucket, and a dict that lasts as long as the bucket -> (block, rows of it, row numbers, values). finish: (what was kept,
    sums of the values by row) -> result rows. A task adds up the answers of its buckets, in at most ``hold`` bytes at a
    time. running: reduce may be called for a part of a bucket's rows, so that a task holds at most ``hold`` bytes of them."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, batch in enumerate(gathered(batches, text, block_bytes)):
            kept, rows = pack(batch, first + i)
            n = batch.num_rows
            yield _batch([(x, first + i, n, y, z) for x, y, z in rows] + [(-1 - first - i, first + i, n, kept, b"")])

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        size, now, rows, held, known = 0, None, [], 0, {}

        def flush() -> pa.RecordBatch:
            out = []
            for k, v in sums.items():
                at = np.flatnonzero(v)
                out.append((1, k, len(v), at.astype(np.uint16).tobytes(), v[at].astype(np.uint32).tobytes() if v.max(initial=0) < 1 << 32 else v[at].tobytes()))
            sums.clear()
            return _batch(out)

        def answer() -> None:
            nonlocal size
            for block, n, at, value in reduce(rows, known):
                if block not in sums:
                    sums[block] = np.zeros(n, np.int64)
                    size += 8 * n + 100
                np.add.at(sums[block], at, value)

        for batch in batches:
            kept = []
            for bucket, block, n, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket < 0:
                    kept.append((0, block, n, a, b))
                    continue
                if bucket != now or running and held > hold:
                    if rows:
                        answer()
                    if bucket != now:
                        known = {}
                    now, rows, held = bucket, [], 0
                    if size > hold:
                        yield flush()
                        size = 0
                rows.append((block, n, a, b))
                held += len(a) + len(b)
            if kept:
                yield _batch(kept)
        if rows:
            answer()
        if sums:
            yield flush()

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, total = None, np.zeros(0, np.int64)
        for batch in batches:
            for kind, n, a, b in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "a", "b"))):
                if kind == 0:
                    if keep is not None:
                        yield finish(keep, total)
                    keep, total = a, np.zeros(n, np.int64)
                else:
                    at = np.frombuffer(a, np.uint16)
                    total[at] += np.frombuffer(b, np.uint32 if len(b) == 4 * len(at) else np.int64).astype(np.int64)
        if keep is not None:
            yield finish(keep, total)

    out = df.mapInArrow(mapped, _ROW).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(reduced, _ROW)
    return out.repartition("block").sortWithinPartitions("block", "bucket").mapInArrow(finished, schema)


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array, and its length at the end."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)
