"""Removal of long repeated spans by a compacted de Bruijn graph of tokens.

Edges of the graph are runs of ``window`` tokens. Each is kept under its anchor, the k-mer
of tokens with the least hash in it, which equal edges share. Edges in a row that share one
occurrence of an anchor are a path without branches as far as their document goes, so they
are compacted into one: (anchor, hash of all its tokens). A join over anchors then tells

* paths that stand in several places: all their edges are repeated;
* anchors that only one place has: none of their edges is repeated;
* anchors where paths part: there the single edges of each distinct path are written out,
  from one of its source coordinates.

A join of path ends then compacts further: where a repeated path is followed by one and the
same path in all its places, and that one has no other before it, no branch lies between
them, and they are one path.

Hashes only propose. Each repeated path and each edge written out goes back to its source
coordinates, where the words are read again, and only those whose 128-bit BLAKE2 digest of
the words stands in two places are repeated. A path that just its hashes made equal to another
is written out edge by edge instead.

Coordinates of repeated edges go back to the documents, which lose the words they cover.
Paths that stand in one block of rows many times are counted there, so that frequent lines
and copies send a row per block.

Defined results: null and empty texts, and texts shorter than a window, lose nothing; repeated
rows are copies of each other, so texts of a window or more lose every word in them; rows
with the same or no id but other texts are separate (rows are joined by the hash of id and text); other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import gathered, runs
from .common import dealt, discard, saved
from .words import grams, mix, pieces, power_table, utf8, words

_U = np.uint64
_PLACE = np.dtype([("key", "<i8"), ("a", "<u4"), ("n", "<u2")])
#: Windows of a long document are worked through in parts of so many words.
PART_WORDS = 1 << 22


def anchors(h: np.ndarray, row: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h, row: hash and document of the words of a block, at most PART_WORDS + window of them.
    (first window, number of windows, anchor's place) of each path; windows don't cross documents."""
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    least = ((grams(h, k) >> _U(24)) << _U(24)) | np.arange(len(h) - k + 1, dtype=np.uint64)
    span, width = window - k + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n], least[span - width :][: n])
    place = (least[:n] & _U((1 << 24) - 1)).astype(np.int64)
    at = np.flatnonzero(row[:n] == row[window - 1 :])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    place = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), place[first]


def span_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    up, down = power_table(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def _paths(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(anchor, path, c, places): each distinct path of a block, how often it stands there, and where."""
    names = ["anchor", "path", "c", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", 8 << 20):
            found = []
            for lo, part in pieces(batch.column("text"), 4 << 20):
                keys = batch.column("key").slice(lo, len(part)).to_numpy()
                _, _, h, row = words(*utf8(part))
                begin = np.searchsorted(row, np.arange(len(part)))
                for cut in range(0, max(1, len(h)), PART_WORDS):
                    own, of = h[cut : cut + PART_WORDS + window - 1], row[cut : cut + PART_WORDS + window - 1]
                    at, n, place = anchors(own, of, window, k)
                    if len(at):
                        doc = of[at]
                        spot = np.empty(len(at), _PLACE)
                        spot["key"], spot["a"], spot["n"] = keys[doc], at + cut - begin[doc], n
                        found.append((grams(own, k)[place], span_hash(own, at, at + n + window - 1), spot))
            if not found:
                continue
            anchor, path, spot = (np.concatenate(x) for x in zip(*found))
            _, first, kind, count = np.unique(mix(anchor + mix(path)), return_index=True, return_inverse=True, return_counts=True)
            data = spot[np.argsort(kind, kind="stable")].tobytes()
            offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32) * _PLACE.itemsize
            places = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
            out = pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(path[first].view(np.int64)), pa.array(count.astype(np.int64)), places], names=names)
            for lo in range(0, out.num_rows, 20_000):
                yield out.slice(lo, 20_000)

    return docs.select("key", "text").mapInArrow(run, "anchor long, path long, c long, places binary")


def _spread(paths: DataFrame) -> DataFrame:
    """(key, a, n, flag, path) of repeated and doubtful paths: flag & 1, all windows are repeated; flag & 2, windows must be written out.

    paths: a saved table. Counts by path and by anchor are partial aggregates, joined back over keys that may be hot.
    """
    paths = paths.withColumn("r", F.xxhash64("places"))
    own = paths.groupBy("anchor", "path").agg(F.sum("c").alias("own"), F.min("r").alias("first"))
    tot = own.groupBy("anchor").agg(F.sum("own").alias("tot"))
    told = own.join(dealt(tot), "anchor").where("own > 1 or tot > own").select("anchor", "path", (F.col("own") > 1).alias("twice"), (F.col("tot") > F.col("own")).alias("parts"), "first")
    # Rows of one hash are equal, so a path that has several is repeated anyway.
    rows = paths.join(dealt(told), ["anchor", "path"]).select("places", "twice", F.xxhash64("anchor", "path").alias("path"), (F.col("parts") & (F.col("r") == F.col("first"))).alias("open"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column("places").to_pylist()
            count = np.array([len(x) // _PLACE.itemsize for x in places])
            spot = np.frombuffer(b"".join(places), _PLACE)
            flag = np.repeat(batch.column("twice").to_numpy(zero_copy_only=False).astype(np.int32), count)
            flag[(np.cumsum(count) - count)[batch.column("open").to_numpy(zero_copy_only=False)]] += 2
            keep = flag > 0
            yield pa.RecordBatch.from_arrays([pa.array(spot["key"][keep]), pa.array(spot["a"][keep].astype(np.int64)), pa.array(spot["n"][keep].astype(np.int32)), pa.array(flag[keep]), pa.array(np.repeat(batch.column("path").to_numpy(), count)[keep])], names=["key", "a", "n", "flag", "path"])

    return rows.mapInArrow(run, "key long, a long, n int, flag int, path long")


def _joined(paths: DataFrame) -> DataFrame:
    """(key, a): where a repeated path goes on from the one before it without a branch. paths: a saved table of key, a, n, path."""
    ends = paths.select("key", (F.col("a") + F.col("n")).alias("a"), F.col("path").alias("p"))
    links = saved(ends.join(paths.select("key", "a", F.col("path").alias("q")), ["key", "a"]), "links")
    places = paths.groupBy("path").agg(F.count(F.lit(1)).alias("c"))
    of = lambda end: places.select(F.col("path").alias(end), "c")
    sole = links.groupBy("p", "q").agg(F.count(F.lit(1)).alias("c")).join(of("p"), ["p", "c"]).join(of("q"), ["q", "c"])
    out = saved(links.join(sole.select("p", "q"), ["p", "q"]).select("key", "a"), "joined")
    discard(links)
    return out


def _listed(rows: DataFrame) -> DataFrame:
    """What to read in the texts of a key. rows: key, a, n, kind (0 repeated path, 1 joined to the one before, 2 edges, 3 edges of a repeated path)."""
    todo = rows.groupBy("key").agg(F.collect_set(F.struct("a", "n", "kind")).alias("s"))
    return todo.select(F.col("key").alias("_k"), F.col("s.a").alias("a"), F.col("s.n").alias("n"), F.col("s.kind").alias("kind"))


def _read(docs: DataFrame, todo: DataFrame, window: int) -> DataFrame:
    """(run, d1, d2, key, a, n, out): digest of the words of each compacted path (run) and of each edge written out, at its coordinates."""
    rows = docs.select("key", "text").join(dealt(todo), F.col("key") == F.col("_k")).select("key", "text", "a", "n", "kind")
    names = ["run", "d1", "d2", "key", "a", "n", "out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in pieces(batch.column("text"), 4 << 20):
                own = batch.slice(lo, len(part))
                digests, found = [], []
                for key, t, *lists in zip(own.column("key").to_pylist(), part, own.column("a"), own.column("n"), own.column("kind")):
                    w = t.as_buffer().to_pybytes().split()
                    body = memoryview(b" ".join(w))
                    begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)])
                    a, n, kind = (x.values.to_numpy() for x in lists)
                    order = np.argsort(a, kind="stable")
                    a, n, kind = a[order], n[order].astype(np.int64), kind[order]
                    paths, single = kind == 0, kind >= 2
                    at, size = a[paths], n[paths]
                    head = np.flatnonzero(~np.isin(at, a[kind == 1]))
                    rank = np.arange(int(n[single].sum())) - np.repeat(np.cumsum(n[single]) - n[single], n[single])
                    many = np.repeat(a[single], n[single]) + rank
                    at = np.concatenate([at[head], many])
                    size = np.concatenate([np.add.reduceat(size, head) if len(head) else size[:0], np.ones(len(many), np.int64)])
                    digests += [hashlib.blake2b(body[s:e], digest_size=16).digest() for s, e in zip(begin[at].tolist(), (begin[at + size + window - 1] - 1).tolist())]
                    whole = np.arange(len(at)) < len(head)
                    found.append((whole, np.full(len(at), key), at, size, whole | np.concatenate([whole[: len(head)], np.repeat(kind[single] == 2, n[single])])))
                if not digests:
                    continue
                both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                whole, key, at, size, out = (np.concatenate(x) for x in zip(*found))
                made = pa.RecordBatch.from_arrays([pa.array(x) for x in (whole, both[:, 0], both[:, 1], key, at, size, out)], names=names)
                for i in range(0, made.num_rows, 20_000):
                    yield made.slice(i, 20_000)

    return rows.mapInArrow(run, "run boolean, d1 long, d2 long, key long, a long, n long, out boolean")


def _seen(read: DataFrame) -> DataFrame:
    """(run, d1, d2, again) of the digests that stand in two places, and of those runs that don't."""
    place = F.xxhash64("key", "a")
    seen = read.groupBy("run", "d1", "d2").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("x"), F.max(place).alias("y"))
    # Rows of one key are places of their own for a path; an edge may be written out twice from one place.
    return seen.select("run", "d1", "d2", F.when(F.col("run"), F.col("c") > 1).otherwise(F.col("x") != F.col("y")).alias("again")).where("again or run")


def repeated_spans(docs: DataFrame, window: int = 35, k: int = 8) -> DataFrame:
    """(key, a, n): runs of n windows, the first at word a, that are repeated. docs: key, text (not null)."""
    paths = saved(_paths(docs, window, k), "paths")
    spans = saved(_spread(paths), "spans")
    discard(paths)
    twice = saved(spans.where("flag in (1, 3)").select("key", "a", "n", "path").distinct(), "twice")
    joined = _joined(twice)
    rows = twice.select("key", "a", "n", F.lit(0).alias("kind")).unionByName(joined.select("key", "a", F.lit(0).alias("n"), F.lit(1).alias("kind")))
    todo = saved(_listed(rows.unionByName(spans.where("flag >= 2").select("key", "a", "n", F.col("flag").alias("kind")))), "todo")
    discard(spans, twice, joined)
    read = saved(_read(docs, todo, window), "read")
    discard(todo)
    seen = saved(_seen(read), "seen")
    lone = seen.where("not again")
    if not lone.isEmpty():
        rows = read.join(lone, ["run", "d1", "d2"]).select("key", "a", "n", F.lit(2).alias("kind"))
        read = read.unionByName(saved(_read(docs, _listed(rows), window), "edges"))
        seen = saved(_seen(read), "seen")
    return read.where("out").join(seen.where("again"), ["run", "d1", "d2"]).select("key", "a", "n")


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35, k: int = 8, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed (array of [start, end) in words) of every row; with_text adds kept_text."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    # Rows of one key have equal spans; as a set, a key has no more of them than one of its rows has.
    cover = repeated_spans(docs, window, k).groupBy("key").agg(F.collect_set(F.struct("a", "n")).alias("s"))
    cover = cover.select(F.col("key").alias("_k"), F.col("s.a").alias("a"), F.col("s.n").alias("n"))
    rows = docs.join(dealt(cover), F.col("key") == F.col("_k"), "left").select("doc_id", "text", "a", "n")
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.list_(pa.int64())))] + [("kept_text", pa.string())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in pieces(batch.column("text"), 4 << 20):
                own = batch.slice(lo, len(part))
                made: list[list] = [[] for _ in kinds]
                for doc, t, a, n in zip(own.column("doc_id").to_pylist(), part, own.column("a"), own.column("n")):
                    w = t.as_buffer().to_pybytes().split()
                    gone: list[list[int]] = []
                    if a.is_valid:
                        lo_, hi_ = a.values.to_numpy(), a.values.to_numpy() + n.values.to_numpy() + window - 1
                        change = np.zeros(len(w) + 1, np.int64)
                        np.add.at(change, lo_, 1)
                        np.add.at(change, hi_, -1)
                        inside = (np.cumsum(change) > 0).astype(np.int8)
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], inside[:-1], [0]])))
                        gone = turn.reshape(-1, 2).tolist()
                    kept, at = [], 0
                    for s, e in gone:
                        kept += w[at:s]
                        at = e
                    body = b" ".join(kept + w[at:])
                    values = [doc, len(w), sum(e - s for s, e in gone), hashlib.sha256(body).hexdigest(), gone, body.decode() if with_text else None]
                    for column, value in zip(made, values):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, kinds)], schema=kinds)

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<array<bigint>>" + ", kept_text string" * with_text)
