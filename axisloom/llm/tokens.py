"""Token counts with each distinct pre-token counted once.

A pre-token is what merges of the vocabulary never reach beyond: a run of spaces with the
characters behind it, up to the next space or line feed. No piece of the vocabulary holds a
space behind another character, nor a line feed among others (checked when the model loads),
so the pieces of a text are those of its pre-tokens put one after another. Blocks of documents
send (pre-token, documents and frequencies) to the bucket of the pre-token; there each distinct
one is counted once, its count is joined to the frequencies, and sums return to the documents.
Ids are never kept. A pre-token that many documents of a block have goes to one of several
buckets by the block's number, one more for every ``PART`` buckets: so no bucket's size follows
that of a hot pre-token. Each of these buckets counts it once.

Defined results: null and empty texts have no tokens; special strings are ordinary text;
repeated rows and ids are counted row by row; texts are whole, however long.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import buckets_for, exchange, runs
from .words import mix, power_table, utf8

_U = np.uint64
#: A pre-token that more than SPREAD documents of a block have is spread over a bucket for every PART of them.
SPREAD, PART = 16, 64
_loaded: dict = {}


def load(model: str):
    """The sentencepiece model of this path, or of this name among the public tokenizers."""
    if model not in _loaded:
        import sentencepiece

        path = model
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(model)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        if any(re.search("[^▁]▁|.\n|\n.", p) for p in pieces) or sp.encode("  a", out_type=str)[0] == "▁a":
            raise ValueError(f"{model} merges across spaces or line feeds, or drops spaces: its texts have no such pre-tokens")
        _loaded[model] = sp
    return _loaded[model]


def piece_counts(sp, keys: list[bytes]) -> np.ndarray:
    """Pieces of each pre-token. One that starts with a space begins as the model's own prefix does; others stand behind a line feed."""
    texts = [(k[1:] if k[:1] == b" " else b"\n" + k).decode("utf-8") for k in keys]
    made = np.fromiter((len(x) for x in sp.encode(texts, num_threads=1)), np.int64, len(keys))
    made -= np.fromiter((0 if k[:1] == b" " else 2 for k in keys), np.int64, len(keys))
    made[np.fromiter((k == b" " for k in keys), bool, len(keys))] = 1
    return made


def pre_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a space put before each row that isn't empty, start and end of each pre-token, row of each, line feeds by row)."""
    full = np.diff(off) > 0
    data = np.insert(data, off[:-1][full], 32)
    off = off + np.concatenate([[0], np.cumsum(full)])
    rows = len(full)
    space, feed = data == 32, data == 10
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    after = np.ones(len(data), bool)  # behind a line feed or at the start of a row
    after[1:] = feed[:-1] | edge[1:-1]
    first = after.copy()
    first[1:] |= space[1:] & ~space[:-1]
    first &= ~feed
    starts = np.flatnonzero(first)
    stop = first | feed
    stop[off[:-1][full]] = True
    stops = np.append(np.flatnonzero(stop), len(data))
    ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
    row = np.searchsorted(off, starts, side="right") - 1
    feeds = np.bincount(np.searchsorted(off, np.flatnonzero(feed), side="right") - 1, minlength=rows)
    return data, starts, ends, row, feeds


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 4 << 20) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, side="right")))
        lo, hi = starts[i], ends[j - 1]
        up, down = power_table(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + _U(1)) * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out)


def bucket_of(h: np.ndarray, entries: np.ndarray, buckets: int, block: int, spread: int = SPREAD) -> np.ndarray:
    """Bucket of each pre-token of a block, by its hash and the number of its documents there."""
    part = int(mix(np.array([block], np.uint64))[0]) % max(1, buckets // PART)
    return (np.where(entries > spread, mix(h + _U(part)), h) % _U(buckets)).astype(np.int64)


def count_tokens(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = "piece_bpe_32k.model", limit: int = 4096, spread: int = SPREAD, hold: int = 24 << 20) -> DataFrame:
    """One row per row of df: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). spread: see ``SPREAD``; hold: bytes
    of postings that a task holds."""
    df = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    buckets = buckets_for(df)
    load(model)  # fails here, on the driver, for a model of another kind

    def pack(batch: pa.RecordBatch, block: int) -> tuple[bytes, list]:
        arr = batch.column("text")
        n_bytes = np.diff(utf8(arr)[1])
        data, off = utf8(pc.replace_substring(arr, "▁", " "))
        data, starts, ends, row, feeds = pre_tokens(data, off)
        h = span_hashes(data, starts, ends)
        _, at, kind = np.unique(h, return_index=True, return_inverse=True)
        pair, freq = np.unique(kind.astype(np.int64) * batch.num_rows + row, return_counts=True)
        token, doc = pair // batch.num_rows, pair % batch.num_rows
        more = np.maximum(1, -(-freq // 255))  # frequencies stand in one byte; larger ones take several entries
        if more.max(initial=1) > 1:
            left = freq - 255 * (more - 1)
            token, doc = np.repeat(token, more), np.repeat(doc, more)
            last = np.cumsum(more) - 1
            freq = np.full(len(token), 255)
            freq[last] = left
        entries = np.bincount(token, minlength=len(at))
        bucket = bucket_of(h[at], entries, buckets, block, spread)
        order = np.argsort(bucket, kind="stable")
        begin = np.concatenate([[0], np.cumsum(entries)])
        doc, freq = doc.astype(np.uint16), freq.astype(np.uint8)
        raw = data.tobytes()
        rows = []
        cuts = runs(bucket[order])
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            own = order[lo:hi]
            where = at[own]
            parts = [raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())]
            take = np.concatenate([np.arange(begin[t], begin[t + 1]) for t in own.tolist()])
            head = np.array([len(own), len(take)], np.uint32).tobytes() + (ends[where] - starts[where]).astype(np.uint32).tobytes() + entries[own].astype(np.uint32).tobytes()
            rows.append((int(bucket[own[0]]), head + doc[take].tobytes() + freq[take].tobytes(), b"".join(parts)))
        ids = batch.column("doc_id")
        kept = np.concatenate([ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), n_bytes, feeds.astype(np.int64)])
        return kept.astype(np.int64).tobytes(), rows

    def reduce(rows: list, known: dict[bytes, int]) -> list:
        fresh: dict[bytes, None] = {}
        held = []
        for block, n, a, b in rows:
            k, m = np.frombuffer(a, np.uint32, 2).tolist()
            stop = np.cumsum(np.frombuffer(a, np.uint32, k, 8)).tolist()
            entries = np.frombuffer(a, np.uint32, k, 8 + 4 * k)
            doc = np.frombuffer(a, np.uint16, m, 8 + 8 * k)
            freq = np.frombuffer(a, np.uint8, m, 8 + 8 * k + 2 * m)
            own = [b[s:e] for s, e in zip([0, *stop[:-1]], stop)]
            fresh.update(dict.fromkeys(key for key in own if key not in known))
            held.append((block, n, own, entries, doc, freq))
        known.update(zip(fresh, piece_counts(load(model), list(fresh)).tolist()))
        return [(block, n, doc.astype(np.int64), np.repeat(np.array([known[key] for key in own], np.int64), entries) * freq) for block, n, own, entries, doc, freq in held]

    def finish(kept: bytes, total: np.ndarray) -> pa.RecordBatch:
        ids, null, n_bytes, feeds = np.frombuffer(kept, np.int64).reshape(4, -1)
        n = total + feeds
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=null > 0), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return exchange(df, pack, reduce, finish, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", hold=hold, running=True)
