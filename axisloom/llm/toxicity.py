"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks at its ends) and itself, hashed into
buckets with a vector each; misspellings share most n-grams with the word. The vectors of a
passage of ``span`` words are averaged and go through a softmax. Passages don't overlap, so that a single word never counts
twice, and a document's score is the mean of its ``top`` most toxic passages, calibrated on labelled documents that the vectors
have not seen. One passage decides over a text of less than ``short`` words, where a word that is like a toxic one by chance is rare. Since the softmax is linear, scoring needs one number per
bucket. Buckets that less than one in ``rare`` documents of the sample has, or fewer than ``LEAST``, count for nothing:
invented and rare words would else tell the sample's documents apart.

Training sees a bounded sample of labelled documents (``FIT_TOXIC`` and ``FIT_CLEAN`` ids, by
their hash, with one text each, of at most ``FIT_CHARS`` characters). Labels belong to documents, not passages: the
passages of a document to train on are picked by log odds of the buckets; each round after the first picks them by the model so far, and trains anew.

Defined results: null and empty texts, and texts without letters or digits, score the share of
toxic documents in the sample, at most 0.49; without any labels the same with share 0. Ids may
repeat or be null: rows are scored one by one, whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bounds of the training sample, and so of what the driver holds: ids of either label, and characters of a text.
FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 2000, 4000, 50_000
#: Documents of the sample that a bucket must be in, at least.
LEAST = 3
BITS, SIZES = 20, (3, 4, 5, 6)
_KEEP = np.zeros(128, bool)
_KEEP[[*range(48, 58), *range(97, 123)]] = True
_A, _B = np.uint32(0x01000193), np.uint32(0x9E3779B1)


@dataclass
class Model:
    value: np.ndarray  # logit of each bucket
    bias: float
    slope: float
    shift: float
    prior: float
    span: int = 1
    top: int = 2
    short: int = 50


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, 0 for what is no letter or digit; where each text begins and the last ends). Texts are set apart by zeros."""
    low = [t.lower() for t in texts]
    raw = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    small = raw < 128
    raw[small] *= _KEEP[raw[small]]
    return raw, np.cumsum([1, *(len(t) + 1 for t in low)])


def features(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, valid) per character for each n-gram size, counted at its second character; last for words, at their first."""
    inner = c != 0
    n = len(c)
    h = c[: n - 2] * _A
    h = (h + c[1 : n - 1]) * _A
    ok = inner[1 : n - 1]
    for size in SIZES:
        m = n - size + 1
        if m <= 0:
            return
        h = (h[:m] ^ c[size - 1 :]) * _A
        if size > SIZES[0]:
            ok = ok[:m] & inner[size - 2 : n - 1]
        yield ((h + np.uint32(size)) * _B) >> np.uint32(32 - BITS), ok


def word_features(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, bucket) of each word."""
    inner = np.concatenate([[False], c != 0, [False]])
    turn = np.flatnonzero(inner[1:] != inner[:-1])
    start, end = turn[::2], turn[1::2]
    weights = np.multiply.accumulate(np.full(len(c) + 1, np.uint64(0x9E3779B97F4A7C15)))
    total = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(c.astype(np.uint64) * weights[: len(c)], out=total[1:])
    back = np.multiply.accumulate(np.full(len(c) + 1, np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))))
    h = (total[end] - total[start]) * back[start]
    return start, end, ((h >> np.uint64(64 - BITS)) ^ np.uint64(0x1F3D)).astype(np.uint32)


def word_sums(c: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, sum of its features' values, number of them)."""
    start, end, bucket = word_features(c)
    total, count = np.zeros(len(c) + 1), np.zeros(len(c) + 1, np.int64)
    for b, ok in features(c):
        total[2 : len(b) + 2] += value[b] * ok
        count[2 : len(b) + 2] += ok
    total, count = np.cumsum(total), np.cumsum(count)
    return start, total[end] - total[start] + value[bucket], count[end] - count[start] + 1


def passages(first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first: where the words of each text begin, and the last end. (text, first word, end) of each passage."""
    n = np.diff(first)
    per = -(-n // span)
    doc = np.repeat(np.arange(len(n)), per)
    lo = first[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * span
    return doc, lo, np.minimum(lo + span, first[doc + 1])


def chunks(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    lo, held = 0, 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t) > limit:
            yield lo, texts[lo:i]
            lo, held = i, 0
        held += len(t)
    if texts:
        yield lo, texts[lo:]


def logits(texts: list[str], model: Model) -> np.ndarray:
    """The mean of the ``top`` largest logits of each text's passages, of a short text the largest; nan without words."""
    out = np.full(len(texts), np.nan)
    for at, part in chunks(texts):
        c, begin = codes(part)
        start, total, count = word_sums(c, model.value)
        words = np.searchsorted(start, begin)
        doc, lo, hi = passages(words, model.span)
        if len(doc):
            t, k = np.concatenate([[0], np.cumsum(total)]), np.concatenate([[0], np.cumsum(count)])
            z = (t[hi] - t[lo]) / (k[hi] - k[lo]) + model.bias
            order = np.lexsort((-z, doc))
            doc, z = doc[order], z[order]
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            size = np.diff(np.append(first, len(doc)))
            top = np.where(np.diff(words)[doc[first]] < model.short, 1, model.top)
            some = np.arange(len(doc)) - np.repeat(first, size) < np.repeat(top, size)
            out[at + doc[first]] = np.add.reduceat(z * some, first) / top
    return out


def scores(texts: list[str], model: Model) -> np.ndarray:
    z = logits(texts, model)
    p = 1 / (1 + np.exp(-np.clip(model.slope * np.nan_to_num(z) + model.shift, -40, 40)))
    return np.where(np.isnan(z), min(model.prior, 0.49), p)


def _bags(texts: list[str], pick: list[list[tuple[int, int]]]) -> list[np.ndarray]:
    """Buckets of the picked passages (first and last word) of each text."""
    out = []
    for at, part in chunks(texts):
        c, begin = codes(part)
        start, end, bucket = word_features(c)
        first = np.searchsorted(start, begin)
        grams = list(features(c))
        for i in range(len(part)):
            for lo, hi in pick[at + i]:
                s, e = start[first[i] + lo], end[first[i] + hi - 1]
                out.append(np.concatenate([bucket[first[i] + lo : first[i] + hi], *(b[s - 1 : e - 1][ok[s - 1 : e - 1]] for b, ok in grams)]))
    return out


def _pick(texts: list[str], value: np.ndarray, span: int, top: int, extra: int, rng: np.random.Generator) -> list[list[tuple[int, int]]]:
    """The passages of each text with the highest two words (by mean value), and some at random."""
    out: list[list[tuple[int, int]]] = []
    for _, part in chunks(texts):
        c, begin = codes(part)
        start, total, count = word_sums(c, value)
        first = np.searchsorted(start, begin)
        word = np.exp(np.clip(4 * total / count, -20, 20))
        doc, lo, hi = passages(first, span)
        held = np.concatenate([[0], np.cumsum(word)])
        z = held[hi] - held[lo]
        cut = np.searchsorted(doc, np.arange(len(part) + 1))
        for i in range(len(part)):
            own = np.arange(cut[i], cut[i + 1])
            take = own[np.argsort(-z[own], kind="stable")[:top]]
            if extra and len(own):
                take = np.concatenate([take, rng.choice(own, min(extra, len(own)), replace=False)])
            out.append([(int(lo[j] - first[i]), int(hi[j] - first[i])) for j in dict.fromkeys(take.tolist())])
    return out


def _train(bags: list[np.ndarray], y: np.ndarray, rng: np.random.Generator, dim: int = 8, epochs: int = 5, rate: float = 0.3, batch: int = 512) -> tuple[np.ndarray, float]:
    """Embeddings and softmax by Adagrad; returns the logit of each bucket (0 where training had none) and the bias."""
    E = rng.normal(0, 0.05, (1 << BITS, dim)).astype(np.float32)
    W = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    gE, gW, gb = np.full(1 << BITS, 1e-6, np.float32), np.full_like(W, 1e-6), np.full_like(b, 1e-6)
    seen = np.zeros(1 << BITS, bool)
    for bag in bags:
        seen[bag] = True
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            take = order[lo : lo + batch]
            size = np.array([len(bags[i]) for i in take])
            ids = np.concatenate([bags[i] for i in take])
            of = np.repeat(np.arange(len(take)), size)
            H = np.add.reduceat(E[ids], np.cumsum(size) - size, axis=0) / size[:, None]
            L = H @ W + b
            P = np.exp(L - L.max(1, keepdims=True))
            P /= P.sum(1, keepdims=True)
            D = P
            D[np.arange(len(take)), y[take]] -= 1
            D *= (weight[take] / len(take))[:, None]
            dH = (D @ W.T / size[:, None] * size.mean()).astype(np.float32)
            dW, db = H.T @ D, D.sum(0)
            own, inv = np.unique(ids, return_inverse=True)
            G = np.stack([np.bincount(inv, weights=dH[of, k], minlength=len(own)) for k in range(dim)], 1).astype(np.float32)
            gE[own] += (G * G).mean(1)
            E[own] -= rate * G / np.sqrt(gE[own])[:, None]
            gW += dW * dW
            W -= 0.1 * dW / np.sqrt(gW)
            gb += db * db
            b -= 0.1 * db / np.sqrt(gb)
    return np.where(seen, E @ (W[:, 1] - W[:, 0]), 0).astype(np.float32), float(b[1] - b[0])


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit with softened targets; labels weigh as they occur."""
    centre, width = z.mean(), z.std() + 1e-9
    x = (z - centre) / width
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g, h = p - t, p * (1 - p) + 1e-6
        H = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(H, np.array([(g * x).sum() + 1e-3 * a, g.sum()])), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    a = max(a, 1e-3)
    return float(a / width), float(b - a * centre / width)


def fit(texts: list[str], labels: list[int], seed: int = 7, span: int = 1, rounds: int = 3, rare: int = 400) -> Model:
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    flat = Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, -40.0, float(y.mean()) if len(y) else 0.0, span)
    if len(set(labels)) < 2:
        return flat
    apart = np.zeros(len(y), bool)  # every fifth of either label is kept for calibration
    for label in (0, 1):
        apart[np.flatnonzero(y == label)[::5]] = len(np.flatnonzero(y == label)) >= 10
    mine = np.flatnonzero(~apart)
    own, of = [texts[i] for i in mine], y[mine]
    seen = np.zeros((2, 1 << BITS))
    for at, part in chunks(own):
        c, begin = codes(part)
        start, _, bucket = word_features(c)
        for place, b in [(start, bucket), *((np.flatnonzero(ok), b[ok]) for b, ok in features(c))]:
            doc = np.searchsorted(begin, place, side="right") - 1
            pair = np.unique(doc.astype(np.int64) << BITS | b)
            for label in (0, 1):
                seen[label] += np.bincount((pair & ((1 << BITS) - 1))[of[at + (pair >> BITS)] == label], minlength=1 << BITS)
    known = seen.sum(0) >= max(LEAST, len(own) / rare)
    value = np.log((seen[1] + 0.5) / (seen[1].sum() + 1) * (seen[0].sum() + 1) / (seen[0] + 0.5)) * known
    bias = 0.0
    for _ in range(rounds):
        tops = [_pick([t], value, span, *((5, 0) if label else (5, 8)), rng)[0] for t, label in zip(own, of)]
        bags = [b[known[b]] for b in _bags(own, tops)]
        some = np.flatnonzero([len(b) > 0 for b in bags])
        if not len(some):
            break
        value, bias = _train([bags[i] for i in some], np.repeat(of, [len(p) for p in tops])[some], rng)
    model = Model(value, bias, 1.0, 0.0, flat.prior, span)
    check = np.flatnonzero(apart) if apart.any() else np.arange(len(y))
    z = logits([texts[i] for i in check], model)
    good = ~np.isnan(z)
    if not good.any():
        return flat
    model.slope, model.shift = _calibrate(z[good], y[check][good])
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def sample(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[str], list[int]]:
    """The bounded sample of labelled rows outside the held-out fold, in the order of their ids' hashes."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(doc_id)) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_y"))
    order = [F.xxhash64("_id"), F.col("_id")]
    some = known.where("_y = 1").orderBy(*order).limit(FIT_TOXIC).unionByName(known.where("_y = 0").orderBy(*order).limit(FIT_CLEAN))
    rows = df.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).where(F.length("_t") <= FIT_CHARS).join(F.broadcast(some), F.col("_d") == F.col("_id"))
    rows = rows.groupBy("_id", "_y").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), "_t")).alias("_t")).collect()
    rows.sort(key=lambda r: r["_id"])
    return [r["_t"] for r in rows], [int(r["_y"]) for r in rows]


def score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """df with a score column (0 to 1); a column of that name is replaced."""
    df = df.drop(column)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                p = scores([t or "" for t in part.column(text).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], names=[*names, column])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(column, DoubleType())]))
