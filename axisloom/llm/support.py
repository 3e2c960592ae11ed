"""Quality by naive Bayes support vectors: n-gram indicators scaled by log-count ratios, a linear hinge loss by dual coordinate descent.

An indicator says that a text holds an n-gram at least once. N-grams are runs of 1 to 5 bytes of the UTF-8
text, words, word pairs, and runs of 1 to 3 word shapes. A shape is the word's first and last byte class, whether it has
capitals only, and whether it equals one of the two words before it; so shapes say of words never seen before that they shout,
trail symbols or repeat. N-grams are hashed into ``1 << BITS`` buckets. A bucket's ratio is the log of its share among
documents of quality 1 over its share among the others, from counts smoothed by 1; the rows of ratios are scaled to
length 1 and fitted with L2-regularised hinge loss, both classes weighing the same in all. The weights are mixed with
their mean size (``BETA``), as naive Bayes would have them, and the margin becomes a probability by a logistic fit on documents set apart.

Fitting sees a bounded sample of labelled documents (``FIT_EACH`` ids of either label by their hash, one text each, of at most
``FIT_CHARS`` characters). Scoring sees every whole text in tasks, one by one.

Defined results: null and empty texts have no indicators and get the share of quality 1 in the labels outside the held-out fold (0.5
without any). Without both labels every text gets that share. Ids may repeat or be null: rows are scored one by one, a null id is in
no held-out fold and never learnt from. Of an id's labels the larger counts; labels other than 0 and 1 are no labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .words import mix, pieces, utf8, words

#: Bounds of the sample to fit on, and so of what the driver holds: ids of each label, and characters of a text.
FIT_EACH, FIT_CHARS = 3000, 20_000
BITS, BETA = 18, 0.25
_U = np.uint64
_SHIFT = _U(64 - BITS)
#: Class of a byte: 0 other ASCII, 1 lower case, 2 capital, 3 digit, 4 beyond ASCII, and each mark its own.
CLASS = np.zeros(256, np.uint64)
CLASS[33:127] = np.arange(10, 104)
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 1, 2, 3, 4


@dataclass
class Model:
    weight: np.ndarray  # of each bucket, ratio included
    square: np.ndarray  # of each bucket's ratio
    bias: float
    slope: float
    shift: float
    prior: float


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return ((h + _U(kind)) * _U(0x9E3779B97F4A7C15) >> _SHIFT).astype(np.int32)


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, row: np.ndarray) -> np.ndarray:
    capitals = np.concatenate([[0], np.cumsum((data >= 65) & (data < 91))])
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data < 123))])
    shouts = (capitals[end] - capitals[start] > 1) & (small[end] == small[start])
    same = np.zeros(len(h), np.uint64)
    for k in (2, 1):
        same[k:][(h[k:] == h[:-k]) & (row[k:] == row[:-k])] = k
    return ((CLASS[data[start]] * _U(128) + CLASS[data[end - 1]]) * _U(2) + shouts) * _U(3) + same


def indicators(arr: pa.Array) -> Iterator[np.ndarray]:
    """The distinct buckets of each text, ascending."""
    held = np.zeros(1 << BITS, bool)
    for _, part in pieces(arr, 1 << 19):
        data, off = utf8(part)
        grams, g = [], np.zeros(len(data), np.uint64)
        for n in range(1, 6):
            g = (g[: max(0, len(data) - n + 1)] << _U(8)) | data[n - 1 :]
            grams.append(_bucket(g, n))
        start, end, h, row = words(data, off)
        first = np.searchsorted(row, np.arange(len(part) + 1))
        tokens = [(_bucket(h, 11), 1), (_bucket(mix(h[:-1] * _U(3) + h[1:]), 12), 2)]
        shape = _shapes(data, start, end, h, row) if len(h) else h
        run = np.zeros(len(h), np.uint64)
        for n in range(1, 4):
            run = run[: max(0, len(h) - n + 1)] * _U(1 << 17) + shape[n - 1 :]
            tokens.append((_bucket(mix(run), 20 + n), n))
        for i in range(len(part)):
            for n, b in enumerate(grams, 1):
                held[b[off[i] : max(off[i], off[i + 1] - n + 1)]] = True
            for b, n in tokens:
                held[b[first[i] : max(first[i], first[i + 1] - n + 1)]] = True
            own = np.flatnonzero(held).astype(np.int32)
            held[own] = False
            yield own


def descend(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, c: np.ndarray, rng: np.random.Generator, epochs: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2 / 2 + sum c * max(0, 1 - y (w x + b)) by dual coordinate descent, x being a row's ``values``, scaled to length 1."""
    scale = [1 / max(1e-12, np.sqrt((values[r] ** 2).sum())) for r in rows]
    w, b, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x = values[rows[i]] * scale[i]
            g = y[i] * (w[rows[i]] @ x + b) - 1
            new = min(max(alpha[i] - g / 2, 0.0), c[i])  # the row and the constant 1 have a squared length of 2
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * x
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3 * c.max():
            break
    return w, b


def _logistic(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and shift of a logistic fit with softened targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        h = p * (1 - p) + 1e-9
        hess = np.array([[(h * z * z).sum() + 1e-6, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([((p - t) * z).sum(), (p - t).sum()]))
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit(texts: list[str], labels: list[int], prior: float | None = None, seed: int = 3, least: int = 3, cost: float = 4.0) -> Model:
    """prior: the share of label 1 among all labels, which the sample need not have."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    share = (float(y.mean()) if len(y) else 0.5) if prior is None else prior
    flat = Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), share)
    if len(set(labels)) < 2:
        return flat
    rows = list(indicators(pa.array(texts, pa.large_string())))
    apart = np.zeros(len(y), bool)  # every fifth of either label is kept for the logistic fit
    for label in (0, 1):
        apart[np.flatnonzero(y == label)[::5]] = (y == label).sum() >= 10
    mine = np.flatnonzero(~apart)
    count = np.zeros((2, 1 << BITS))
    for i in mine:
        count[y[i], rows[i]] += 1
    known = count.sum(0) >= least
    odds = (count + 1) / (count + 1)[:, known].sum(1, keepdims=True)
    ratio = np.where(known, np.log(odds[1] / odds[0]), 0.0)
    for i in range(len(rows)):
        rows[i] = rows[i][known[rows[i]]]
    own = [rows[i] for i in mine]
    sign = np.where(y[mine] == 1, 1, -1)
    c = cost * np.where(sign == 1, 0.5 / (sign == 1).sum(), 0.5 / (sign == -1).sum()) * len(sign)
    w, bias = descend(own, ratio, sign, c, rng)
    w = BETA * w + (1 - BETA) * np.abs(w[known]).mean()
    model = Model((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, 1.0, 0.0, share)
    check = np.flatnonzero(apart) if apart.any() else np.arange(len(y))
    z = np.array([margin(rows[i], model) for i in check])
    model.slope, model.shift = _logistic(z, y[check])
    sampled = y.mean()
    if 0 < share < 1:
        model.shift += float(np.log(share / (1 - share) * (1 - sampled) / sampled))
    return model


def margin(own: np.ndarray, model: Model) -> float:
    return float(model.weight[own].sum(dtype=np.float64) / max(1e-12, np.sqrt(model.square[own].sum(dtype=np.float64)))) + model.bias


def scores(arr: pa.Array, model: Model) -> np.ndarray:
    z = np.array([margin(own, model) if len(own) else np.nan for own in indicators(arr)])
    p = 1 / (1 + np.exp(-np.clip(model.slope * np.nan_to_num(z) + model.shift, -40, 40)))
    return np.where(np.isnan(z), model.prior, p)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def sample(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[list[str], list[int], float]:
    """The bounded sample of labelled rows outside the held-out fold, in the order of their ids, and the share of label 1 among all labels there."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_y"))
    order = [F.xxhash64("_id"), F.col("_id")]
    some = known.where("_y = 1").orderBy(*order).limit(FIT_EACH).unionByName(known.where("_y = 0").orderBy(*order).limit(FIT_EACH))
    rows = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).where(F.length("_t") <= FIT_CHARS).join(F.broadcast(some), "_id")
    rows = rows.groupBy("_id", "_y").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), "_t")).alias("_t")).collect()
    rows.sort(key=lambda r: r["_id"])
    share = known.agg(F.avg("_y")).first()[0]
    return [r["_t"] for r in rows], [int(r["_y"]) for r in rows], 0.5 if share is None else float(share)


def score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """df with a score column (0 to 1); a column of that name is replaced."""
    df = df.drop(column)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(batch.column(text), model))], names=[*names, column])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(column, DoubleType())]))
