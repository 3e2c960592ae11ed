"""Filter interaction audit: what each of several filters removes, in every order of applying them, by part of a table.

Texts are scanned in tasks over their Arrow buffers: byte classes and their prefix sums count code points, capitals and symbols, words
are hashed by prefix sums too, and sorted by document and hash they give the distinct ones; equal hashes count as one word only where
the bytes are equal as well. A document's failures are a mask of five bits. Rows are counted by part and mask, at most 32 numbers a
part for all documents, documents of good quality and toxic ones, and every order and step is a sum over masks.

Filter E (a copy of a text with a smaller id) needs no gathering of copies: the least id of each text's SHA-256 is a partial aggregate,
and rows, pre-counted by text, id and part, look for (text, own id) among these, so that no group of copies meets in one task.

Defined results: null texts are empty ones, and equal to these; a null source is the part ''. A null id is neither smaller nor larger
than any id: its row neither fails E nor makes others fail. Rows that repeat an id are counted one by one; of equal texts, all rows of the least id
stay. An id counts as good or toxic if any of its labels says so. Empty tables give no rows. Columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import saved
from .words import pieces, utf8, words

FILTERS = "ABCDE"
COUNTS = ("n_words", "n_distinct", "n_points", "n_capitals", "n_symbols")
#: Failure conditions of the first four filters over the counts; E is the copy rule.
CONDITIONS = ("n_words < 200", "100 * n_distinct < 50 * n_words", "100 * n_capitals > 2 * n_points", "n_symbols > 0")
_CAPITAL, _SYMBOL, _POINT = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_CAPITAL[65:91] = True
_SYMBOL[list(b"#$%&*|")] = True
_POINT[128:192] = False


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b on are the same, ``size`` (over 0) of them."""
    first = np.cumsum(size) - size
    step = np.arange(size.sum()) - np.repeat(first, size)
    return np.logical_and.reduceat(data[np.repeat(a, size) + step] == data[np.repeat(b, size) + step], first) if len(size) else np.zeros(0, bool)


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct words of each row; h may have collisions."""
    out = np.bincount(row, minlength=rows)
    order = np.lexsort((h, row))
    s, e, k, r = start[order], end[order], h[order], row[order]
    near = np.flatnonzero((k[1:] == k[:-1]) & (r[1:] == r[:-1]))  # of each pair of neighbours, the first
    size = e[near] - s[near]
    same = size == e[near + 1] - s[near + 1]
    same[same] = _equal(data, s[near[same]], s[near[same] + 1], size[same])
    out -= np.bincount(r[near[same]], minlength=rows)
    for i in near[~same]:  # a collision: its whole run is counted by its bytes
        lo, hi = np.searchsorted(r, [r[i], r[i] + 1])
        lo, hi = lo + np.searchsorted(k[lo:hi], [k[i], k[i]], side="left")[0], lo + np.searchsorted(k[lo:hi], k[i], side="right")
        if not same[np.searchsorted(near, np.arange(lo, i))].all():
            continue  # the run's first collision has settled it
        own = np.searchsorted(near, np.arange(lo, hi - 1))
        out[r[i]] += int(same[own].sum()) - (hi - lo) + len({data[a:b].tobytes() for a, b in zip(s[lo:hi], e[lo:hi])})
    return out


def counts(arr: pa.Array) -> np.ndarray:
    """The five counts of each text, a row for each of ``COUNTS``."""
    out = np.zeros((len(COUNTS), len(arr)), np.int64)
    for lo, part in pieces(arr):
        data, off = utf8(part)
        start, end, h, row = words(data, off)
        own = out[:, lo : lo + len(part)]
        own[0] = np.bincount(row, minlength=len(part))
        own[1] = distinct(data, start, end, h, row, len(part))
        for k, kind in enumerate((_POINT, _CAPITAL, _SYMBOL), 2):
            held = np.concatenate([[0], np.cumsum(kind[data])])
            own[k] = held[off[1:]] - held[off[:-1]]
    return out


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its text, with the five counts; columns of their names are replaced."""
    df = df.drop(*COUNTS)
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, counts(b.column(text)))], names=[*kept, *COUNTS])

    return df.select(*kept, text).mapInArrow(run, StructType([*(df.schema[c] for c in kept), *(StructField(c, LongType()) for c in COUNTS)]))


def masks(df: DataFrame, labels: DataFrame, part: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, n, n_good, n_toxic): rows of each part by the set of filters they fail, bit i for filter i."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("digest"), whole.alias("text"))
    mask = sum(F.expr(c).cast("int") * (1 << k) for k, c in enumerate(CONDITIONS))
    rows = saved(scan(rows).select("id", "part", "digest", mask.alias("mask")), "scanned")
    least = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("least", F.lit(True))
    known = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id"))
    known = known.agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c) for c in ("quality", "toxic")))
    held = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")).join(least, ["digest", "id"], "left")
    held = held.withColumn("mask", F.col("mask") + F.when(F.col("id").isNotNull() & F.col("least").isNull(), 16).otherwise(0)).join(known, "id", "left")
    lost = [F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(f"n_{name}") for name, c in (("good", F.col("quality")), ("toxic", F.col("toxic")))]
    return held.groupBy("part", "mask").agg(F.sum("n").alias("n"), *lost)


def interactions(by_mask: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from the counts by mask."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    bit = np.array([[1 << FILTERS.index(c) for c in o] for o in orders])
    before = (np.cumsum(bit, axis=1) - bit).ravel()[:, None]
    bit = bit.ravel()[:, None]
    m = np.arange(1 << len(FILTERS))
    fails, gone = (m & bit) > 0, (m & before) > 0
    removed, kept, redundant, only = fails & ~gone, ~fails & ~gone, fails & gone, m == bit
    of = np.array([FILTERS.index(c) for o in orders for c in o])
    names = np.repeat(orders, len(FILTERS))
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(orders))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, held in zip(b.column("part").to_pylist(), b.column("held").to_pylist()):
                n = np.zeros((3, len(m)), np.int64)
                for x in held:
                    n[:, x["mask"]] = x["n"], x["n_good"], x["n_toxic"]
                out = removed @ n[0]
                total = np.bincount(of, weights=out).astype(np.int64)[of]
                columns = [kept @ n[0], out, redundant @ n[0], only @ n[0], removed @ n[1], removed @ n[2], total]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(of)), pa.array(names), pa.array(steps), *map(pa.array, columns)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    parts = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("held"))  # at most 32
    return parts.mapInArrow(run, SCHEMA)


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(df: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What every filter removes at every step of every order, by part."""
    return interactions(masks(df, labels, part))


ORACLE = r"""with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (select doc_id, part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask from d),
l as (select doc_id, coalesce(max((quality = 1)::int), 0) as good, coalesce(max((toxic = 1)::int), 0) as bad from labels group by doc_id),
n as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(bad), 0) as bad from f left join l using (doc_id) group by part, mask),
b(c, v) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o as (select a.c || b.c || c.c || d.c || e.c as filter_order, [a.v, b.v, c.v, d.v, e.v] as v from b a, b b, b c, b d, b e where a.v + b.v + c.v + d.v + e.v = 31 and len(list_distinct([a.v, b.v, c.v, d.v, e.v])) = 5),
s as (select filter_order, step, v[step] as bit, coalesce(list_sum(v[1:step - 1]), 0)::int as before from o cross join (select unnest(range(1, 6)) as step)),
x as (select part, filter_order, step::int as step, bit, sum(case when mask & (bit | before) = 0 then n else 0 end)::bigint as kept,
  sum(case when mask & bit > 0 and mask & before = 0 then n else 0 end)::bigint as removed, sum(case when mask & bit > 0 and mask & before > 0 then n else 0 end)::bigint as redundant,
  sum(case when mask = bit then n else 0 end)::bigint as unique_fails, sum(case when mask & bit > 0 and mask & before = 0 then good else 0 end)::bigint as good_lost,
  sum(case when mask & bit > 0 and mask & before = 0 then bad else 0 end)::bigint as toxic_lost from n cross join s group by part, filter_order, step, bit)
select * exclude (bit), (sum(removed) over (partition by part, bit))::bigint as shapley from x"""
