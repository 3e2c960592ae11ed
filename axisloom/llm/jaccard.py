"""N-gram Jaccard join by PartEnum signatures.

Sets are the distinct word shingles of whole texts. Sizes are cut into bands whose ratio is
the threshold, so that similar sets lie in the same or in neighbouring bands. For each pair of
neighbouring bands the feature domain is divided into first-level parts, and each of these in
three second-level parts. Similar sets differ in so few features that some first-level part has
at most one of them, and then two of its second-level parts agree: the signatures are the
features in each choice of two second-level parts of a first-level part. Sets with too many
parts that are nearly empty enumerate single features as well, which among themselves has the same guarantee.

Five steps keep this in bounds, none of which loses a link:

* A set can only have a partner if enough of its least features occur in another set (the
  two share the least of their common features); other sets get no signatures. The counts are
  exchanged between blocks of rows (see ``blocks``), where a feature that is frequent in a
  block is sent once.
* Equal sets have one representative.
* Signatures that no other set has go no further; they are told by such an exchange too.
* Of a signature's group each member is first held against one member only, in a few rounds
  (a quarter of the signatures and two pairs a member do for this step, as it need not be complete).
* In groups whose members are then of several components, those outside the largest component meet all
  others in bounded cells, where sketches that bound the sets' difference leave few pairs. Each member
  asks for its most alike ones, these are compared in full and components united; groups that have
  more such pairs go into the next round, with more pairs a member, until none is left.

So the members of a component are never all compared with each other. What remains quadratic is the sketches of
sets that share signatures with a large component without belonging to it, times that component (128 bytes each).

Equality of shingles is that of 64-bit hashes, that of whole sets and of rows is that of two such hashes.

Defined results: null and empty texts, and texts without words, have empty sets and link with
nothing; texts with fewer words than a shingle have their whole word sequence as one feature;
repeated rows and ids are rows of their own; the component of rows with null ids is the least
id that isn't null, if any; columns other than the id and the text, of any name, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BUCKET_BYTES, MIN_BUCKETS, buckets_for, exchange, runs
from .common import dealt, discard, saved
from .components import components
from .words import batch_rows, grams, mix, utf8, words

_U = np.uint64
#: Second-level parts of a first-level part, and how many of these may differ: signatures leave out each choice of so many.
SECOND, ALLOWED = 3, 1
#: Members of a signature's group that are at home in one cell, and members that visit a cell together.
CELL, VISITORS = 256, 4096
#: Rounds of comparing with one member of a group before the exact rest; they only save work there.
STAR_ROUNDS = 2
#: Pairs that a member may ask for in the first round of the rest; four times as many in each later one.
ASKED = 4
#: 64-bit words of a set's sketch.
SKETCH = 16


def shingle_sets(arr: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = utf8(arr)
    _, _, h, row = words(data, off, lower=True)
    cuts = np.searchsorted(row, np.arange(len(off)))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        n = hi - lo
        yield np.unique(grams(h[lo:hi], min(k, n))) if n else np.zeros(0, np.uint64)


class Bands:
    """Size bands and their numbers of first-level parts for a threshold of num / den."""

    def __init__(self, num: int = 3, den: int = 4, largest: int = 1 << 40):
        self.num, self.den, self.low, self.high, self.parts = num, den, [], [], []
        at = 1
        while at <= largest:
            top = at * den // num
            # |s| + |t| - 2 |s & t| <= (|s| + |t|) (den - num) / (den + num), |t| <= |s| den / num
            differ = (top + top * den // num) * (den - num) // (den + num)
            self.low.append(at)
            self.high.append(top)
            # a quarter more than the pigeonhole asks for, as some parts are too empty to sign
            self.parts.append((differ // (ALLOWED + 1) + 1) * 5 // 4 + 1)
            at = top + 1

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, side="right")) - 1


def signatures(h: np.ndarray, bands: Bands) -> list[np.ndarray]:
    """The signatures of a set under its own band and the one below.

    Similar sets differ in at most ``differ`` features, so in all first-level parts but differ // 2 in at most
    one, and there at least two of three second-level parts agree. A first-level part is good if a feature is in any
    two of its second-level parts. Of more good parts than needed the first ones are left out: all sets leave them out in
    one order, so the last part in which a pair agrees remains. Where a set has too few good parts, its single features
    are signatures as well, the least of them left out likewise.
    """
    out = []
    n, own = len(h), bands.of(len(h))
    for band in (own, own - 1):
        if band < 0:
            continue
        tag = mix(np.array([band + 1], np.uint64))[0]
        parts = bands.parts[band]
        m = mix(h ^ tag)
        part = ((m >> _U(32)) * _U(parts) >> _U(32)) * _U(SECOND) + (m & _U(0xFFFFFFFF)) % _U(SECOND)
        order = np.argsort(part, kind="stable")
        cut = runs(part[order])
        at = part[order][cut[:-1]].astype(np.int64)
        sums, filled = np.zeros(parts * SECOND, np.uint64), np.zeros(parts * SECOND, bool)
        sums[at] = mix(np.add.reduceat(mix(m[order]), cut[:-1]) + mix(at.astype(np.uint64) + tag))
        filled[at] = True
        sums, filled = sums.reshape(parts, SECOND), filled.reshape(parts, SECOND)
        signed = filled.sum(1, keepdims=True) - filled > 0  # by the second-level part left out
        sig = mix(sums.sum(1, keepdims=True) - sums + mix(np.arange(1, parts * SECOND + 1, dtype=np.uint64).reshape(parts, SECOND) ^ tag))
        good = np.flatnonzero(signed.all(1))
        most = n * bands.den // bands.num if band == own else min(n, bands.high[band])
        differ = (n + most) * (bands.den - bands.num) // (bands.den + bands.num)
        spare = len(good) - differ // (ALLOWED + 1) - 1
        signed[good[: max(0, spare)]] = False
        out.append(sig[signed])
        if spare < 0:
            out.append(np.sort(mix(m + _U(1)))[max(0, n - 1 - differ) :])
    return out


def sketch(h: np.ndarray) -> np.ndarray:
    """Parity of the features in each of 1024 cells. Two sketches differ in at most as many bits as the sets differ in features."""
    odd = np.bincount((mix(h + _U(0x2545F491)) >> _U(54)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _candidates(df: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(k1, k2, doc_id, n, sa, sb, maybe): size and 128-bit hash of each set, and whether it can have a partner."""
    buckets = buckets_for(df)

    def slack(n: np.ndarray) -> np.ndarray:
        return np.maximum(1, n // 8)

    def need(n: np.ndarray) -> np.ndarray:
        return -(-n * num // den)

    def pack(batch: pa.RecordBatch, _: int) -> tuple[bytes, list]:
        count, sa, sb, least, owner = [], [], [], [], []
        for part in batch_rows(batch, 2 << 20):
            for h in shingle_sets(part.column("text"), k):
                n = len(h)
                i = len(count)
                count.append(n)
                sa.append(mix(h).sum(dtype=np.uint64) if n else 0)
                sb.append(mix(h + _U(0x51ED270B)).sum(dtype=np.uint64) if n else 0)
                if n:
                    first = h[: n - int(need(np.int64(n))) + int(slack(np.int64(n)))]
                    least.append(first)
                    owner.append(np.full(len(first), i, np.int64))
        n = np.array(count, np.int64)
        base = np.zeros(len(n), np.int64)
        rows = []
        if least:
            h, own = np.concatenate(least), np.concatenate(owner)
            order = np.argsort(h, kind="stable")
            h, own = h[order], own[order]
            cut = runs(h)
            size = np.diff(cut)
            multi = np.repeat(size > 1, size)
            base = np.bincount(own[multi], minlength=len(n))
            h, own = h[cut[:-1]], np.where(size > 1, 0xFFFF, own[cut[:-1]])
            bucket = (mix(h) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, h, own = bucket[order], (h[order] >> _U(24)).astype(np.uint32), own[order].astype(np.uint16)
            at = runs(bucket)
            rows = [(int(bucket[lo]), h[lo:hi].tobytes(), own[lo:hi].tobytes()) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
        ids = batch.column("doc_id")
        wanted = slack(need(n))
        kept = np.concatenate([batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), n, base - wanted, np.array(sa, np.uint64).view(np.int64), np.array(sb, np.uint64).view(np.int64)])
        return kept.astype(np.int64).tobytes(), rows

    def reduce(rows: list, _: dict) -> list:
        h = np.concatenate([np.frombuffer(a, np.uint32) for _, _, a, _ in rows])
        own = np.concatenate([np.frombuffer(b, np.uint16) for _, _, _, b in rows])
        of = np.repeat(np.arange(len(rows)), [len(a) // 4 for _, _, a, _ in rows])
        order = np.argsort(h, kind="stable")
        size = np.diff(runs(h[order]))
        shared = order[np.repeat(size > 1, size)]
        shared = np.sort(shared[own[shared] != 0xFFFF])
        out = []
        cut = runs(of[shared])
        for lo, hi in zip(cut[:-1], cut[1:]):
            at = own[shared[lo:hi]].astype(np.int64)
            out.append((*rows[of[shared[lo]]][:2], at, np.ones(len(at), np.int64)))
        return out

    def finish(kept: bytes, total: np.ndarray) -> pa.RecordBatch:
        k1, k2, ids, null, n, missing, sa, sb = np.frombuffer(kept, np.int64).reshape(8, -1)
        return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(ids, mask=null > 0), pa.array(n), pa.array(sa), pa.array(sb), pa.array((n > 0) & (missing + total >= 0))], names=["k1", "k2", "doc_id", "n", "sa", "sb", "maybe"])

    return exchange(df, pack, reduce, finish, "k1 long, k2 long, doc_id long, n long, sa long, sb long, maybe boolean")


def _sets(df: DataFrame, k: int) -> DataFrame:
    """(sid, n, h, bits): each set with its sketch."""
    kinds = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("h", pa.binary()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_rows(batch, 2 << 20):
                made = list(shingle_sets(part.column("text"), k))
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array([len(h) for h in made], pa.int64()), pa.array([h.tobytes() for h in made], pa.binary()), pa.array([sketch(h).tobytes() for h in made], pa.binary())], schema=kinds)

    return df.select("rep", "text").mapInArrow(run, "sid long, n long, h binary, bits binary")


def _shared(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(sig, sid) of every signature that several sets have.

    Blocks of sets send their signatures, packed, to the bucket of each. One that several sets of a block have goes to its
    bucket once, without an owner, and its owners are known to share it; so a bucket gets no more than one entry a block of any signature.
    """
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-total * 16 // BUCKET_BYTES))
    kinds = pa.schema([("bucket", pa.int64()), ("sig", pa.binary()), ("sid", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        held: list[tuple[np.ndarray, int]] = []
        size = 0

        def block() -> pa.RecordBatch:
            sig = np.concatenate([x for x, _ in held])
            sid = np.repeat(np.array([i for _, i in held], np.int64), [len(x) for x, _ in held])
            order = np.argsort(sig, kind="stable")
            sig, sid = sig[order], sid[order]
            cut = runs(sig)
            many = np.diff(cut) > 1
            own = np.repeat(many, np.diff(cut))
            rows = [(-1 - int(sid[0]), sig[own].tobytes(), sid[own].tobytes())] if own.any() else []
            sig, sid = sig[cut[:-1]], np.where(many, -1, sid[cut[:-1]])
            bucket = (mix(sig) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sig, sid, bucket = sig[order], sid[order], bucket[order]
            at = runs(bucket)
            rows += [(int(bucket[lo]), sig[lo:hi].tobytes(), sid[lo:hi].tobytes()) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)

        for batch in batches:
            for sid, h in zip(batch.column("sid").to_pylist(), batch.column("h")):
                made = np.unique(np.concatenate(signatures(np.frombuffer(h.as_buffer(), np.uint64), bands)))
                held.append((made, sid))
                size += 16 * len(made)
                if size > 24 << 20:
                    yield block()
                    held, size = [], 0
        if size:
            yield block()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def rows(sig: np.ndarray, sid: np.ndarray) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(sig), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(sig[lo : lo + 100_000].view(np.int64)), pa.array(sid[lo : lo + 100_000])], names=["sig", "sid"])

        def bucket() -> Iterator[pa.RecordBatch]:
            sig, sid = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in ((0, np.uint64), (1, np.int64)))
            order = np.argsort(sig, kind="stable")
            sig, sid = sig[order], sid[order]
            size = np.diff(runs(sig))
            keep = np.repeat(size > 1, size) & (sid >= 0)
            return rows(sig[keep], sid[keep])

        for batch in batches:
            for at, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if at < 0:
                    yield from rows(np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64))
                    continue
                if at != now:
                    if held:
                        yield from bucket()
                    now, held = at, []
                held.append((a, b))
        if held:
            yield from bucket()

    packed = sets.select("sid", "h").mapInArrow(pack, "bucket long, sig binary, sid binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "sig long, sid long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int, per_copy: int = 500) -> DataFrame:
    """Of pairs (u, v), those that are similar. A set with many partners is copied, so that its pairs are dealt to several tasks."""
    sizes = sets.select("sid", "n", "h")
    often = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / per_copy).cast("int").alias("copies"))
    left = sizes.join(dealt(often), sizes.sid == often.u).select("u", "copies", F.col("n").alias("nu"), F.col("h").alias("hu"))
    left = left.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    spread = pairs.join(dealt(often), "u").withColumn("copy", F.pmod(F.xxhash64("v"), F.col("copies")).cast("int")).select("u", "v", "copy")
    right = sizes.join(spread.hint("merge"), spread.v == sizes.sid).select("u", "copy", "v", F.col("n").alias("nv"), F.col("h").alias("hv"))
    both = right.join(left.drop("copies").hint("merge"), ["u", "copy"]).where(F.least("nu", "nv") * den >= F.greatest("nu", "nv") * num)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("hu"), batch.column("hv")):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = overlap(x, y)
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "hu", "hv").mapInArrow(run, "u long, v long")


def _named(signed: DataFrame, comps: DataFrame | None) -> DataFrame:
    """(sig, sid, c): with the component so far."""
    if comps is None:
        return signed.select("sig", "sid", F.col("sid").alias("c"))
    return signed.join(dealt(comps.withColumnRenamed("node", "sid")), "sid", "left").select("sig", "sid", F.coalesce("component", "sid").alias("c"))


def _mixed(named: DataFrame) -> DataFrame:
    """The rows of signatures whose members are of several components."""
    groups = named.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    return named.join(dealt(groups.where("lo < hi").select("sig")), "sig", "left_semi")


def _stars(named: DataFrame, seed: int, most: int = 2) -> DataFrame:
    """(u, v): members of a signature's group and the group's first member in an order drawn by ``seed``, if not
    connected yet; of each member the ``most`` pairs that stand in the most groups."""
    first = F.min(F.struct(F.xxhash64("c", F.lit(seed)).alias("r"), "c", "sid"))
    center = named.groupBy("sig").agg(first.alias("first"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("sig", F.col("first.sid").alias("u"), F.col("first.c").alias("cu"))
    pairs = named.join(dealt(center), "sig").where("c <> cu").groupBy("u", F.col("sid").alias("v")).agg(F.count(F.lit(1)).alias("groups"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("groups")).alias("g"), "u"))), 1, most)
    return pairs.groupBy("v").agg(best.alias("best")).select(F.explode("best.u").alias("u"), "v")


def asked_pairs(sid: np.ndarray, c: np.ndarray, n: np.ndarray, bits: np.ndarray, home: np.ndarray, minor: np.ndarray, asked: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(u, v, whole) of a cell: its members at home against all minor ones there.

    Pairs of different components that may be similar by their sizes and sketches; of each minor member the ``asked``
    most alike. whole: none was left out.
    """
    rows, cols = np.flatnonzero(minor), np.flatnonzero(home)
    found, whole = [], True
    for lo in range(0, len(rows), 256):
        at = rows[lo : lo + 256]
        a, b = n[at][:, None], n[cols][None, :]
        apart = np.zeros((len(at), len(cols)), np.int64)
        for w in range(bits.shape[1]):
            apart += np.bitwise_count(bits[at, w][:, None] ^ bits[cols, w][None, :])
        room = (a + b) * (den - num) - apart * (den + num)
        may = (c[at][:, None] != c[cols][None, :]) & (np.minimum(a, b) * den >= np.maximum(a, b) * num) & (room >= 0)
        i, j = np.nonzero(may)
        count = np.bincount(i, minlength=len(at))
        if count.max(initial=0) > asked:
            whole = False
            order = np.lexsort((sid[cols[j]], -(room[i, j] / (n[at[i]] + n[cols[j]])), i))
            i, j = i[order], j[order]
            nth = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            i, j = i[nth < asked], j[nth < asked]
        found.append(np.stack([sid[at[i]], sid[cols[j]]]))
    u, v = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return np.minimum(u, v), np.maximum(u, v), whole


def _cells(rows: DataFrame, sets: DataFrame, asked: int, num: int, den: int) -> DataFrame:
    """rows (sig, sid, c) of mixed groups. (sig, u, v): pairs to compare; (sig, null, null) of groups that have more.

    A group's members are dealt to cells. Those outside its largest component, which every open pair has one of, visit the
    other cells, at most VISITORS at a time. So a cell is bounded, and the members of the largest component never meet.
    """
    by = rows.groupBy("sig", "c").agg(F.count(F.lit(1)).alias("k"))
    groups = by.groupBy("sig").agg(F.sum("k").alias("m"), F.max(F.struct("k", "c")).alias("main")).select("sig", "m", F.col("main.c").alias("main"), (F.col("m") - F.col("main.k")).alias("minors"))
    rows = rows.join(dealt(groups), "sig").select("sig", "sid", "c", (F.col("c") != F.col("main")).alias("minor"), F.ceil(F.col("m") / CELL).cast("int").alias("cells"), F.ceil(F.col("minors") / VISITORS).cast("int").alias("lots"))
    rows = rows.withColumns({"cell": F.pmod(F.xxhash64("sid"), F.col("cells")).cast("int"), "lot": F.pmod(F.xxhash64("sid", F.lit(1)), F.col("lots")).cast("int")})
    home = rows.withColumns({"lot": F.explode(F.sequence(F.lit(0), F.col("lots") - 1)), "home": F.lit(True)})
    visits = rows.where("minor and cells > 1").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).where("to <> cell").withColumns({"cell": F.col("to"), "home": F.lit(False)})
    both = home.unionByName(visits.drop("to")).select("sig", "cell", "lot", "sid", "c", "minor", "home")
    both = both.join(dealt(sets.select("sid", "n", "bits")), "sid")
    kinds = pa.schema([("sig", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def work(t: pa.Table) -> pa.RecordBatch:
        sig, cell, lot, sid, c, n = (t.column(x).to_numpy() for x in ("sig", "cell", "lot", "sid", "c", "n"))
        minor, home = (t.column(x).to_numpy() for x in ("minor", "home"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(sig), SKETCH)
        cut = np.flatnonzero((sig[1:] != sig[:-1]) | (cell[1:] != cell[:-1]) | (lot[1:] != lot[:-1])) + 1
        cut = np.concatenate([[0], cut, [len(sig)]])
        size = np.diff(cut)
        out = []
        # groups of two are compared all at once
        i = cut[:-1][size == 2]
        j = i + 1
        apart = np.bitwise_count(bits[i] ^ bits[j]).astype(np.int64).sum(1)
        may = (c[i] != c[j]) & (home[i] | home[j]) & (minor[i] | minor[j]) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num) & (apart * (den + num) <= (n[i] + n[j]) * (den - num))
        out.append((sig[i[may]], np.minimum(sid[i[may]], sid[j[may]]), np.maximum(sid[i[may]], sid[j[may]]), np.ones(int(may.sum()), bool)))
        for lo, hi in zip(cut[:-1][size > 2].tolist(), cut[1:][size > 2].tolist()):
            u, v, whole = asked_pairs(*(x[lo:hi] for x in (sid, c, n, bits, home, minor)), asked, num, den)
            out.append((np.full(len(u), sig[lo]), u, v, np.ones(len(u), bool)))
            if not whole:
                out.append((sig[lo : lo + 1], np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, bool)))
        sig, u, v, real = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(u, mask=~real), pa.array(v, mask=~real)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= 4 * (CELL + VISITORS):
                t = pa.Table.from_batches(held)
                key = np.stack([t.column(x).to_numpy() for x in ("sig", "cell", "lot")])
                last = np.flatnonzero((key != key[:, -1:]).any(0))
                stop = int(last[-1]) + 1 if len(last) else 0  # where the last cell begins
                if stop:
                    yield work(t.slice(0, stop))
                held = t.slice(stop).to_batches()
                rows -= stop
        if rows:
            yield work(pa.Table.from_batches(held))

    cells = both.repartition("sig", "cell", "lot").sortWithinPartitions("sig", "cell", "lot")
    return cells.mapInArrow(run, "sig long, u long, v long")


def _linked(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) of all sets with a link."""
    shared, comps = saved(_shared(sets, num, den), "signatures"), None

    def join(pairs: DataFrame) -> None:
        nonlocal comps
        pairs = saved(pairs, "pairs")
        links = saved(_verified(pairs, sets, num, den), "links")
        edges = links if comps is None else links.unionByName(comps.select(F.col("node").alias("u"), F.col("component").alias("v")))
        was, comps = comps, components(edges)
        discard(pairs, links, was)

    for seed in range(STAR_ROUNDS):
        join(_stars(_named(shared.where(F.pmod("sig", F.lit(4)) == seed), comps), seed))
    open_ = saved(_mixed(_named(shared, comps)).select("sig", "sid"), "mixed")
    discard(shared)
    asked = ASKED
    while True:
        out = saved(_cells(_mixed(_named(open_, comps)), sets, asked, num, den), "asked")
        join(out.where("u is not null").select("u", "v").distinct())
        more = out.where("u is null").select("sig").distinct()
        if more.isEmpty():
            discard(out, open_)
            return comps
        was, open_ = open_, saved(open_.join(dealt(more), "sig", "left_semi"), "mixed")
        discard(out, was)
        asked *= 4


def jaccard_join(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; linked if Jaccard >= num / den.

    Also k1, k2, a 128-bit key of the row's id and text (see ``row_keys``), and stays: true for the row of its component with
    the least id (null ids last) and those that repeat it, and for rows with an empty set.
    """
    docs = row_keys(df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    info = saved(_candidates(docs, k, num, den), "info")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "k1", "k2")).alias("first")
    reps = info.where("maybe").groupBy("sa", "sb", "n").agg(first)
    reps = saved(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    chosen = reps.select(F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), "rep")
    sets = saved(_sets(docs.select("k1", "k2", "text").join(dealt(chosen), ["k1", "k2"]), k), "shingles")
    if not sets.groupBy("sid").count().where("count > 1").isEmpty():  # rows that repeat with their id
        was, sets = sets, saved(sets.dropDuplicates(["sid"]), "shingles")
        discard(was)
    comps = _linked(sets, num, den)
    discard(sets)
    # A component is named by its least id; rows of equal sets share their representative.
    nodes = saved(reps.join(dealt(comps.withColumnRenamed("node", "rep")), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component", "rep"), "nodes")
    least = saved(nodes.groupBy("c").agg(F.min("first").alias("least")), "least")
    discard(comps, reps)
    named = saved(nodes.join(dealt(least), "c").select("sa", "sb", "n", "least"), "named")
    discard(nodes, least)
    maybe = info.where("maybe").join(dealt(named), ["sa", "sb", "n"])
    maybe = maybe.select("doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), "k1", "k2", ((F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2"))).alias("stays"))
    alone = info.where("not maybe").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "k1", "k2", F.lit(True).alias("stays"))
    return maybe.unionByName(alone)


def row_keys(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with k1 and k2, two 64-bit hashes of its id and whole text."""
    return df.withColumns({"k1": F.xxhash64(doc_id, text), "k2": F.xxhash64(F.lit(1), text, doc_id)})
