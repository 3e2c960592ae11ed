"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors of a label and length have one representative. Representatives are dealt into overlapping
shards, those of the nearest pivots of their kind (label and length); in each shard a flat graph is built by robust pruning,
and the adjacency lists that a vector has in its shards are united. Each vector is then
searched for in the shard of its nearest pivot, to which its neighbours from all of its shards are added, so that a link is met wherever
its two vectors share a shard: a greedy search from the vector's own place in the graph, whose
beam becomes an expansion over all vectors within range (and a slack) of the query. Two vectors within range of a third
are not far from each other, so edges longer than that are never taken and are left out while pruning, which changes
no other edge; vectors without edges have no links and aren't sent on. Every
match is verified in double precision. A shard answers with a number of links for each query
and a spanning forest of the matches, never with all pairs. At last the recall of a sample of all
vectors is audited against brute force, each vector with links counting once, and logged; below
``min_recall`` overlap and beam are doubled, and after the last try brute force gives the links.

Bounds: pivots are chosen from a sample of at most ``MAX_PIVOTS`` vectors and ``PIVOT_VALUES`` components in all, ``PIVOT_SAMPLE`` for each one wanted
(fetched by Arrow, at most 64 MB; broadcast). The audit has no bound: where links are rare it goes on to all vectors, a block at a time. Kinds without one are a shard of their own, so nothing crosses kinds. Shards of more than ``SHARD_ROWS`` vectors are indexed in blocks that keep
all edges, and their queries visit each block, from its medoid where it isn't their own: past about 6.5 million vectors, and within a group of near copies, time grows with the rows of a shard.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those
without a label, link with nothing; so do vectors of unequal length; repeated rows, and rows of one id, are vectors
of their own that link with each other by their vectors alone; rows without an id link too, and a component is named by its least
id that isn't null, if any (without one, all its rows are kept); other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import logging
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, discard, saved, shared_dir, small
from .components import components

MAX_PIVOTS, PIVOT_VALUES, PIVOT_SAMPLE, SHARD_ROWS, DEGREE, POOL, ALPHA = 65_536, 1 << 23, 5, 4096, 24, 64, 1.2
_log = logging.getLogger(__name__)
#: Vectors of an audit's sample at first and at most, those with links that are enough, and components of a block that goes over all vectors.
AUDIT, AUDIT_LINKED, BLOCK_VALUES = 1024, 400, 1 << 22
#: How far below the wanted cosine an expansion goes on, and what is put down to single precision.
SLACK, EPS = 0.04, 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def pivots_of(x: np.ndarray, want: int, reach: float) -> np.ndarray:
    """``want`` of a sample of unit vectors, none in reach of an earlier one, those that stand for most of the sample first.

    So a group of near copies has one pivot, and stays in one shard.
    """
    keep = x[:1]
    for lo in range(1, len(x), 256):
        part = x[lo : lo + 256]
        part = part[(part @ keep.T).max(1) < reach]
        own = part @ part.T
        alive = np.ones(len(part), bool)
        for i in range(len(part)):
            if alive[i]:
                alive[i + 1 :] &= own[i, i + 1 :] < reach
        keep = np.concatenate([keep, part[alive]])
    stands = np.zeros(len(keep), np.int64)
    for lo in range(0, len(x), 256):
        s = x[lo : lo + 256] @ keep.T
        stands += np.bincount(s.argmax(1)[s.max(1) >= reach], minlength=len(keep))
    return keep[np.argsort(-stands, kind="stable")[:want]]


def robust_prune(x: np.ndarray, least: float, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA, seed: int = 3) -> np.ndarray:
    """Adjacency (-1 where fewer) of unit vectors: the nearest of a pool, leaving out what a chosen neighbour is closer to by ``alpha``.

    Candidates with a cosine below ``least`` are left out first; farther ones never decide over nearer ones, so all other edges stay.
    """
    m = len(x)
    out = np.full((m, degree), -1, np.int64)
    if m == 1:
        return out
    k = min(pool, m - 1)
    cosine = x @ x.T  # of SHARD_ROWS vectors or so
    np.fill_diagonal(cosine, -np.inf)
    rng = np.random.default_rng(seed)
    for lo in range(0, m, 512):
        far = rng.integers(0, m, (min(512, m - lo), 8))  # a few far ones, for long edges
        own = lo + np.flatnonzero(cosine[lo : lo + 512].max(1) >= least)
        if not len(own):
            continue
        cand = np.argpartition(cosine[own], m - k, axis=1)[:, m - k :] if k < m - 1 else np.argsort(-cosine[own], axis=1)[:, :k]
        cand = np.concatenate([cand, far[own - lo]], axis=1)
        near = cosine[own[:, None], cand]
        order = np.argsort(-near, axis=1, kind="stable")
        cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
        most = int((near >= least).sum(1).max())
        cand, near = cand[:, :most], near[:, :most]
        d = np.maximum(0, 2 - 2 * near)
        alive = (near >= least) & (cand != own[:, None])
        rows = np.arange(len(own))
        for j in range(degree):
            first = alive.argmax(1)
            some = alive[rows, first]
            if not some.any():
                break
            chosen = cand[rows, first]
            out[own[some], j] = chosen[some]
            gap = np.maximum(0, 2 - 2 * cosine[chosen[:, None], cand])
            alive &= ~((alpha * alpha * gap <= d) & some[:, None])
            alive &= cand != np.where(some, chosen, -2)[:, None]
    return out


def mutual(adjacency: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Adjacency with reverse edges."""
    m = len(adjacency)
    src = np.repeat(np.arange(m), [len(a) for a in adjacency])
    dst = np.concatenate(adjacency) if m else src
    both = np.unique(np.concatenate([src * m + dst, dst * m + src]))
    cut = np.searchsorted(both // m, np.arange(m + 1))
    lists = np.split(both % m, cut[1:-1]) if m else []
    for i in np.flatnonzero(np.diff(cut) > 2 * DEGREE):  # hubs keep their nearest, so that a step of the search stays small
        lists[i] = lists[i][np.argsort(-(x[lists[i]] @ x[i]), kind="stable")[: 2 * DEGREE]]
    near = [a if len(a) <= 4 else a[np.argsort(-(x[a] @ x[i]), kind="stable")[:4]] for i, a in enumerate(lists)]
    for i in range(m):  # and every vector stays in reach of its own nearest
        for j in near[i]:
            if i not in lists[j]:
                lists[j] = np.append(lists[j], i)
    return lists


def connected(lists: list[np.ndarray], x: np.ndarray, medoid: int) -> list[np.ndarray]:
    """Mutual adjacency with an edge to each part that the medoid doesn't reach, from its nearest reached vector."""
    seen = np.zeros(len(lists), bool)

    def flood(start: int) -> None:
        front = np.array([start])
        seen[start] = True
        while len(front):
            front = np.unique(np.concatenate([lists[i] for i in front]))
            front = front[~seen[front]]
            seen[front] = True

    flood(medoid)
    while not seen.all():
        lost = int(np.flatnonzero(~seen)[0])
        reached = np.flatnonzero(seen)
        spare = reached[[len(lists[i]) < 3 * DEGREE for i in reached]]
        at = spare if len(spare) else reached
        to = int(at[(x[at] @ x[lost]).argmax()])
        lists[to] = np.append(lists[to], lost)
        lists[lost] = np.append(lists[lost], to)
        flood(lost)
    return lists


def range_search(x: np.ndarray, lists: list[np.ndarray], start: np.ndarray, queries: np.ndarray, reach: float, slack: float = SLACK, beam: int = 24) -> Iterator[tuple[int, np.ndarray]]:
    """(query, index vectors with a cosine of at least ``reach`` - EPS) for all queries that have some, each searched for from its start."""
    width = max(len(a) for a in lists)
    table = np.full((len(lists), max(1, width)), -1, np.int64)
    for i, a in enumerate(lists):
        table[i, : len(a)] = a
    for lo in range(0, len(queries), 256):
        q = queries[lo : lo + 256]
        rows = np.arange(len(q))
        ids = np.full((len(q), beam), -1, np.int64)
        score = np.full((len(q), beam), -np.inf, x.dtype)
        open_ = np.zeros((len(q), beam), bool)
        ids[:, 0], open_[:, 0] = start[lo : lo + 256], True
        score[:, 0] = np.einsum("qd,qd->q", q, x[ids[:, 0]])
        while True:
            active = np.flatnonzero(open_.any(1))
            if not len(active):
                break
            best = np.where(open_[active], score[active], -np.inf).argmax(1)
            node = ids[active, best]
            open_[active, best] = False
            near = table[node]
            near = near[:, : max(1, int((near >= 0).sum(1).max()))]
            s = np.einsum("qkd,qd->qk", x[near], q[active])
            s[(near < 0) | (near[:, :, None] == ids[active][:, None, :]).any(2)] = -np.inf
            every = np.concatenate([score[active], s], 1)
            top = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            score[active] = np.take_along_axis(every, top, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], near], 1), top, 1)
            open_[active] = np.take_along_axis(np.concatenate([open_[active], np.isfinite(s)], 1), top, 1)
        for i in rows[(score >= reach - slack).any(1)]:
            front = ids[i][score[i] >= reach - slack]
            seen = np.zeros(len(x) + 1, bool)  # the last one stands for no neighbour
            seen[front] = seen[-1] = True
            found = [front]
            while len(front):
                last, rest = np.zeros(len(seen), bool), np.flatnonzero(~seen)
                if len(front) <= len(rest):
                    last[table[front]] = True
                    front = np.flatnonzero(last & ~seen)
                else:  # in a group of near copies few are left, which look for a neighbour among the last ones
                    last[front] = True
                    front = rest[last[table[rest]].any(1)]
                front = front[x[front] @ q[i] >= reach - slack]
                seen[front] = True
                found.append(front)
            hits = np.concatenate(found)
            hits = hits[x[hits] @ q[i] >= reach - EPS]
            if len(hits):
                yield lo + int(i), hits


def forest(n: int, pairs: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    """The root of each of n nodes under the pairs (node, others)."""
    up = np.arange(n)

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    for i, others in pairs:
        for j in {find(int(o)) for o in np.unique(up[others])}:
            a, b = find(i), j
            if a != b:
                up[max(a, b)] = min(a, b)
    while (up != up[up]).any():
        up = up[up]
    return up


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors of one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _kinds(column: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """(kind, its rows) of a column of kinds."""
    made = column.dictionary_encode()
    code = made.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    for name, own in zip(made.dictionary.to_pylist(), np.split(order, np.cumsum(np.bincount(code, minlength=len(made.dictionary)))[:-1])):
        yield name, own


def _links(reps: DataFrame, reach: float, overlap: int, beam: int, shard_rows: int = 500) -> tuple[DataFrame, DataFrame]:
    """reps: rep, label, vec, copies. (rep, found): links of each representative that has some, copies counted; (u, v): a forest of the links."""
    total, widest = reps.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    most = min(MAX_PIVOTS, max(1, PIVOT_VALUES // max(1, widest or 1)))
    shrink = min(1.0, most * shard_rows / (PIVOT_SAMPLE * max(1, total)))
    # Kinds of a shard or less want no pivots; the others have a sample in proportion to their rows.
    counts = reps.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows)
    rate = PIVOT_SAMPLE * shrink / shard_rows
    draw = F.pmod(F.xxhash64("rep", "label"), F.lit(1 << 30)) < int(rate * (1 << 30)) + 1
    drawn: dict = {}
    some = reps.where(draw).join(dealt(counts), "label").orderBy(F.xxhash64("rep", "label"), "rep").limit(most).select("label", "n", "vec").toArrow()
    for batch in some.to_batches():
        for kind, own in _kinds(batch.column("label")):
            x = _vectors(batch.column("vec").take(pa.array(own))).astype(np.float32)
            drawn.setdefault((kind, batch.column("n")[int(own[0])].as_py()), []).append(x)
    pivots = {k: pivots_of(unit(np.concatenate(v)), max(1, round(n / shard_rows * shrink)), reach - 0.1) for (k, n), v in sorted(drawn.items())}
    shared = reps.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, its rows, their unit vectors, their shards by nearness)."""
        for kind, own in _kinds(batch.column("label")):
            x = unit(_vectors(batch.column("vec").take(pa.array(own)))).astype(np.float32)
            p = shared.value.get(kind)
            if p is None:
                yield kind, own, x, np.zeros((len(own), 1), np.int64)
                continue
            s, n = -(x @ p.T), min(overlap, len(p))
            near = np.argpartition(s, n - 1, axis=1)[:, :n] if n < len(p) else np.tile(np.arange(n), (len(own), 1))
            yield kind, own, x, np.take_along_axis(near, np.argsort(np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, _, _, near in nearest(batch) if batch.num_rows else ():
                shard, n = np.unique(near, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(shard)), pa.array(shard), pa.array(n)], names=["label", "shard", "n"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = list(nearest(batch))
            row = pa.array(np.concatenate([np.repeat(own, near.shape[1]) for _, own, _, near in parts]))
            home = pa.array(np.concatenate([np.repeat(near[:, 0], near.shape[1]) for *_, near in parts]))
            ends = np.cumsum(np.concatenate([[0], *(np.full(near.size, 4 * x.shape[1]) for _, _, x, near in parts)]))
            flat = np.concatenate([np.repeat(x, near.shape[1], axis=0).ravel() for _, _, x, near in parts])
            unit_vec = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])
            shard = pa.array(np.concatenate([near.ravel() for *_, near in parts]))
            yield pa.RecordBatch.from_arrays([batch.column("label").take(row), shard, home, batch.column("rep").take(row), unit_vec], names=["label", "shard", "home", "rep", "x"])

    # A large shard has several blocks of index vectors.
    sizes = reps.select("label", "vec").mapInArrow(count, "label string, shard long, n long").groupBy("label", "shard").agg(F.ceil(F.sum("n") / SHARD_ROWS).cast("int").alias("blocks"))
    sizes = saved(sizes.where("blocks > 1"), "sizes")
    placed = reps.select("label", "rep", "vec").mapInArrow(deal, "label string, shard long, home long, rep long, x binary")

    def in_blocks(df: DataFrame) -> DataFrame:
        df = df.join(sizes, ["label", "shard"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        return df.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    # What an expansion meets lies within reach - SLACK of the query, so no two such vectors are farther apart than twice that angle.
    least = 2 * (reach - SLACK) ** 2 - 1 - EPS if reach > SLACK else -2.0

    def build(key: tuple, table: pa.Table) -> pa.Table:
        rep, several = table.column("rep").to_numpy(), table.column("blocks")[0].as_py() > 1
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(len(rep), -1)
        adjacency = robust_prune(x, -2.0 if several else least)
        some = np.flatnonzero((adjacency >= 0).any(1) | several)
        near = [a[a >= 0] for a in adjacency[some]]
        close = [rep[a[x[a] @ x[i] >= reach - SLACK]] for i, a in zip(some, near)]
        out = table.select(["label", "shard", "home", "rep"]).take(pa.array(some))
        return out.append_column("near", pa.array([rep[a] for a in near], pa.list_(pa.int64()))).append_column("close", pa.array(close, pa.list_(pa.int64())))

    lists = in_blocks(placed).groupBy("label", "shard", "block").applyInArrow(build, "label string, shard long, home long, rep long, near array<bigint>, close array<bigint>")
    lists = saved(lists, "lists")
    united = lists.groupBy("rep", "label", "home").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("near", "close")))
    united = saved(united.join(reps.select("rep", "copies", "vec"), "rep"), "united")
    # Where a vector is searched for, there are its neighbours of all its shards, and those whose neighbour it is.
    homes = united.select("label", F.col("home").alias("shard"), "rep")
    pairs = united.select("label", F.col("home").alias("shard"), "rep", F.explode("close").alias("other"))
    members = lists.select("label", "shard", "rep").unionByName(homes).unionByName(pairs.select("label", "shard", F.col("other").alias("rep")))
    members = members.unionByName(pairs.select("rep", "other").join(homes.withColumnRenamed("rep", "other"), "other").select("label", "shard", "rep")).distinct()
    index = in_blocks(members).join(united.drop("label", "close"), "rep").withColumns({"home": F.col("home") == F.col("shard"), "index": F.lit(True)})
    visits = in_blocks(homes).where("blocks > 1").join(united.select("rep", "copies", "vec"), "rep")
    visits = visits.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to <> block").withColumn("block", F.col("to")).drop("to")
    visits = visits.withColumns({"near": F.array().cast("array<bigint>"), "home": F.lit(True), "index": F.lit(False)})
    both = index.unionByName(visits, allowMissingColumns=True).select("label", "shard", "block", "home", "index", "rep", "copies", "vec", "near")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("rep", "ascending"), ("index", "descending")])
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        home, index = (table.column(c).to_numpy().astype(bool) for c in ("home", "index"))
        exact = _vectors(table.column("vec"))
        norm = np.sqrt((exact * exact).sum(1))
        x = (exact / norm[:, None]).astype(np.float32)
        own = np.flatnonzero(index)
        if not len(own):
            return pa.table({k: pa.array([], pa.int64()) for k in ("rep", "found", "root")})
        near = table.column("near").to_pylist()
        at = {int(r): i for i, r in enumerate(rep[own])}
        lists = mutual([np.array([at[j] for j in near[i] if j in at], np.int64) for i in own], x[own])
        asked = np.flatnonzero(home)
        found = np.zeros(len(rep), np.int64)
        start = np.zeros(len(rep), np.int64)
        start[own] = np.arange(len(own))
        if len(own) < len(rep):
            start[~index] = medoid = int((x[own] @ x[own].mean(0)).argmax())
            lists = connected(lists, x[own], medoid)

        def pairs() -> Iterator[tuple[int, np.ndarray]]:
            for i, hits in range_search(x[own], lists, start[asked], x[asked], reach, beam=beam):
                q = asked[i]
                others = own[hits]
                others = others[rep[others] != rep[q]]
                good = others[(exact[others] @ exact[q]) / (norm[others] * norm[q]) >= reach]
                if len(good):
                    found[q] = copies[good].sum()
                    yield int(q), good

        root = forest(len(rep), pairs())
        keep = (found > 0) | (root != np.arange(len(rep)))
        return pa.table({"rep": pa.array(rep[keep]), "found": pa.array(found[keep]), "root": pa.array(rep[root[keep]])})

    answers = saved(both.groupBy("label", "shard", "block").applyInArrow(search, "rep long, found long, root long"), "answers")
    discard(sizes, lists, united)
    return _united(answers)


def _united(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    return answers.groupBy("rep").agg(F.sum("found").alias("found")).where("found > 0"), answers.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v"))


def _brute(reps: DataFrame, queries: pa.Table, reach: float) -> tuple[DataFrame, Broadcast]:
    """(rep, found, root) as a shard answers, by brute force of the queries over all vectors; and the broadcast queries."""
    asked = {}
    if queries.num_rows:
        label = queries.column("label").combine_chunks()
        for kind, own in _kinds(label):
            exact = _vectors(queries.column("vec").take(pa.array(own)))
            asked[kind] = (own, exact, norm := np.sqrt((exact * exact).sum(1)), (exact / norm[:, None]).astype(np.float32))
    shared = reps.sparkSession.sparkContext.broadcast((queries.column("rep").to_numpy(), asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, copies = batch.column("rep").to_numpy(), batch.column("copies").to_numpy()
            found = np.zeros(len(ids) + len(rep), np.int64)

            def pairs() -> Iterator[tuple[int, np.ndarray]]:
                for kind, own in _kinds(batch.column("label")):
                    if kind not in asked:
                        continue
                    of, q, q_norm, q_unit = asked[kind]
                    x = _vectors(batch.column("vec").take(pa.array(own)))
                    norm = np.sqrt((x * x).sum(1))
                    x_unit = (x / norm[:, None]).astype(np.float32).T
                    for lo in range(0, len(of), 512):
                        near = q_unit[lo : lo + 512] @ x_unit >= reach - EPS  # single precision tells what to compare in double precision
                        for i in np.flatnonzero(near.any(1)):
                            at, to = of[lo + i], np.flatnonzero(near[i])
                            to = to[((x[to] @ q[lo + i]) / (norm[to] * q_norm[lo + i]) >= reach) & (rep[own[to]] != ids[at])]
                            found[at] += copies[own[to]].sum()
                            yield int(at), len(ids) + own[to]

            root, node = forest(len(found), pairs()), np.concatenate([ids, rep])
            keep = (found > 0) | (root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(found[keep]), pa.array(node[root[keep]])], names=["rep", "found", "root"])

    return reps.select("rep", "label", "copies", "vec").mapInArrow(run, "rep long, found long, root long"), shared


def _drawn(reps: DataFrame, lo: float, hi: float) -> pa.Table:
    """The vectors whose hash lies in this part of its range."""
    top = 1 << 30
    at = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(top))
    return reps.where((at >= int(lo * top)) & (at < int(min(1.0, hi) * top))).select("rep", "label", "vec").toArrow()


def _block(reps: DataFrame) -> int:
    """Vectors of a block that goes over all vectors."""
    return max(1, BLOCK_VALUES // max(1, reps.agg(F.max(F.size("vec"))).first()[0] or 1))


def _exact(reps: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """As _links, without misses: each block of vectors goes over all vectors."""
    spark = reps.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/axisloom-exact-{uuid.uuid4().hex}"
    passes = -(-reps.count() // _block(reps))
    for p in range(passes):
        answers, shared = _brute(reps, _drawn(reps, p / passes, (p + 1) / passes), reach)
        answers.write.mode("append").parquet(path)
        shared.destroy()
    return _united(spark.read.schema(answers.schema).parquet(path))


def audit_recall(reps: DataFrame, found: DataFrame, reach: float) -> float:
    """Mean share of its links that ``found`` has, over the vectors of a sample of all vectors that have any by brute force.

    The sample grows until AUDIT_LINKED vectors with links are in it, to all vectors where links are that rare; the share is then exact.
    """
    every, at, step, shares, most = reps.count(), 0, AUDIT, [], _block(reps)
    while at < every and len(shares) < AUDIT_LINKED:
        step = min(step, most)
        truth, shared = _brute(reps, _drawn(reps, at / every, (at + step) / every), reach)
        truth = truth.groupBy("rep").agg(F.sum("found").alias("links")).where("links > 0")
        shares += [r[0] for r in truth.join(found, "rep", "left").select(F.least("links", F.coalesce("found", F.lit(0))) / F.col("links")).collect()]
        shared.destroy()
        at, step = at + step, 2 * step
    return float(np.mean(shares)) if shares else 1.0


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which vectors are usable, and those by a power of two, so that their largest component is near 1 and no norm over- or underflows;
    cosines stay as they are to the last bit. -0.0 becomes 0.0, as they are one value."""
    for batch in batches:
        vec = batch.column("vec")
        size = pc.fill_null(pc.list_value_length(vec), 0).to_numpy().astype(np.int64)
        flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null: not a number
        most = np.zeros(len(size))
        if len(flat):
            most[size > 0] = np.maximum.reduceat(np.abs(flat), (np.cumsum(size) - size)[size > 0])
        ok = np.isfinite(most) & (most > 0) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
        power = np.frexp(np.where(ok, most, 1.0))[1]
        kept = np.repeat(ok, size)
        flat = np.ldexp(flat[kept], -np.repeat(power, size)[kept]) + 0.0
        ends = np.cumsum(np.concatenate([[0], np.where(ok, size, 0)])).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(ok), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["vec_id", "label", "ok", "vec"])


def near_dedup(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", reach: float = 0.93, min_recall: float = 0.98, tries: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    df = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("vec"))
    rows = df.mapInArrow(_scaled, "vec_id long, label string, ok boolean, vec array<double>")
    # Vectors of one label and length are of a kind.
    rows = saved(rows.withColumn("label", F.when(F.col("ok"), F.concat(F.size("vec").cast("string"), F.lit(" "), "label"))), "vectors")
    lone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    copies = rows.where("ok").groupBy("label", "vec").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    copies = saved(copies.withColumn("rep", F.monotonically_increasing_id()), "copies")
    reps = copies.select("rep", "label", "vec", "copies")
    overlap, beam = 4, 24
    for _ in range(tries):
        found, edges = _links(reps, reach, overlap, beam)
        recall = audit_recall(reps, found, reach)
        _log.info("recall of links %.4f with overlap %d and beam %d", recall, overlap, beam)
        if recall >= min_recall:
            break
        overlap, beam = 2 * overlap, 2 * beam
    else:
        _log.warning("recall of links below %.4f after %d tries: brute force", min_recall, tries)
        found, edges = _exact(reps, reach)
    comps = components(edges)
    nodes = copies.drop("vec").join(found, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    nodes = saved(nodes.select("rep", "least", "copies", "c", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links")), "nodes")
    least = saved(nodes.groupBy("c").agg(F.min("least").alias("component_id")), "least")
    named = nodes.join(least, "c").select("rep", "least", "copies", "n_links", "component_id")
    # A vector without copies is its row; only the others are looked up by their components.
    out = lone.unionByName(named.where("copies = 1").select(F.col("least").alias("vec_id"), "n_links", "component_id"))
    if not small(several := copies.where("copies > 1"), 0):
        several = several.select("rep", "label", "vec").join(named.where("copies > 1").drop("least", "copies"), "rep")
        out = out.unionByName(rows.where("ok").select("vec_id", "label", "vec").join(several, ["label", "vec"]).select("vec_id", "n_links", "component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
