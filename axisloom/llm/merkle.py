"""Merkle manifest of a table: a tree of SHA-256 digests for each language, one tree over these, and a proof for every row.

Leaves are digests of rows, made by expressions. A tree is climbed by supersteps over RDDs of keyed messages: a vertex stands for
``1 << STEPS`` neighbouring nodes of its level; children send it their digests, and once all it expects are there it hashes them pairwise,
``STEPS`` levels up, and sends what remains to its own parent. In reverse supersteps each vertex tells its children the siblings on
their way to the root, below which it appends its own, until every leaf has its whole path and is checked against the root.
A path takes part in messages once for each vertex of leaves, not for each leaf.

Positions of leaves come from a range exchange and the counts of its partitions. Rows that are equal in all of the tree's fields are apart by
a number of their own, so that a repeated row does not end up in one partition. No vertex has over ``1 << STEPS`` children, whatever the
languages' sizes, and languages are themselves leaves of a tree that is climbed alike. Vertices are written to the shared folder at each
superstep: a lost executor costs the step at hand.

Defined results: nulls are fields like others; a null doc_id comes first in its tree and is never tampered with; rows with equal doc_id are ordered by
their leaves; a tree of one leaf is that leaf; a row without any sibling has the digest of nothing as its proof. An n_chars that is null
can't be tampered with: the row verifies. Empty tables give no rows. Columns besides the five fields are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, saved

#: Levels that a vertex hashes at a time.
STEPS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_VERTEX = "tree long, at long, total long, nodes array<binary>"


def digest(values: list[Column]) -> Column:
    """SHA-256 of the values one after another, each with its length in bytes, null as a dash."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def numbered(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with ``pos`` (from 0, in that order within a group, nulls first) and ``total`` (rows of the group); the order should be total."""
    a = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    a = saved(a.withColumns({"_p": F.spark_partition_id(), "_o": F.monotonically_increasing_id()}), "ordered")
    runs = a.groupBy("_p", *group).agg(F.count("*").alias("_c"), F.min("_o").alias("_first"))
    own = Window.partitionBy(*group)  # of one group no more runs than partitions
    runs = runs.withColumns({"_before": F.sum("_c").over(own.orderBy("_p")) - F.col("_c"), "total": F.sum("_c").over(own)})
    runs = runs.select(F.col("_p").alias("_q"), *(F.col(c).alias(f"_g_{c}") for c in group), "_first", "_before", "total")
    on = F.col("_p") == F.col("_q")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    out = a.join(runs, on).withColumn("pos", F.col("_o") - F.col("_first") + F.col("_before")).select(*df.columns, "pos", "total")
    out._source = a
    return out


def _h(*nodes: bytes) -> bytes:
    return sha256("".join(n.hex() for n in nodes).encode()).digest()


def levels(nodes: list[bytes], total: int) -> list[list[bytes]]:
    """The levels above a vertex's nodes, themselves included; total: nodes of their level in the whole tree."""
    out = [nodes]
    while total > 1 and len(out) <= STEPS:
        nodes = [_h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
        total = (total + 1) // 2
    return out


def siblings(made: list[list[bytes]], i: int) -> list[tuple[int, bytes]]:
    """(1 left, 2 right or 0 none, sibling) at each level above node i; in whole paths 3 marks the tree's own root."""
    out = []
    for k, nodes in enumerate(made[:-1]):
        j = (i >> k) ^ 1
        out.append((0, b"") if j >= len(nodes) else (1 if j < i >> k else 2, bytes(nodes[j])))
    return out


def fold(leaf: bytes, path: Iterable[tuple[int, bytes]]) -> bytes:
    for side, other in path:
        if side == 3:
            continue
        leaf = _h(leaf) if side == 0 else _h(other, leaf) if side == 1 else _h(leaf, other)
    return leaf


def _pack(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + other for side, other in path)


def _unpack(path: bytes) -> Iterator[tuple[int, bytes]]:
    i = 0
    while i < len(path):
        n = 32 if path[i] else 0
        yield path[i], path[i + 1 : i + 1 + n]
        i += 1 + n


def _above(total: int) -> int:
    """Nodes STEPS levels up."""
    return -(-total >> STEPS) if total > 1 else 1


class Forest:
    """Trees of any number and size over (tree, position, total, digest)."""

    def __init__(self, spark: SparkSession, leaves: RDD, largest: int, extra: str = ""):
        """leaves: ((tree, pos), (total, digest, *extra)); extra: further array columns of the vertices of leaves."""
        self.spark, self.parts = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[DataFrame] = []
        messages = leaves.map(lambda x: ((x[0][0], x[0][1] >> STEPS), (x[0][1], *x[1])))
        while True:
            self.levels.append(saved(spark.createDataFrame(messages.groupByKey(self.parts).map(_gathered), _VERTEX + extra, verifySchema=False), "vertices"))
            if largest <= 1 << STEPS:
                break
            messages, extra, largest = self.levels[-1].rdd.flatMap(_upward), "", _above(largest)

    def roots(self) -> RDD:
        """(tree, root)."""
        return self.spark.sparkContext.union([v.rdd.filter(_is_top).map(lambda v: (v["tree"], levels(v["nodes"], v["total"])[-1][0])) for v in self.levels])

    def paths(self, start: RDD) -> RDD:
        """((tree, at), (vertex of leaves, packed path above it)); start: (tree, packed path above the tree)."""
        start = start.map(lambda x: ((x[0], 0), x[1]))
        heard = None
        for k in range(len(self.levels) - 1, -1, -1):
            vertices = self.levels[k].rdd.map(lambda v: ((v["tree"], v["at"]), v))
            tops = vertices.filter(lambda x: _is_top(x[1])).join(start, self.parts)
            own = tops if heard is None else tops.union(vertices.filter(lambda x: not _is_top(x[1])).join(heard, self.parts))
            if k:
                told = saved(self.spark.createDataFrame(own.flatMap(_downward), "tree long, at long, path binary", verifySchema=False), "paths")
                heard = told.rdd.map(lambda r: ((r["tree"], r["at"]), bytes(r["path"])))
        return own


def _gathered(x: tuple) -> tuple:
    """A completed vertex from its children's messages."""
    (tree, at), got = x
    got = sorted(got, key=lambda m: m[0])
    total = got[0][1]
    if len(got) != min(1 << STEPS, total - (at << STEPS)):
        raise RuntimeError(f"vertex {at} of tree {tree} has heard of {len(got)} children")
    return (tree, at, total, *([m[k] for m in got] for k in range(2, len(got[0]))))


def _is_top(v) -> bool:
    return v["total"] <= 1 << STEPS


def _upward(v) -> list:
    return [] if _is_top(v) else [((v["tree"], v["at"] >> STEPS), (v["at"], _above(v["total"]), bytes(levels(v["nodes"], v["total"])[-1][0])))]


def _downward(x: tuple) -> Iterator[tuple]:
    (tree, at), (v, path) = x
    made = levels(v["nodes"], v["total"])
    for i in range(len(v["nodes"])):
        yield tree, (at << STEPS) + i, _pack(siblings(made, i)) + path


def manifest(df: DataFrame, every: int = 7) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified); rows whose id's CRC-32 ``every`` divides are verified as if n_chars were one more."""
    spark = df.sparkSession
    field = [F.col(c) for c in FIELDS]
    more = [F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    leaf, other = F.unhex(digest(field)), F.unhex(digest(more))
    chosen = F.col("doc_id").isNotNull() & F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % every == 0)
    rows = saved(df.select("doc_id", "lang", leaf.alias("leaf"), F.when(chosen, other).alias("other"), F.monotonically_increasing_id().alias("own")), "leaves")
    kind = rows.schema["doc_id"].dataType.simpleString()
    placed = numbered(rows, ["lang"], ["doc_id", "leaf", "own"])
    trees = numbered(rows.groupBy("lang").agg(F.count("*").alias("n")), [], ["lang"])
    trees = saved(trees.select(F.col("lang").alias("_lang"), F.col("pos").alias("tree"), "n", F.col("total").alias("trees")), "trees")
    size = trees.agg(F.max("n"), F.max("trees")).first()
    if size[0] is None:
        return spark.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    placed = placed.join(trees.select("_lang", "tree"), F.col("lang").eqNullSafe(F.col("_lang"))).select("tree", "pos", "total", "leaf", "doc_id", "other")
    leaves = placed.rdd.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]), r[4], r[5])))
    lower = Forest(spark, leaves, size[0], f", ids array<{kind}>, others array<binary>")
    n_trees = size[1]
    upper = Forest(spark, lower.roots().map(lambda x: ((0, x[0]), (n_trees, bytes(x[1])))), n_trees)
    root = bytes(upper.roots().first()[1])
    above = upper.paths(spark.sparkContext.parallelize([(0, b"")], 1)).flatMap(_downward)
    told = saved(spark.createDataFrame(above, "tree long, at long, path binary", verifySchema=False), "paths").rdd.map(lambda r: (r["at"], bytes(r["path"])))
    start = told.join(lower.roots(), lower.parts).map(lambda x: (x[0], _pack([(3, bytes(x[1][1]))]) + x[1][0]))
    out = lower.paths(start).flatMap(lambda x: _proofs(*x[1], root))
    done = spark.createDataFrame(out, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", verifySchema=False)
    discard(rows, *lower.levels[1:], *upper.levels)
    return done


def _proofs(v, above: bytes, root: bytes) -> Iterator[tuple]:
    """The rows of a vertex of leaves: each leaf, or what it was tampered into, is folded along its own path."""
    above = list(_unpack(above))
    subroot = next(d for side, d in above if side == 3).hex()
    made = levels([bytes(n) for n in v["nodes"]], v["total"])
    for i, (leaf, own, other) in enumerate(zip(made[0], v["ids"], v["others"])):
        path = siblings(made, i) + above
        top = fold(leaf if other is None else bytes(other), path)
        yield own, leaf.hex(), subroot, root.hex(), _h(*(d for side, d in path if side in (1, 2))).hex(), top.hex(), top == root


_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
#: CRC-32 (reflected, polynomial 0xEDB88320) of the digits of doc_id: each byte goes in before the first of eight shifts.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
ORACLE = f"""with recursive d as (select row_number() over () as r, *, {_LEAF} as leaf, {_LEAF.replace("n_chars", "(n_chars + 1)")} as other, {_CRC} as crc from documents),
l as (select r, doc_id, lang, leaf, case when n_chars is not null and doc_id is not null and crc % 7 = 0 then other else leaf end as given, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from d),
up(lang, k, nodes) as (select lang, 0, list(leaf order by pos) from l group by lang union all
  select lang, k + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) from up where len(nodes) > 1),
sub as (select lang, nodes[1] as subroot, row_number() over (order by lang nulls first) - 1 as t from up where len(nodes) = 1),
top(k, nodes) as (select 0, list(subroot order by t) from sub union all select k + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) from top where len(nodes) > 1),
s as (select r, 0 as tree, k, pos >> k as j, nodes from l join up on l.lang is not distinct from up.lang where len(nodes) > 1 union all select r, 1, k, t >> k, nodes from l join sub on l.lang is not distinct from sub.lang cross join top where len(nodes) > 1),
p as (select r, list(case when j % 2 = 1 then 'L' || nodes[j] when j + 2 <= len(nodes) then 'R' || nodes[j + 2] else 'N' end order by tree, k) as path from s group by r)
select doc_id, leaf, subroot, nodes[1] as root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x[2:]), ''), '')) as proof_sha256,
  list_reduce(list_prepend(given, coalesce(path, [])), lambda a, x: case x[1] when 'L' then sha256(x[2:] || a) when 'R' then sha256(a || x[2:]) else sha256(a) end) as folded_root, folded_root = root as verified
from l join sub on l.lang is not distinct from sub.lang left join p using (r) cross join (select nodes from top where len(nodes) = 1)"""
