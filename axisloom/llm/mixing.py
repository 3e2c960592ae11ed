"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame expressions only.

A document's key is an exponential variate divided by its quality weight; within a source,
documents in key order fill what the complete epochs leave of the source's token target.
The order is never sorted as a whole: sums over ranges of keys find the one range in which
a source's budget ends, and only that range is sorted. What remains is one cut-off per
source, which each row is compared with.

Defined results: a null source is a source of its own, last in order; null sizes count 0;
repeated rows (same id, size and weight) share a cut equally, rounded down; null ids have
equal variates; an empty table gives an empty result. The cut document gives only the
words that its source's target still has room for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, returned, saved, small

#: Ranges of keys hold about so many rows; a source has at most MAX_RANGES of them.
RANGE_ROWS, MAX_RANGES = 256, 100_000
#: Cut-offs of at most so many sources (under 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) from the id: the same in every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def lexical_weight(words: Column) -> Column:
    """Quality weight of a text: 0.1 plus the share of distinct words."""
    n = F.size(words)
    return F.when(n > 0, F.lit(0.1) + F.size(F.array_distinct(words)) / n).otherwise(F.lit(0.1))


def with_keys(df: DataFrame, doc_id: str, size: str, weight: str, seed: str) -> DataFrame:
    u = uniform(F.col(doc_id), seed)
    return df.withColumns({"_size": F.coalesce(F.col(size), F.lit(0)).cast("long"), "_key": -F.log(u) / F.col(weight), "_id": F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).cast("long")})


def targets(sources: DataFrame, shares: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(_source, source_size) -> plus target: budget * all sizes by repeating shares, none above most * its size."""
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    pick = F.get(F.array(*[F.lit(float(x)) for x in shares]), (F.row_number().over(order) - 1) % len(shares))
    rising = Window.orderBy(most * F.col("source_size") / F.col("_share"), F.col("_source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    df = sources.withColumn("_share", pick)
    level = (budget * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("_share").over(onward)
    df = df.withColumn("_level", level)
    df = df.withColumn("_full", F.col("_level") >= most * F.col("source_size") / F.col("_share"))
    top = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    return df.withColumn("target", F.when(F.col("_full"), most * F.col("source_size")).otherwise(top * F.col("_share"))).drop("_share", "_level", "_full")


def plan_mix(
    df: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    size: str = "size",
    weight: str = "weight",
    seed: str = "mix",
    shares: tuple[int, ...] = (3, 1, 2),
    budget: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """One row per source: its size, target, complete epochs, and where its fractional epoch ends. df should be narrow: it is read three times."""
    df, names = aside(df)
    doc_id, source, size, weight = (names.get(c, c) for c in (doc_id, source, size, weight))
    rows = with_keys(df.withColumn("_source", F.col(source)), doc_id, size, weight, seed).select("_source", "_size", "_key", "_id", F.col(weight).cast("double").alias("_weight"))
    sources = targets(rows.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_n")), shares, budget, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("_epochs", epochs)
    sources = sources.withColumn("_rest", F.round("target").cast("long") - F.col("_epochs") * F.col("source_size"))
    sources = sources.withColumn("_ranges", F.least(F.lit(MAX_RANGES), F.ceil(F.col("_n") / RANGE_ROWS)).cast("long"))
    sources = saved(sources.withColumnRenamed("_source", "_of"), "sources")
    few = small(sources, BROADCAST_SOURCES)
    side = F.broadcast(sources) if few else sources
    rows = rows.join(side, F.col("_source").eqNullSafe(F.col("_of")))
    # exp(-key) is uniform at weight 1, so ranges of 1 - exp(-key) are of like size; their order is the keys' order.
    rows = rows.withColumn("_range", F.least(F.col("_ranges") - 1, F.floor((1 - F.exp(-F.col("_key"))) * F.col("_ranges"))))
    sums = rows.groupBy("_of", "_range", "_rest").agg(F.sum("_size").alias("_held"))
    at = Window.partitionBy("_of").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_before", F.sum("_held").over(at) - F.col("_held"))
    ends = sums.where((F.col("_rest") > F.col("_before")) & (F.col("_rest") <= F.col("_before") + F.col("_held")))
    ends = saved(ends.select(F.col("_of").alias("_end_of"), F.col("_range").alias("_end"), "_before"), "ends")
    inside = rows.join(F.broadcast(ends) if few else ends, F.col("_of").eqNullSafe(F.col("_end_of")) & (F.col("_range") == F.col("_end")))
    inside = inside.groupBy("_of", "_rest", "_before", "_key", "_id", "_size").agg(F.count(F.lit(1)).alias("_like"))
    inside = inside.withColumn("_sum", F.col("_before") + F.sum(F.col("_like") * F.col("_size")).over(Window.partitionBy("_of").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)))
    cut = inside.where((F.col("_rest") <= F.col("_sum")) & (F.col("_rest") > F.col("_sum") - F.col("_like") * F.col("_size")))
    cut = cut.select(F.col("_of").alias("_cut_of"), F.struct("_key", "_id", "_size").alias("_cut"), F.floor((F.col("_rest") - (F.col("_sum") - F.col("_like") * F.col("_size"))) / F.col("_like")).cast("long").alias("_part"))
    return saved(sources.join(cut, F.col("_of").eqNullSafe(F.col("_cut_of")), "left").select("_of", "source_size", "target", "_epochs", "_cut", "_part"), "cuts")


def apply_mix(df: DataFrame, cuts: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str = "size", weight: str = "weight", seed: str = "mix") -> DataFrame:
    """Adds source_size, target and taken (words that the mix takes of the row, repeats counted). Nothing is shuffled while sources are few.

    Columns of these three names are replaced; all others pass through under any name."""
    df, names = aside(df)
    doc_id, source, size, weight = (names.get(c, c) for c in (doc_id, source, size, weight))
    df = with_keys(df.drop("source_size", "target", "taken"), doc_id, size, weight, seed)
    side = F.broadcast(cuts) if small(cuts, BROADCAST_SOURCES) else cuts
    df = df.join(side, F.col(source).eqNullSafe(F.col("_of")))
    own = F.struct("_key", "_id", "_size")
    part = F.when(F.col("_cut").isNull(), 0).when(own < F.col("_cut"), F.col("_size")).when(own == F.col("_cut"), F.col("_part")).otherwise(0)
    df = df.withColumn("taken", (F.col("_epochs") * F.col("_size") + part).cast("long"))
    return returned(df.drop("_size", "_key", "_id", "_of", "_epochs", "_cut", "_part"), names)


ORACLE = r"""
with t as (select doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
d as (select doc_id, source, len(ws)::bigint as size, case when len(ws) > 0 then 0.1::double + len(list_distinct(ws))::double / len(ws) else 0.1::double end as weight from t),
k as (select *, -ln((('0x' || substr(md5('mix:' || doc_id::varchar), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double) / weight as key from d),
s as (select source, sum(size)::bigint as source_size, [3.0::double, 1.0::double, 2.0::double][1 + ((row_number() over (order by source nulls last) - 1) % 3)::int] as share from d group by source),
l as (select *, (1.5::double * sum(source_size) over () - 2.0::double * coalesce(sum(source_size) over (order by 2.0::double * source_size / share, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(share) over (order by 2.0::double * source_size / share, source nulls last rows between current row and unbounded following) as level from s),
f as (select *, level >= 2.0::double * source_size / share as whole from l),
g as (select source, source_size, case when whole then 2.0::double * source_size else max(case when not whole then level end) over () * share end as target from f),
e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as epochs from g),
r as (select *, round(target)::bigint - epochs * source_size as rest from e),
c as (select k.doc_id, k.size, r.source_size, r.target, r.epochs, r.rest, sum(k.size) over (partition by k.source order by k.key, k.doc_id rows between unbounded preceding and current row) as upto
  from k join r on k.source is not distinct from r.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - (upto - size))))::bigint as taken from c"""
