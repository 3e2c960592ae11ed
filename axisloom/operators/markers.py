"""Markers and differential ranking from per-group sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .measure import view


def markers(stats: DataFrame, sizes: DataFrame, n: int | None = None) -> DataFrame:
    """One group against the rest: (g, j, lfc, padj). stats: (g, j, sum, n_expr) on the full grid; n: all rows, ungrouped ones too."""
    s = stats.join(sizes, "g")
    if n is None:
        s = s.crossJoin(F.broadcast(sizes.agg(F.sum("n").cast("double").alias("_all"))))
    return one_against_rest(s, F.col("_all") if n is None else n, ["j"]).select("g", "j", "lfc", "padj")


def one_against_rest(s: DataFrame, rows: int | Column, column: list[str]) -> DataFrame:
    """s, (sum, n_expr, n: rows of the group) by group and column, with lfc and padj; column: the keys within which groups make up the whole."""
    rows = F.lit(rows).cast("double") if isinstance(rows, int) else rows
    everything = F.sum("sum").over(Window.partitionBy(*column))
    lfc = F.col("sum") / F.greatest("n", F.lit(1)) - (everything - F.col("sum")) / F.greatest(rows - F.col("n"), F.lit(1.0))
    return s.withColumn("lfc", lfc).withColumn("padj", padj())


def padj() -> Column:
    """From lfc and n_expr of the same row."""
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-12), F.exp(-F.abs(F.col("lfc") * F.sqrt(F.col("n_expr") + 1)))))


def top_markers(table: DataFrame, stat: str = "lfc", top: int = 10, ascending: bool = False) -> DataFrame:
    """Tidy ranks: per group the top rows by a statistic; NaN and null left out, ties by column."""
    order = F.col(stat).asc() if ascending else F.col(stat).desc()
    rank = F.row_number().over(Window.partitionBy("g").orderBy(order, "j"))
    return table.where(F.col(stat).isNotNull() & ~F.isnan(stat)).withColumn("rank", rank).where(F.col("rank") <= top)


def rank_scores(table: DataFrame, score: str = "score") -> DataFrame:
    """Per group the rank of each column by score, NaN and null last, ties by column."""
    order = F.coalesce(F.nanvl(F.col(score), F.lit(float("-inf"))), F.lit(float("-inf"))).desc()
    return table.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(order, "j")))


def a_versus_b(m: DataFrame, sides: DataFrame, n_a: int, n_b: int, lognorm: bool = False) -> DataFrame:
    """(j, mean_a, mean_b, lfc). sides: (i, side) with side 'a' or 'b', each row in one of them. Largest |lfc| first is up to the caller."""
    x = m.join(sides, "i").select("j", "side", view(F.col("v"), lognorm=lognorm).alias("x"))
    of = lambda s, n: F.sum(F.when(F.col("side") == s, F.col("x")).otherwise(0.0)) / max(n, 1)
    out = x.groupBy("j").agg(of("a", n_a).alias("mean_a"), of("b", n_b).alias("mean_b"))
    return out.withColumn("lfc", F.col("mean_a") - F.col("mean_b"))


def disjoint(sides: DataFrame) -> bool:
    return sides.groupBy("i").agg(F.countDistinct("side").alias("n")).where("n > 1").isEmpty()


def by_effect(de: DataFrame) -> DataFrame:
    return de.orderBy(F.abs("lfc").desc(), "j")


def most_variable(stats: DataFrame, k: int = 2000, digits: int = 9) -> DataFrame:
    """The k columns of largest variance, rounded so that ties are ties everywhere; ties by column."""
    return stats.orderBy(F.round("var", digits).desc(), "j").limit(k)


def ranked_bundle(records: DataFrame, columns: DataFrame) -> DataFrame:
    """Ranked records (g, names, scores: arrays) -> (g, j, score) for names on the axis (label, pos); unknown names are skipped."""
    pairs = records.select("g", F.explode(F.arrays_zip("names", "scores")).alias("z")).select("g", F.col("z.names").alias("label"), F.col("z.scores").alias("score"))
    return pairs.join(columns, "label").select("g", F.col("pos").alias("j"), "score")
