"""Zero-aware column statistics, per-group sufficient statistics and what follows from them.

n is always the length of the row axis, never a count of stored rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .measure import view


def _viewed(m: DataFrame, depth: DataFrame | None, scale: float, lognorm: bool) -> DataFrame:
    """depth: (i, d). The view is fused into the aggregate that follows."""
    if depth is None:
        return m.select("i", "j", view(F.col("v"), lognorm=lognorm).alias("x"))
    return m.join(depth.select("i", "d"), "i").select("i", "j", view(F.col("v"), F.col("d"), scale, lognorm).alias("x"))


def depth_of(m: DataFrame) -> DataFrame:
    """(i, d): the total of each row."""
    return m.groupBy("i").agg(F.sum(F.col("v").cast("double")).alias("d"))


def col_stats(m: DataFrame, n: int | Column, columns: DataFrame | None = None, lognorm: bool = False, depth: DataFrame | None = None, scale: float = 1e4, population: bool = False) -> DataFrame:
    """(j, mean, var, nnz) over all n rows, zeros included. columns (j): columns without entries appear with zeros.

    Moments of the entries are merged with those of the n - nnz zeros, which avoids the cancellation of
    sums of squares and needs only one partial aggregate.
    """
    g = _viewed(m, depth, scale, lognorm).groupBy("j").agg(F.count("x").alias("nnz"), F.avg("x").alias("a"), F.var_pop("x").alias("p"))
    return with_zeros(g, n, columns, population)


def with_zeros(g: DataFrame, n: int | Column, columns: DataFrame | None = None, population: bool = False) -> DataFrame:
    """(j, nnz, a, p), count, mean and population variance of the entries, as moments over n rows."""
    n = F.lit(n).cast("double") if isinstance(n, int) else n.cast("double")
    if columns is not None:
        g = columns.select("j").join(g, "j", "left")
    c, a, p = F.coalesce("nnz", F.lit(0)).cast("double"), F.coalesce("a", F.lit(0.0)), F.coalesce("p", F.lit(0.0))
    spread = p * c + a * a * c * (n - c) / n
    below = n if population else n - 1
    return g.select("j", (a * c / n).alias("mean"), F.when(below > 0, spread / below).otherwise(F.lit(0.0)).alias("var"), F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"))


def all_group_stats(m: DataFrame, own: DataFrame, cells: DataFrame, columns: DataFrame, lognorm: bool = False, parts: int | None = None) -> DataFrame:
    """(c, j, n, sum, sumsq, n_expr, p): the whole grid of cells and columns, for any number of groupings in one pass.

    own: (i, own: array<int>), the cells of a row; cells: (c, n), for each its rows; columns: (j). All rows together are the cell -1, which
    is not in ``own``; it stands in ``cells`` if it is wanted. p: population variance of the entries; empty cells have sums 0 and a null p.
    parts: entries go by column to as many tasks, once, and there meet their cells, so that an entry moves once however many groupings
    there are; what follows by column moves nothing. Leave it out for columns too large for a task: partial sums move then.
    """
    entries = _viewed(m, None, 1.0, lognorm).join(own, "i", "left").select("j", "x", "own", F.lit(False).alias("blank"))
    x = entries.unionAll(columns.select("j", F.lit(None).cast("double"), F.lit(None).cast("array<int>"), F.lit(True)))  # a blank a column, for cells without entries
    if parts:
        x = x.repartition(parts, "j")
    every = cells.agg(F.collect_list(F.struct("c", "n")).alias("every"))  # one row: the cells of a column
    mine = F.transform(F.concat(F.array(F.lit(-1)), F.coalesce("own", F.array().cast("array<int>"))), lambda c: F.struct(c.alias("c"), F.lit(None).cast("long").alias("n")))
    x = x.crossJoin(F.broadcast(every)).select("j", "x", F.explode(F.when(F.col("blank"), F.col("every")).otherwise(mine)).alias("e"))
    s = x.groupBy(F.col("e.c").alias("c"), "j").agg(F.max("e.n").alias("n"), F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sumsq"), F.count("x").alias("n_expr"), F.var_pop("x").alias("p"))
    return s.where("n is not null").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("sum", "sumsq")})  # cells and columns that there are


def group_stats(m: DataFrame, groups: DataFrame, lognorm: bool = False, depth: DataFrame | None = None, scale: float = 1e4, columns: DataFrame | None = None, levels: DataFrame | None = None) -> DataFrame:
    """(g, j, sum, sumsq, n_expr); groups: (i, g), null groups are left out. With columns and levels the full grid, empty cells 0."""
    x = _viewed(m, depth, scale, lognorm)
    out = x.join(groups.where("g is not null").select("i", "g"), "i").groupBy("g", "j").agg(F.sum("x").alias("sum"), F.sum(F.col("x") * F.col("x")).alias("sumsq"), F.count("x").alias("n_expr"))
    if columns is not None and levels is not None:
        # Only on request: the caller asks for a row per cell. Catalyst broadcasts the levels if they are small.
        grid = columns.select("j").crossJoin(levels.select("g"))
        out = grid.join(out, ["g", "j"], "left").select("g", "j", F.coalesce("sum", F.lit(0.0)).alias("sum"), F.coalesce("sumsq", F.lit(0.0)).alias("sumsq"), F.coalesce("n_expr", F.lit(0)).alias("n_expr"))
    return out


def group_sizes(groups: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """(g, n): rows of each group, missing ones left out; with levels, empty groups as 0."""
    out = groups.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    if levels is not None:
        out = levels.select("g").join(out, "g", "left").select("g", F.coalesce("n", F.lit(0)).alias("n"))
    return out


def pseudobulk(m: DataFrame, groups: DataFrame, **kwargs) -> DataFrame:
    """(g, j, mean, frac): mean over the group's rows, and the share that express; groups without rows have none."""
    s = group_stats(m, groups, **kwargs)
    sizes = group_sizes(groups)
    return s.join(sizes, "g", "left").select("g", "j", F.coalesce(F.try_divide("sum", "n"), F.lit(0.0)).alias("mean"), F.coalesce(F.try_divide("n_expr", "n"), F.lit(0.0)).alias("frac"))


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
