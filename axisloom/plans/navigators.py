"""Navigators: the precomputed fields that let a viewer open a large dataset at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Dataset, Field, as_categorical
from ..operators import dispersion, markers, order, stats
from ..operators.validate import NAVIGATOR_PROFILE
from ..sources.measures import hot_keys
from ..sources.shared import dealt, saved

# Fixed values of the policy.
PREFERRED_GROUPINGS = ("leiden", "cluster", "clusters", "cell_type", "celltype", "cell_types", "louvain", "seurat_clusters", "annotation", "cluster_label")
PREFERRED_EMBEDDINGS = ("umap",)
LOGNORM_NAMES = ("X", "data", "logcounts")
MIN_GROUPS, MAX_GROUPS, GRID = 2, 60, 1024
CACHE = NAVIGATOR_PROFILE


def counts_basis(ds: Dataset, name: str | None = None) -> Field:
    """The measure to start from: the one named, else raw, else log-normalised (by state, then by name); never scaled."""
    if name is not None:
        return ds.fields[name]
    full = [f for f in ds.fields.values() if f.role == "measure" and len(f.span) == 2]
    for test in (lambda f: f.state == "raw", lambda f: f.state == "lognorm", lambda f: f.name in LOGNORM_NAMES and f.state != "scaled"):
        for f in full:
            if test(f):
                return f
    raise ValueError("no raw or log-normalised measure to start from")


def _preference(name: str, preferred: tuple[str, ...]) -> int:
    """Place of the first preferred word that the name has in it, in any case; last without one."""
    return next((i for i, p in enumerate(preferred) if p in name.lower()), len(preferred))


def groupings(ds: Dataset, axis: str) -> list[str]:
    """Label fields over the row axis with 2 to 60 levels that occur, preferred words in their names first, then by name."""
    found = []
    for f in ds.fields_over(axis, "label"):
        if f.span == (axis,) and f.name != "active_ident":
            n = f.df.where("v is not null").agg(F.count_distinct("v")).first()[0]
            if MIN_GROUPS <= n <= MAX_GROUPS:
                found.append(f.name)
    return sorted(found, key=lambda n: (_preference(n, PREFERRED_GROUPINGS), n))


def embedding(ds: Dataset, axis: str) -> str | None:
    """An embedding over the row axis of two or more dimensions, chosen as groupings are."""
    found = [f.name for f in ds.fields_over(axis, "embedding") if f.span[0] == axis and (len(f.span) < 2 or ds.axes[f.span[1]].length >= 2)]
    return min(found, key=lambda n: (_preference(n, PREFERRED_EMBEDDINGS), n), default=None)


def _coded(ds: Dataset, name: str) -> DataFrame:
    """(i, g): a grouping by the codes of its factor axis, which is made if there is none; null without a group."""
    f = ds.fields[name]
    labels = f.df.select("i", F.col("v").alias("g"))
    if f.encoding == "categorical":
        if name not in ds.axes:
            ds.induce(name)
        return labels.select("i", F.when(F.col("g") >= 0, F.col("g")).cast("int").alias("g"))
    coded, levels = as_categorical(f.df)
    if name not in ds.axes:
        ds.add_axis(name, list(levels), origin="derived", role="factor")
    return coded.select("i", F.col("v").cast("int").alias("g"))


def _statistics(m: DataFrame, groups: DataFrame, levels: DataFrame, columns: DataFrame, names: dict[str, int], n: int, rows: int, lognorm: bool) -> DataFrame:
    """(of, g, j, sum, sumsq, n_expr, lfc, p): the whole grid, computed once and saved, whatever the number of groupings; all rows together are
    the group 0 of the grouping ''. groups: (i, c) and levels: (c), groups as numbers from names[of] on; rows: how many there are of cells, or of entries and columns, whichever are more.

    Entries meet by column in tasks bounded by both. A column that alone is far over a task's share is summed by parts instead."""
    parts = dealt(m.sparkSession, rows)
    sizes = levels.join(groups.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "c", "left").select("c", F.coalesce("n", F.lit(0)).alias("n"))
    sizes = sizes.unionAll(m.sparkSession.range(1).select(F.lit(-1), F.lit(n).cast("long")))
    own = groups.groupBy("i").agg(F.collect_list("c").alias("own"))  # one a grouping
    hot = [j for j in hot_keys(m, "j", parts) if j is not None]
    of, g = F.lit(""), F.lit(0)
    for name, at in names.items():
        of, g = F.when(F.col("c") >= at, F.lit(name)).otherwise(of), F.when(F.col("c") >= at, F.col("c") - at).otherwise(g)

    def grid(m: DataFrame, columns: DataFrame, parts: int | None) -> DataFrame:
        s = stats.all_group_stats(m, own, sizes, columns, lognorm, parts).withColumns({"of": of, "g": g})
        return markers.one_against_rest(s, n, ["of", "j"]).select("of", "g", "j", "sum", "sumsq", "n_expr", "lfc", F.when(F.col("c") < 0, F.col("p")).alias("p"))

    if not hot:
        return saved(grid(m, columns, parts), "grid")
    is_hot = F.col("j").isin(hot)
    return saved(grid(m.where(~is_hot), columns.where(~is_hot), parts).unionAll(grid(m.where(is_hot), columns.where(is_hot), None)), "grid")


def extend(ds: Dataset, basis: str | None = None, groups: list[str] | None = None) -> Dataset:
    """Adds, per grouping g, stats_g_{sum,sumsq,nexpr} (g x columns), markers_g_{lfc,padj} (columns x g), and od_score, counts_cellmajor, counts_cellmajor_order.
    The measure is read several times, so save it before if it is dear; by rows if it is large."""
    f = counts_basis(ds, basis)
    rows, cols = f.span
    lognorm = f.state == "raw"
    n = ds.axes[rows].length
    axis_cols = ds.axes[cols].df.select(F.col("pos").alias("j"))
    tag = {"provenance": {"cache": CACHE}, "induce": False}
    chosen = groups if groups is not None else groupings(ds, rows)
    if not chosen:
        raise ValueError("no grouping has between 2 and 60 levels")
    groups, levels, names, at = [], [], {}, 0
    for g in chosen:
        coded = _coded(ds, g)
        last = ds.axes[g].df.agg(F.max("pos")).first()[0]
        last = -1 if last is None else last
        groups.append(coded.where(F.col("g").between(0, last)).select("i", (F.col("g") + at).cast("int").alias("c")))
        levels.append(ds.axes[g].df.select((F.col("pos") + at).cast("int").alias("c")))
        names[g], at = at, at + last + 1
    entries, width = f.df.count(), ds.axes[cols].length
    grid = _statistics(f.df, reduce(DataFrame.unionAll, groups), reduce(DataFrame.unionAll, levels), axis_cols, names, n, max(entries + width, (at + 1) * width), lognorm)
    for g in chosen:
        own = grid.where(F.col("of") == g).withColumn("padj", markers.padj())
        for part, column in (("sum", "sum"), ("sumsq", "sumsq"), ("nexpr", "n_expr")):
            ds.add_field(f"stats_{g}_{part}", own.select(F.col("g").cast("long").alias("i"), "j", F.col(column).alias("v")), span=(g, cols), role="measure", state="raw", encoding="dense", **tag)
        for part in ("lfc", "padj"):
            ds.add_field(f"markers_{g}_{part}", own.select(F.col("j").alias("i"), F.col("g").cast("long").alias("j"), F.col(part).alias("v")), span=(cols, g), role="measure", state="scaled", encoding="dense", subtype="de", **tag)
    all_rows = grid.where("of = ''").select("j", F.col("n_expr").alias("nnz"), F.try_divide("sum", "n_expr").alias("a"), "p")
    cs = stats.with_zeros(all_rows, n, axis_cols, population=True)
    ds.add_field("od_score", dispersion.overdispersion(cs).select(F.col("j").alias("i"), F.col("od_score").alias("v")), span=(cols,), role="measure", state="scaled", encoding="dense", **tag)
    first = ds.fields[chosen[0]]
    labels = first.df.select("i", F.col("v").alias("g"))
    e = embedding(ds, rows)
    if e is not None:
        points = ds.fields[e].df.select("i", F.get("vec", F.lit(0)).cast("double").alias("x"), F.get("vec", F.lit(1)).cast("double").alias("y"))
        at = order.cell_order(points, labels, GRID)
    else:
        at = order.group_order(labels)
    ds.add_field("counts_cellmajor_order", at.select("i", F.col("new_pos").alias("v")), span=(rows,), role="measure", state="permutation", encoding="dense", **tag)
    ds.add_field("counts_cellmajor", order.reordered(f.df, at, dealt(ds.spark, entries)), span=(rows, cols), role="measure", state=f.state, encoding="csr", **tag)
    if NAVIGATOR_PROFILE not in ds.profiles:
        ds.profiles.append(NAVIGATOR_PROFILE)
    return ds


def drop_cache(ds: Dataset) -> Dataset:
    """Removes regenerable fields, recording them in ``dropped``."""
    for name in [n for n, f in ds.fields.items() if f.provenance.get("cache")]:
        del ds.fields[name]
        ds.dropped.append(f"fields/{name}")
    return ds


def de_field_name(factor: str, stat: str) -> str:
    return f"de.{factor}.{stat}"


def de_factors(ds: Dataset) -> list[str]:
    """Factors with differential results, in the order of their fields."""
    return list(dict.fromkeys(f.provenance["de_factor"] for f in ds.fields.values() if f.subtype == "de" and f.provenance.get("de_factor")))


def de_bundle(ds: Dataset, factor: str) -> dict[str, Field]:
    """statistic -> field of a factor's differential results."""
    return {f.provenance["de_stat"]: f for f in ds.fields.values() if f.subtype == "de" and f.provenance.get("de_factor") == factor and f.provenance.get("de_stat")}


def de_fields(ds: Dataset) -> DataFrame:
    """The registry of differential results: fields of subtype 'de' with their factor."""
    return ds.manifest().where("subtype = 'de'").select("field", F.element_at("span", -1).alias("factor"))
