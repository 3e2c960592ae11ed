"""Registered queries over the driver's tables, and the same in DuckDB SQL.

Customers are the row axis (i), parts the column axis (j), and the measure is the quantity bought.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .operators import access, collection, dispersion, markers, measure, order, stats, validate
from .model import Dataset, as_categorical, state_columns
from .plans import navigators
from .sources import measures, promote
from .sources.shared import TASK_ROWS, dealt, saved, shared_dir
from .streaming import additive

SQL_M = "m as (select o_custkey as i, l_partkey as j, sum(l_quantity) as v from lineitem join orders on l_orderkey = o_orderkey group by 1, 2 having sum(l_quantity) <> 0)"
SQL_G = "g as (select c_custkey as i, c_mktsegment as g from customer)"
SQL_N = "n as (select count(*)::double as n from customer)"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _sold(spark: SparkSession, sf: str, value: str = "l_quantity") -> DataFrame:
    """(i, j, v) of every line. Adaptive execution merges partitions by their compressed bytes, so that the sort and the sums of a task would
    grow with the tables up to hundreds of MB; larger tables are dealt out by number of rows instead, which is in the files' footers."""
    line, orders = _t(spark, sf, "lineitem"), _t(spark, sf, "orders")
    line, orders = line.select("l_orderkey", "l_partkey", value), orders.select("o_orderkey", "o_custkey")
    n = line.count()
    if n > 8 * TASK_ROWS:
        line, orders = line.repartition(dealt(spark, n), "l_orderkey"), orders.repartition(dealt(spark, n), "o_orderkey")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("i"), F.col("l_partkey").alias("j"), F.col(value).alias("v"))


def _m(spark: SparkSession, sf: str, value: str = "l_quantity") -> DataFrame:
    return measure.measure(_sold(spark, sf, value), "i", "j", "v")


def _g(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.col("c_mktsegment").alias("g"))


def _n(spark: SparkSession, sf: str) -> int:
    return _t(spark, sf, "customer").count()


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("j"))


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def group_stats(spark, sf):
    return _r(stats.group_stats(_m(spark, sf), _g(spark, sf), lognorm=True), "sum", "sumsq")


def group_stats_grid(spark, sf):
    return stats.group_stats(_m(spark, sf), _g(spark, sf), columns=_parts(spark, sf), levels=_g(spark, sf).select("g").distinct())


def group_stats_depth(spark, sf):
    m = _m(spark, sf)
    return _r(stats.group_stats(m, _g(spark, sf), lognorm=True, depth=stats.depth_of(m)), "sum", "sumsq")


def _col_stats(**kwargs):
    def run(spark, sf):
        m = _m(spark, sf)
        depth = stats.depth_of(m) if kwargs.get("depth") else None
        return _r(stats.col_stats(m, _n(spark, sf), _parts(spark, sf), **{**kwargs, "depth": depth}), "mean", "var")

    return run


def _col_sql(x: str, below: str = "(n - 1)") -> str:
    return f"""with {SQL_M}, {SQL_N}, d as (select i, sum(v) as d from m group by i), x as (select j, {x} as x from m join d using (i)),
s as (select j, count(*)::double as c, avg(x) as a, var_pop(x) as p from x group by j),
f as (select p_partkey as j, coalesce(c, 0) as c, coalesce(a, 0) as a, coalesce(p, 0) as p, n from part left join s on j = p_partkey cross join n)
select j, round(a * c / n, 6) as mean, round((p * c + a * a * c * (n - c) / n) / {below}, 6) as var, c::bigint as nnz from f"""


def total_sum(spark, sf):
    return measure.total(_m(spark, sf))


def row_depth(spark, sf):
    return stats.depth_of(_m(spark, sf))


def group_sizes(spark, sf):
    return stats.group_sizes(_g(spark, sf))


def pseudobulk_mean_frac(spark, sf):
    return _r(stats.pseudobulk(_m(spark, sf), _g(spark, sf)), "mean", "frac", digits=9)


def _markers(spark, sf):
    s = stats.group_stats(_m(spark, sf), _g(spark, sf), lognorm=True, columns=_parts(spark, sf), levels=_g(spark, sf).select("g").distinct())
    return markers.markers(s, stats.group_sizes(_g(spark, sf)), _n(spark, sf))


def markers_1vs_rest(spark, sf):
    return _r(_markers(spark, sf), "lfc", "padj")


def markers_top_n(spark, sf):
    return markers.top_markers(markers_1vs_rest(spark, sf), top=10).select("g", "j", "lfc", "rank")


def rank_by_score(spark, sf):
    return markers.rank_scores(markers_1vs_rest(spark, sf).select("g", "j", F.col("lfc").alias("score"))).select("g", "j", "rank")


SQL_MARKERS = f"""{SQL_M}, {SQL_G}, {SQL_N}, z as (select g, count(*)::double as n_g from g group by g),
s as (select g, j, sum(ln(1 + v)) as s, count(*) as e from m join g using (i) group by 1, 2),
f as (select z.g, p_partkey as j, n_g, coalesce(s, 0) as s, coalesce(e, 0) as e, n from z cross join part cross join n left join s on s.g = z.g and s.j = p_partkey),
l as (select g, j, e, s / greatest(n_g, 1) - (sum(s) over (partition by j) - s) / greatest(n - n_g, 1) as lfc from f),
k as (select g, j, round(lfc, 6) as lfc, round(least(1.0, greatest(1e-12, exp(-abs(lfc * sqrt(e + 1))))), 6) as padj from l)"""


def de_a_vs_b(spark, sf):
    sides = _g(spark, sf).where("g in ('BUILDING', 'MACHINERY')").select("i", F.when(F.col("g") == "BUILDING", "a").otherwise("b").alias("side"))
    n = {r[0]: r[1] for r in sides.groupBy("side").count().collect()}
    return _r(markers.by_effect(markers.a_versus_b(_m(spark, sf), sides, n.get("a", 0), n.get("b", 0), lognorm=True)), "mean_a", "mean_b", "lfc")


def hvg_top_k(spark, sf):
    s = _r(stats.col_stats(_m(spark, sf), _n(spark, sf), _parts(spark, sf)), "var")
    return markers.most_variable(s, 100, 6).select("j", "var")


def gene_column(spark, sf):
    return access.column(_m(spark, sf), 7)


def cell_row(spark, sf):
    return access.row(_m(spark, sf), 11)


def gene_range(spark, sf):
    return access.column_range(_m(spark, sf), 10, 20)


def row_block(spark, sf):
    return access.row_block(_m(spark, sf), 100, 120)


def gene_gather_with_duplicates(spark, sf):
    return access.gather(_m(spark, sf), [9, 3, 9, 40])


def cell_gather(spark, sf):
    return access.gather(_m(spark, sf), [5, 2, 5], "i")


def _rows(spark, sf):
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("i"))


def gene_expression_zero_filled(spark, sf):
    return _r(access.expression(_m(spark, sf), _rows(spark, sf), 7, lognorm=True), "x")


def gene_expression_max(spark, sf):
    return access.expression_max(access.expression(_m(spark, sf), _rows(spark, sf), 7))


def crossfilter_cat_range(spark, sf):
    df = _t(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return access.Crossfilter(df).keep("c_mktsegment", ["BUILDING", "FURNITURE"]).between("c_acctbal", 0.0, 5000.0).selected()


def partial_coverage_left(spark, sf):
    axis = _t(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("label"))
    field = _t(spark, sf, "labels").select(F.col("doc_id").alias("i"), F.col("quality").alias("v"))
    return measure.with_coverage(axis, field)


def partial_coverage_inner(spark, sf):
    axis = _t(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("label"))
    return measure.covered(axis, _t(spark, sf, "labels").select(F.col("doc_id").alias("i"), F.col("toxic").alias("v")))


def nullable_mask(spark, sf):
    df = _t(spark, sf, "customer")
    values, mask = df.select(F.col("c_custkey").alias("i"), F.col("c_nationkey").alias("v")), df.select(F.col("c_custkey").alias("i"), (F.col("c_acctbal") < 0).cast("int").alias("m"))
    return measure.decode_mask(values, mask)


def factor_axis_induce(spark, sf):
    return access.factor_levels(_t(spark, sf, "customer").select(F.col("c_mktsegment").alias("v")))


def utf8_first_seen_codes(spark, sf):
    return access.first_seen_codes(_t(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.col("c_mktsegment").alias("v")))


def _samples(spark, sf):
    """Samples are regions: (i, sample, sample_ord) of each customer."""
    c, n, r = _t(spark, sf, "customer"), _t(spark, sf, "nation"), _t(spark, sf, "region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("c_custkey").alias("i"), F.col("r_name").alias("sample"), F.col("r_regionkey").alias("sample_ord"))


def collection_union_axis(spark, sf):
    axes = _m(spark, sf).join(_samples(spark, sf), "i").select("sample_ord", F.col("j").alias("pos"), F.concat(F.lit("part"), F.col("j")).alias("label")).distinct()
    return collection.union_axis(axes)


def _collected(spark, sf):
    return _m(spark, sf).join(_samples(spark, sf), "i").select("sample", F.concat_ws(":", "sample", F.col("i").cast("string")).alias("row"), F.col("j").alias("col"), "v", "i")


def collection_pseudobulk(spark, sf):
    names = _samples(spark, sf).join(_g(spark, sf), "i").select(F.concat_ws(":", "sample", F.col("i").cast("string")).alias("row"), "g")
    return _r(collection.collection_pseudobulk(_collected(spark, sf), names), "mean", "frac", digits=9)


def collection_flatten(spark, sf):
    rows = _samples(spark, sf).select(F.concat_ws(":", "sample", F.col("i").cast("string")).alias("label"), F.col("i").alias("pos"))
    return collection.flatten(_collected(spark, sf).drop("i"), rows, _parts(spark, sf).select(F.col("j").alias("pos"), F.col("j").alias("label")))


def collection_sizes(spark, sf):
    return collection.sample_sizes(_samples(spark, sf))


def _labels_of(spark, sf, sample):
    return _m(spark, sf).join(_samples(spark, sf).where(F.col("sample") == sample), "i").select(F.col("j").alias("label")).distinct()


def set_union(spark, sf):
    return _labels_of(spark, sf, "ASIA").unionByName(_labels_of(spark, sf, "EUROPE")).distinct()


def set_intersect(spark, sf):
    return collection.intersect_labels(_labels_of(spark, sf, "ASIA"), _labels_of(spark, sf, "EUROPE"))


def set_except(spark, sf):
    return collection.except_labels(_labels_of(spark, sf, "ASIA"), _labels_of(spark, sf, "EUROPE"))


SQL_LABELS = SQL_M + ", s as (select c_custkey as i, r_name as sample, r_regionkey as sample_ord from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


def state_inference(spark, sf):
    """One row per measure: what the state follows from, and the state."""
    out = None
    for name, column in (("quantity", "l_quantity"), ("price", "l_extendedprice")):
        one = _m(spark, sf, column).agg(*state_columns()).select(F.lit(name).alias("field"), F.when(F.col("lo") < -1e-6, "scaled").when(F.col("whole"), "raw").otherwise("lognorm").alias("state"))
        out = one if out is None else out.unionByName(one)
    return out


def stride_sample(spark, sf):
    return access.stride_sample(_t(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), "c_name"), 7, 3)


def window_sample(spark, sf):
    return access.window_sample(_t(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), "c_name"), _n(spark, sf), 5, 10)


def capped_groups(spark, sf):
    return access.capped(_g(spark, sf), 20)


def dense_posexplode(spark, sf):
    return _r(measure.dense_to_sparse(_t(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").alias("vec"))).withColumn("v", F.col("v").cast("double")), "v")


def embedding_extent(spark, sf):
    p = _t(spark, sf, "embeddings").select(F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return p.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def cell_order_cluster_only(spark, sf):
    return order.group_order(_g(spark, sf))


def _points(spark, sf):
    e = _t(spark, sf, "embeddings")
    points = e.select(F.col("vec_id").alias("i"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return points, e.select(F.col("vec_id").alias("i"), F.col("label").alias("g"))


def cell_order_hilbert(spark, sf):
    return order.cell_order(*_points(spark, sf))


def grid_cells(spark, sf):
    p = _points(spark, sf)[0]
    ends = F.broadcast(p.agg(F.min("x").alias("x0"), F.max("x").alias("x1")))
    return p.crossJoin(ends).select("i", scalar.grid_cell(F.col("x"), F.col("x0"), F.col("x1")).alias("cell"))


def row_reorder(spark, sf):
    return order.reordered(_m(spark, sf), order.group_order(_g(spark, sf)))


def transposed(spark, sf):
    return measure.transpose(_m(spark, sf))


def flat_positions(spark, sf):
    n = _t(spark, sf, "part").count()
    return _m(spark, sf).select("i", "j", measure.flat_position((1, n), ("i", "j")).alias("at"))


def validate_issues(spark, sf):
    m = _t(spark, sf, "lineitem").select((F.col("l_orderkey") - 1).alias("i"), F.col("l_linenumber").cast("long").alias("j"), F.col("l_discount").alias("v"))
    return validate.issue_counts(m, _t(spark, sf, "orders").count(), 5)


def scalar_to_rgba(spark, sf):
    x = access.expression(_m(spark, sf), _rows(spark, sf), 7, lognorm=True)
    return x.crossJoin(F.broadcast(access.expression_max(x))).select("i", scalar.rgba(F.col("x"), F.col("max")).alias("c")).select("i", "c.r", "c.g", "c.b")


def overdispersion(spark, sf):
    s = stats.col_stats(_m(spark, sf), _n(spark, sf), _parts(spark, sf), lognorm=True, population=True)
    return _r(dispersion.overdispersion(s), "od_score")


def overdispersion_inputs(spark, sf):
    s = stats.col_stats(_m(spark, sf), _n(spark, sf), _parts(spark, sf), lognorm=True, population=True)
    return _r(dispersion.eligible(s), "mean", "var")


def overdispersion_trend(spark, sf):
    """The 200 anchors of the trend."""
    s = stats.col_stats(_m(spark, sf), _n(spark, sf), _parts(spark, sf), lognorm=True, population=True)
    at, fit = dispersion.trend(dispersion.points(s))
    return _r(spark.createDataFrame([(a, float(x), float(y)) for a, (x, y) in enumerate(zip(at, fit))], "a long, x double, fit double"), "x", "fit")


SQL_TREND = f"""with {SQL_M}, {SQL_N}, s as (select j, count(*)::double as c, avg(ln(1 + v)) as a, var_pop(ln(1 + v)) as p from m group by j),
f as (select j, ln(a * c / n) as x, ln((p * c + a * a * c * (n - c) / n) / n) as y from s cross join n where c >= 3 and a > 0 and p * c + a * a * c * (n - c) / n > 0),
r as (select x, y, row_number() over (order by x, j) - 1 as k from f), e as (select count(*) as n, min(x) as lo, max(x) as hi, greatest(2, floor(0.3::double * count(*))::bigint) as w from f),
q as (select a, lo + (hi - lo) * a / 199.0::double as x0, n, w from e cross join range(200) t(a)),
b as (select a, x0, n, w, (select count(*) from f where f.x < q.x0) as below from q),
l as (select a, x0, least(n, greatest(0, below - w // 2) + w) as stop, greatest(0, least(n, greatest(0, below - w // 2) + w) - w) as start from b),
u as (select a, x0, x - x0 as u, y, greatest(1e-9, max(abs(x - x0)) over (partition by a)) as far from l join r on k >= start and k < stop),
v as (select a, x0, sum(w) as w, sum(w * u) as u, sum(w * y) as y, sum(w * u * u) as uu, sum(w * u * y) as uy from (select *, pow(1 - pow(abs(u) / far, 3), 3) as w from u) group by a, x0)
select a, round(x0, 6) as x, round(case when abs(w * uu - u * u) < 1e-12 then y / w else (uu * y - u * uy) / (w * uu - u * u) end, 6) as fit from v"""


def _dataset(spark, sf):
    """Customers by parts, with their segment as a grouping."""
    ds = Dataset(spark)
    ds.add_axis("cells", _t(spark, sf, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("label")))
    ds.add_axis("genes", _t(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("label")))
    sold = saved(_sold(spark, sf), "sold")
    path = f"{shared_dir(spark).rstrip('/')}/axisloom-measure-{uuid.uuid4().hex}"
    ds.add_field("counts", measures.rows(sold, path, dealt(spark, sold.count()), summed=False), span=("cells", "genes"))  # read by each navigator
    coded, levels = as_categorical(_g(spark, sf).withColumnRenamed("g", "v"))
    ds.add_field("segment", coded, span=("cells",), categories=levels, role="label")
    return ds


def navigators_built(spark, sf):
    """(field, i, j, v): the navigators of the dataset, as stored."""
    ds, out = navigators.extend(_dataset(spark, sf)), None
    for name in [f"stats_segment_{x}" for x in ("sum", "sumsq", "nexpr")] + [f"markers_segment_{x}" for x in ("lfc", "padj")] + ["counts_cellmajor_order", "counts_cellmajor"]:
        df = ds.fields[name].df
        one = df.select(F.lit(name).alias("field"), "i", F.col("j").cast("long").alias("j") if "j" in df.columns else F.lit(None).cast("long").alias("j"), F.round(F.col("v").cast("double"), 5).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


def navigators_two_groupings(spark, sf):
    """(field, i, j, v): statistics and markers by segment and by nation, from one pass over the measure."""
    ds, out = _dataset(spark, sf), None
    coded, levels = as_categorical(_t(spark, sf, "customer").select(F.col("c_custkey").alias("i"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("v")))
    ds.add_field("nation", coded, span=("cells",), categories=levels, role="label")
    navigators.extend(ds)
    for name in [f"{x}_{g}_{y}" for g in ("segment", "nation") for x, y in (("stats", "sum"), ("stats", "nexpr"), ("markers", "lfc"))]:
        one = ds.fields[name].df.select(F.lit(name).alias("field"), "i", "j", F.round(F.col("v").cast("double"), 5).alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


def props_promoted(spark, sf):
    """(event_id, k, rest): the scalar keys of every event's documents as columns, and what is left of each."""
    docs = _t(spark, sf, "events").select("event_id", promote.as_variant(F.col("props")).alias("props"))
    out = promote.promoted_columns(docs, "props")
    return out.withColumn("rest", F.to_json("rest"))


def tail_promoted(spark, sf):
    """(field, i, j, v): typed fields from documents of a segment's twenty most bought parts and a palette, bound to their axes, and the
    keys left in the tail (as fields of no position)."""
    ds = Dataset(spark)
    ds.add_axis("genes", _t(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("part "), "p_partkey").alias("label")))
    ds.add_axis("segment", list(as_categorical(_g(spark, sf).withColumnRenamed("g", "v"))[1]), role="factor")
    s = stats.group_stats(_m(spark, sf), _g(spark, sf))
    top = markers.top_markers(s, "sum", 20)
    records = top.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("part "), "j").alias("name"), F.col("sum").cast("double").alias("score")))).alias("e"))
    lists = [F.map_from_entries(F.collect_list(F.struct("g", F.col(f"e.{c}")))).alias(k) for k, c in (("names", "name"), ("scores", "score"))]
    records = records.agg(F.struct(F.struct(F.lit("segment").alias("groupby")).alias("params"), *lists).alias("d")).select(F.lit("rank_genes_groups").alias("key"), F.to_variant_object("d").alias("doc"))
    palette = ds.axes["segment"].df.agg(F.transform(F.array_sort(F.collect_list("label")), lambda x: F.concat(F.lit("#"), F.substring(F.md5(x), 1, 6))).alias("d"))
    tail = records.unionByName(palette.select(F.lit("segment_colors").alias("key"), F.to_variant_object("d").alias("doc")))
    tail = tail.unionByName(spark.range(1).select(F.lit("note").alias("key"), F.parse_json(F.lit('{"a": 1}')).alias("doc")))
    left = promote.promote(ds, tail)
    out = left.select(F.concat(F.lit("tail "), "key").alias("field"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("j"), F.to_json("doc").alias("v"))
    for name, f in ds.fields.items():
        j = F.col("j") if "j" in f.df.columns else F.lit(None).cast("long").alias("j")
        out = out.unionByName(f.df.select(F.lit(name).alias("field"), "i", j, (F.col("v").cast("long").cast("string") if "j" in f.df.columns else F.col("v")).alias("v")))
    return out


def modality_placement(spark, sf):
    """(modality, axis, coverage, i, j, v): what Asian customers bought lies on some of the shared customers, what suppliers sold on rows of their own."""
    ds = Dataset(spark)
    customers, line = _t(spark, sf, "customer"), _t(spark, sf, "lineitem")
    ds.add_axis("cells", customers.select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("label")))
    nations = _t(spark, sf, "nation").join(_t(spark, sf, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    some = order.numbered(customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", F.col("c_name").alias("label")), ["label"], "pos")
    bought = _m(spark, sf).join(some.select(F.col("c_custkey").alias("i"), "pos"), "i").select(F.col("pos").alias("i"), "j", "v")
    parts = _t(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("label"))
    collection.add_modality(ds, "asia", bought, some, parts)
    sellers = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("label"))
    collection.add_modality(ds, "suppliers", measure.measure(line, "l_suppkey", "l_partkey", "l_quantity"), sellers, parts)
    frames = [f.df.select(F.lit(n).alias("modality"), F.lit(f.span[0]).alias("axis"), F.lit(f.coverage).alias("coverage"), "i", "j", "v") for n, f in ds.fields.items()]
    return frames[0].unionByName(frames[1])


def label_dictionary(spark, sf):
    """(i, code, label): every order's priority and customer by the dictionary of all of these."""
    codes, levels = access.encoded(_t(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), F.concat_ws(" ", F.col("o_orderpriority"), F.col("o_custkey").cast("string")).alias("v")))
    return codes.join(levels, codes["v"] == levels["pos"]).select("i", F.col("v").alias("code"), "label")


_STORED: dict[tuple[str, str], measures.StoredMeasure] = {}


def stored_measure(spark, sf):
    """The measure in both clusterings, written once for a session and folder of tables."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _STORED:
        path = f"{shared_dir(spark).rstrip('/')}/axisloom-measure-{uuid.uuid4().hex}"
        sold = saved(_sold(spark, sf), "sold")
        _STORED[at] = measures.write(sold, path, buckets=dealt(spark, sold.count()), summed=False)
    return _STORED[at]


def stored_gene_expression(spark, sf):
    """One part's quantities over all customers, from the stored measure: one bucket is read."""
    return _r(access.expression(stored_measure(spark, sf).by_column, _rows(spark, sf), 7, lognorm=True), "x")


def stored_col_stats(spark, sf):
    return _r(stats.col_stats(stored_measure(spark, sf).by_column, _n(spark, sf), _parts(spark, sf), lognorm=True), "mean", "var")


def stored_row_depth(spark, sf):
    return stats.depth_of(stored_measure(spark, sf).by_row)


def stored_gene_range(spark, sf):
    return access.column_range(stored_measure(spark, sf).by_column, 10, 20)


def columns_typed(spark, sf):
    """(field, role, encoding, state, nullable, n): the columns of orders as fields, and their values that aren't null."""
    ds = Dataset(spark)
    orders = _t(spark, sf, "orders")
    ds.add_axis("orders", orders.select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("label")))
    ds.add_columns(orders.withColumn("o_priority", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority"))), "orders", "o_orderkey")
    counts = None
    for name, f in ds.fields.items():
        one = f.df.agg(F.count("v").alias("n")).select(F.lit(name).alias("field"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return ds.manifest().select("field", "role", "encoding", "state", "nullable").join(counts, "field")


def ranked_records(spark, sf):
    """(g, j, score): the twenty parts most bought in each segment as ranked records, brought back onto the axis of parts."""
    s = stats.group_stats(_m(spark, sf), _g(spark, sf))
    parts = _t(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("part "), "p_partkey").alias("label"))
    top = markers.top_markers(s, "sum", 20).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("part "), "j").alias("name"), "sum"))).alias("e"))
    return markers.ranked_bundle(top.select("g", F.array_append("e.name", F.lit("no such part")).alias("names"), F.array_append("e.sum", F.lit(0.0)).alias("scores")), parts)


def validate_rules(spark, sf):
    """What validation finds in a dataset with faults of each kind of content."""
    ds = _dataset(spark, sf)
    ds.add_field("far", _m(spark, sf).withColumn("j", F.col("j") + 10), span=("cells", "genes"), state="raw")
    ds.add_field("fewer", _g(spark, sf).where("g = 'BUILDING'").select("i", F.lit(0).alias("v")), span=("cells",), role="vector")
    ds.add_field("three", ds.fields["segment"].df, span=("cells",), categories=("a", "b", "c"), role="label", induce=False)
    ds.add_field("again", _t(spark, sf, "orders").select(F.col("o_custkey").alias("i"), F.col("o_totalprice").alias("v")), span=("cells",), role="vector", coverage="partial", index_axis="cells")
    ds.add_field("lost", _g(spark, sf).select("i", F.lit(1.0).alias("v")), span=("nowhere",), role="vector")
    return validate.issues(ds).select("field", "rule", "severity", F.coalesce("n", F.lit(0)).alias("n"))


def graph_degree(spark, sf):
    line, orders = _t(spark, sf, "lineitem"), _t(spark, sf, "orders")
    edges = line.join(orders, line.l_orderkey == orders.o_orderkey).groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))
    return collection.degree(edges)


def passthrough_json(spark, sf):
    docs = _t(spark, sf, "events").select("event_id", promote.as_variant(F.col("props")).alias("props"))
    return promote.promoted_columns(docs, "props", {"k": "string"}).select("event_id", "k")


def additive_stats(spark, sf):
    """Statistics of two halves of the events, merged: equal to those of the whole."""
    e = _t(spark, sf, "events").select(F.col("event_type").alias("g"), F.col("user_id").alias("j"), F.col("value").alias("v"), "event_id")
    halves = [additive.batch_stats(e.where(F.pmod("event_id", F.lit(2)) == k)) for k in (0, 1)]
    return _r(additive.merged(halves[0].unionByName(halves[1])), "sum", "sumsq", digits=4)


def uniqueness(spark, sf):
    return stats.uniqueness(_t(spark, sf, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber")), "key")


_W = f"with {SQL_M}"
ORACLE = {
    "group_stats": f"{_W}, {SQL_G} select g, j, round(sum(ln(1 + v)), 6) as sum, round(sum(ln(1 + v) * ln(1 + v)), 6) as sumsq, count(*) as n_expr from m join g using (i) group by 1, 2",
    "group_stats_grid": f"{_W}, {SQL_G}, s as (select g, j, sum(v) as s, sum(v * v) as q, count(*) as e from m join g using (i) group by 1, 2) select z.g, p_partkey as j, coalesce(s, 0) as sum, coalesce(q, 0) as sumsq, coalesce(e, 0) as n_expr from (select distinct g from g) z cross join part left join s on s.g = z.g and s.j = p_partkey",
    "col_stats_raw": _col_sql("v"),
    "col_stats_lognorm": _col_sql("ln(1 + v)"),
    "col_stats_depth": _col_sql("ln(1 + v * 10000.0::double / d)"),
    "col_stats_population": _col_sql("v", "n"),
    "total_sum": f"{_W} select sum(v) as total from m",
    "row_depth": f"{_W} select i, sum(v) as d from m group by i",
    "group_sizes": "select c_mktsegment as g, count(*) as n from customer group by 1",
    "pseudobulk_mean_frac": f"{_W}, {SQL_G}, z as (select g, count(*)::double as n from g group by g), s as (select g, j, sum(v) as s, count(*) as e from m join g using (i) group by 1, 2) select g, j, round(s / n, 9) as mean, round(e / n, 9) as frac from s join z using (g)",
    "markers_1vs_rest": f"with {SQL_MARKERS} select * from k",
    "markers_top_n": f"with {SQL_MARKERS}, r as (select *, row_number() over (partition by g order by lfc desc, j) as rank from k) select g, j, lfc, rank::int as rank from r where rank <= 10",
    "rank_by_score": f"with {SQL_MARKERS} select g, j, (row_number() over (partition by g order by lfc desc, j))::int as rank from k",
    "de_a_vs_b": f"{_W}, {SQL_G}, z as (select count(*) filter (g = 'BUILDING')::double as a, count(*) filter (g = 'MACHINERY')::double as b from g), s as (select j, sum(case when g = 'BUILDING' then ln(1 + v) else 0 end) as a, sum(case when g = 'MACHINERY' then ln(1 + v) else 0 end) as b from m join g using (i) where g in ('BUILDING', 'MACHINERY') group by j) select j, round(s.a / z.a, 6) as mean_a, round(s.b / z.b, 6) as mean_b, round(s.a / z.a - s.b / z.b, 6) as lfc from s cross join z",
    "hvg_top_k": f"with t as ({_col_sql('v')}) select j, var from t order by var desc, j limit 100",
    "gene_column": f"{_W} select i, v from m where j = 7",
    "cell_row": f"{_W} select j, v from m where i = 11",
    "gene_range": f"{_W} select * from m where j >= 10 and j < 20",
    "row_block": f"{_W} select * from m where i >= 100 and i < 120",
    "gene_gather_with_duplicates": f"{_W}, q as (select * from (values (9, 0), (3, 1), (9, 2), (40, 3)) t(j, ord)) select m.j, i, v, ord::bigint as ord from m join q on m.j = q.j",
    "cell_gather": f"{_W}, q as (select * from (values (5, 0), (2, 1), (5, 2)) t(i, ord)) select m.i, j, v, ord::bigint as ord from m join q on m.i = q.i",
    "gene_expression_zero_filled": f"{_W} select c_custkey as i, round(coalesce(ln(1 + v), 0), 6) as x from customer left join (select * from m where j = 7) on i = c_custkey",
    "gene_expression_max": f"{_W} select greatest(coalesce(max(v), 0), 0.0::double) as max from m where j = 7",
    "crossfilter_cat_range": "select c_custkey, c_mktsegment, c_acctbal from customer where c_mktsegment in ('BUILDING', 'FURNITURE') and (isnan(c_acctbal) or c_acctbal between 0 and 5000)",
    "partial_coverage_left": "select d.doc_id as pos, source as label, quality as v, l.doc_id is not null as is_covered from documents d left join labels l using (doc_id)",
    "partial_coverage_inner": "select doc_id as pos, source as label, toxic as v from documents join labels using (doc_id)",
    "nullable_mask": "select c_custkey as i, case when c_acctbal < 0 then null else c_nationkey end as v from customer",
    "factor_axis_induce": "select row_number() over (order by v) - 1 as pos, v as label from (select distinct c_mktsegment as v from customer)",
    "utf8_first_seen_codes": "with f as (select c_mktsegment as v, min(c_custkey) as first from customer group by 1), c as (select v, (row_number() over (order by first) - 1)::int as code from f) select c_custkey as i, code from customer join c on v = c_mktsegment",
    "collection_union_axis": f"with {SQL_LABELS}, f as (select j, min(sample_ord) as o from m join s using (i) group by j) select row_number() over (order by o, j) - 1 as pos, 'part' || j as label from f",
    "collection_pseudobulk": f"{_W}, {SQL_G}, z as (select g, count(*)::double as n from g group by g), s as (select g, j, sum(v) as s, count(*) as e from m join g using (i) group by 1, 2) select g, j as col, round(s / n, 9) as mean, round(e / n, 9) as frac from s join z using (g)",
    "collection_flatten": f"{_W} select * from m",
    "collection_sizes": f"with {SQL_LABELS} select sample, count(*) as n_rows from s group by 1",
    "set_union": f"with {SQL_LABELS} select distinct j as label from m join s using (i) where sample in ('ASIA', 'EUROPE')",
    "set_intersect": f"with {SQL_LABELS} select j as label from m join s using (i) where sample = 'ASIA' intersect select j from m join s using (i) where sample = 'EUROPE'",
    "set_except": f"with {SQL_LABELS} select j as label from m join s using (i) where sample = 'ASIA' except select j from m join s using (i) where sample = 'EUROPE'",
    "state_inference": f"{_W}, p as (select sum(l_extendedprice) as v from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_partkey), a as (select 'quantity' as field, v from m union all select 'price', v from p) select field, case when min(v) < -1e-6 then 'scaled' when bool_and(abs(v - round_even(v, 0)) <= 1e-6 + 1e-5 * abs(round_even(v, 0))) then 'raw' else 'lognorm' end as state from a group by field",
    "stride_sample": "select c_custkey as pos, c_name from customer where (c_custkey + 4) % 7 = 0",
    "window_sample": "with n as (select greatest(1, count(*) // 5) as step from customer) select c_custkey as pos, c_name from customer cross join n where c_custkey % step < 10 and c_custkey // step < 5",
    "capped_groups": f"with {SQL_G}, r as (select *, row_number() over (partition by g order by i) as k from g) select i, g from r where k <= 20",
    "dense_posexplode": "with e as (select vec_id as i, unnest(embedding) as v, unnest(range(len(embedding))) as j from embeddings) select i, j, round(v::double, 6) as v from e where v <> 0",
    "embedding_extent": "select min(embedding[1])::double as x0, max(embedding[1])::double as x1, min(embedding[2])::double as y0, max(embedding[2])::double as y1 from embeddings",
    "cell_order_cluster_only": f"with {SQL_G} select i, row_number() over (order by g, i) - 1 as new_pos from g",
    "grid_cells": "with p as (select vec_id as i, embedding[1]::double as x from embeddings), e as (select min(x) as x0, max(x) as x1 from p) select i, least(1023, greatest(0, floor((x - x0) / case when x1 > x0 then x1 - x0 else 1 end * 1023)))::int as cell from p cross join e",
    "row_reorder": f"{_W}, {SQL_G}, o as (select i, row_number() over (order by g, i) - 1 as p from g) select p as i, j, v from m join o using (i)",
    "transposed": f"{_W} select j as i, i as j, v from m",
    "flat_positions": f"{_W} select i, j, i * (select count(*) from part) + j as at from m",
    "validate_issues": "with m as (select l_orderkey - 1 as i, l_linenumber as j, l_discount as v from lineitem), o as (select count(*) as n from orders), d as (select i, j from m group by 1, 2 having count(*) > 1) select 'row_out_of_range' as rule, count(*) filter (i < 0 or i >= n) as n from m cross join o union all select 'column_out_of_range', count(*) filter (j < 0 or j >= 5) from m union all select 'explicit_zero', count(*) filter (v = 0) from m union all select 'missing_value', count(*) filter (v is null) from m union all select 'repeated_entry', count(*) from d",
    "scalar_to_rgba": f"{_W}, x as (select c_custkey as i, coalesce(ln(1 + v), 0) as x from customer left join (select * from m where j = 7) on i = c_custkey), t as (select i, least(1.0, greatest(0.0, x / (select case when max(x) > 0 then max(x) else 1 end from x))) as t from x) select i, floor(255 * t + 0.5)::int as r, floor(64 + 120 * t + 0.5)::int as g, floor(255 * (1 - t) + 0.5)::int as b from t",
    "overdispersion_inputs": f"with t as ({_col_sql('ln(1 + v)', 'n')}) select * from t where nnz >= 3 and mean > 0 and var > 0",
    "overdispersion_trend": SQL_TREND,
    "group_stats_depth": f"{_W}, {SQL_G}, d as (select i, sum(v) as d from m group by i), x as (select g, j, ln(1 + v * 10000.0::double / d) as x from m join d using (i) join g using (i)) select g, j, round(sum(x), 6) as sum, round(sum(x * x), 6) as sumsq, count(*) as n_expr from x group by 1, 2",
    "navigators_built": f"""{_W}, {SQL_G}, {SQL_N}, c as (select g, row_number() over (order by g) - 1 as k from (select distinct g from g)), z as (select k, count(*)::double as n_g from g join c using (g) group by k),
s as (select k, j, sum(ln(1 + v)) as s, sum(ln(1 + v) * ln(1 + v)) as q, count(*) as e from m join g using (i) join c using (g) group by 1, 2),
f as (select z.k, p_partkey as j, n_g, coalesce(s, 0) as s, coalesce(q, 0) as q, coalesce(e, 0) as e, n from z cross join part cross join n left join s on s.k = z.k and s.j = p_partkey),
l as (select k, j, e, s / greatest(n_g, 1) - (sum(s) over (partition by j) - s) / greatest(n - n_g, 1) as lfc from f),
o as (select i, row_number() over (order by k, i) - 1 as p from g join c using (g))
select 'stats_segment_sum' as field, k as i, j, round(s, 5) as v from f union all select 'stats_segment_sumsq', k, j, round(q, 5) from f union all select 'stats_segment_nexpr', k, j, e::double from f
union all select 'markers_segment_lfc', j, k, round(lfc, 5) from l union all select 'markers_segment_padj', j, k, round(least(1.0, greatest(1e-12, exp(-abs(lfc * sqrt(e + 1))))), 5) from l
union all select 'counts_cellmajor_order', i, null, p::double from o union all select 'counts_cellmajor', p, j, round(v, 5) from m join o using (i)""",
    "navigators_two_groupings": f"""{_W}, {SQL_N}, y as (select c_custkey as i, 'segment' as o, c_mktsegment as g from customer union all select c_custkey, 'nation', lpad(c_nationkey::varchar, 2, '0') from customer),
c as (select o, g, row_number() over (partition by o order by g) - 1 as k from (select distinct o, g from y)), z as (select o, k, count(*)::double as n_g from y join c using (o, g) group by 1, 2),
s as (select o, k, j, sum(ln(1 + v)) as s, count(*) as e from m join y using (i) join c using (o, g) group by 1, 2, 3),
f as (select o, z.k, p_partkey as j, n_g, coalesce(s, 0) as s, coalesce(e, 0) as e, n from z cross join part cross join n left join s using (o, k) where coalesce(s.j, p_partkey) = p_partkey
  union all select z.o, z.k, p_partkey, n_g, 0, 0, n from z cross join part cross join n where exists (select 1 from s where s.o = z.o and s.k = z.k) and not exists (select 1 from s where s.o = z.o and s.k = z.k and s.j = p_partkey))
select 'stats_' || o || '_sum' as field, k as i, j, round(s, 5) as v from f union all select 'stats_' || o || '_nexpr', k, j, e::double from f
union all select 'markers_' || o || '_lfc', j, k, round(s / greatest(n_g, 1) - (sum(s) over (partition by o, j) - s) / greatest(n - n_g, 1), 5) from f""",
    "modality_placement": f"""{_W} select 'asia' as modality, 'cells' as axis, 'partial' as coverage, i, j, v from m join customer on c_custkey = i join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where r_name = 'ASIA'
union all select 'suppliers', 'cells.suppliers', 'full', l_suppkey, l_partkey, sum(l_quantity) from lineitem group by l_suppkey, l_partkey having sum(l_quantity) <> 0""",
    "label_dictionary": "with l as (select o_orderkey as i, o_orderpriority || ' ' || o_custkey as label from orders), d as (select label, row_number() over (order by label) - 1 as code from (select distinct label from l)) select i, code, label from l join d using (label)",
    "columns_typed": """with o as (select *, case when o_orderpriority <> '1-URGENT' then o_orderpriority end as o_priority from orders)
select 'o_custkey' as field, 'measure' as role, 'dense' as encoding, 'raw' as state, false as nullable, count(o_custkey) as n from o
union all select 'o_totalprice', 'measure', 'dense', case when bool_and(abs(o_totalprice - round(o_totalprice)) <= 1e-6 + 1e-5 * abs(round(o_totalprice))) then 'raw' else 'lognorm' end, false, count(o_totalprice) from o
union all select 'o_orderstatus', 'label', 'utf8', null, false, count(o_orderstatus) from o union all select 'o_orderdate', 'label', 'utf8', null, false, count(o_orderdate) from o
union all select 'o_orderpriority', 'label', 'utf8', null, false, count(o_orderpriority) from o union all select 'o_priority', 'label', 'utf8', null, count(o_priority) < count(*), count(o_priority) from o""",
    "ranked_records": f"{_W}, {SQL_G}, s as (select g, j, sum(v) as score from m join g using (i) group by 1, 2) select g, j, score from s qualify row_number() over (partition by g order by score desc, j) <= 20",
    "props_promoted": "select event_id, (props ->> '$.k')::bigint as k, null::varchar as rest from events",
    "tail_promoted": f"""{_W}, {SQL_G}, c as (select g, row_number() over (order by g) - 1 as k from (select distinct g from g)), s as (select g, j, sum(v) as s from m join g using (i) group by 1, 2),
t as (select k, j, s, row_number() over (partition by g order by s desc, j) as r from s join c using (g))
select 'de.segment.score' as field, k as i, j, s::bigint::varchar as v from t where r <= 20 union all select 'segment_colors', k, null, '#' || md5(g)[1:6] from c union all select 'tail note', null, null, '{{"a":1}}'""",
    "validate_rules": f"""{_W}, {SQL_G}, c as (select g, row_number() over (order by g) - 1 as k from (select distinct g from g)), t as (
select 'far' as field, 'position' as rule, 'ERROR' as severity, count(*) as n from m where j + 10 >= (select count(*) from part)
union all select 'fewer', 'length', 'ERROR', (select count(*) from customer) - count(*) from g where g = 'BUILDING'
union all select 'three', 'code', 'ERROR', count(*) from g join c using (g) where k >= 3
union all select 'again', 'repeated_index', 'WARN', count(*) - count(distinct o_custkey) from orders) select * from t where n > 0 union all select 'lost', 'span_unknown', 'ERROR', 0""",
    "cell_order_hilbert": """with recursive e as (select vec_id as i, label as g, embedding[1]::double as x, embedding[2]::double as y from embeddings), b as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from e),
h(i, g, x, y, d, s) as (select i, g, least(1023, greatest(0, floor((x - x0) / case when x1 > x0 then x1 - x0 else 1 end * 1023)))::bigint, least(1023, greatest(0, floor((y - y0) / case when y1 > y0 then y1 - y0 else 1 end * 1023)))::bigint, 0::bigint, 512::bigint from e cross join b
union all select i, g, case when ry = 1 then x when rx = 1 then 1023 - y else y end, case when ry = 1 then y when rx = 1 then 1023 - x else x end, d + s * s * xor(3 * rx, ry), s // 2 from (select *, ((x & s) > 0)::bigint as rx, ((y & s) > 0)::bigint as ry from h where s > 0))
select i, row_number() over (order by g nulls last, d, i) - 1 as new_pos from h where s = 0""",
    "graph_degree": "with e as (select o_custkey as src, l_suppkey as dst, sum(l_quantity) as w from lineitem join orders on l_orderkey = o_orderkey group by 1, 2) select src, count(*) as degree, sum(w) as weight from e group by src",
    "passthrough_json": "select event_id, props ->> '$.k' as k from events",
    "additive_stats": "select event_type as g, user_id as j, round(sum(value), 4) as sum, round(sum(value * value), 4) as sumsq, count(*) as n_expr from events where value <> 0 group by 1, 2",
    "uniqueness": "select l_orderkey || '-' || l_linenumber as key, count(*) as n from lineitem group by 1 having count(*) > 1",
}

ORACLE |= {"stored_gene_expression": ORACLE["gene_expression_zero_filled"], "stored_col_stats": ORACLE["col_stats_lognorm"], "stored_row_depth": ORACLE["row_depth"], "stored_gene_range": ORACLE["gene_range"]}

QUERIES = {
    f.__name__: f
    for f in (group_stats, group_stats_grid, group_stats_depth, total_sum, row_depth, group_sizes, pseudobulk_mean_frac, markers_1vs_rest, markers_top_n, rank_by_score, de_a_vs_b, hvg_top_k)
    + (gene_column, cell_row, gene_range, row_block, gene_gather_with_duplicates, cell_gather, gene_expression_zero_filled, gene_expression_max, crossfilter_cat_range)
    + (partial_coverage_left, partial_coverage_inner, nullable_mask, factor_axis_induce, utf8_first_seen_codes, collection_union_axis, collection_pseudobulk, collection_flatten, collection_sizes)
    + (set_union, set_intersect, set_except, state_inference, stride_sample, window_sample, capped_groups, dense_posexplode, embedding_extent, cell_order_cluster_only, cell_order_hilbert)
    + (grid_cells, row_reorder, transposed, flat_positions, validate_issues, validate_rules, navigators_built, navigators_two_groupings, props_promoted, tail_promoted, modality_placement, label_dictionary, columns_typed, ranked_records, stored_gene_expression, stored_col_stats, stored_row_depth, stored_gene_range, scalar_to_rgba, overdispersion, overdispersion_inputs, overdispersion_trend, graph_degree, passthrough_json, additive_stats, uniqueness)
} | {
    "col_stats_raw": _col_stats(),
    "col_stats_lognorm": _col_stats(lognorm=True),
    "col_stats_depth": _col_stats(lognorm=True, depth=True, scale=1e4),
    "col_stats_population": _col_stats(population=True),
}
