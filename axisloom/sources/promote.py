"""Promotion: typed fields out of untyped documents, and back.

The untyped tail of a dataset is a frame ``(key, doc VARIANT)``. Rules look at each document's schema and bind what they know to axes:
palettes to a factor axis, variances to a coordinate axis, square entry lists to a relation, ranked records to a bundle over factor and
features. What became a field leaves the tail; all else stays there as it was. Only schemas and lengths, one row a key, reach the driver; values are
exploded and joined to labels by the cluster. ``demoted`` rebuilds the documents from the fields.

For a column of documents, one a row, ``promoted_columns`` does the same by key: scalars whose type all documents
agree on become columns, and whatever doesn't fit its key's type stays in the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Dataset
from ..plans.navigators import de_bundle, de_factors, de_field_name

# Names of the documents' format.
PALETTE_SUFFIX = "_colors"
VARIANCE_KEY, VARIANCES = "pca", {"variance": "pca_variance", "variance_ratio": "pca_variance_ratio"}
RANKED_KEY, RANKED_STATS = "rank_genes_groups", {"scores": "score", "logfoldchanges": "lfc", "pvals": "pval", "pvals_adj": "padj"}
#: Keys of an entry list: shape, and positions and values of equal length.
ENTRY_KEYS = ("shape", "row", "col", "data")


def as_variant(text: Column) -> Column:
    """A JSON text as VARIANT; text that isn't JSON is a string."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def _keys(doc: Column) -> Column:
    return F.try_variant_get(doc, "$", "map<string,variant>")


def _without(doc: Column, keys: list[str]) -> Column:
    return F.to_variant_object(F.map_filter(_keys(doc), lambda k, _: ~k.isin(keys)))


def scalar_keys(df: DataFrame, column: str) -> dict[str, str]:
    """Keys that hold scalars of one type in all documents, with that type."""
    found = df.where(_keys(F.col(column)).isNotNull()).agg(F.schema_of_variant_agg(column)).first()[0]
    if not found or not found.startswith("OBJECT<"):
        return {}
    kind = T.DataType.fromDDL(found.replace("OBJECT<", "STRUCT<"))
    plain = (T.LongType, T.DoubleType, T.DecimalType, T.StringType, T.BooleanType, T.DateType, T.TimestampType)
    return {f.name: f.dataType.simpleString() for f in kind.fields if isinstance(f.dataType, plain) and "'" not in f.name}


def promoted_columns(df: DataFrame, column: str, types: dict[str, str] | None = None, rest: str = "rest") -> DataFrame:
    """df with a column for each scalar key of the documents in place of ``column``, and what is left of each in ``rest`` (null if nothing).
    A value that isn't of its key's type, an explicit null among them, stays in the rest, so nothing is lost."""
    types = scalar_keys(df, column) if types is None else types
    value = {k: F.try_variant_get(F.col(column), f"$['{k}']", t) for k, t in types.items()}
    taken = F.array_compact(F.array(*[F.when(v.isNotNull(), F.lit(k)) for k, v in value.items()])) if value else F.array().cast("array<string>")
    left = F.map_filter(_keys(F.col(column)), lambda k, _: ~F.array_contains(taken, k))
    left = F.when(_keys(F.col(column)).isNull(), F.col(column)).when((F.size(taken) == 0) | (F.size(left) > 0), F.to_variant_object(left))
    own = [c for c in df.columns if c != column]
    clash = {*types, rest} & set(own)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    return df.select(*own, *(v.alias(k) for k, v in value.items()), left.alias(rest))


def _series(tail: DataFrame, key: str, path: str, kind: str) -> DataFrame:
    """(i, v) of an array in a document."""
    return tail.where(F.col("key") == key).select(F.posexplode(F.try_variant_get("doc", path, f"array<{kind}>")).alias("i", "v")).withColumn("i", F.col("i").cast("long"))


def _described(tail: DataFrame) -> dict[str, dict]:
    """Of each key what the rules ask for: no values."""
    doc = F.col("doc")
    size = lambda path, kind: F.size(F.try_variant_get(doc, path, f"array<{kind}>"))
    cols = {"strings": size("$", "string"), "shape": F.try_variant_get(doc, "$.shape", "array<long>"), "factor": F.try_variant_get(doc, "$.params.groupby", "string")}
    cols |= {"reference": F.coalesce(F.try_variant_get(doc, "$.params.reference", "string"), F.lit("rest")), "raw": F.try_variant_get(doc, "$.params.use_raw", "boolean"), "method": F.try_variant_get(doc, "$.params.method", "string")}
    cols |= {"entries": F.array(*(size(f"$.{k}", "double") for k in ENTRY_KEYS[1:])), "keys": F.map_keys(_keys(doc))} | {f"n_{k}": size(f"$.{k}", "double") for k in VARIANCES}
    cols |= {"groups": F.map_keys(F.try_variant_get(doc, "$.names", "map<string,variant>"))}
    return {r["key"]: r.asDict() for r in tail.select("key", *(c.alias(k) for k, c in cols.items())).collect()}


def promote(ds: Dataset, tail: DataFrame, rows: str = "cells", features: str = "genes") -> DataFrame:
    """Adds a field for all that the rules know to ds; returns what is left of the tail."""
    gone: dict[str, list[str] | None] = {}  # keys taken from a document, None for all of it
    for key, d in _described(tail).items():
        base = key.removesuffix(PALETTE_SUFFIX)
        if key != base and base in ds.axes and ds.axes[base].role == "factor" and d["strings"] == ds.axes[base].length:
            ds.add_field(key, _series(tail, key, "$", "string"), span=(base,), role="label", subtype="color", encoding="utf8", provenance={"tail": key})
            gone[key] = None
        elif key == VARIANCE_KEY and VARIANCE_KEY in ds.axes:
            gone[key] = [k for k in VARIANCES if d[f"n_{k}"] == ds.axes[VARIANCE_KEY].length]
            for k in gone[key]:
                ds.add_field(VARIANCES[k], _series(tail, key, f"$.{k}", "double"), span=(VARIANCE_KEY,), role="measure", state=None, subtype="pca_var", encoding="dense", provenance={"tail": f"{key}/{k}"})
        elif d["keys"] and set(d["keys"]) == set(ENTRY_KEYS) and len(d["shape"] or ()) == 2 and len({*d["entries"]}) == 1:
            axis = next((a for a in (rows, features) if a in ds.axes and d["shape"] == [ds.axes[a].length] * 2), None)
            if axis:
                ds.add_field(key, _entries(tail, key), span=(axis, axis), role="relation", subtype="tail_graph", encoding="coo", directed=True, weighted=True, provenance={"tail": key})
                gone[key] = None
        elif key == RANKED_KEY and d["factor"] and d["groups"] and d["reference"] == "rest":
            found = _ranked(ds, tail, d, f"{features}_raw" if d["raw"] and f"{features}_raw" in ds.axes else features)
            gone |= {key: None} if found else {}
    whole = [k for k, v in gone.items() if v is None]
    out = tail.where(~F.col("key").isin(whole)) if whole else tail
    for key, keys in gone.items():
        if keys:
            left = _without(F.col("doc"), keys)
            out = out.withColumn("doc", F.when(F.col("key") == key, left).otherwise(F.col("doc"))).where((F.col("key") != key) | (F.size(_keys(F.col("doc"))) > 0))
    return out


def _entries(tail: DataFrame, key: str) -> DataFrame:
    at = [F.try_variant_get("doc", f"$.{k}", f"array<{t}>").alias(k) for k, t in zip(ENTRY_KEYS[1:], ("long", "long", "double"))]
    one = tail.where(F.col("key") == key).select(F.explode(F.arrays_zip(*at)).alias("e"))
    return one.select(F.col("e.row").alias("i"), F.col("e.col").alias("j"), F.col("e.data").alias("v"))


def _ranked(ds: Dataset, tail: DataFrame, d: dict, features: str) -> list[str]:
    """Records ranked within groups as measures over (factor, features). A group that ranked a feature not at all has no row, which is partial coverage;
    groups and features that the axes don't know are left out."""
    stats = [k for k in RANKED_STATS if k in d["keys"]]
    factor = d["factor"]
    if features not in ds.axes or not stats:
        return []
    if factor not in ds.axes or ds.axes[factor].role != "factor":
        ds.add_axis(factor, list(d["groups"]), origin="derived", role="factor")
    doc = tail.where(F.col("key") == RANKED_KEY)
    arrays = [F.try_variant_get("doc", "$.names", "map<string,array<string>>").alias("names"), *(F.try_variant_get("doc", f"$.{k}", "map<string,array<double>>").alias(k) for k in stats)]
    one = doc.select(*arrays).select(F.explode(F.map_keys("names")).alias("group"), "names", *stats)
    one = one.select("group", F.explode(F.arrays_zip(*(F.try_element_at(c, F.col("group")).alias(c) for c in ("names", *stats)))).alias("e")).select("group", "e.*")
    at = one.join(ds.axes[factor].df.select(F.col("pos").alias("i"), F.col("label").alias("group")), "group").join(ds.axes[features].df.select(F.col("pos").alias("j"), F.col("label").alias("names")), "names")
    for k in stats:
        own = {"tail": RANKED_KEY, "de_factor": factor, "de_stat": RANKED_STATS[k], "reference": "rest", "method": d["method"], "use_raw": bool(d["raw"])}
        ds.add_field(de_field_name(factor, RANKED_STATS[k]), at.select("i", "j", F.col(k).alias("v")), span=(factor, features), role="measure", state=None, subtype="de", encoding="coo", coverage="partial", index_axis=features, provenance=own)
    return stats


def _document(key: str, frame: DataFrame, value: Column) -> DataFrame:
    return frame.agg(value.alias("doc")).select(F.lit(key).alias("key"), F.to_variant_object("doc").alias("doc"))


def _listed(v: str = "v") -> Column:
    return F.array_sort(F.collect_list(F.struct("i", v)))[v]


def demoted(ds: Dataset, tail: DataFrame) -> DataFrame:
    """The tail with the documents of all promoted fields again."""
    parts = []
    for f in ds.fields.values():
        source = f.provenance.get("tail")
        if f.subtype == "color":
            parts.append(_document(source, f.df, _listed()))
        elif f.subtype == "tail_graph":
            n = ds.axes[f.span[0]].length
            entries = F.array_sort(F.collect_list(F.struct("i", "j", "v")))
            parts.append(_document(source, f.df, F.struct(F.array(F.lit(n), F.lit(n)).alias("shape"), *(entries[c].alias(k) for k, c in zip(ENTRY_KEYS[1:], "ijv")))))
    for factor in de_factors(ds):
        bundle = {s: f for s, f in de_bundle(ds, factor).items() if f.provenance.get("tail") == RANKED_KEY}
        if bundle:
            parts.append(_records(ds, factor, bundle))
    found = {f.provenance["tail"].split("/")[1]: f for f in ds.fields.values() if f.subtype == "pca_var" and f.provenance.get("tail")}
    if found:
        lists = reduce(lambda a, b: a.crossJoin(b), [f.df.agg(_listed().alias(k)) for k, f in found.items()])  # one row each
        lists = lists.select(F.to_variant_object(F.struct(*found)).alias("new"))
        both = lists.crossJoin(tail.where(F.col("key") == VARIANCE_KEY).agg(F.first("doc").alias("old")))
        merged = F.to_variant_object(F.map_concat(F.coalesce(_keys(F.col("old")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), _keys(F.col("new"))))
        parts.append(both.select(F.lit(VARIANCE_KEY).alias("key"), merged.alias("doc")))
        tail = tail.where(F.col("key") != VARIANCE_KEY)
    return reduce(lambda a, b: a.unionByName(b), parts, tail)


def _records(ds: Dataset, factor: str, bundle: dict) -> DataFrame:
    """Ranks within each group by score (else by the first statistic), ties by position."""
    name = {v: k for k, v in RANKED_STATS.items()}
    first = next(iter(bundle.values()))
    by = "score" if "score" in bundle else next(iter(bundle))
    long = reduce(lambda a, b: a.unionByName(b), [f.df.select("i", "j", F.lit(s).alias("s"), F.col("v").cast("double").alias("v")) for s, f in bundle.items()])
    wide = long.groupBy("i", "j").agg(*(F.max(F.when(F.col("s") == s, F.col("v"))).alias(s) for s in bundle))
    wide = wide.join(ds.axes[factor].df.select(F.col("pos").alias("i"), F.col("label").alias("group")), "i").join(ds.axes[first.span[1]].df.select(F.col("pos").alias("j"), F.col("label").alias("name")), "j")
    group = F.array_sort(F.collect_list(F.struct((-F.col(by)).alias("rank"), "j", "name", *bundle)))
    rows = wide.groupBy("group").agg(group.alias("e"))
    maps = lambda c: F.map_from_entries(F.collect_list(F.struct("group", F.col(f"e.{c}"))))
    p = first.provenance
    params = F.struct(F.lit(factor).alias("groupby"), F.lit("rest").alias("reference"), F.lit(p.get("method")).alias("method"), F.lit(bool(p.get("use_raw"))).alias("use_raw"))
    return _document(RANKED_KEY, rows, F.struct(params.alias("params"), maps("name").alias("names"), *(maps(s).alias(name[s]) for s in bundle)))
