"""Routing: where each field belongs in a cells-by-genes container with fixed slots, and what has no place there."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalar import strip_prefix
from ..model import Dataset, Field
from .navigators import counts_basis


def slot(f: Field, ds: Dataset, rows: str, columns: str) -> str | None:
    """Slot of a field in the obs / var / obsm / varm / obsp / varp / layers layout, by role, state and span; None if it has none."""
    span = tuple(f.span)
    if f.provenance.get("cache"):
        return None
    if f.provenance.get("slot"):
        return f.provenance["slot"]
    if f.role == "measure" and span == (rows, columns) and f.coverage == "full":
        lognorm = [x.name for x in ds.fields.values() if x.role == "measure" and tuple(x.span) == span and x.state == "lognorm"]
        primary = lognorm[0] if lognorm else counts_basis(ds).name
        return "X" if f.name == primary else f"layers/{f.name}"
    if f.role == "relation" and span in ((rows, rows), (columns, columns)):
        return f"{'obsp' if span[0] == rows else 'varp'}/{f.name}"
    if f.role in ("embedding", "coordinate", "probability") and span[:1] == (rows,):
        return f"obsm/X_{strip_prefix(f.name)}"
    if f.role == "loading" and span[:1] == (columns,):
        return f"varm/{f.name}"
    if span in ((rows,), (columns,)):
        return f"{'obs' if span == (rows,) else 'var'}/{f.name}"
    if len(span) == 1 and f.role in ("measure", "vector"):
        return f"uns/{span[0]}/{f.name}"
    return None


def routed(ds: Dataset, rows: str = "cells", columns: str = "genes") -> DataFrame:
    """(field, slot) of every field; fields without a slot are recorded in ``dropped`` too."""
    made = [(f.name, slot(f, ds, rows, columns)) for f in ds.fields.values()]
    for name, to in made:
        if to is None and f"fields/{name}" not in ds.dropped:
            ds.dropped.append(f"fields/{name}")
    return ds.spark.createDataFrame(made, "field string, slot string")


def facets(ds: Dataset) -> DataFrame:
    """(embedding, loading, axis): pairs that share a coordinate axis, so that the one explains the other."""
    m = ds.manifest().selectExpr("field", "role", "span", "element_at(span, -1) as axis").where("size(span) = 2")
    a, b = m.where("role = 'embedding'").selectExpr("field as embedding", "axis"), m.where("role = 'loading'").selectExpr("field as loading", "axis")
    return a.join(b, "axis").select("embedding", "loading", "axis")
