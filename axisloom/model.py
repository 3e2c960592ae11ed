"""Data model: a dataset is named, ordered axes and typed fields over one to three of them.

Everything is a DataFrame in long form; the handles here hold only plans and metadata.

==============  ==========================================  =======================================
axis            ``(pos BIGINT, label STRING)``              position is data, never row order
label, scalar   ``(i, v)``                                  null = masked or missing category
measure         ``(i, j, v)``                               an absent row is an implicit zero
embedding       ``(i, vec ARRAY)``                          dense rows
tensor          ``(i, j, k, v)``
==============  ==========================================  =======================================

Four kinds of "missing" stay apart: an implicit zero (absent row of a full field), NaN (a value),
null (masked), and absence under partial coverage (``coverage="partial"``, absent row).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field as _field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The core vocabularies. Others are allowed and give a warning on validation.
ROLES = ("measure", "embedding", "loading", "relation", "label", "sequence", "design", "transform", "vector", "probability", "coordinate", "factor")
STATES = ("raw", "lognorm", "scaled", "clr", "permutation")
KEYS = ("i", "j", "k")
# A label with more categories than both this share of its rows and this number induces no axis.
ID_SHARE, ID_LEAST = 0.5, 100


@dataclass
class Axis:
    name: str
    df: DataFrame
    length: int
    origin: str = "observed"
    role: str = "observation"
    induced_by: str | None = None
    provenance: dict = _field(default_factory=dict)


@dataclass
class Field:
    name: str
    df: DataFrame
    span: tuple[str, ...]
    role: str
    encoding: str
    state: str | None = None
    shape: tuple[int, ...] = ()
    subtype: str | None = None
    coverage: str = "full"
    index_axis: str | None = None
    directed: bool | None = None
    weighted: bool | None = None
    uncertainty: str | None = None
    nullable: bool = False
    categories: tuple[str, ...] | None = None
    ordered: bool = False
    provenance: dict = _field(default_factory=dict)

    @property
    def keys(self) -> list[str]:
        return [k for k in KEYS if k in self.df.columns]


def axis_frame(spark: SparkSession, labels: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(map(str, labels))), "pos long, label string")


class Dataset:
    """A handle over axes and fields, with the profiles that wrote it, what was dropped, and untyped leftovers (``aux``)."""

    def __init__(self, spark: SparkSession, kind: str = "sample"):
        self.spark, self.kind = spark, kind
        self.axes: dict[str, Axis] = {}
        self.fields: dict[str, Field] = {}
        self.profiles: list[str] = []
        self.dropped: list[str] = []
        self.aux: dict[str, Any] = {}
        self.leaves: DataFrame | None = None  # chunks of the array leaves that aux refers to

    def add_axis(self, name: str, labels: DataFrame | list[str], length: int | None = None, **meta: Any) -> Axis:
        df = axis_frame(self.spark, labels) if isinstance(labels, list) else labels.select(F.col("pos").cast("long"), F.col("label").cast("string"))
        if length is None:
            length = len(labels) if isinstance(labels, list) else df.count()
        self.axes[name] = Axis(name, df, length, **meta)
        return self.axes[name]

    def axis(self, name: str) -> Axis:
        return self.axes[name]

    def field(self, name: str) -> Field:
        return self.fields[name]

    def fields_over(self, axis: str, role: str | None = None) -> list[Field]:
        return [f for f in self.fields.values() if axis in f.span and (role is None or f.role == role)]

    def add_field(self, name: str, df: DataFrame, span: tuple[str, ...] | None = None, shape: tuple[int, ...] | None = None, induce: bool = True, **meta: Any) -> Field:
        """Infers span, role and encoding where they aren't given. A categorical induces its factor axis."""
        span = tuple(span or self.infer_span(df, shape))
        encoding = meta.pop("encoding", None) or infer_encoding(df, meta.get("categories"))
        role = meta.pop("role", None) or infer_role(df, span, self)
        if role == "measure" and "state" not in meta:
            meta["state"] = infer_state(df)
        shape = shape or tuple(self.axes[a].length for a in span if a in self.axes)
        f = Field(name, df, span, role, encoding, shape=tuple(shape), **meta)
        self.fields[name] = f
        if induce and f.categories is not None and len(span) == 1:
            n, k = self.axes[span[0]].length, len(f.categories)
            # Categories for more than half of the rows, and many of them, name rows rather than group them. A clash of names is left to validation.
            if not (k > ID_SHARE * n and k > ID_LEAST) and (name not in self.axes or self._same_labels(name, f.categories)):
                self.induce(name)
        return f

    def add_columns(self, df: DataFrame, axis: str, pos: str = "pos") -> list[Field]:
        """A field for each column of a table over an axis, typed by the schema: numbers are measures, strings, booleans and dates labels.
        A column that holds a null (not a NaN) is nullable. One aggregate looks at all columns."""
        columns = [f for f in df.schema.fields if f.name != pos]
        plain = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
        odd = [f.name for f in columns if not isinstance(f.dataType, plain)]
        if odd:
            raise ValueError(f"columns {odd} are of no type that a field of one axis may have")
        seen = df.agg(F.count(F.lit(1)).alias("_rows"), *(F.count_if(F.col(f"`{f.name}`").isNull()).alias(f.name) for f in columns)).first().asDict() if columns else {}
        out = []
        for f in columns:
            number = isinstance(f.dataType, T.NumericType)
            value = F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.col(f"`{f.name}`")
            frame = df.select(F.col(pos).cast("long").alias("i"), value.alias("v"))
            out.append(self.add_field(f.name, frame, span=(axis,), role="measure" if number else "label", nullable=bool(seen[f.name])))
        return out

    def provenance(self, path: str | None = None) -> DataFrame:
        """(field, provenance) as JSON; with a JSON path such as $.de_factor what stands there, for the fields that have it."""
        df = self.spark.createDataFrame([(n, json.dumps(f.provenance, sort_keys=True)) for n, f in self.fields.items()], "field string, provenance string")
        return df if path is None else df.select("field", F.get_json_object("provenance", path).alias("value")).where("value is not null")

    def add_labels(self, name: str, df: DataFrame, span: str, **meta: Any) -> Field:
        """A label (i, v) as codes of a factor axis of its own, which is its dictionary: for any number of labels, none on the driver."""
        from .operators.access import encoded

        codes, levels = encoded(df)
        self.add_axis(name, levels, origin="derived", role="factor", induced_by=name)
        return self.add_field(name, codes, span=(span,), role="label", encoding="categorical", induce=False, **meta)

    def _same_labels(self, axis: str, labels: tuple[str, ...]) -> bool:
        a = self.axes[axis]
        return a.length == len(labels) and [r[0] for r in a.df.orderBy("pos").select("label").collect()] == list(labels)

    def induce(self, field: str) -> Axis:
        """The factor axis of a categorical field: its categories in order. An axis of that name must have the same labels."""
        f = self.fields[field]
        if f.categories is None:
            raise ValueError(f"field '{field}' has no categories to induce an axis from")
        if field in self.axes:
            if not self._same_labels(field, f.categories):
                raise ValueError(f"axis '{field}' exists with other labels")
            self.axes[field].induced_by = self.axes[field].induced_by or field
            return self.axes[field]
        return self.add_axis(field, list(f.categories), origin="derived", role="factor", induced_by=field)

    def infer_span(self, df: DataFrame, shape: tuple[int, ...] | None = None) -> tuple[str, ...]:
        """Matches each dimension's length to exactly one axis."""
        if shape is None:
            if "vec" in df.columns:
                r = df.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
                shape = (r[0], r[1] or 0)
            elif "j" not in df.columns:
                shape = (df.count(),)
            else:
                raise ValueError("a sparse field needs its span or its shape: absent rows don't tell the lengths")
        span = []
        for n in shape:
            fits = [a.name for a in self.axes.values() if a.length == n]
            if len(fits) != 1:
                raise ValueError(f"length {n} matches {len(fits)} axes: {fits}")
            span.append(fits[0])
        return tuple(span)

    def table(self, axis: str) -> DataFrame:
        """All fields of arity one over an axis beside its labels (the obs / var view)."""
        out = self.axes[axis].df
        for f in self.fields.values():
            if f.span == (axis,):
                out = out.join(f.df.select(F.col("i").alias("pos"), F.col("v").alias(f.name)), "pos", "left")
        return out

    def manifest(self) -> DataFrame:
        rows = [(f.name, f.role, list(f.span), f.state, f.encoding, f.subtype, f.coverage, f.index_axis, f.directed, f.weighted, f.nullable, f.uncertainty, list(f.shape)) for f in self.fields.values()]
        return self.spark.createDataFrame(rows, "field string, role string, span array<string>, state string, encoding string, subtype string, coverage string, index_axis string, directed boolean, weighted boolean, nullable boolean, uncertainty string, shape array<bigint>")


def infer_encoding(df: DataFrame, categories: tuple | None = None) -> str:
    if categories is not None:
        return "categorical"
    if "vec" in df.columns or "k" in df.columns:
        return "dense"
    if "j" in df.columns:
        return "coo"
    return "utf8" if isinstance(df.schema["v"].dataType, T.StringType) else "dense"


def infer_role(df: DataFrame, span: tuple[str, ...], ds: Dataset) -> str:
    if len(span) == 2 and span[0] == span[1]:
        return "relation"
    if "vec" in df.columns:
        return "embedding"
    if len(span) == 1:
        return "label" if isinstance(df.schema["v"].dataType, (T.StringType, T.BooleanType)) else "measure"
    return "measure"


def state_of(lo: float | None, whole: bool | None) -> str:
    return "scaled" if lo is not None and lo < -1e-6 else "raw" if whole or lo is None else "lognorm"


def state_columns(v: str = "v") -> list:
    """One-row aggregate behind the state: least finite value, and whether all are near an integer (absolute 1e-6 and relative 1e-5)."""
    x = F.when(~F.isnan(F.col(v).cast("double")) & (F.abs(F.col(v).cast("double")) < float("inf")), F.col(v).cast("double"))
    return [F.min(x).alias("lo"), F.coalesce(F.every(F.abs(x - F.rint(x)) <= 1e-6 + 1e-5 * F.abs(F.rint(x))), F.lit(True)).alias("whole")]


def infer_state(df: DataFrame) -> str:
    """raw, lognorm or scaled by content."""
    if "vec" in df.columns:
        df = df.select(F.explode("vec").alias("v"))
    r = df.agg(*state_columns()).first()
    return state_of(r["lo"], r["whole"])


def as_categorical(df: DataFrame, v: str = "v", categories: list[str] | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """(i, v) -> (i, code) and the category list: sorted by code point unless given. Null and unlisted values have a
    null code. The list is metadata and stays on the driver; rows get their codes by a join."""
    value = F.col(v).cast("string")
    if categories is None:
        categories = [r[0] for r in df.select(value.alias("c")).where("c is not null").distinct().orderBy("c").collect()]
    codes: dict[str, int] = {}
    for at, c in enumerate(categories):
        codes.setdefault(c, at)
    table = df.sparkSession.createDataFrame(pa.table({"_c": pa.array(codes, pa.string()), "_at": pa.array(codes.values(), pa.int32())}))
    return df.select("i", value.alias("_c")).join(table, "_c", "left").select("i", F.col("_at").alias("v")), tuple(categories)
