"""Queries: criteria, order, skip, limit and projection, applied in that order."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocumentError
from ..functions.fields import DOC, field
from . import criteria as C

#: Order of insertion, the tie-break of every sort, where a collection has it.
POSITION = "_pos"
#: Rows to pass over from which they are counted, and the ranges of a count.
DEEP, BINS = 10_000, 1024


@dataclass(frozen=True)
class Query:
    """Immutable; every method returns a new query."""

    criteria: Any = None
    order: tuple[tuple[str, int], ...] = ()
    skipped: int = 0
    limited: int | None = None
    fields: tuple[str, ...] = ()
    excluded: bool = False

    def sort(self, keys: dict[str, int]) -> "Query":
        for path, way in keys.items():
            if way not in (1, -1):
                raise DocumentError(f"Sort direction of {path} must be 1 or -1", "DOC009", field=path)
        return replace(self, order=tuple(keys.items()))

    def skip(self, n: int) -> "Query":
        return replace(self, skipped=max(0, int(n)))

    def limit(self, n: int | None) -> "Query":
        if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 0):
            raise DocumentError("Limit must be a number from 0", "DOC009", value=repr(n))
        return replace(self, limited=n)

    def select(self, fields: list[str] | dict[str, int]) -> "Query":
        """A list of fields, {field: 1} to keep or {field: 0} to leave out."""
        if isinstance(fields, dict):
            kept = {bool(v) for v in fields.values()}
            if len(kept) > 1:
                raise DocumentError("A projection either keeps or leaves out", "DOC009")
            return replace(self, fields=tuple(fields), excluded=kept == {False})
        return replace(self, fields=tuple(fields), excluded=False)

    def matches(self, schema: T.StructType) -> Column:
        """Whether a document matches, as a column."""
        return C.matches(self.criteria, schema)

    def filtered(self, df: DataFrame) -> DataFrame:
        tree = C.parse(self.criteria)
        return df if tree == C.All(()) else df.where(C.where(self.criteria, df.schema))

    def ordered(self, df: DataFrame) -> DataFrame:
        """In sort order; with a skip or limit and no sort, in order of position."""
        keys = [k for path, way in self.order for k in sort_keys(df.schema, path, way)]
        if POSITION in df.columns and (keys or self.skipped or self.limited is not None):
            keys.append(F.col(POSITION).asc())
        return df.orderBy(*keys) if keys else df

    def execute(self, df: DataFrame) -> DataFrame:
        """Lazy, but for a skip from DEEP on: what it passes over is counted first, and never sorted."""
        out = self.filtered(df)
        deep = self.skipped >= DEEP and self.order and self.limited != 0
        cut = past(out, *self.order[0], self.skipped) if deep else None
        if cut is None:
            out = self.ordered(out)
            if self.skipped:
                out = out.offset(self.skipped)
        else:
            some, skip, rest = cut
            out = self.ordered(self.ordered(some).offset(skip).unionByName(rest))
        if self.limited is not None:
            out = out.limit(self.limited)
        return project(out, self.fields, self.excluded) if self.fields else out


def past(df: DataFrame, path: str, way: int, skip: int) -> tuple[DataFrame, int, DataFrame] | None:
    """(rows, rows of these to pass over, rows that all come after): what is left after a skip in the order of a field,
    the first rows being few or equal in it. None for fields that are no number or date.

    The field's range is cut into BINS, the bin that holds the place into as many again, and so on: each turn counts one
    column, and a row for each bin comes to the driver."""
    f = field(df.schema, path)
    if f.kind == "number":
        place = f.col.cast("double")
    elif f.kind == "date":
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), f.col) if isinstance(f.dtype, T.TimestampNTZType) else F.unix_micros(f.col.cast("timestamp"))
        place = micros.cast("double")
    else:
        return None
    key, there = f.col, f.col.isNotNull()
    ends = [F.min(key).alias("lo"), F.max(key).alias("hi"), F.min(place).alias("a"), F.max(place).alias("b")]
    at = df.agg(F.count_if(~there).alias("nulls"), F.count(key).alias("n"), F.count_if(F.isnan(place)).alias("odd"), *ends).first()
    if at["odd"]:
        return None
    none = df.where(F.lit(False))
    if way == 1 and skip < at["nulls"]:
        return df.where(~there), skip, df.where(there)
    if way == -1 and skip >= at["n"]:
        return df.where(~there), skip - at["n"], none
    skip -= at["nulls"] if way == 1 else 0
    if skip >= at["n"]:
        return none, 0, none
    while at["n"] > DEEP and at["a"] < at["b"]:
        width = (at["b"] - at["a"]) / BINS
        inside = df.where(key.between(F.lit(at["lo"]), F.lit(at["hi"])))
        bins = inside.groupBy(F.floor((place - F.lit(at["a"])) / F.lit(width)).alias("bin")).agg(F.count("*").alias("n"), *ends).collect()
        before = at
        for at in sorted(bins, key=lambda r: way * r["bin"]):
            if skip < at["n"]:
                break
            skip -= at["n"]
        if at["n"] == before["n"]:
            break
    lo, hi = F.lit(at["lo"]), F.lit(at["hi"])
    rest = df.where(key > hi) if way == 1 else df.where((key < lo) | ~there)
    return df.where(key.between(lo, hi)), skip, rest


def sort_keys(schema: T.StructType, path: str, way: int) -> list[Column]:
    """Missing values come first in ascending and last in descending order. Variants sort by number (dates by their
    instant), then by text."""
    f = field(schema, path)
    if f.kind == "missing":
        return []
    if f.kind == "variant":
        number = F.when(f.is_number(), f.number()).when(f.is_boolean(), F.try_variant_get(f.col, "$", "boolean").cast("int").cast("double")).when(f.is_date(), f.instant().cast("double"))
        cols = [f.missing | f.is_null(), number, F.when(f.shape == "STRING", f.text())]
        cols[0] = ~F.coalesce(cols[0], F.lit(True))
    else:
        cols = [f.col]
    return [c.asc_nulls_first() if way == 1 else c.desc_nulls_last() for c in cols]


def _tree(paths: tuple[str, ...]) -> dict:
    """Paths as nested dictionaries; a whole field covers its parts."""
    out: dict = {}
    for path in paths:
        at = out
        parts = path.split(".")
        for p in parts[:-1]:
            nxt = at.setdefault(p, {})
            if nxt is None:
                break
            at = nxt
        else:
            at[parts[-1]] = None
    return out


def project(df: DataFrame, paths: tuple[str, ...], excluded: bool = False) -> DataFrame:
    """Keeps (or leaves out) fields. Dotted paths rebuild nested objects; unknown fields are passed over."""
    tree = _tree(paths)
    if isinstance(df.schema[DOC].dataType if DOC in df.columns else None, T.VariantType):
        typed = [c for c in df.columns if c != DOC]
        keep = [c for c in typed if c == POSITION or (c in tree) != excluded]
        part = drop_variant(F.col(DOC), tree) if excluded else pick_variant(F.col(DOC), tree)
        return df.select(*keep, part.alias(DOC))
    if excluded:
        cols = [(_drop(F.col(f"`{f.name}`"), f.dataType, tree[f.name]) if f.name in tree else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields if not (f.name in tree and tree[f.name] is None)]
    else:
        types = {f.name: f.dataType for f in df.schema.fields}
        cols = [_pick(F.col(f"`{n}`"), types[n], sub).alias(n) for n, sub in tree.items() if n in types]
    return df.select(*cols)


def _pick(col: Column, t: T.DataType, tree: dict | None) -> Column:
    if tree is None:
        return col
    if isinstance(t, T.VariantType):
        return pick_variant(col, tree)
    if not isinstance(t, T.StructType):
        return F.lit(None)
    parts = [_pick(col.getField(n), t[n].dataType, sub).alias(n) for n, sub in tree.items() if n in t.names]
    return F.when(col.isNotNull(), F.struct(*parts)) if parts else F.lit(None)


def _drop(col: Column, t: T.DataType, tree: dict | None) -> Column:
    if isinstance(t, T.VariantType):
        return drop_variant(col, tree or {})
    if not isinstance(t, T.StructType) or tree is None:
        return col
    parts = [_drop(col.getField(n), t[n].dataType, tree.get(n)).alias(n) for n in t.names if not (n in tree and tree[n] is None)]
    return F.when(col.isNotNull(), F.struct(*parts))


def members(v: Column) -> Column:
    """An object variant as a map; NULL for anything else."""
    return v.try_cast("map<string,variant>")


def pick_variant(v: Column, tree: dict) -> Column:
    m = members(v)
    whole = [k for k, sub in tree.items() if sub is None]
    out = F.map_filter(m, lambda k, _: k.isin(whole) if whole else F.lit(False))
    for k, sub in tree.items():
        if sub is not None:
            child = F.try_element_at(m, F.lit(k))
            inner = pick_variant(child, sub)
            some = members(child).isNotNull() & (F.size(members(inner)) > 0)
            out = F.map_concat(out, F.when(F.coalesce(some, F.lit(False)), F.create_map(F.lit(k), inner)).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))))
    return F.to_variant_object(out)


def replaced(m: Column, key: str, new) -> Column:
    """A map with new(value) under a key."""
    return F.transform_values(m, lambda k, x: F.when(k == key, new(x)).otherwise(x))


def _drop_inside(x: Column, tree: dict) -> Column:
    return F.when(members(x).isNotNull(), drop_variant(x, tree)).otherwise(x)


def drop_variant(v: Column, tree: dict) -> Column:
    m = members(v)
    whole = [k for k, sub in tree.items() if sub is None]
    out = F.map_filter(m, lambda k, _: ~k.isin(whole)) if whole else m
    for k, sub in tree.items():
        if sub is not None:
            out = replaced(out, k, partial(_drop_inside, tree=sub))
    return F.coalesce(F.to_variant_object(out), v)
