"""Indexes as declared constraints. Lookups need none: Parquet statistics prune by any column."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import canonical, field


def fields_of(fields: str | list[str]) -> list[str]:
    """Field names, given as a list or joined by a plus."""
    return fields.split("+") if isinstance(fields, str) else list(fields)


def overlap(a: str, b: str) -> bool:
    """Whether one of two paths holds the other."""
    return a == b or a.startswith(b + ".") or b.startswith(a + ".")


def definition(fields: str | list[str], unique: bool = False, sparse: bool = False, name: str | None = None) -> dict[str, Any]:
    cols = [fields] if isinstance(fields, str) else list(fields)
    return {"name": name or "idx_" + "_".join(cols), "fields": cols, "unique": unique, "sparse": sparse}


def keys(df: DataFrame, index: dict[str, Any]) -> tuple[list[Column], Column]:
    """(key columns, whether a row takes part). Values are compared with their type; null is a value. A single field
    that is missing takes no part, nor does a compound key without a single member; a sparse compound key needs all."""
    parts = [field(df.schema, p) for p in index["fields"]]
    cols = [canonical(f.variant()) if f.kind in ("variant", "array", "object") else f.col for f in parts]
    there = [~f.missing for f in parts]
    many = len(parts) > 1 and not index["sparse"]
    return cols, reduce((lambda a, b: a | b) if many else (lambda a, b: a & b), there)


def violations(df: DataFrame, index: dict[str, Any]) -> DataFrame:
    """(k0, k1, ..., n): the keys that more than one row has. Counts are summed before the shuffle."""
    cols, there = keys(df, index)
    named = [c.alias(f"k{i}") for i, c in enumerate(cols)]
    return df.where(there).select(*named).groupBy(*[f"k{i}" for i in range(len(cols))]).agg(F.count("*").alias("n")).where("n > 1")


def touched(base: DataFrame, batch: DataFrame, index: dict[str, Any]) -> DataFrame:
    """Rows of base that share a key with the batch: all that can clash with it."""
    cols, there = keys(batch, index)
    wanted = batch.where(there).select(*[c.alias(f"b{i}") for i, c in enumerate(cols)]).distinct()
    own, _ = keys(base, index)
    same = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(f"b{i}")) for i, c in enumerate(own)])
    return base.join(wanted, same, "left_semi")


