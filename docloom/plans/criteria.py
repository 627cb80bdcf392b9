"""Criteria: nested dictionaries of conditions on documents, compiled to one boolean column.

The language is two-valued: a condition on a missing field is false, its negation true. SQL is three-valued, so each
condition has two forms: one that is TRUE exactly where it holds, and one that is TRUE exactly where it does not.
Negation is pushed down to the conditions by De Morgan's laws, and no form wraps a plain comparison, so Spark still
pushes filters into the scan. Only a projected result (`matches`) is wrapped once, at the top.

Unknown operators, nested literals and malformed patterns are errors at once, before any row is read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocumentError
from ..functions import regex
from ..functions.fields import Field, canonical, field, iso, js_number, js_number_of, millis, variant_of

FIELD_OPERATORS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$regex", "$size", "$all")
_FLIP = {"$gt": "$lte", "$gte": "$lt", "$lt": "$gte", "$lte": "$gt"}
_COMPARE = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any_:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class Leaf:
    path: str
    op: str
    bound: Any
    options: str = ""


def _bad(operator: str, why: str = "Invalid query operator") -> DocumentError:
    return DocumentError(f"{why}: {operator}", "QUE002", operator=operator)


def parse(criteria: Any):
    """Criteria as a tree. None and {} hold for every document."""
    if criteria is None:
        return All(())
    if not isinstance(criteria, dict):
        raise DocumentError("Criteria must be an object", "DOC009", value=repr(criteria))
    parts: list = []
    for key, value in criteria.items():
        if key == "$and":
            parts.append(All(tuple(map(parse, value))) if isinstance(value, (list, tuple)) else Const(False))
        elif key == "$or":
            parts.append(Any_(tuple(map(parse, value))) if isinstance(value, (list, tuple)) else Const(False))
        elif key == "$not":
            parts.append(Not(parse(value)))
        elif key.startswith("$"):
            raise _bad(key)
        elif isinstance(value, dict):
            if not value:
                raise _bad(key, "An empty object is no condition")
            for op, bound in value.items():
                if op == "$options":
                    if "$regex" not in value:
                        raise _bad(op)
                    continue
                if op not in FIELD_OPERATORS:
                    raise _bad(op)
                options = value.get("$options", "") if op == "$regex" else ""
                if op == "$regex":
                    try:
                        regex.of(bound, options)
                    except ValueError as e:
                        raise _bad(op, str(e)) from None
                parts.append(Leaf(key, op, bound, options))
        elif isinstance(value, re.Pattern):
            parts.append(Leaf(key, "$regex", value))
        elif isinstance(value, (list, tuple)):
            raise _bad(key, "A list is no condition; use $eq, $in or $all")
        else:
            parts.append(Leaf(key, "$eq", value))
    return parts[0] if len(parts) == 1 else All(tuple(parts))


def where(criteria: Any, schema: T.StructType) -> Column:
    """For filters: TRUE exactly for the documents that match, else FALSE or NULL."""
    return _emit(parse(criteria), schema, True)


def matches(criteria: Any, schema: T.StructType) -> Column:
    """For projections: TRUE or FALSE."""
    return F.coalesce(where(criteria, schema), F.lit(False))


def _emit(node, schema: T.StructType, holds: bool) -> Column:
    if isinstance(node, Const):
        return F.lit(node.value == holds)
    if isinstance(node, Not):
        return _emit(node.part, schema, not holds)
    if isinstance(node, (All, Any_)):
        both = isinstance(node, All) == holds
        parts = [_emit(p, schema, holds) for p in node.parts]
        if not parts:
            return F.lit(both)
        return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), parts)
    f = field(schema, node.path)
    if node.op == "$ne":
        return _equal(f, node.bound, not holds)
    if node.op == "$nin":
        return _member(f, node.bound, not holds)
    if node.op == "$eq":
        return _equal(f, node.bound, holds)
    if node.op == "$in":
        return _member(f, node.bound, holds)
    if node.op == "$exists":
        there = bool(node.bound) == holds
        return ~f.missing if there else f.missing
    if node.op in _COMPARE:
        return _ordered(f, node.op, node.bound, holds)
    if node.op == "$regex":
        pattern = regex.of(node.bound, node.options)
        test = {"string": lambda: f.col.rlike(pattern), "variant": lambda: f.is_string() & f.text().rlike(pattern)}.get(f.kind)
    elif node.op == "$size":
        n = node.bound
        known = isinstance(n, (int, float)) and not isinstance(n, bool) and float(n).is_integer() and n >= 0
        test = {"array": lambda: f.col.isNotNull() & (F.size(f.col) == int(n)), "variant": lambda: f.is_array() & (F.size(f.elements()) == int(n))}.get(f.kind) if known else None
    else:
        test = _contains_all(f, node.bound)
    return _either(test() if test else F.lit(False), holds)


def _either(test: Column, holds: bool) -> Column:
    return test if holds else ~F.coalesce(test, F.lit(False))


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def literal(f: Field, bound: Any) -> Column | None:
    """The bound as a literal of a typed field's own kind; None if it can equal no value of it."""
    if f.kind == "number" and _is_number(bound) and not (isinstance(bound, float) and math.isnan(bound)):
        if isinstance(bound, int) and abs(bound) >= 2**63:
            return F.lit(float(bound))
        whole = isinstance(f.dtype, T.IntegralType) and isinstance(bound, float) and bound.is_integer() and abs(bound) < 2**63
        return F.lit(int(bound)) if whole else F.lit(bound)
    if f.kind == "string" and isinstance(bound, str):
        return F.lit(bound)
    if f.kind == "boolean" and isinstance(bound, bool):
        return F.lit(bound)
    if f.kind == "date" and isinstance(bound, date):
        text = iso(bound)
        if isinstance(f.dtype, T.TimestampType):
            return F.lit(text).cast("timestamp")
        return F.lit(text[:-1].replace("T", " ")).cast("timestamp_ntz")
    return None


def _equal(f: Field, bound: Any, holds: bool) -> Column:
    if f.kind == "missing":
        return F.lit(not holds)
    if f.kind == "variant":
        return _either(_same(f, bound), holds)
    lit = literal(f, bound)
    if lit is not None:
        return f.col == lit if holds else ~f.col.eqNullSafe(lit)
    if f.kind in ("array", "object") and isinstance(bound, (list, tuple, dict)):
        return _either(canonical(f.variant()) == canonical(variant_of(bound)), holds)
    return F.lit(not holds)


def _same(f: Field, bound: Any) -> Column:
    """Equality of a variant and a value: kinds must agree; objects and arrays compare deeply."""
    if bound is None:
        return f.is_null()
    if isinstance(bound, bool):
        return f.is_boolean() & (F.try_variant_get(f.col, "$", "boolean") == F.lit(bound))
    if _is_number(bound):
        if isinstance(bound, float) and math.isnan(bound):
            return F.lit(False)
        return f.is_number() & (f.number() == F.lit(float(bound)))
    if isinstance(bound, date):
        return f.is_date() & (f.instant() == F.lit(millis(bound)))
    if isinstance(bound, str):
        return (f.shape == "STRING") & (f.text() == F.lit(bound))
    shape = f.is_object() if isinstance(bound, dict) else f.is_array()
    return shape & (canonical(f.col) == canonical(variant_of(bound)))


def _same_as_any(f: Field, bounds: list[Any]) -> Column:
    """Equality of a variant and one of many values: one look-up a kind, whatever their number."""
    numbers, texts, tests = [], [], []
    for x in bounds:
        if _is_number(x) and not isinstance(x, bool):
            if not (isinstance(x, float) and math.isnan(x)):
                numbers.append(float(x))
        elif isinstance(x, str):
            texts.append(x)
        else:
            tests.append(_same(f, x))
    if numbers:
        tests.append(f.is_number() & f.number().isin(numbers))
    if texts:
        tests.append((f.shape == "STRING") & f.text().isin(texts))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _element(v: Column) -> Field:
    return Field("", "variant", v)


def _member(f: Field, bounds: Any, holds: bool) -> Column:
    if not isinstance(bounds, (list, tuple)):
        return F.lit(not holds)
    if f.kind == "missing" or not bounds:
        return F.lit(not holds)
    if f.kind == "variant":
        one = lambda e: _same_as_any(e, bounds)
        many = F.exists(f.elements(), lambda e: F.coalesce(one(_element(e)), F.lit(False)))
        return _either(F.when(f.is_array(), many).otherwise(one(f)), holds)
    if f.kind == "array":
        inner = Field("", _inner(f), F.lit(None), f.dtype.elementType)
        if inner.kind in ("array", "object", "variant"):
            wanted = [canonical(variant_of(x)) for x in bounds]
            return _either(F.exists(f.variant().cast("array<variant>"), lambda e: canonical(e).isin(wanted)), holds)
        wanted = [x for x in (literal(inner, b) for b in bounds) if x is not None]
        if not wanted:
            return F.lit(not holds)
        return _either(F.arrays_overlap(f.col, F.array(*wanted).cast(f.dtype)) if inner.kind != "number" else F.exists(f.col, lambda e: e.isin(wanted)), holds)
    wanted = [x for x in (literal(f, b) for b in bounds) if x is not None]
    if not wanted:
        if f.kind == "object":
            return reduce(lambda a, b: a | b if holds else a & b, [_equal(f, b, holds) for b in bounds])
        return F.lit(not holds)
    return f.col.isin(wanted) if holds else ~f.col.isin(wanted) | f.col.isNull()


def _held(elements: Column, x: Any) -> Column:
    return F.exists(elements, lambda e: F.coalesce(_same(_element(e), x), F.lit(False)))


def _holds(elements: Column, lit: Column) -> Column:
    return F.exists(elements, lambda e: e == lit)


def _inner(f: Field) -> str:
    from ..functions.fields import kind_of

    return kind_of(f.dtype.elementType)


def _contains_all(f: Field, bounds: Any):
    if not isinstance(bounds, (list, tuple)):
        return None
    if f.kind == "variant":
        held = [_held(f.elements(), x) for x in bounds]
        return lambda: reduce(lambda a, b: a & b, held, f.is_array())
    if f.kind != "array":
        return None
    inner = Field("", _inner(f), F.lit(None), f.dtype.elementType)
    tests = [f.col.isNotNull()]
    for x in bounds:
        if inner.kind in ("array", "object", "variant"):
            tests.append(_held(f.variant().cast("array<variant>"), x))
        elif (lit := literal(inner, x)) is None:
            return None
        else:
            tests.append(F.array_contains(f.col, lit.cast(f.dtype.elementType)) if inner.kind != "number" else _holds(f.col, lit))
    return lambda: reduce(lambda a, b: a & b, tests)


def _ordered(f: Field, op: str, bound: Any, holds: bool) -> Column:
    """Relational operators: both sides of one kind compare as such, otherwise as numbers."""
    test = _COMPARE[op]
    if f.kind == "variant":
        return _either(_ordered_variant(f, test, bound), holds)
    lit = literal(f, bound)
    if lit is not None and f.kind != "boolean":
        real = isinstance(f.dtype, (T.DoubleType, T.FloatType))
        if holds:
            return test(f.col, lit) & ~F.isnan(f.col) if real and op in ("$gt", "$gte") else test(f.col, lit)
        no = _COMPARE[_FLIP[op]](f.col, lit) | f.col.isNull()
        return no | F.isnan(f.col) if real and op in ("$lt", "$lte", "$gt", "$gte") else no
    n = _as_number(bound)
    x = _number_of(f)
    if n is None or x is None:
        return F.lit(not holds)
    return _either(test(x, F.lit(n)), holds)


def _as_number(bound: Any) -> float | None:
    if isinstance(bound, bool):
        return float(bound)
    if bound is None:
        return 0.0
    if _is_number(bound):
        return None if isinstance(bound, float) and math.isnan(bound) else float(bound)
    if isinstance(bound, (datetime, date)):
        return float(millis(bound))
    return js_number_of(bound) if isinstance(bound, str) else None


def _number_of(f: Field) -> Column | None:
    if f.kind == "number":
        return F.nanvl(f.col.cast("double"), F.lit(None).cast("double"))
    if f.kind == "string":
        return js_number(f.col)
    if f.kind == "boolean":
        return f.col.cast("int").cast("double")
    if f.kind == "date":
        return f.instant().cast("double")
    return None


def _ordered_variant(f: Field, test, bound: Any) -> Column:
    n = _as_number(bound)
    if isinstance(bound, str):
        text = F.when(f.is_string(), test(f.text(), F.lit(bound)))
        return text if n is None else text.otherwise(_variant_number(f, test, n))
    if n is None:
        return F.lit(False)
    return _variant_number(f, test, n)


def _variant_number(f: Field, test, n: float) -> Column:
    number = (
        F.when(f.is_number(), f.number())
        .when(f.is_null(), F.lit(0.0))
        .when(f.is_boolean(), F.try_variant_get(f.col, "$", "boolean").cast("int").cast("double"))
        .when(f.is_date(), f.instant().cast("double"))
        .when(f.shape == "STRING", js_number(f.text()))
    )
    return test(number, F.lit(n))
