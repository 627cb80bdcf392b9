"""Updates: one projection over documents, set at a time.

$set, then $unset, then $inc, then $push, $pull and $addToSet; a plain object is merged into the top level. Over typed
columns the result keeps their types; over a variant column objects are rebuilt along the static path.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocumentError
from ..functions.fields import DOC, Field, canonical, field, variant_of
from .criteria import literal
from .query import members

OPERATORS = ("$set", "$unset", "$inc", "$push", "$pull", "$addToSet")


def parse(update: Any) -> dict[str, dict[str, Any]]:
    """{operator: {path: value}} in the order of application."""
    if not isinstance(update, dict):
        raise DocumentError("An update must be an object", "DOC009", value=repr(update))
    if bad := [k for k in update if k.startswith("$") and k not in OPERATORS]:
        raise DocumentError(f"Invalid update operator: {', '.join(bad)}", "DOC006", operators=bad)
    steps = {op: dict(update[op]) for op in OPERATORS if op in update}
    if not steps:
        steps = {"$set": {k: v for k, v in update.items() if k != "_id"}}
        if dotted := [k for k in steps["$set"] if "." in k]:
            raise DocumentError(f"Field names with dots need $set: {', '.join(dotted)}", "DOC006", fields=dotted)
    for op, fields in steps.items():
        if any(p.split(".")[0] == "_id" for p in fields):
            raise DocumentError("The id of a document can't change", "DOC006", operator=op)
        if op == "$inc" and any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in fields.values()):
            raise DocumentError("$inc takes numbers", "DOC003")
    return steps


def apply(df: DataFrame, update: Any, changed: Column | None = None) -> DataFrame:
    """df with the update made where `changed` holds (everywhere, if None)."""
    steps = parse(update)
    mark = "__changed"
    out = df if changed is None else df.withColumn(mark, F.coalesce(changed, F.lit(False)))
    pick = (lambda new, old: new) if changed is None else (lambda new, old: F.when(F.col(mark), new).otherwise(old))
    for op, fields in steps.items():
        for path, value in fields.items():
            top = path.split(".")[0]
            typed = top in out.columns and top != DOC
            if typed or DOC not in out.columns:
                out = _typed(out, op, path, value, pick)
            else:
                out = out.withColumn(DOC, pick(_variant(F.col(DOC), op, path, value), F.col(DOC)))
    return out.drop(mark) if changed is not None else out


def _not_a_number(path: str) -> Column:
    return F.raise_error(F.lit(f"DOC003: $inc on {path}, which is no number"))


def _typed(df: DataFrame, op: str, path: str, value: Any, pick) -> DataFrame:
    top, *rest = path.split(".")
    if top not in df.columns:
        if rest or op in ("$unset", "$pull"):
            if op in ("$unset", "$pull"):
                return df
            raise DocumentError(f"{top} is no column", "DOC006", field=path)
        new = F.lit(value) if op in ("$set", "$inc") else F.array(F.lit(value))
        return df.withColumn(top, pick(new, F.lit(None)))
    f = field(df.schema, path)
    if f.kind == "variant":
        v = F.col(f"`{top}`")
        at = f"{top}.{'.'.join(rest)}"
        return df.withColumn(top, pick(members_changed(v, at, op, value), v)) if rest else df.withColumn(top, pick(_value(f, op, value, path), v))
    if f.kind == "missing":
        if op in ("$unset", "$pull"):
            return df
        if op in ("$push", "$addToSet"):
            new = F.array(F.lit(value))
        else:
            new = F.lit(value)
    elif op == "$set":
        new = F.lit(None) if value is None else literal(f, value)
        if new is None:
            if f.kind == "array" and isinstance(value, (list, tuple)):
                new = F.from_json(F.to_json(variant_of(list(value))), f.dtype)
            elif f.kind == "object" and isinstance(value, dict):
                new = F.from_json(F.to_json(variant_of(value)), f.dtype)
            else:
                raise DocumentError(f"{path} holds values of kind {f.kind}", "DOC006", field=path, value=repr(value))
        new = new.cast(f.dtype)
    elif op == "$unset":
        new = F.lit(None).cast(f.dtype)
    elif op == "$inc":
        if f.kind != "number":
            raise DocumentError(f"Cannot increment {path}, which is no number", "DOC003", field=path)
        new = F.coalesce(f.col, F.lit(0)) + F.lit(value)
    else:
        if f.kind != "array":
            raise DocumentError(f"{path} is no array", "DOC006", field=path)
        one = literal(Field("", _kind(f.dtype.elementType), F.lit(None), f.dtype.elementType), value)
        if one is None:
            if op == "$pull":
                return df
            raise DocumentError(f"{path} holds values of another kind", "DOC006", field=path, value=repr(value))
        one = one.cast(f.dtype.elementType)
        old = F.coalesce(f.col, F.array().cast(f.dtype))
        if op == "$push":
            new = F.array_append(old, one)
        elif op == "$pull":
            new = F.array_remove(f.col, one)
        else:
            new = F.when(F.coalesce(F.array_contains(old, one), F.lit(False)), old).otherwise(F.array_append(old, one))
    if rest:
        new = _nested(F.col(f"`{top}`"), df.schema[top].dataType, rest, new)
    return df.withColumn(top, pick(new, F.col(f"`{top}`")))


def _kind(t: T.DataType) -> str:
    from ..functions.fields import kind_of

    return kind_of(t)


def _nested(col: Column, t: T.DataType, parts: list[str], new: Column) -> Column:
    """A struct with one field at a path replaced; missing parents come into being."""
    if not parts:
        return new
    if not isinstance(t, T.StructType):
        raise DocumentError(f"No object at {parts[0]}", "DOC006", field=".".join(parts))
    head, *rest = parts
    cols = []
    for f in t.fields:
        cols.append((_nested(col.getField(f.name), f.dataType, rest, new) if f.name == head else col.getField(f.name)).alias(f.name))
    if head not in t.names:
        if rest:
            raise DocumentError(f"No object at {head}", "DOC006", field=".".join(parts))
        cols.append(new.alias(head))
    return F.struct(*cols)


def members_changed(v: Column, path: str, op: str, value: Any) -> Column:
    return _variant(v, op, path.split(".", 1)[1], value)


def _empty() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))


def _variant(v: Column, op: str, path: str, value: Any) -> Column:
    """A variant object with the value at a path changed."""
    head, *rest = path.split(".")
    m = F.coalesce(members(v), _empty())
    child = F.try_element_at(m, F.lit(head))
    others = F.map_filter(m, lambda k, _: k != head)
    if rest:
        if op in ("$unset", "$pull"):  # no parents come into being
            inner = _variant(child, op, ".".join(rest), value)
            return F.when(members(child).isNotNull(), F.to_variant_object(F.map_concat(others, F.create_map(F.lit(head), inner)))).otherwise(v)
        inner = _variant(child, op, ".".join(rest), value)
        return F.to_variant_object(F.map_concat(others, F.create_map(F.lit(head), inner)))
    if op == "$unset":
        return F.to_variant_object(others)
    new = _value(Field(path, "variant", child), op, value, path)
    changed = F.to_variant_object(F.map_concat(others, F.create_map(F.lit(head), new)))
    return F.when(child.isNull(), v).otherwise(changed) if op == "$pull" else changed


def _value(f: Field, op: str, value: Any, path: str) -> Column:
    """The new value of a variant field."""
    if op == "$set":
        return variant_of(value)
    if op == "$unset":
        return F.lit(None).cast("variant")
    if op == "$inc":
        none = f.missing | F.coalesce(f.is_null(), F.lit(False))
        total = f.number() + F.lit(float(value))
        whole = (total == F.floor(total)) & (F.abs(total) < F.lit(float(2**53)))
        number = F.when(whole, total.cast("long").cast("variant")).otherwise(total.cast("variant"))
        return F.when(none, variant_of(value)).when(f.is_number(), number).otherwise(_not_a_number(path).cast("variant"))
    one = variant_of(value)
    old = F.coalesce(f.elements(), F.when(f.missing | F.coalesce(f.is_null(), F.lit(False)), F.array().cast("array<variant>")))
    if op == "$push":
        new = F.array_append(old, one)
    elif op == "$pull":
        new = F.filter(old, lambda e: canonical(e) != canonical(one))
    else:
        new = F.when(F.exists(old, lambda e: canonical(e) == canonical(one)), old).otherwise(F.array_append(old, one))
    fail = F.raise_error(F.lit(f"DOC006: {op} on {path}, which is no array")).cast("variant")
    return F.when(old.isNotNull(), F.to_variant_object(new)).otherwise(fail)
