"""Schemas: types, rules, defaults and transforms of documents, as columns.

`errors` is one struct column, NULL for a valid document, else the first failure in the order of definition:
required, type, min, max, minLength, maxLength, pattern, enum, custom; a field that a strict schema lacks comes last.
`normalised` gives the documents with defaults and transforms applied. Both work on typed columns and on a variant.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as item
from datetime import date, datetime
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import regex
from ..functions.fields import DOC, Field, field, variant_of
from .query import members, replaced

RULES = ("min", "max", "minLength", "maxLength", "pattern", "enum", "custom", "message")
Error = "struct<code:string,field:string,message:string>"


#: Python types and the names they stand for.
KINDS = {str: "string", int: "number", float: "number", bool: "boolean", datetime: "date", date: "date", list: "array", tuple: "array", dict: "object"}


def type_name(kind: str | type) -> str:
    if isinstance(kind, str):
        return kind
    if kind not in KINDS:
        raise ValueError(f"no documents hold values of {kind!r}")
    return KINDS[kind]


@dataclass(frozen=True)
class PythonRule:
    """A rule in Python, for what columns can't say: value -> None or True if good, False or a text if not."""

    check: Callable[[Any], Any]


@dataclass(frozen=True)
class FieldRule:
    type: str = ""
    required: bool = False
    default: Any = None
    validate: dict[str, Any] = item(default_factory=dict)
    transform: Callable[[Column], Column] | None = None


class Schema:
    """fields: {name: {type, required, default, validate, transform}}. A type is a name or a Python type.

    A default is a value or a callable that gets a function from path to Column and returns a Column. A transform is a
    callable from Column to Column. A custom rule is a callable (value, get) that returns a boolean Column or a text
    Column, NULL where there is nothing to say; or a PythonRule.
    """

    def __init__(self, fields: dict[str, dict[str, Any]], strict: bool = True, timestamps: bool = False):
        self.fields = {name: FieldRule(**{**rule, "type": type_name(rule.get("type", ""))}) for name, rule in fields.items()}
        for name, rule in self.fields.items():
            if unknown := set(rule.validate) - set(RULES):
                raise ValueError(f"unknown rules of {name}: {', '.join(sorted(unknown))}")
        self.strict, self.timestamps = strict, timestamps

    @property
    def id_pattern(self) -> str | None:
        p = self.fields["_id"].validate.get("pattern") if "_id" in self.fields else None
        return None if p is None else regex.of(p)

    def errors(self, df: DataFrame, skip: tuple[str, ...] = ()) -> Column:
        found = [e for name, rule in self.fields.items() if name not in skip for e in self._field_errors(df, name, rule)]
        if self.strict:
            found.append(self._unknown(df))
        return F.coalesce(*found) if found else F.lit(None).cast(Error)

    def _field_errors(self, df: DataFrame, name: str, rule: FieldRule) -> list[Column]:
        f = field(df.schema, name)
        absent = f.missing | F.coalesce(f.is_null(), F.lit(False)) if f.kind == "variant" else f.missing
        out = []

        def fail(bad: Column, code: str, message: Column | str) -> None:
            text = F.lit(message) if isinstance(message, str) else message
            out.append(F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(name).alias("field"), text.alias("message"))))

        if rule.required:
            fail(absent, "SCH002", f"{name} is required and has no value")
        if f.kind == "missing":
            return out
        there = ~absent
        if (good := of_type(f, rule.type)) is not None:
            fail(there & ~good, "SCH003", f"{name} must be of type {rule.type}")
        told = rule.validate.get("message")
        checks = rule.validate
        number, text, size = value_number(f), value_text(f), value_size(f)
        for key, bad, say in (("min", lambda x: number < x, "must be at least"), ("max", lambda x: number > x, "must be at most")):
            if checks.get(key) is not None and number is not None:
                fail(there & bad(F.lit(checks[key])), "SCH004", told or f"{name} {say} {checks[key]}")
        for key, bad, say in (("minLength", lambda x: size < x, "must have a length of at least"), ("maxLength", lambda x: size > x, "must have a length of at most")):
            if checks.get(key) is not None and size is not None:
                fail(there & bad(F.lit(checks[key])), "SCH004", told or f"{name} {say} {checks[key]}")
        if checks.get("pattern") is not None and text is not None:
            fail(there & ~text.rlike(regex.of(checks["pattern"])), "SCH004", told or f"{name} does not have the form asked for")
        if checks.get("enum") is not None:
            fail(there & ~among(f, checks["enum"]), "SCH004", told or f"{name} takes only {', '.join(map(str, checks['enum']))}")
        if (custom := checks.get("custom")) is not None:
            self._custom(df, f, custom, there, told, fail)
        return out

    def _custom(self, df: DataFrame, f: Field, custom, there: Column, told: str | None, fail) -> None:
        value = typed_value(f, self.fields[f.path].type)
        if isinstance(custom, PythonRule):
            check, bad = custom.check, told or "the field's own rule rejects the value"

            def said(v):
                r = None if v is None else check(v)
                return r if isinstance(r, str) else bad if r is False else None

            text = F.udf(said, "string", useArrow=True)(value)
            fail(there & text.isNotNull(), "SCH006", text)
            return
        result = custom(value, lambda path: typed_value(field(df.schema, path), self.fields[path].type if path in self.fields else ""))
        if isinstance(df.select(result.alias("r")).schema["r"].dataType, T.BooleanType):
            fail(there & ~result, "SCH006", told or "the field's own rule rejects the value")
        else:
            fail(there & result.isNotNull(), "SCH006", result)

    def _unknown(self, df: DataFrame) -> Column:
        known = set(self.fields)
        if DOC in df.columns:
            extra = F.filter(F.map_keys(members(F.col(DOC))), lambda k: ~k.isin(list(known)) & ~k.startswith("_") if known else ~k.startswith("_"))
            first = F.get(extra, F.lit(0))
        else:
            own = [F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in df.columns if c not in known and not c.startswith("_")]
            first = F.coalesce(*own) if own else F.lit(None).cast("string")
        return F.when(first.isNotNull(), F.struct(F.lit("SCH005").alias("code"), first.alias("field"), F.concat(first, F.lit(" is no field of the schema")).alias("message")))

    def normalised(self, df: DataFrame, now: Column | None = None) -> DataFrame:
        """Defaults for what is null or missing, then transforms; undeclared fields stay only in a lax schema, and
        those that begin with an underscore go (the id and position stay)."""
        if DOC in df.columns:
            return df.withColumn(DOC, self._variant(df, now))
        cols = []
        for c in df.columns:
            if c in self.fields:
                cols.append(self._typed(df, c).alias(c))
            elif c in ("_id", "_pos") or not self.strict and not c.startswith("_"):
                cols.append(F.col(f"`{c}`"))
        for c, rule in self.fields.items():
            if c not in df.columns and rule.default is not None:
                cols.append(self._default(df, rule).alias(c))
        if self.timestamps:
            stamp = now if now is not None else F.current_timestamp()
            cols.append((F.coalesce(F.col("_createdAt"), stamp) if "_createdAt" in df.columns else stamp).alias("_createdAt"))
            cols.append(stamp.alias("_updatedAt"))
        return df.select(*cols)

    def _default(self, df: DataFrame, rule: FieldRule) -> Column:
        if callable(rule.default):
            return rule.default(lambda path: typed_value(field(df.schema, path), self.fields[path].type if path in self.fields else ""))
        return F.lit(rule.default)

    def _typed(self, df: DataFrame, name: str) -> Column:
        rule, col = self.fields[name], F.col(f"`{name}`")
        value = col
        if rule.default is not None:
            value = F.coalesce(col, self._default(df, rule).cast(df.schema[name].dataType))
        if rule.transform is not None:
            value = F.when(col.isNull(), value).otherwise(rule.transform(value))  # a default is not transformed
        return value

    def _variant(self, df: DataFrame, now: Column | None) -> Column:
        m = members(F.col(DOC))
        own = [n for n in self.fields if n != "_id"]
        keep = lambda k, v: (k.isin(own) if own else F.lit(False)) & ~F.is_variant_null(v)
        if self.strict:
            out = F.map_filter(m, keep)
        else:
            out = F.map_filter(m, lambda k, v: keep(k, v) | ((~k.isin(own) if own else F.lit(True)) & ~k.startswith("_")))
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
        for name in own:
            rule = self.fields[name]
            f = field(df.schema, name)
            if rule.transform is not None:
                value = as_variant(rule.transform(typed_value(f, rule.type)))
                out = replaced(out, name, partial(_constant, value=value))
            if rule.default is not None:
                value = as_variant(self._default(df, rule)) if callable(rule.default) else variant_of(rule.default)
                absent = f.missing | F.coalesce(f.is_null(), F.lit(False))
                out = F.map_concat(out, F.when(absent, F.create_map(F.lit(name), value)).otherwise(empty))
        if self.timestamps:
            stamp = as_variant(now if now is not None else F.current_timestamp())
            made = F.coalesce(F.try_element_at(m, F.lit("_createdAt")), stamp)
            out = F.map_concat(F.map_filter(out, lambda k, _: ~k.isin("_createdAt", "_updatedAt")), F.create_map(F.lit("_createdAt"), made, F.lit("_updatedAt"), stamp))
        return F.to_variant_object(out)


def _constant(_: Column, value: Column) -> Column:
    return value


def as_variant(col: Column) -> Column:
    """A computed value as a variant; an instant becomes its date text."""
    kind = F.typeof(col)
    text = F.date_format(col.try_cast("string").try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    whole = F.to_json(F.struct(col.alias("x")))  # {"x":...}, or {} for NULL
    value = F.when(whole != "{}", F.substr(whole, F.lit(6), F.char_length(whole) - 6))
    return F.when(kind.isin("timestamp", "timestamp_ntz", "date"), F.parse_json(F.concat(F.lit('"'), text, F.lit('"')))).otherwise(F.parse_json(value))


def of_type(f: Field, name: str) -> Column | None:
    """Whether a value has a type; None where there is nothing to check."""
    if f.kind == "variant":
        tests = {
            "string": lambda: f.is_string(), "number": lambda: f.is_number(), "boolean": lambda: f.is_boolean(), "date": lambda: f.is_date(),
            "array": lambda: f.is_array(), "object": lambda: f.is_object() | f.is_date(),
        }
        return tests[name]() if name in tests else None
    if name not in ("string", "number", "boolean", "date", "array", "object"):
        return None
    if f.kind == "number" == name and isinstance(f.dtype, (T.DoubleType, T.FloatType)):
        return ~F.isnan(f.col)
    return None if f.kind == name or name == "object" and f.kind == "date" else F.lit(False)


def value_number(f: Field) -> Column | None:
    if f.kind == "variant":
        return F.when(f.is_number(), f.number())
    return f.col if f.kind == "number" else None


def value_text(f: Field) -> Column | None:
    if f.kind == "variant":
        return F.when(f.is_string(), f.text())
    return f.col if f.kind == "string" else None


def value_size(f: Field) -> Column | None:
    """Length of a string in UTF-16 units, or of an array."""
    units = lambda s: (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")
    if f.kind == "variant":
        return F.when(f.is_string(), units(f.text())).when(f.is_array(), F.size(f.elements()))
    if f.kind == "string":
        return units(f.col)
    return F.size(f.col) if f.kind == "array" else None


def among(f: Field, values: list) -> Column:
    from .criteria import _same_as_any, literal

    if f.kind == "variant":
        return F.coalesce(_same_as_any(f, values), F.lit(False))
    wanted = [x for x in (literal(f, v) for v in values) if x is not None]
    return f.col.isin(wanted) if wanted else F.lit(False)


def typed_value(f: Field, name: str) -> Column:
    """A field as an ordinary column of its declared type, for callables."""
    if f.kind != "variant":
        return f.col
    if name == "number":
        return f.number()
    if name == "boolean":
        return F.try_variant_get(f.col, "$", "boolean")
    if name == "date":
        return F.try_to_timestamp(f.text())
    if name == "array":
        return f.elements()
    return f.text() if name == "string" else f.col

