"""Fields of documents by dotted path, over typed columns and over a VARIANT column.

A typed column's NULL is a missing field. In a variant, a missing field is SQL NULL and a JSON null is a value. Dates
inside variants are the strings YYYY-MM-DDTHH:MM:SS.mmmZ, wherever they stand.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import date, datetime, timezone
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column that holds schemaless content.
DOC = "doc"
ISO = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z\z"
_iso = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z")
_NUMERIC = "^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"


def millis(d: date | datetime) -> int:
    """Epoch milliseconds; without a zone the instant is UTC."""
    if not isinstance(d, datetime):
        d = datetime(d.year, d.month, d.day)
    if d.tzinfo is None:
        d = d.replace(tzinfo=timezone.utc)
    whole = d - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return whole.days * 86_400_000 + whole.seconds * 1000 + whole.microseconds // 1000


def iso(d: date | datetime) -> str:
    ms = millis(d)
    return datetime.fromtimestamp(ms // 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") + f".{ms % 1000:03d}Z"


def plain(value: Any) -> Any:
    """A Python value as JSON can hold it; numbers without a finite value become null."""
    if isinstance(value, (datetime, date)):
        return iso(value)
    if isinstance(value, float):
        if value != value or abs(value) == float("inf"):
            return None
        return int(value) if value.is_integer() and abs(value) < 2**53 else value
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def revive(value: Any) -> Any:
    """What plain() wrote, with dates as datetimes again."""
    if isinstance(value, str) and _iso.fullmatch(value):
        return datetime.strptime(value[:-1], "%Y-%m-%dT%H:%M:%S.%f").replace(tzinfo=timezone.utc)
    if isinstance(value, dict):
        return {k: revive(v) for k, v in value.items()}
    if isinstance(value, list):
        return [revive(v) for v in value]
    return value


def variant_of(value: Any) -> Column:
    """A literal as a variant."""
    return F.parse_json(F.lit(json.dumps(plain(value), ensure_ascii=False)))


def canonical(variant: Column) -> Column:
    """Text that is equal for deeply equal variants, whatever the order of keys."""
    return F.to_json(variant)


def js_number(s: Column) -> Column:
    """A string as a number: blank is 0, what is no number is NULL."""
    t = F.trim(s)
    return F.when(t == "", F.lit(0.0)).when(t.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)\z"), t.try_cast("double"))


def js_number_of(s: str) -> float | None:
    t = s.strip()
    if not t:
        return 0.0
    return float(t) if re.fullmatch(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)", t) else None


def kind_of(t: T.DataType | None) -> str:
    if t is None:
        return "missing"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.VariantType):
        return "variant"
    return "object"


@dataclass
class Field:
    """A field's column and kind: missing, number, string, boolean, date, array, object or variant."""

    path: str
    kind: str
    col: Column
    dtype: T.DataType | None = None

    @property
    def missing(self) -> Column:
        return F.lit(True) if self.kind == "missing" else self.col.isNull()

    # of variants

    @property
    def shape(self) -> Column:
        return F.schema_of_variant(self.col)

    def text(self) -> Column:
        return F.try_variant_get(self.col, "$", "string")

    def is_date(self) -> Column:
        return (self.shape == "STRING") & self.text().rlike(ISO)

    def is_string(self) -> Column:
        return (self.shape == "STRING") & ~self.text().rlike(ISO)

    def is_number(self) -> Column:
        return self.shape.rlike(_NUMERIC)

    def is_boolean(self) -> Column:
        return self.shape == "BOOLEAN"

    def is_null(self) -> Column:
        return F.is_variant_null(self.col)

    def is_array(self) -> Column:
        return self.shape.startswith("ARRAY")

    def is_object(self) -> Column:
        return self.shape.startswith("OBJECT")

    def number(self) -> Column:
        return F.try_variant_get(self.col, "$", "double")

    def elements(self) -> Column:
        return F.try_variant_get(self.col, "$", "array<variant>")

    def instant(self) -> Column:
        """Epoch milliseconds of a date."""
        if self.kind == "variant":
            return F.unix_millis(F.try_to_timestamp(self.text()))
        if isinstance(self.dtype, T.TimestampNTZType):
            return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), self.col)
        return F.unix_millis(self.col.cast("timestamp"))

    def variant(self) -> Column:
        """The field as a variant, whatever it is."""
        if self.kind == "variant":
            return self.col
        if self.kind == "missing":
            return F.lit(None).cast("variant")
        if self.kind == "date":
            return F.date_format(self.col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").cast("variant")
        return F.to_variant_object(self.col) if self.kind in ("array", "object") else self.col.cast("variant")


def _json_path(parts: list[str]) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else "['" + p.replace("'", "\\'") + "']" for p in parts)


def field(schema: T.StructType, path: str) -> Field:
    """The field at a dotted path; digits index arrays. Typed columns come first, then the variant column."""
    parts = path.split(".")
    names = {f.name: f.dataType for f in schema.fields}
    if parts[0] not in names or parts[0] == DOC and isinstance(names[DOC], T.VariantType):
        if isinstance(names.get(DOC), T.VariantType):
            return Field(path, "variant", F.try_variant_get(F.col(DOC), _json_path(parts), "variant"))
        return Field(path, "missing", F.lit(None))
    at, t = F.col(f"`{parts[0]}`"), names[parts[0]]
    for i, p in enumerate(parts[1:], 1):
        if isinstance(t, T.StructType) and p in t.names:
            at, t = at.getField(p), t[p].dataType
        elif isinstance(t, T.ArrayType) and p.isdigit():
            at, t = F.get(at, F.lit(int(p))), t.elementType
        elif isinstance(t, T.MapType) and isinstance(t.keyType, T.StringType):
            at, t = F.try_element_at(at, F.lit(p)), t.valueType
        elif isinstance(t, T.VariantType):
            return Field(path, "variant", F.try_variant_get(at, _json_path(parts[i:]), "variant"))
        else:
            return Field(path, "missing", F.lit(None))
    return Field(path, kind_of(t), at, t)
