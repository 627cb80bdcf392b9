"""Document ids: 24 hexadecimal digits, or UUIDs of version 4."""

from __future__ import annotations

import re
import secrets
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two accepted shapes.
HEX24 = "[0-9a-f]{24}"
UUID4 = "[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"


def is_uuid(s: Column) -> Column:
    return s.rlike(f"(?i)^{UUID4}\\z")


def is_hex_id(s: Column) -> Column:
    return s.rlike(f"(?i)^{HEX24}\\z")


def is_id(s: Column) -> Column:
    return is_uuid(s) | is_hex_id(s)


def valid_id(s: object) -> bool:
    """The same test for one value on the driver."""
    return isinstance(s, str) and re.fullmatch(f"{HEX24}|{UUID4}", s, re.IGNORECASE) is not None


def valid_uuid(s: object) -> bool:
    return isinstance(s, str) and re.fullmatch(UUID4, s, re.IGNORECASE) is not None


def new_id(kind: str = "mongo") -> str:
    """A fresh id: of 24 digits, or a UUID (kind "uuid")."""
    return str(uuid.uuid4()) if kind == "uuid" else secrets.token_hex(12)


def new_ids(kind: str = "mongo") -> Column:
    """A fresh id a row. Not deterministic: write the result before it is read twice."""
    return F.uuid() if kind == "uuid" else F.substring(F.sha2(F.concat(F.uuid(), F.uuid()), 256), 1, 24)
