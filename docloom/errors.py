"""Errors with codes."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import Any

#: Codes and what they stand for. Fixed values.
CODES = {
    "DB000": "invalid database name",
    "DB001": "initialisation failed",
    "DB007": "duplicate id",
    "DB010": "concurrent commit",
    "DB011": "database not initialised",
    "SCH001": "document is not an object",
    "SCH002": "required field missing",
    "SCH003": "wrong type",
    "SCH004": "rule violated",
    "SCH005": "field not in schema",
    "SCH006": "custom rule violated",
    "STO003": "read failed",
    "STO004": "delete failed",
    "IDX001": "index creation failed",
    "IDX002": "index update failed",
    "IDX004": "unique constraint violated",
    "DOC001": "document not found or not loadable",
    "DOC002": "insert failed",
    "DOC003": "increment of something that is no number",
    "DOC004": "delete failed",
    "DOC005": "lock not obtained",
    "DOC006": "update failed",
    "DOC007": "query failed",
    "DOC008": "invalid id",
    "DOC009": "invalid argument",
    "COL002": "collection drop failed",
    "COL003": "invalid collection name",
    "COM002": "compression failed",
    "QUE002": "invalid query operator",
}


class DocumentError(Exception):
    """An error with a code of CODES, details and the time it was raised."""

    def __init__(self, message: str, code: str, **details: Any):
        super().__init__(message)
        self.message, self.code, self.details = message, code, details
        self.timestamp = datetime.now(timezone.utc)

    def to_dict(self) -> dict[str, Any]:
        return {"name": type(self).__name__, "code": self.code, "message": self.message, "details": self.details, "timestamp": self.timestamp.isoformat()}

    def within(self, message: str, code: str) -> "DocumentError":
        """This error as the cause of an operation's own."""
        return DocumentError(f"{message}: {self.message}", code, cause=self.code, **self.details)
