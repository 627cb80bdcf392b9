"""docloom: document queries and data processing expressed as Spark plans."""

from .errors import CODES, DocumentError
from .functions.ids import new_id, valid_id, valid_uuid
from .operators.collection import Collection
from .operators.database import Database
from .plans.query import Query
from .plans.schema import PythonRule, Schema

__all__ = ["CODES", "Collection", "Database", "DocumentError", "PythonRule", "Query", "Schema", "new_id", "valid_id", "valid_uuid"]
