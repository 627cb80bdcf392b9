"""Names of databases and collections, which become folder names."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a name must not hold. Any dot or slash covers traversal, absolute paths and file names.
FORBIDDEN = [
    r"[./\\]",
    r"[\x00-\x1f\x7f]",
    r"(?i)%2e%2e|%2f|%5c|%252e|%252f|%255c|%c0%ae|%c0%af|%c1%9c",
    r"\$\{.*\}|#\{.*\}|\{\{.*\}\}",
    r"(?i)passwd|shadow|hosts",
]
LONGEST = 64
#: What a folder's name can't hold as it is, on some file system or in a path that Spark reads.
ESCAPED = '<>:"|?*%[]{}'


def check_name(name: object) -> str | None:
    """What is wrong with a name, or None."""
    if not isinstance(name, str):
        return "a name is a text"
    if not name.strip():
        return "it holds nothing but blanks"
    if any(re.search(p, x) for p in FORBIDDEN for x in (name, unquote(name))):
        return "it could lead out of its folder"
    if len(name) > LONGEST:
        return f"it is longer than {LONGEST} characters"
    if name.strip().startswith("_"):
        return "a leading underscore is for the engine's own folders"
    return None


def folder_of(name: str) -> str:
    """The folder of a name without its outer blanks; different names have different folders."""
    return "".join(f"%{ord(c):02x}" if c in ESCAPED else c for c in name.strip())


def name_of(folder: str) -> str:
    return unquote(folder)


def is_name(s: Column) -> Column:
    """The same test over a column, but for decoding."""
    bad = F.lit(False)
    for p in FORBIDDEN:
        bad = bad | s.rlike(p)
    return F.coalesce(~bad & (F.trim(s) != "") & (F.char_length(s) <= LONGEST) & ~s.startswith("_"), F.lit(False))
