"""Patterns of the document language (ECMAScript) as patterns of the JVM."""

from __future__ import annotations

import re

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException


def to_java(pattern: str, flags: str = "") -> str:
    """Translates what the two dialects read differently; raises ValueError for an invalid pattern or flag."""
    if bad := set(flags) - set("gimsuy"):
        raise ValueError(f"invalid flags {''.join(sorted(bad))}")
    out, i, inside = [], 0, False
    multi = "m" in flags
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise ValueError("pattern ends with a backslash")
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
            elif c == "[":
                c = "\\["
            elif pattern.startswith("&&", i):
                c, i = "\\&\\&", i + 1
        elif c == "[":
            if pattern.startswith("[^]", i):
                c, i = "[\\s\\S]", i + 2
            elif pattern.startswith("[]", i):
                c, i = "(?!)", i + 1
            else:
                inside = True
        elif c == "$" and not multi:
            c = "\\z"
        out.append(c)
        i += 1
    if inside:
        raise ValueError("unterminated class")
    return compiled("".join(f"(?{f})" for f in "ims" if f in flags) + "".join(out))


def compiled(pattern: str) -> str:
    """The pattern, if the JVM can read it, so that a bad one is an error before any row is read."""
    sc = SparkContext._active_spark_context
    if sc is not None:
        try:
            sc._jvm.java.util.regex.Pattern.compile(pattern)
        except IllegalArgumentException as e:  # so PySpark names the JVM's own error
            raise ValueError(str(e).split("\n")[0]) from None
    return pattern


def of(value: object, options: str = "") -> str:
    """JVM pattern of a string or a compiled Python pattern."""
    if isinstance(value, re.Pattern):
        flags = "".join(f for f, bit in (("i", re.IGNORECASE), ("m", re.MULTILINE), ("s", re.DOTALL)) if value.flags & bit)
        return to_java(value.pattern, flags + options)
    if not isinstance(value, str):
        raise ValueError("a pattern is a string or a compiled pattern")
    return to_java(value, options)
