"""Scalar functions on columns: ids, names, patterns, field access."""
