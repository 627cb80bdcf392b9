"""Operators for preparing training text at scale.

Nothing outside this folder imports it. Every module states in its docstring what it does with nulls,
empty texts, repeated rows and empty tables.
"""
