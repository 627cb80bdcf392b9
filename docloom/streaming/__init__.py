"""Queries and inserts on streams of documents."""
