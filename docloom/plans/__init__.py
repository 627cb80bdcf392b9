"""Criteria, queries, updates and schemas, compiled to Spark columns and plans."""
