"""Databases and collections."""
