"""Databases: a folder with a folder for each collection."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import SparkSession

from ..errors import DocumentError
from ..functions.names import check_name, folder_of, name_of
from ..plans.schema import Schema
from ..sources.store import Files
from .collection import Collection


class Database:
    """name: folder under data_dir. compression: gzip if true, or a Parquet codec; chunk_rows: rows a file at most."""

    def __init__(self, spark: SparkSession, name: str = "default", data_dir: str | None = None, compression: bool | str = True, chunk_rows: int = 0, id_type: str = "mongo"):
        if why := check_name(name):
            raise DocumentError(f"Invalid database name: {why}", "DB000", name=repr(name))
        if id_type not in ("mongo", "uuid"):
            raise DocumentError("id_type is mongo or uuid", "DOC009", value=id_type)
        base = data_dir or os.path.join(os.getcwd(), "data")
        if "://" not in base:
            base = "file://" + os.path.abspath(base)
        self.spark, self.name, self.id_type = spark, name.strip(), id_type
        self.codec = {True: "gzip", False: "uncompressed"}.get(compression, compression)
        self.chunk_rows = chunk_rows
        self.files = Files(spark, f"{base.rstrip('/')}/{folder_of(name)}")
        self.ready = False

    def initialize(self) -> "Database":
        try:
            self.files.make()
        except Exception as e:  # noqa: BLE001  whatever the file system says
            raise DocumentError(f"Error initializing database: {e}", "DB001", path=self.files.root) from e
        self.ready = True
        return self

    def collection(self, name: str, schema: Schema | None = None, id_type: str | None = None, cache: bool = False) -> Collection:
        """A handle; the collection comes into being with its first write. cache: see Collection."""
        self._check()
        if why := check_name(name):
            raise DocumentError(f"Collection name can't be used: {why}", "COL003", name=repr(name))
        return Collection(self.spark, f"{self.files.root}/{folder_of(name)}", name.strip(), schema, id_type or self.id_type, self.codec, self.chunk_rows, cache=cache)

    def list_collections(self) -> list[str]:
        self._check()
        return sorted(name_of(n) for n, folder in self.files.list() if folder and not n.startswith("_"))

    def drop_collection(self, name: str) -> bool:
        """False if there is none."""
        self._check()
        if check_name(name) or name.strip() not in self.list_collections():
            return False
        self.collection(name).drop()
        return True

    def _check(self) -> None:
        if not self.ready:
            raise DocumentError("Database not initialized", "DB011", name=self.name)

    def describe(self) -> dict[str, Any]:
        return {n: self.collection(n).store.manifest().__dict__ for n in self.list_collections()}
