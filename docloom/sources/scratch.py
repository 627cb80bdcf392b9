"""A folder for tables that a query writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

from .store import Files

_SETTING = "spark.checkpoint.dir"


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all machines share; it goes when the interpreter ends. Only a local
    master may leave that unset."""
    where = spark.conf.get(_SETTING, None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {_SETTING} to a folder that all machines of the cluster share")
        where = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.conf.set(_SETTING, where)
    files = Files(spark, f"{where.rstrip('/')}/docloom-{uuid.uuid4().hex}")
    atexit.register(_drop, files, spark)
    return files.root


def _drop(files: Files, spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            files.delete()
        except Exception:  # noqa: BLE001  the gateway may already be gone when the interpreter ends
            pass
