"""Scratch tables, column selection and Arrow helpers that the operators of this folder share."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
#: Texts in a batch, and the bytes from which a batch has fewer.
TEXTS = 1000
BYTES = 8 << 20
_roots: dict[str, tuple] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: the one in spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; a cluster without it is an error, as a
    machine's own folder would not be seen by the others.
    """
    where = spark.conf.get(_SETTING, None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {_SETTING} to a folder that all machines of the cluster share")
        where = f"file://{tempfile.mkdtemp(prefix='docloom-')}"
        spark.conf.set(_SETTING, where)
    app = f"{where.rstrip('/')}/docloom-{spark.sparkContext.applicationId}"
    if app not in _roots:
        _roots[app] = (spark,)
        atexit.register(_drop, spark, app)
    return app


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is None or jvm is None:
        return
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may already be gone when the interpreter ends
        pass


#: Paths of staged tables, in order.
_made: list[str] = []


def staged() -> int:
    """How many tables have been staged, as a mark for `finished`."""
    return len(_made)


def finished(spark: SparkSession, mark: int) -> None:
    """Frees the tables staged since the mark, when all that was built on them has been written."""
    for path in _made[mark:]:
        _drop(spark, path)
    del _made[mark:]


class Staged:
    """Written tables of one operator call; each cuts lineage and survives the loss of an executor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def put(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        _made.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._docloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Frees a table that no later plan reads."""
        if path := getattr(df, "_docloom_path", None):
            _drop(self.spark, path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under fixed names; a null text counts as empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Tells the executors where to find this package, and Spark to send them fewer rows at once, unless a number was
    set: rows here hold whole texts."""
    sc = spark.sparkContext
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(TEXTS))
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(prefix="docloom-"), f"{top.name}-{sc.applicationId}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, run, schema, rows: int | None = None) -> DataFrame:
    """df.mapInArrow by a function of this package; with `rows`, it gets batches of so many rows and of BYTES at most, or
    one row, which bounds what a worker holds of long texts."""
    ship(df.sparkSession)

    def whole(batches):
        try:
            yield from run(batches if rows is None else (s for b in batches for s in slices(b, rows)))
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def slices(b: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, max(1, b.num_rows), rows):
        part = b.slice(i, rows)
        if part.num_rows > 1 and part.nbytes > BYTES:
            yield from slices(part, (part.num_rows + 1) // 2)
        else:
            yield part


def give_back() -> None:
    """A worker waits for its next task with no more memory than it uses."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def as_bytes(column) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def list_column(offsets, values: pa.Array) -> pa.ListArray:
    """Arrow lists from offsets and flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
