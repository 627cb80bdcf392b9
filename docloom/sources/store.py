"""Versioned storage: Parquet files and a manifest for each version.

A manifest lists the files of its version with their rows and their range of positions, so a change writes anew only the
files that hold what it changes. Manifests are written aside and then given their name, which fails if the name is
taken: of two writers that began at the same version one starts over, and no reader sees half a manifest. That needs a
file system whose rename is atomic (HDFS, a local disk); on an object store let one process write. Files that a reader
may hold are never overwritten, and stay for `keep` seconds after the version that replaced them; then they go, as do
files that no commit ever named. All access goes through the cluster's file system.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections import defaultdict
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DocumentError

ROW = "_id string, _pos long, doc variant"
#: Versions between two searches for what may go.
_SWEEP = 16
#: Rows of a file at most, where no number is given: what a change of one document writes anew.
ROWS = 100_000


class Files:
    """The few file operations that storage needs, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(self.conf)
        self.scheme = self.fs.getUri().getScheme()

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def status(self, *parts: str) -> list[tuple[str, bool, int, float]]:
        """(name, is a folder, bytes, time of the last change)."""
        p = self.path(*parts)
        return [(s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime() / 1000) for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def list(self, *parts: str) -> list[tuple[str, bool]]:
        """(name, is a folder)."""
        return [x[:2] for x in self.status(*parts)]

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.path(*parts))

    def make(self, *parts: str) -> None:
        self.fs.mkdirs(self.path(*parts))

    def delete(self, *parts: str) -> bool:
        return self.fs.delete(self.path(*parts), True)

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, text: str, name: str) -> bool:
        """The whole file under its name, or False if there is one already."""
        aside = f"_{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(aside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if self.scheme == "file":  # a local rename overwrites, a link does not
                os.link(*(self.fs.pathToFile(self.path(x)).getPath() for x in (aside, name)))
            else:
                files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path().toUri(), self.conf)
                files.rename(self.path(aside), self.path(name), self._no_overwrite())
            return True
        except FileExistsError:
            return False
        except Exception as e:  # noqa: BLE001  py4j wraps the file system's own errors
            if "AlreadyExists" in str(e):
                return False
            raise
        finally:
            if self.exists(aside):
                self.delete(aside)

    def _no_overwrite(self):
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = SparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        return options


@dataclass
class Manifest:
    """parts: the files, each with its folder, name, number of files beside it, rows, least and greatest position, bytes.
    streams: the last batch of each stream."""

    version: int = 0
    parts: list[dict[str, Any]] = field(default_factory=list)
    next_pos: int = 0
    indexes: list[dict[str, Any]] = field(default_factory=list)
    streams: dict[str, int] = field(default_factory=dict)
    created: str = ""
    updated: str = ""


class Store:
    """One collection's versions under a folder. codec: a Parquet compression codec; rows: rows a file at most
    (0: ROWS)."""

    def __init__(self, spark: SparkSession, root: str, codec: str = "gzip", rows: int = 0, keep: float = 86400.0):
        self.spark, self.files, self.codec, self.rows, self.keep = spark, Files(spark, root), codec, rows or ROWS, keep

    def manifest(self) -> Manifest:
        versions = sorted(n for n, folder in self.files.list() if not folder and n.startswith("manifest-") and n.endswith(".json"))
        return Manifest(**json.loads(self.files.read(versions[-1]))) if versions else Manifest()

    def frame(self, m: Manifest | None = None, parts: list[dict[str, Any]] | None = None) -> DataFrame:
        """All documents of a version, or those of some of its files. A folder whose files all count is read as one."""
        if parts is None:
            parts = (m or self.manifest()).parts
        if not parts:
            return self.spark.createDataFrame([], ROW)
        folders = defaultdict(list)
        for p in parts:
            folders[p["folder"]].append(p)
        paths = [x for folder, own in folders.items() for x in ([folder] if len(own) == own[0]["of"] else [f"{folder}/{p['file']}" for p in own])]
        return self.spark.read.schema(ROW).parquet(*[f"{self.files.root}/{p}" for p in paths])

    def holding(self, m: Manifest, df: DataFrame, chosen: Column) -> dict[str, int]:
        """The files of a version's frame that hold chosen rows and how many; a row for each file comes to the driver."""
        if not m.parts:
            return {}
        return {r[0]: r[1] for r in df.where(chosen).groupBy(F.col("_metadata.file_name").alias("f")).count().collect()}

    def write(self, df: DataFrame) -> list[dict[str, Any]]:
        """New files, not yet in any version."""
        folder = f"part-{uuid.uuid4().hex}"
        writer = df.select("_id", "_pos", "doc").write.option("compression", self.codec).option("maxRecordsPerFile", self.rows)
        try:
            writer.parquet(f"{self.files.root}/{folder}")
            size = {n: b for n, _, b, _ in self.files.status(folder)}
            made = self.spark.read.schema("_pos long").parquet(f"{self.files.root}/{folder}")
            stats = made.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n"), F.min("_pos").alias("lo"), F.max("_pos").alias("hi")).collect()
        except Exception:
            self.files.delete(folder)
            raise
        return [{"folder": folder, "file": r["f"], "of": len(stats), "n": r["n"], "lo": r["lo"], "hi": r["hi"], "bytes": size[r["f"]]} for r in stats]

    def discard(self, parts: list[dict[str, Any]]) -> None:
        """Files that were written for a commit which did not come about."""
        for folder in {p["folder"] for p in parts}:
            self.files.delete(folder)

    def commit(self, base: Manifest, **changes: Any) -> Manifest:
        now = datetime.now(timezone.utc).isoformat()
        new = Manifest(**{**base.__dict__, "version": base.version + 1, "created": base.created or now, "updated": now, **changes})
        self.files.make()
        if not self.files.create(json.dumps(new.__dict__), f"manifest-{new.version:012d}.json"):
            raise DocumentError("Another writer committed first", "DB010", version=new.version)
        if new.version % _SWEEP == 0:
            self.sweep()
        return new

    def sweep(self, keep: float | None = None) -> None:
        """Drops manifests that were replaced more than `keep` seconds ago, and files as old that no manifest left names."""
        before = time.time() - (self.keep if keep is None else keep)
        there = sorted(self.files.status())
        versions = [(n, at) for n, folder, _, at in there if not folder and n.startswith("manifest-") and n.endswith(".json")]
        gone = [n for (n, _), (_, replaced) in zip(versions, versions[1:]) if replaced <= before]
        named: dict[str, set[str]] = defaultdict(set)
        for n, _ in versions:
            if n not in gone:
                for p in json.loads(self.files.read(n))["parts"]:
                    named[p["folder"]].add(p["file"])
        for n, folder, _, at in there:
            if folder and n.startswith("part-"):
                if n not in named and at <= before:
                    self.files.delete(n)
                elif n in named:
                    for f, _, _, since in self.files.status(n):
                        if f.endswith(".parquet") and f not in named[n] and since <= before:
                            self.files.delete(n, f)
            elif not folder and n.startswith("_manifest-") and at <= before:
                self.files.delete(n)
        for n in gone:
            self.files.delete(n)


def positions(df: DataFrame, start: int) -> DataFrame:
    """df with _pos: ascending in the order of partitions and rows from `start`, with gaps between partitions."""
    return df.withColumn("_pos", F.lit(start) + F.monotonically_increasing_id())


#: Rows that are few enough to be sorted for one place among them.
FEW = 10_000
_BINS = 1024


def place_of_rank(df: DataFrame, n: int, parts: list[dict[str, Any]], whole: bool) -> int | None:
    """The position of row n (from 0) of df in order of position; None if it has no such row. parts: the files that df
    reads; whole: df has all their rows. Files tell between which positions it lies, then counts of ever finer ranges
    do; what is sorted in the end are FEW rows."""
    if not parts:
        return None
    lo, hi, count = min(p["lo"] for p in parts), max(p["hi"] for p in parts), None
    if whole:
        before, group = 0, []
        for p in sorted(parts, key=lambda p: p["lo"]):
            if group and p["lo"] > group[1]:
                if n < before + group[2]:
                    break
                before += group[2]
                group = []
            group = [p["lo"], p["hi"], p["n"]] if not group else [group[0], max(group[1], p["hi"]), group[2] + p["n"]]
        if n >= before + group[2]:
            return None
        lo, hi, count = group
        n -= before
    pos = F.col("_pos")
    while hi > lo and (count is None or count > FEW and count < hi - lo + 1):
        width = -(-(hi - lo + 1) // _BINS)
        bins = df.where(pos.between(lo, hi)).groupBy(F.expr(f"(_pos - {lo}L) div {width}L").alias("b")).count().orderBy("b").collect()
        for b, c in bins:
            if n < c:
                lo, hi, count = lo + b * width, min(hi, lo + (b + 1) * width - 1), c
                break
            n -= c
        else:
            return None
    if count is not None and count == hi - lo + 1:
        return lo + n
    found = df.where(pos.between(lo, hi)).select("_pos").orderBy("_pos").offset(n).limit(1).collect()
    return found[0][0] if found else None
