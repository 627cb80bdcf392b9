"""Queries over streams of documents, and streams into collections."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..errors import DocumentError
from ..functions.fields import DOC
from ..operators.collection import Collection
from ..plans.query import Query, project


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """New JSON files of a folder as a stream of variants."""
    return spark.readStream.option("singleVariantColumn", DOC).json(path)


def find(stream: DataFrame, criteria: Any = None) -> DataFrame:
    """Matching documents of a stream. A stream has no end, so a query with an order, skip or limit is an error."""
    q = criteria if isinstance(criteria, Query) else Query(criteria)
    if q.order or q.skipped or q.limited is not None:
        raise DocumentError("A stream can't be sorted, skipped or limited", "DOC007")
    out = q.filtered(stream)
    return project(out, q.fields, q.excluded) if q.fields else out


def insert(stream: DataFrame, into: Collection, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Inserts every micro-batch; each is one commit, which notes the batch: one that comes again after a failure is
    passed over. The checkpoint names the stream."""

    def batch(df: DataFrame, number: int) -> None:
        into.insert_df(df, (checkpoint.rstrip("/"), number))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
