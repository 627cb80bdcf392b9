"""Labelled rows to fit on: a bounded, deterministic sample that leaves the held-out rows alone."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged


def remainder(id_col, folds: int):
    """crc32 of the id written as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def remainder_of(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held: int, bound: int, chars: int = 1 << 27) -> DataFrame:
    """(doc_id, text, y), staged, of at most `bound` labelled documents outside the held-out fold, those of the smallest
    id hashes, and of these as many as have `chars` characters together.

    The list of ids is broadcast; `bound` is its proven size. Labels other than 0 and 1 and null ids take no part; an
    id with several labels counts as 1 if any of them is, and an id with several texts has the least of them."""
    spark = docs.sparkSession
    kept = Staged(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("lid"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("lid").isNotNull() & F.col("y").isin(0, 1) & (remainder("lid", folds) != held))
    picked = known.groupBy("lid").agg(F.max("y").alias("y")).orderBy(F.xxhash64("lid"), "lid").limit(bound)
    rows = docs.join(F.broadcast(picked), docs["doc_id"] == picked["lid"]).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = kept.put(rows, "labelled")
    if (rows.agg(F.sum(F.char_length("text"))).first()[0] or 0) <= chars:
        return rows
    sizes = rows.select(F.col("doc_id").alias("sid"), F.char_length("text").cast("long").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("sid"), "sid"))  # `bound` rows at most
    few = sizes.withColumn("upto", upto).where(F.col("upto") <= chars).select("sid")
    out = kept.put(rows.join(F.broadcast(few), rows["doc_id"] == few["sid"]).drop("sid"), "labelled")
    kept.drop(rows)
    return out
