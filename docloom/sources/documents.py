"""Documents from JSON and from typed tables, dates in texts, and texts in chunks."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import DOC, ISO, plain, revive


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One variant a JSON document, one document a line; .gz files are read as well."""
    return spark.read.option("singleVariantColumn", DOC).json(path)


def write_json(df: DataFrame, path: str, compressed: bool = True) -> None:
    """One document a line."""
    df.select(F.to_json(DOC).alias("value")).write.option("compression", "gzip" if compressed else "none").text(path)


def from_values(spark: SparkSession, docs: list[dict[str, Any]]) -> DataFrame:
    """(_ord, _id, doc) of Python dictionaries; the id is taken out of the document."""
    rows = [(i, d.get("_id"), json.dumps(plain({k: v for k, v in d.items() if k != "_id"}), ensure_ascii=False)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "_ord long, _id string, json string").select("_ord", "_id", F.parse_json("json").alias(DOC))


def from_typed(df: DataFrame) -> DataFrame:
    """(_id, doc) of a table: a column that is NULL is a field that is missing."""
    cols = [c for c in df.columns if c != "_id"]
    stamp = lambda f: F.date_format(F.col(f"`{f.name}`"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(f.name) if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(f"`{f.name}`")
    body = F.parse_json(F.to_json(F.struct(*[stamp(df.schema[c]) for c in cols])))
    own = F.col("_id").cast("string") if "_id" in df.columns else F.lit(None).cast("string")
    return df.select(own.alias("_id"), body.alias(DOC))


def to_values(df: DataFrame) -> list[dict[str, Any]]:
    """Rows as Python dictionaries, with dates as datetimes; for results that fit the driver."""
    if DOC not in df.columns:
        return [r.asDict(True) for r in df.collect()]
    names = [c for c in df.columns if c not in (DOC, "_pos")]
    rows = df.select(*names, F.to_json(DOC).alias(DOC)).collect()
    return [{**{n: r[n] for n in names if r[n] is not None}, **revive(json.loads(r[DOC] or "{}"))} for r in rows]


def revived(text: Column) -> Column:
    """A text of the exact date form as an instant, else NULL."""
    return F.when(text.rlike(ISO), F.try_to_timestamp(text))


def chunks(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, chunk, body): a text in pieces of `size` characters; an empty text has none."""
    if size < 1:
        raise ValueError("a chunk holds a character at least")
    n = F.ceil(F.char_length(text_col) / F.lit(size)).cast("int")
    at = F.sequence(F.lit(0), n - 1)
    cut = F.when(n > 0, F.transform(at, lambda i: F.substr(F.col(text_col), i * size + 1, F.lit(size))))
    return df.select(id_col, F.posexplode(cut).alias("chunk", "body"))


def joined(df: DataFrame, id_col: str) -> DataFrame:
    """(id, text): chunks put together in order."""
    parts = F.array_sort(F.collect_list(F.struct("chunk", "body")))
    return df.groupBy(id_col).agg(F.array_join(F.transform(parts, lambda p: p["body"]), "").alias("text"))
