"""From raw documents to packed training bins: toxic documents go, then exact copies, near copies and repeated passages;
what is left is packed. Each stage reads what the one before wrote.

All stages but the last return the columns of documents. Null texts count as empty, repeated rows as copies, and an
empty table passes through; each operator's module says the rest.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm import exact_dedup, packing, simhash, suffix_dedup, toxicity
from docloom.llm.common import finished, scratch_path, staged, table

#: Vocabulary whose ids are counted for packing.
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(spark, docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_least(spark, docs, width=5, least=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_texts(spark, docs, words=51)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(spark, docs, MODEL)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: The fitted classifier, fingerprints and suffix sorting have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path, mark = scratch_path(spark, "pipeline-" + name.replace(" ", "-")), staged()
        stage(spark, docs, sf_dir).write.parquet(path)
        finished(spark, mark)
        docs = spark.read.parquet(path)
    return docs
