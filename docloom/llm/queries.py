"""Queries of this folder's operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, licences, nearest, packing, pieces, quality, simhash, suffix_dedup, token_counts, toxicity
from .common import table

#: Vocabulary of op1, op3 and op7.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pieces.encode_decode(table(spark, sf_dir, "documents"), PIECES)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(pieces.ids_text(F.col("ids")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"), words=51)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "n_passage_words")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(spark, table(spark, sf_dir, "documents"), PIECES)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(spark, table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_dedup(spark, table(spark, sf_dir, "documents"))
    return d.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECES)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = toxicity.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = licences.scan_licences(table(spark, sf_dir, "documents"))
    return d.select("doc_id", *licences.summary(F.col("matches")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_suffix_dedup, op3_best_fit_packing, op4_nearest_neighbours, op5_quality,
        op6_simhash_near_dedup, op7_token_counts, op8_exact_dedup, op9_toxicity, op10_licence_scan,
    )
}

ORACLE_SQL = {
    "op8_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept,
       h AS text_sha256
FROM d
WINDOW w AS (PARTITION BY h ORDER BY length(t) DESC, doc_id ASC)
""",
}
