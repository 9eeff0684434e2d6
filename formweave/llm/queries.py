"""Queries over the driver's tables: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, forest, huffman, jaccard, line_dedup, packing, quality, toxicity, warc

JSON_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANK_VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), JSON_VOCABULARY)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(_table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(_table(spark, sf_dir, "documents"), RANK_VOCABULARY, public_tokenizers.PATTERN)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.token_round_trip(_table(spark, sf_dir, "documents"), JSON_VOCABULARY)


def queries() -> dict:
    return {"op1_packing": op1_packing, "op2_nearest": op2_nearest, "op3_bpe": op3_bpe, "op4_exact_dedup": op4_exact_dedup, "op5_line_dedup": op5_line_dedup, "op6_jaccard": op6_jaccard, "op7_warc": op7_warc, "op8_quality": op8_quality, "op9_toxicity": op9_toxicity, "op10_token_ids": op10_token_ids}
