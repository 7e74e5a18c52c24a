"""One query per training-data operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm import (
    chunk_dedup, host_quality, labelled, line_dedup, minhash_forest, mixing, packing, quality_nbsvm,
    range_shards, secret_scan, token_alignment, token_counts, toxicity, whitening,
)
from attesta.llm.common import read, tagged


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = tagged(host_quality.measure(docs).drop("text"), "op1")
    judged = host_quality.judge(measured, host_quality.host_verdicts(measured))
    return judged.select("doc_id", *host_quality.METRICS, "base_failed", "kept", "host_fails")


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.join(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("_r1", "_r2")


def op3_range_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = range_shards.shard_documents(docs, 8, keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, keep=["doc_id"])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels, labelled.fold(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, model)


def op10_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_nbsvm.fit(docs, labels, labelled.fold(F.col("doc_id"), 4) != 2)
    return quality_nbsvm.score(docs, model)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_host_quality": op1_host_quality,
    "op2_minhash_forest": op2_minhash_forest,
    "op3_range_shards": op3_range_shards,
    "op4_mixing": op4_mixing,
    "op5_secret_scan": op5_secret_scan,
    "op6_chunk_dedup": op6_chunk_dedup,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_quality_nbsvm": op10_quality_nbsvm,
    "op11_token_counts": op11_token_counts,
    "op12_token_alignment": op12_token_alignment,
    "op13_whitening": op13_whitening,
}
