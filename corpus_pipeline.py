"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm import host_quality, line_dedup, minhash_forest, mixing, packing
from attesta.llm.common import packed, unpacked
from attesta.session import materialize


#: The column that depends on the text.
COUNTED = frozenset({"n_chars"})


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c in COUNTED else c for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rule and whose host has no bad verdict."""
    measured = host_quality.measure(packed(docs, "text", "source"))
    judged = host_quality.judge(measured, host_quality.host_verdicts(measured))
    return unpacked(judged.filter("kept"), docs.columns, "text", "source")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later repeated runs of lines; a document of nothing else goes."""
    out = line_dedup.dedup_lines(packed(docs, "doc_id", "text"))
    out = out.filter(r"n_deleted = 0 or text rlike '[^\x20\x09-\x0D]'")
    return _counted(unpacked(out, docs.columns, "doc_id", "text"), docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return unpacked(minhash_forest.keep_one(packed(docs, "doc_id", "text")), docs.columns, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that each source has its target share of words."""
    out = mixing.mixed_documents(packed(docs, "text", "source"))
    return _counted(unpacked(out, docs.columns, "text", "source"), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", without_repeated_lines),
    ("n-gram jaccard join", one_of_each_group),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Signatures and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
