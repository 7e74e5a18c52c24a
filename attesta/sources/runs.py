"""Run documents and raw evidence files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta import schemas as S
from attesta.functions import text as tx


def read_runs(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Run documents: JSON lines, or one document per file with ``multiline``."""
    return (spark.read.schema(S.struct_of(S.RUN_DOCUMENT)).option("multiLine", multiline)
            .json(path).filter(F.col("run_id").isNotNull()))


def run_rows(docs: DataFrame) -> DataFrame:
    """One row per run with counts and spend."""
    usage = F.col("llm_usage")
    return docs.select(
        F.col("run_id").alias("id"), tx.text_of("query").alias("query"),
        F.coalesce("started_at", F.lit(0)).cast("bigint").alias("started_at"),
        F.coalesce("completed_at", F.lit(0)).cast("bigint").alias("completed_at"),
        F.coalesce("providers_used", F.array().cast("array<string>")).alias("providers_used"),
        F.coalesce(F.array_size("sources_visited"), F.lit(0)).alias("sources_count"),
        F.coalesce(F.array_size("lineage_claims"), F.lit(0)).alias("claims_count"), "error",
        F.coalesce(usage["calls"], F.lit(0)).alias("llm_calls"),
        *[F.coalesce(usage[c], F.lit(0)).alias(c)
          for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        F.nullif(usage["model"], F.lit("")).alias("llm_model"))


def visited_sources(docs: DataFrame) -> DataFrame:
    return docs.select("run_id", "completed_at", F.posexplode("sources_visited").alias("seq", "s")).select(
        "run_id", "completed_at", F.col("seq").cast("bigint").alias("seq"), "s.title", "s.url", "s.engine")


def lineage_claims(docs: DataFrame) -> DataFrame:
    """Claims of the documents; a blank child means the query itself."""
    rows = docs.select("run_id", "query", "completed_at",
                       F.posexplode("lineage_claims").alias("seq", "c")).select(
        "run_id", "query", "completed_at", F.col("seq").cast("bigint").alias("seq"), "c.*")
    return rows.withColumns({
        "child": F.coalesce(F.nullif("child", F.lit("")), tx.text_of("query")),
        "confidence": F.coalesce("confidence", F.lit(0.5)),
        "source_url": tx.text_of("source_url")})


def entity_meta(docs: DataFrame) -> DataFrame:
    return docs.select("run_id", F.explode("strain_meta").alias("slug", "m")).select(
        "run_id", "slug", "m.summary", "m.thc_range", "m.strain_type", "m.breeder")


RAW_BUCKETS = 64


def write_raw(results: DataFrame, path: str) -> None:
    """Kept results as JSON below a fixed number of folders, each run in one of them."""
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(RAW_BUCKETS))
    results.withColumn("bucket", bucket).write.mode("append").partitionBy("bucket").json(path)


def read_raw(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Raw evidence with its file name; unreadable files and non-objects are skipped."""
    schema = S.struct_of(S.PROVIDER_RESULT + ", run_id STRING, query STRING, _corrupt_record STRING")
    df = (spark.read.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE")
          .json(path).withColumn("file", F.col("_metadata.file_path")))
    something = F.coalesce("title", "url", "snippet", "source").isNotNull()
    return df.filter(F.col("_corrupt_record").isNull() & something).drop("_corrupt_record")
