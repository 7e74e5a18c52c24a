"""The append-only research ledger (JSON lines)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta import schemas as S
from attesta.functions import text as tx
from attesta.operators import claims as cl
from attesta.session import materialize


def parse_lines(lines: DataFrame, column: str = "value", fields: str = S.LEDGER_ROW) -> DataFrame:
    """Ledger rows of text lines; blank and malformed lines disappear.

    ``fields`` may name fewer fields (with ``kind``), which costs less.
    """
    row = F.from_json(F.col(column), fields, {"mode": "PERMISSIVE"})
    return (lines.filter(tx.nonblank(column)).select(row.alias("r"))
            .filter(F.col("r.kind").isNotNull()).select("r.*"))


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All ledger rows; a ledger that does not exist yet is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], S.struct_of(S.LEDGER_ROW))
    return parse_lines(spark.read.option("recursiveFileLookup", True).text(path))


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    return read_ledger(spark, path).filter("kind = 'lineage_claim'")


def claims_of_entity(rows: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Claims naming an entity as child, query or a main parent, newest first."""
    target = name.strip().lower().replace(" ", "-")
    if not target:
        return rows.filter(F.lit(False))
    trimmed = [tx.ledger_fold(tx.strip(tx.text_of(c))) for c in ("claim.child", "query")]
    parents = [tx.ledger_fold(c) for c in ("claim.parent_a", "claim.parent_b")]
    hit = F.array_contains(F.array(*trimmed, *parents), target)
    return (rows.filter((F.col("kind") == "lineage_claim") & hit)
            .orderBy(F.desc(F.coalesce("ingested_at", F.lit(0))), "run_id", "claim.source_url").limit(limit))


def ledger_lines(runs: DataFrame, visited: DataFrame, claims: DataFrame) -> DataFrame:
    """Lines to append: a summary per run (failed ones too), then its claims.

    ``runs`` has run_id, query, started_at, completed_at, providers_used, error,
    llm_usage, cache_usage; ``claims`` is tier-stamped with a ``seq``.
    """
    summary = cl.run_summaries(runs, visited, claims)
    head = summary.select("run_id", F.lit(-1).cast("bigint").alias("seq"), F.to_json(F.struct(
        F.lit("research_run").alias("kind"), "run_id", "query", "started_at", "completed_at",
        "providers_used", "sources_count", "lineage_claims_count", "disagreement_count",
        "node_count", "edge_count", "error", "llm_usage", "cache_usage"),
        {"ignoreNullFields": "false"}).alias("value"))
    fields = [f.name for f in S.struct_of(S.LINEAGE_CLAIM).fields]
    claim = S.conform(claims, S.LINEAGE_CLAIM + ", run_id STRING, seq BIGINT")
    at = runs.select("run_id", "query", F.col("completed_at").alias("ingested_at"))
    body = claim.join(at, "run_id").select("run_id", "seq", F.to_json(F.struct(
        F.lit("lineage_claim").alias("kind"), "run_id", "query",
        F.struct(*fields).alias("claim"), "ingested_at"), {"ignoreNullFields": "false"}).alias("value"))
    return head.unionByName(body)


#: Folders that runs are dealt into.
RUN_BUCKETS = 64


def _written(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    """Kind and run of the ledger rows of some buckets, and of files that lie in none (older ledgers)."""
    fields = "kind STRING, run_id STRING"
    rows = spark.createDataFrame([], S.struct_of(fields))
    for part in [f"{path}/part-*", *[f"{path}/bucket={b}" for b in buckets]]:
        try:
            rows = rows.unionByName(parse_lines(spark.read.text(part), fields=fields))
        except AnalysisException:  # nothing there yet
            pass
    return rows


def append(spark: SparkSession, path: str, runs: DataFrame, visited: DataFrame, claims: DataFrame) -> None:
    """Append runs that the ledger does not hold yet; a replay adds nothing.

    A run lies in the bucket of its id, so only the new runs' buckets are read.
    """
    path, bucket = path.rstrip("/"), F.pmod(F.xxhash64("run_id"), F.lit(RUN_BUCKETS)).cast("int")
    touched = [r["b"] for r in runs.select(bucket.alias("b")).distinct().collect()]  # RUN_BUCKETS numbers at most
    done = _written(spark, path, touched).filter("kind = 'research_run'").select("run_id").distinct()
    # The counts of a summary read the claims again and again, so both are stored first.
    fresh = materialize(runs.join(done, "run_id", "left_anti"), "runs")
    ids = fresh.select("run_id")
    told = materialize(claims.join(ids, "run_id", "left_semi"), "claims")
    lines = ledger_lines(fresh, visited.join(ids, "run_id", "left_semi"), told)
    # A run lies in one file, its summary before its claims.
    lines = lines.withColumn("bucket", bucket).repartition("run_id").sortWithinPartitions("bucket", "run_id", "seq")
    lines.select("bucket", "value").write.mode("append").partitionBy("bucket").text(path)
