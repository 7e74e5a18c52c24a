"""Saved evidence tables: versioned Parquet folders with additive schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta import schemas as S
from attesta.sources.ledger import path_exists

TABLES = {
    "strains": S.STRAINS, "sources": S.SOURCES, "lineage_sources": S.OBSERVATIONS,
    "claims": S.CLAIMS, "research_runs": S.RUNS, "lineage_edges": S.EDGES,
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], S.struct_of(TABLES[table]))


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table in today's schema, however old its files; empty if not written yet."""
    path = f"{root.rstrip('/')}/{table}"
    if not path_exists(spark, path):
        return empty(spark, table)
    return S.conform(spark.read.option("mergeSchema", True).parquet(path), TABLES[table])


def write_table(df: DataFrame, root: str, table: str, mode: str = "errorifexists") -> None:
    S.conform(df, TABLES[table]).write.mode(mode).parquet(f"{root.rstrip('/')}/{table}")


def write_bucketed(df: DataFrame, name: str, buckets: int, key: str = "child_slug") -> None:
    """Save as a table bucketed and sorted on the key that derivations group by."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def read_kb(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in TABLES if name != "lineage_edges"}


def write_kb(tables: dict[str, DataFrame], root: str) -> None:
    """Write one consistent version of every table under a new root."""
    for name in TABLES:
        if name in tables:
            write_table(tables[name], root, name)
