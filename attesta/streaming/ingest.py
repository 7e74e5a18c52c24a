"""Run documents as a stream: evidence tables kept current by touching only what a batch changes.

Every table lies in a fixed number of buckets by its own key.  A batch names a few children; what it
can change is bounded by them: their observations, claims, edges and tiers, the children that waited for
a parent that becomes known, and the entities and sources named.  Only those rows, with the entities
that they mention, are merged by ``operators.merge``; only buckets that hold a changed row are written
again, by dynamic partition overwrite.

A batch that fails half-way is merged again under the engine's batch id.  Upserts give the same rows a
second time, and the runs, by which a document counts as merged, are written last.  Readers may see some
tables of a batch before the others.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta import schemas as S
from attesta import vocab as V
from attesta.functions import text as tx
from attesta.operators import aliases as al
from attesta.operators import gate as gt
from attesta.operators import merge as mg
from attesta.session import materialize, write_step
from attesta.sources import runs as rn
from attesta.sources import tables as tb

BUCKETS = 64
KEY = {"strains": "slug", "sources": "url", "lineage_sources": "child_slug", "claims": "child_slug",
       "lineage_edges": "child_slug", "research_runs": "id"}
#: What tells rows of one key apart; never null in a stored row.
ROW = {"strains": ["slug"], "sources": ["url"], "lineage_sources": gt.OBS_KEY, "claims": ["id"],
       "lineage_edges": ["child_slug", "parent_slug"], "research_runs": ["id"]}
#: Lookups beside the tables, appended to: who waits for a parent, whose an alias is.
INDEXES = {"waiting": "parent_slug STRING, child_slug STRING", "aliases": "alias STRING, slug STRING"}


def _bucket(key: str | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _numbers(keys: DataFrame) -> list[int]:
    """The buckets of some keys, BUCKETS numbers at most."""
    return [r["b"] for r in keys.select(_bucket(F.col(keys.columns[0])).alias("b")).distinct().collect()]


def _stored(spark: SparkSession, root: str, name: str, ddl: str) -> DataFrame:
    schema = S.struct_of(ddl + ", bucket INT")
    try:
        return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema)


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A whole table as it stands."""
    return S.conform(_stored(spark, root, table, tb.TABLES[table]).drop("bucket"), tb.TABLES[table])


def _rows_of(spark: SparkSession, root: str, name: str, ddl: str, key: str, keys: DataFrame) -> DataFrame:
    """Rows of some keys; only their buckets are read."""
    here = _stored(spark, root, name, ddl).filter(F.col("bucket").isin(_numbers(keys)))
    return here.join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_semi").drop("bucket")


def _append(rows: DataFrame, root: str, name: str, key: str, batch_id: int) -> None:
    (rows.distinct().withColumns({"bucket": _bucket(key), "batch": F.lit(batch_id)})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch")
     .parquet(f"{root.rstrip('/')}/{name}"))


def _replace(before: DataFrame, after: DataFrame, root: str, table: str) -> None:
    """Write again the buckets that hold a row of ``after`` that is not in ``before``, or lack one that was."""
    spark, key, ddl = after.sparkSession, KEY[table], tb.TABLES[table]
    digest = F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("d")
    told = [df.select(_bucket(key).alias("b"), digest, F.lit(n).alias("n")) for df, n in ((before, -1), (after, 1))]
    moved = told[0].unionByName(told[1]).groupBy("b", "d").agg(F.sum("n").alias("n")).filter("n <> 0")
    numbers = [r["b"] for r in moved.select("b").distinct().collect()]  # BUCKETS numbers at most
    if not numbers:
        return
    same = before.select(*ROW[table]).unionByName(after.select(*ROW[table])).distinct()
    after = after.withColumn("bucket", _bucket(key)).filter(F.col("bucket").isin(numbers))
    rest = _stored(spark, root, table, ddl).filter(F.col("bucket").isin(numbers)).join(same, ROW[table], "left_anti")
    rows = materialize(rest.unionByName(after), table)
    (rows.repartition(min(len(numbers), 8), "bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root.rstrip('/')}/{table}"))


def _names(df: DataFrame, *columns: str | Column) -> DataFrame:
    """All values of some columns, once each, as ``name``."""
    values = F.explode(F.array(*[F.col(c) if isinstance(c, str) else c for c in columns]))
    return df.select(values.alias("name")).filter("name <> ''").distinct()


def affected(spark: SparkSession, root: str, docs: DataFrame) -> dict[str, DataFrame]:
    """The part of every table that merging ``docs`` can read or change.

    Complete because (1) edges and tiers of a child depend on its own
    observations and on whose aliases their parents are; (2) a row that waits is
    released only when its parent becomes an entity or a dictionary alias.
    """
    ddl = tb.TABLES
    claims = rn.lineage_claims(docs)
    more = F.coalesce("extra_parents", F.array().cast("array<string>"))
    named = materialize(claims.select(
        tx.slug("child").alias("child"), F.transform(F.concat(F.array("parent_a", "parent_b"), more), tx.slug).alias("parents"),
        tx.slug("query").alias("subject")), "named")
    subjects = docs.select(tx.slug("query").alias("name"))
    fixed = spark.createDataFrame([(x,) for x in sorted({*V.SAFE_ALIASES, *V.SAFE_ALIASES.values()})], "name STRING")
    born = _names(named, "child", "subject").unionByName(subjects).unionByName(fixed).distinct()

    def owners(names: DataFrame) -> DataFrame:
        return _rows_of(spark, root, "aliases", INDEXES["aliases"], "alias", names).select(F.col("slug").alias("name"))

    waiting = _rows_of(spark, root, "waiting", INDEXES["waiting"], "parent_slug", born)
    children = (_names(named, "child").unionByName(waiting.select(F.col("child_slug").alias("name")))
                .unionByName(fixed)).distinct()
    children = materialize(children.unionByName(owners(children)).distinct(), "children")
    known = _rows_of(spark, root, "strains", ddl["strains"], "slug", children)
    spellings = known.select(F.explode(tx.alias_slugs("aliases")).alias("name"))
    children = materialize(children.unionByName(spellings).distinct(), "children")

    obs = materialize(_rows_of(spark, root, "lineage_sources", ddl["lineage_sources"], "child_slug", children), "obs")
    names = (children.unionByName(born).unionByName(obs.select(F.col("parent_slug").alias("name")))
             .unionByName(named.select(F.explode("parents").alias("name")))).distinct()
    names = materialize(names.unionByName(owners(names)).distinct(), "names")
    urls = rn.visited_sources(docs).select("url").distinct()
    part = {"lineage_sources": obs,
            "strains": materialize(_rows_of(spark, root, "strains", ddl["strains"], "slug", names), "strains"),
            "claims": _rows_of(spark, root, "claims", ddl["claims"], "child_slug", children),
            "lineage_edges": _rows_of(spark, root, "lineage_edges", ddl["lineage_edges"], "child_slug", children),
            "sources": _rows_of(spark, root, "sources", ddl["sources"], "url", urls),
            "research_runs": _rows_of(spark, root, "research_runs", ddl["research_runs"], "id", docs.select("run_id"))}
    return {t: S.conform(df, ddl[t]) for t, df in part.items()}


def merge_batches(root: str, raw: DataFrame | None = None, session: SparkSession | None = None):
    """``foreachBatch`` function that merges run documents into the tables under ``root``.

    ``session`` is the caller's: a stream's own has adaptive execution switched off.
    """

    def merge(docs: DataFrame, batch_id: int) -> None:
        spark = session or docs.sparkSession
        docs = S.conform(docs, S.RUN_DOCUMENT).filter(F.col("run_id").isNotNull())
        docs = spark.read.schema(docs.schema).parquet(write_step(docs, "docs"))
        done = _rows_of(spark, root, "research_runs", tb.TABLES["research_runs"], "id", docs.select("run_id"))
        docs = materialize(docs.join(done.select(F.col("id").alias("run_id")), "run_id", "left_anti"), "docs")
        if docs.isEmpty():
            return
        before = affected(spark, root, docs)
        after = mg.merge_runs({t: df for t, df in before.items() if t != "lineage_edges"}, docs, raw)
        after = {t: S.conform(after[t], tb.TABLES[t]) for t in tb.TABLES}
        after |= {t: materialize(after[t], t) for t in ("strains", "claims")}  # the others are stored or small
        _append(gt.pending(after["lineage_sources"]).select("parent_slug", "child_slug"), root, "waiting", "parent_slug", batch_id)
        _append(al.alias_pairs(after["strains"]), root, "aliases", "alias", batch_id)
        for table in (*[t for t in tb.TABLES if t != "research_runs"], "research_runs"):
            _replace(before[table], after[table], root, table)

    return merge


def merge_stream(spark: SparkSession, docs_path: str, root: str, checkpoint: str,
                 files_per_batch: int | None = None, trigger: dict | None = None):
    """Start merging run documents as they land in ``docs_path``.

    A batch takes some fifty jobs however few documents it holds, so ``files_per_batch`` should grow with
    the number of files.
    """
    reader = spark.readStream.schema(S.struct_of(S.RUN_DOCUMENT))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (reader.json(docs_path).writeStream.foreachBatch(merge_batches(root, session=spark))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
