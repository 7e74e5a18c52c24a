"""What the shared steps leave on disk, and that observations stay those of their pages."""

from __future__ import annotations

import pathlib

from pyspark.sql import functions as F

from attesta.plans.evidence_views import Views
from attesta.session import write_step

DATA = "/root/testdata/sf0.001"


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i)) for i in range(files.size()) if "shuffle_" in str(files.apply(i))}


def test_a_written_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    write_step(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert shuffle_files(spark) <= before


def test_edges_store_the_observations_once(spark, tmp_path):
    for file in pathlib.Path(DATA).iterdir():
        if file.name != "pages.parquet":
            (tmp_path / file.name).symlink_to(file)
    twin = F.when(F.col("page_id") % 50 == 3, "https://same.example.com/").otherwise(F.col("url"))     # pages that share a URL
    spark.read.parquet(f"{DATA}/pages.parquet").withColumn("url", twin).write.parquet(str(tmp_path / "pages.parquet"))
    v = Views(spark, str(tmp_path))
    v.edges
    assert "canon" not in v._steps
    assert v.obs.filter("source_url = 'https://same.example.com/'").count() > 1
    parts, n = v.table("part").count(), v.table("pages").count()
    item = v.table("lineitem").select((F.col("l_partkey") + parts * (F.col("l_orderkey") % 20)).alias("c"),
                                      (F.col("l_suppkey") % 3 + 1 + 3 * (F.col("l_partkey") % 7)).alias("p"),
                                      (F.col("l_orderkey") % n).alias("page_id"), "l_returnflag").filter("c <> p")
    want = item.join(v.pages, "page_id").groupBy("c", "p", "source_url").agg(F.min(F.col("l_returnflag") == "R").alias("q"))
    got = v.obs.select(F.substring("child_slug", 2, 20).cast("long"), F.substring("parent_slug", 2, 20).cast("long"), "source_url", "quarantined")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
