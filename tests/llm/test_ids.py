"""Ids and foreign columns reach the result as they were."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from attesta.llm import chunk_dedup, minhash_forest, mixing, packing, quality_nbsvm, range_shards, toxicity

from llm_cases import prose

BIG = 2 ** 53
IDS = [None, BIG + 1, BIG + 3, 7, None]
TEXTS = [prose(1, 80), prose(2, 80), prose(2, 80), None, ""]
NOTES = "_note string, `_source` string, hash_of_text string, `_hash` string, doc string, `_doc` string, `a.b` string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, f"s{i % 2}", *"nshxyzq") for i, (d, t) in enumerate(zip(IDS, TEXTS))]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {NOTES}").coalesce(1)


@pytest.fixture(scope="module")
def models(spark):
    labelled = spark.createDataFrame([(i, prose(50 + i, 60) + (" vile" if i % 2 else " kind")) for i in range(24)],
                                     "doc_id long, text string")
    marks = spark.range(24).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"),
                                   (F.col("id") % 2).cast("int").alias("quality"))
    return toxicity.fit(labelled, marks, F.lit(True)), quality_nbsvm.fit(labelled, marks, F.lit(True))


def ids(df, column="doc_id"):
    return sorted((r[0] is None, r[0] or 0) for r in df.select(column).collect())


def test_ids_beside_a_null_stay_exact(docs, models):
    want = sorted((d is None, d or 0) for d in IDS)
    assert ids(minhash_forest.join(docs)) == want
    assert ids(chunk_dedup.dedup(docs)) == want
    assert ids(toxicity.score(docs, models[0])) == want
    assert ids(quality_nbsvm.score(docs, models[1])) == want
    assert {r.doc_id for r in packing.pack(docs).select("doc_id").collect()} == set(IDS)
    assert {r.class_id for r in minhash_forest.join(docs).collect()} <= set(IDS)
    kept = {r.doc_id: r.keep_id for r in chunk_dedup.dedup(docs).collect()}
    assert kept[BIG + 3] == BIG + 1 == kept[BIG + 1]


def test_text_ids(docs):
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = {r.doc_id: r.keep_id for r in chunk_dedup.dedup(named).collect()}
    assert got[f"d{BIG + 3}"] == f"d{BIG + 1}"
    assert range_shards.shard_documents(named, 2).count() == len(IDS)


def test_foreign_columns_pass_through(docs):
    names = [c for c in docs.columns if c not in ("size",)]
    shards = range_shards.shard_documents(docs, 2)
    assert shards.columns == [*names, "size", "text_crc32", "shard", "slot"]
    mixed = mixing.mix(docs)
    assert mixed.columns == [*names, "size", "source_size", "target", "taken"]
    for out in (shards, mixed):
        assert {(r._note, r._source, r.hash_of_text, r["_hash"], r.doc, r["_doc"], r["a.b"]) for r in out.collect()} == {tuple("nshxyzq")}
