"""Streams against their batch forms."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from attesta import schemas as S
from attesta.operators import aliases as al
from attesta.operators import evidence as ev
from attesta.operators import merge as mg
from attesta.plans.queries import QUERIES as graph_queries
from attesta.sources import tables as tb
from attesta.streaming import ingest as ig
from attesta.streaming import tiers as ti

from test_merge import RUNS, VIEW, claim, docs, empty_kb, rows, run

KEY = "child_slug string, parent_slug string, source_url string, quarantined boolean"


def observations(spark, rows):
    return S.conform(spark.createDataFrame(rows, KEY).withColumn("observed_at", F.lit(1).cast("long")), S.OBSERVATIONS)


def random_rows(n, seed=3):
    """Few sites, parents and sources, copies of rows, held rows, a child with a third of all."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        child = "hot" if rng.random() < .34 else f"c{rng.randint(0, 40)}"
        rows.append((child, f"p{rng.randint(0, 2 + rng.randint(0, 3))}",
                     rng.choice(["", f"https://s{rng.randint(0, 2)}.org/{rng.randint(0, 4)}"]), rng.random() < .3))
    return rows + rows[:20]


def batch_tiers(rows, pairs):
    canon = ev.canonical_observations(rows, pairs)
    return {(r.child_slug, r.machine_tier) for r in ev.child_tiers(ev.derive_edges(canon), canon).collect()}


def test_tier_stream_goes_on_after_a_restart(spark, tmp_path):
    strains = S.conform(spark.createDataFrame([("c1", ["c2", "nick"]), ("p0", ["p5"])], "slug string, aliases array<string>")
                        .withColumn("name", F.col("slug")), S.STRAINS)
    pairs = al.alias_pairs(strains)
    landing, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    rows = random_rows(260) + [("held", "p", "https://a.com", True), ("c3", "p", None, False)]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for part in (rows[:90], rows[90:150], rows[150:]):       # each run starts from the last one's checkpoint
        observations(spark, part).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(S.struct_of(S.OBSERVATIONS)).option("maxFilesPerTrigger", 1).parquet(landing)
        ti.start(stream, pairs, out, log).awaitTermination()
        so_far = spark.read.parquet(landing)
        assert {(r.child_slug, r.tier) for r in ti.standing(spark.read.parquet(out)).collect()} == batch_tiers(so_far, pairs)
    changes = spark.read.parquet(out).orderBy("child_slug", "version").collect()
    for a, b in zip(changes, changes[1:]):
        if a.child_slug == b.child_slug:                      # only moves, each from where the last one led
            assert b.was == a.tier != b.tier and b.version == a.version + 1


def test_tier_moves(spark, tmp_path):
    none = al.alias_pairs(S.conform(spark.createDataFrame([("kid",)], "slug string"), S.STRAINS))
    landing, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    moves = []
    for url, parent in [("https://a.com", "ma"), ("https://a.com/2", "ma"), ("https://b.com", "ma"), ("https://c.com", "pa")]:
        observations(spark, [("kid", parent, url, False)]).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(S.struct_of(S.OBSERVATIONS)).parquet(landing)
        ti.start(stream, none, out, log).awaitTermination()
        moves.append(sorted((r.version, r.tier) for r in spark.read.parquet(out).collect()))
    tiers = [(1, "ANECDOTAL"), (2, "COMMUNITY_CONSENSUS"), (3, "CONTRADICTED")]
    assert moves == [tiers[:1], tiers[:1], tiers[:2], tiers]


def files(root):
    return {t: {p.parent.name: p.name for p in sorted((root / t).rglob("*.parquet"))} for t in tb.TABLES}


def test_merge_touches_only_what_a_batch_changes(spark, tmp_path):
    root = tmp_path / "kb"
    more = tuple(run(f"s{i}", 10 + i, f"Other {i}", [claim(f"Other {i}", "Ma", f"Sire {i}", url=f"https://o{i}.org/")]) for i in range(6))
    merge = ig.merge_batches(str(root))
    batches = [(*RUNS[:1], *more), RUNS[1:2], RUNS[2:]]
    for i, batch in enumerate(batches):
        merge(docs(spark, *batch), i)
    whole = mg.merge_runs(empty_kb(spark), docs(spark, *RUNS, *more))
    for table, cols in VIEW.items():
        a, b = rows(ig.read(spark, str(root), table), *cols), rows(whole[table], *cols)
        assert a == b, (table, a ^ b)

    before = files(root)
    merge(docs(spark, *RUNS[2:]), 2)                          # a replayed batch, and runs already merged
    merge(docs(spark, RUNS[0]), 3)
    assert files(root) == before
    # A run of one child releases another child's parent: only buckets of those two are written.
    merge(docs(spark, run("t", 900, "Sire 3", [claim("Sire 3", "New One", url="https://n.org/")])), 4)
    after = files(root)
    bucket = {name: f"bucket={b}" for name, b in spark.createDataFrame([("sire-3",), ("other-3",)], "s string").select(
        "s", ig._bucket("s")).collect()}
    for table in ("lineage_sources", "lineage_edges", "claims"):
        changed = {b for b in after[table] if after[table][b] != before[table].get(b)}
        # Its own edge is held back, as nobody knows "New One": no edge of sire-3 yet.
        assert changed == ({bucket["other-3"]} if table == "lineage_edges" else set(bucket.values()))


def test_tier_batches_are_plain_table_work_and_replay(spark, tmp_path):
    none = al.alias_pairs(S.conform(spark.createDataFrame([("kid",)], "slug string"), S.STRAINS))
    out, log, landing = (str(tmp_path / x) for x in ("out", "log", "in"))
    first = [(f"c{i}", f"p{i % 3}", f"https://s{i % 5}.org/", i % 7 == 0) for i in range(200)] + [(None, "p", "https://a.com", False)]
    observations(spark, first).coalesce(1).write.parquet(landing)
    stream = spark.readStream.schema(S.struct_of(S.OBSERVATIONS)).parquet(landing)
    query = ti.start(stream, none, out, log)
    query.awaitTermination()
    assert all(not p["stateOperators"] for p in query.recentProgress)       # nothing is kept or visited key by key
    more = ti.members(observations(spark, [("c1", "p9", "https://s1.org/", False), ("c2", "p2", "https://z.org/", False)]), none)
    fold = ti.fold_batches(spark, out, f"{log}/members")
    before = {(r.child_slug, r.tier, r.version) for r in ti.changes(spark, out).collect()}
    assert len(before) == 201
    for _ in range(2):                                                      # a batch that failed half-way comes again
        fold(more, 1)
        added = {(r.child_slug, r.tier, r.version) for r in ti.changes(spark, out).collect()} - before
        assert added == {("c2", "COMMUNITY_CONSENSUS", 2)}
        assert ti.changes(spark, out).count() == 202
    fold(more, 2)                                                           # known rows move nothing
    assert ti.changes(spark, out).count() == 202
    touched = {p.parent.name for p in (tmp_path / "log" / "members").rglob("batch=1/*/*.parquet")}
    assert 1 <= len(touched) <= 2


def test_merge_query_takes_two_batches_however_many_files(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ig, "merge_batches", lambda root, **_: lambda docs, batch_id: seen.append((batch_id, docs.count())))
    data = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{data}/events.parquet").select(F.floor(F.col("event_id") / 25)).distinct().count()
    conf = {"spark.sql.shuffle.partitions": "6", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in conf}
    for k, value in conf.items():
        spark.conf.set(k, value)
    try:
        graph_queries["stream_merge_equals_batch"](spark, data)
    finally:
        for k, value in kept.items():
            spark.conf.set(k, value)
    assert len(seen) == 2 and sum(n for _, n in seen) == want
