"""Sharding, mixing, packing, the classifiers and the pipeline."""

import pathlib
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).parent))

import llm_cases as cases  # noqa: E402
from attesta.llm import labelled, mixing, packing, quality_nbsvm, queries, range_shards, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("range_rows", [4096, 8])
def test_shards(spark, range_rows, monkeypatch):
    monkeypatch.setattr(range_shards.assign, "__defaults__", (range_rows,))
    rows = cases.edge_texts() + [(500 + i, cases.prose(7, 60), "s0") for i in range(120)]
    rows += [(700, cases.prose(8, 60), "s0")] * 40 + [(800 + i, cases.prose(i, 40 + i % 30), "s1") for i in range(200)]
    got = range_shards.shard_documents(cases.frame(spark, rows), 8).collect()
    assert len(got) == len(rows)
    own = {}
    for r in got:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and r.kept == "y"
        own.setdefault(r.shard, []).append(r)
    sizes = [sum(r.size for r in x) for x in own.values()]
    assert sorted(own) == list(range(8)) and max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    for x in own.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
    spread = {}
    for r in got:
        spread.setdefault(r.text, set()).add(r.shard)
    assert sum(max(s) - min(s) for s in spread.values()) <= 7, "a group is cut only where a shard ends"


def test_range_search(spark):
    keys = [(5, 0, 0), (5, 7, 1), (9, -3, 2)]
    probes = [(4, 9, 9), (5, 0, 0), (5, 7, 0), (5, 7, 1), (9, -4, 0), (9, -3, 2), (10, 0, 0)]
    df = spark.createDataFrame(probes, "k0 long, k1 long, k2 long")
    got = [r[0] for r in df.select(range_shards.range_of(F.struct("k0", "k1", "k2"), keys)).collect()]
    assert got == [sum(k <= p for k in keys) for p in probes]


def _targets(sizes, weights):
    """Water level by bisection."""
    low, high = 0.0, 4.0 * sum(sizes.values())
    for _ in range(200):
        mid = (low + high) / 2
        full = sum(min(3 * sizes[s], mid * weights[s]) for s in sizes)
        low, high = (mid, high) if full < sum(sizes.values()) else (low, mid)
    return {s: min(3 * sizes[s], high * weights[s]) for s in sizes}


def test_mixing(spark):
    rows = cases.edge_texts() + [(100 + i, cases.prose(i, 30 + i % 50), "s0") for i in range(300)]
    rows += [(600 + i, cases.prose(i, 60), "s1") for i in range(60)]
    rows += [(300 + i, cases.prose(i, 20), "t") for i in range(2)] + [(900, "", "zero")]
    docs = cases.frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    names = sorted({s for _, _, s in rows if s is not None}) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    sizes = {n: sum(len(cases.words(t)) for _, t, s in rows if s == n) for n in names}
    want = _targets(sizes, weights)
    for n in names:
        own = [r for r in got if r.source == n]
        taken = sum(r.taken for r in own)
        assert all(r.source_size == sizes[n] and abs(r.target - want[n]) < 1e-3 for r in own)
        assert abs(taken - want[n]) <= 4 + 0.01 * want[n]
    assert all(r.taken <= 3 * r["size"] for r in got) and got[0].kept == "y"
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    mixed = mixing.mixed_documents(docs.drop("size")).collect()
    assert sum(len(cases.words(r.text)) for r in mixed) == sum(r.taken for r in got)


def test_mixing_small_sources_beside_large_blocks(spark):
    """One slot for the whole corpus makes blocks of MAX_BLOCK words; small sources still meet their targets."""
    small = (100, 150, 300, 600, 1000, 2000, 2049, 3000, 4100, 5000)
    rows = [(i, cases.prose(i, 1000), source) for i in range(240) for source in ("a", "zz")]
    for k, n in enumerate(small):
        rows += [(1000 + 100 * k + j, cases.prose(1000 + 100 * k + j, min(90, n - j)), f"m{k:02}") for j in range(0, n, 90)]
    got = mixing.mix(cases.frame(spark, rows), slots=1).collect()
    names = sorted({s for _, _, s in rows})
    sizes = {n: sum(len(cases.words(t)) for _, t, s in rows if s == n) for n in names}
    assert [sizes[f"m{k:02}"] for k in range(len(small))] == list(small)
    want = _targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    for n in names:
        own = [r for r in got if r.source == n]
        taken = sum(r.taken for r in own)
        assert abs(taken - want[n]) <= 4 + 0.01 * want[n], (n, sizes[n], want[n], taken)
        assert all(r.taken <= 3 * r["size"] for r in own)


def test_mixing_many_sources(spark):
    """More sources than fit a list in the plan, beside one with half of the words."""
    n = 120_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("h"), F.col("id")).alias("source"),
                                 F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 9 + 1).cast("int"))).alias("text"))
    hot = spark.range(n).select((F.col("id") + n).alias("doc_id"), F.lit("a").alias("source"), F.lit("v v v v v").alias("text"))
    got = mixing.mix(docs.union(hot)).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("source_size"),
        F.sum("size").alias("size")).collect()
    assert len(got) == n + 1 and all(r.source_size == r.size for r in got)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(r.source for r in got))}
    want = _targets({r.source: r.size for r in got}, weights)
    assert all(abs(r.target - want[r.source]) < 1e-3 and abs(r.taken - r.target) <= 4 + 0.01 * r.target for r in got)


def test_mixing_without_words(spark):
    got = mixing.mix(cases.frame(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_best_fill_is_best():
    rng = np.random.default_rng(1)
    for _ in range(60):
        room = int(rng.integers(5, 60))
        counts = np.zeros(80, np.int64)
        for length in rng.integers(1, 40, 4):
            counts[length] += int(rng.integers(1, 4))
        sums = {0}
        for length in np.flatnonzero(counts).tolist():
            for _ in range(int(counts[length])):
                sums |= {s + length for s in sums if s + length <= room}
        total, used = packing.best_fill(counts, room)
        assert total == max(sums) == sum(k * n for k, n in used.items())
        assert all(n <= counts[k] for k, n in used.items())


def _check_packing(docs, pieces, capacity):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_model())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {d: np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(want[p.doc_id][p.start:p.start + p.length].tobytes())
        assert p.doc_tokens == len(want[p.doc_id])
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        spans = sorted((p.start, p.start + p.length) for p in own)
        assert spans[0][0] == 0 and spans[-1][1] == len(want[d])
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    filled = 0
    for own in by_sequence.values():
        spans = sorted((p.offset, p.offset + p.length) for p in own)
        assert spans[0][0] == 0 and spans[-1][1] <= capacity
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        filled += spans[-1][1]
    assert filled >= len(by_sequence) * (capacity - packing.TOLERATED) - capacity
    return want


def test_packing_round_trip(spark):
    rows = {d: (d, t, s) for d, t, s in cases.edge_texts() if d is not None}
    rows[60] = (60, "ends <|endoftext|> here", "s0")
    rows |= {100 + i: (100 + i, cases.prose(3, 31), "s0") for i in range(40)}  # one length holds most rows
    docs = cases.frame(spark, list(rows.values()))
    pieces = packing.pack(docs, capacity=128).collect()
    want = _check_packing(docs, pieces, 128)
    made = packing.sequences(docs, spark.createDataFrame(pieces))
    ids = sorted(x for r in made.collect() for x in r.ids)
    assert ids == sorted(int(x) for v in want.values() for x in v)


def test_packing_repeated_rows_and_empty(spark):
    rows = [(1, "alpha beta", "s")] * 5 + [(None, None, None)]
    pieces = packing.pack(cases.frame(spark, rows)).collect()
    assert len(pieces) == 6 and len({(p.sequence_id, p.offset) for p in pieces}) == 6
    assert packing.pack(cases.empty(spark)).count() == 0
    assert mixing.mix(cases.empty(spark)).count() == 0
    assert range_shards.shard_documents(cases.empty(spark), 8).count() == 0


def test_segments_are_maximal():
    """Against the recursive definition: the best segment, then both sides of it."""
    def brute(scores, lo, hi):
        best = (0.0, 0, 0)
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += scores[b]
                if total > best[0] + 1e-9:
                    best = (total, a, b)
        if best[0] <= 1e-9:
            return []
        return [*brute(scores, lo, best[1]), best, *brute(scores, best[2] + 1, hi)]

    rng = np.random.default_rng(4)
    for _ in range(200):
        scores = np.where(rng.random(30) < 0.3, rng.random(30) * 3 + 0.01, -0.7)
        hits = [(i, float(s)) for i, s in enumerate(scores) if s > 0]
        got = toxicity.segments(hits, -0.7)
        want = brute(scores, 0, len(scores))
        assert [x[1:] for x in got] == [x[1:] for x in want]
        assert np.allclose([x[0] for x in got], [x[0] for x in want])


def test_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    ratio = rng.normal(size=12)
    w, b = quality_nbsvm.coordinate_descent(rows, ratio, y, rounds=2000)

    def loss(w, b):
        margin = np.array([w[r] @ ratio[r] + b for r in rows])
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * margin).sum()

    assert all(loss(w, b) <= loss(w + rng.normal(size=12) * s, b + s * rng.normal()) + 1e-6
               for s in (1e-3, 1e-2, 0.1, 1) for _ in range(200))


@pytest.mark.parametrize("name,label,least", [("op9_toxicity", "toxic", 0.93), ("op10_quality_nbsvm", "quality", 0.93)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = queries.QUERIES[name](spark, SF)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    mod, left_out = (5, 0) if label == "toxic" else (4, 2)
    assert all((zlib.crc32(str(r.doc_id).encode()) % mod == left_out) for r in rows)


@pytest.mark.parametrize("module,label,folds", [(toxicity, "toxic", 5), (quality_nbsvm, "quality", 4)])
def test_classifiers_edge_cases(spark, module, label, folds):
    docs = cases.frame(spark, cases.edge_texts())
    kind = "doc_id long, toxic int, quality int"
    some = spark.createDataFrame([(4, 1, 1), (4, 1, 1), (20, 0, 0), (21, None, None), (None, 1, 1), (22, 0, 1), (23, 1, 0)], kind)
    for labels in (some, some.limit(0), some.filter("doc_id = 4")):
        model = module.fit(docs, labels, labelled.fold(F.col("doc_id"), folds) >= 0)
        got = module.score(docs, model).collect()
        assert len(got) == len(cases.edge_texts()) and all(0 <= r.score <= 1 for r in got)
        blank = {r.score for r in got if r.doc_id in (1, 2, 3)}
        assert len(blank) == 1 and len({r.score for r in got if r.doc_id in (4, 5, 6)}) == 1
    assert module.score(cases.empty(spark), model).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    rows = cases.edge_texts() + [(300 + i, "\n".join((cases.prose(1, 60), cases.prose(300 + i, 80))), "s3") for i in range(5)]
    docs = cases.frame(spark, rows)
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    good = [r for r in rows if (m := cases.metrics(r[1]))["n_words"] >= 50 and m["n_repeat_words"] * 2 <= m["n_words"]]
    assert kept.columns == docs.columns and kept.count() == len(good)
    lines = corpus_pipeline.without_repeated_lines(spark, kept, "").cache()
    runs = cases.line_runs([(d, t) for d, t, _ in good])
    assert lines.columns == docs.columns
    assert lines.count() == sum(any(cases.words(x) for i, x in enumerate(t.split("\n")) if i not in runs[(d, t)]) for d, t, _ in good)
    assert all(r.n_chars == len(r.text) and r.size == "x" for r in lines.collect())
    single = corpus_pipeline.one_of_each_group(spark, lines, "").cache()
    classes, _ = cases.near_links([r.text for r in lines.collect()])
    assert single.columns == docs.columns and single.count() == len(set(classes))
    mixed = corpus_pipeline.mix_sources(spark, single, "").cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in single.collect()}
    total = sum(len(cases.words(r.text)) for r in single.collect())
    assert abs(sum(len(cases.words(r.text)) for r in mixed.collect()) - total) <= 20 + 0.02 * total
    pieces = corpus_pipeline.pack_sequences(spark, mixed, "")
    assert pieces.agg(F.sum("length")).first()[0] == sum(
        len(packing.ids_of(r.text, packing.default_model())) for r in mixed.collect())
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), "")
        assert out.count() == 0
