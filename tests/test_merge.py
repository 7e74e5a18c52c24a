"""Run merging, the parent gate and curation folds."""

import random

from pyspark.sql import functions as F

from attesta import schemas as S
from attesta.operators import curate as cu
from attesta.operators import gate as gt
from attesta.operators import merge as mg
from attesta.operators import upserts as up
from attesta.session import materialize
from attesta.sources import tables as tb


def claim(child, a, b="", url="https://a.com/1", conf=.7, extra=(), roles=None):
    return {"child": child, "parent_a": a, "parent_b": b, "extra_parents": list(extra), "source_url": url,
            "source_title": "t", "source_engine": "e", "snippet_excerpt": f"{child}: {a} {b}", "confidence": conf,
            "raw_text": "", "tier": None, "parent_roles": roles}


def run(run_id, at, query, claims, meta=None, **more):
    return {"query": query, "run_id": run_id, "started_at": at - 5, "completed_at": at, "providers_used": ["w"],
            "sources_visited": [{"title": "T", "url": c["source_url"], "engine": "e"} for c in claims],
            "lineage_claims": claims, "strain_meta": meta or {}, "raw_dir": None, "error": None,
            "llm_usage": None, **more}


def docs(spark, *runs):
    return spark.createDataFrame(list(runs), S.struct_of(S.RUN_DOCUMENT))


def empty_kb(spark):
    return {t: tb.empty(spark, t) for t in tb.TABLES if t != "lineage_edges"}


def rows(df, *cols):
    return {tuple(str(x) for x in r) for r in df.select(*cols).collect()}


RUNS = (
    run("r1", 100, "Kid", [claim("Kid", "Ma", "Pa"), claim("Kid", "GSC", url="https://b.org/")],
        {"kid": {"summary": "s1", "thc_range": None, "strain_type": "indica", "breeder": ""}}),
    run("r2", 200, "Ma", [claim("Ma", "Old One", url="https://c.net/", roles={"Old One": "female"})]),
    run("r3", 300, "Girl Scout Cookies", [claim("Girl Scout Cookies", "Ma", "Thai", url="https://d.net/")],
        {"kid": {"summary": "s2", "thc_range": "20%", "strain_type": None, "breeder": "Bob"}}),
    run("r4", 400, "kid", [claim("KID", "gsc", "Ma", url="https://e.net/", conf=.9), claim("kid", "Ma", "Pa", conf=.95)],
        {"kid": {"summary": "s3", "thc_range": "21%", "strain_type": "x", "breeder": "Eve"}}),
)
VIEW = {
    "strains": ("slug", "name", "trust_tier", "confidence", "summary", "thc_range", "strain_type", "breeder",
                "first_seen", "last_researched", "aliases"),
    "sources": ("url", "title", "fetched_at"),
    "lineage_sources": ("child_slug", "parent_slug", "source_url", "confidence", "role", "quarantined",
                        "quarantine_reason", "observed_at", "excerpt"),
    "claims": ("child_slug", "value", "source_url", "quarantined", "created_at"),
    "research_runs": ("id", "query", "sources_count", "claims_count"),
    "lineage_edges": ("child_slug", "parent_slug", "agreement", "source_count", "avg_confidence"),
}


def test_batch_merge_equals_one_by_one(spark):
    whole = {t: materialize(df) for t, df in mg.merge_runs(empty_kb(spark), docs(spark, *RUNS)).items()}
    step = empty_kb(spark)
    for r in (RUNS[:1], RUNS[1:2], RUNS[2:]):
        step = mg.merge_runs(step, docs(spark, *r))
        step = {t: materialize(df) for t, df in step.items()}
    for table, cols in VIEW.items():
        a, b = rows(whole[table], *cols), rows(step[table], *cols)
        assert a == b, (table, a ^ b)

    obs = {(r.child_slug, r.parent_slug, r.source_url): r for r in whole["lineage_sources"].collect()}
    assert obs["kid", "pa", "https://a.com/1"].quarantine_reason == "UNRESOLVED_PARENT"
    assert not obs["kid", "ma", "https://a.com/1"].quarantined            # ma became real in r2
    assert obs["kid", "ma", "https://a.com/1"].confidence == .95
    assert obs["kid", "gsc", "https://b.org/"].parent_slug == "gsc"       # before the owner existed
    assert ("kid", "girl-scout-cookies", "https://e.net/") in obs          # after
    assert obs["ma", "old-one", "https://c.net/"].role == "female"
    kid = whole["strains"].filter("slug = 'kid'").first()
    assert (kid.name, kid.summary, kid.thc_range, kid.breeder, kid.first_seen, kid.last_researched) == \
        ("Kid", "s1", "21%", "", 100, 400)
    hidden = rows(whole["claims"].filter("quarantined"), "value")
    assert ("Kid = Ma × Pa",) in hidden and ("KID = gsc × Ma",) not in hidden
    assert "VERIFIED" not in {r.trust_tier for r in whole["strains"].collect()}
    # Merging a run again changes nothing.
    again = mg.merge_runs({t: whole[t] for t in step if t != "lineage_edges"}, docs(spark, RUNS[3]))
    for table in ("lineage_sources", "claims", "lineage_edges"):
        assert rows(again[table], *VIEW[table]) == rows(whole[table], *VIEW[table])
    counts = dict(mg.merge_counts(empty_kb(spark), whole, docs(spark, *RUNS)).collect())
    # Touched per run: kid; ma; gsc and the by then known ma; kid, gsc by alias, ma.
    assert counts == {"strains": 7, "edges": 10, "claims": 6, "sources": 6}


def test_mined_summary_fills_only_blanks(spark):
    raw = spark.createDataFrame([
        ("r9", "Kid", "Kid", "https://en.wikipedia.org/wiki/Kid", "Kid is a hybrid cultivar from the coast.", "wikipedia"),
        ("r9", "Kid", "Kid shop", "https://shop.com", "Kid is a song about weed and a strain.", "web"),
    ], "run_id string, query string, title string, url string, snippet string, source string")
    kb = mg.merge_runs(empty_kb(spark), docs(spark, run("r9", 10, "Kid", [])), raw)
    kid = kb["strains"].first()
    assert kid.summary == "Kid is a hybrid cultivar from the coast." and "wikipedia" in kid.summary_source_url
    told = {"kid": {"summary": "told", "thc_range": None, "strain_type": None, "breeder": None}}
    kb = mg.merge_runs(empty_kb(spark), docs(spark, run("r9", 10, "Kid", [], told)), raw)
    assert kb["strains"].first().summary == "told"


def gate_world(spark):
    obs = S.conform(spark.createDataFrame([
        ("a", "ghost", "u1", True, "UNRESOLVED_PARENT"), ("b", "ghost", "u2", True, None),
        ("c", "ghost", "u3", False, "HUMAN_APPROVED"), ("d", "real", "u4", True, "UNRESOLVED_PARENT"),
        ("e", "spook", "u5", True, "UNRESOLVED_PARENT"), ("e", "real", "u5", False, None),
    ], "child_slug string, parent_slug string, source_url string, quarantined boolean, quarantine_reason string")
        .withColumn("observed_at", F.lit(7)), S.OBSERVATIONS)
    strains = S.conform(spark.createDataFrame([("real", []), ("a", []), ("e", [])], "slug string, aliases array<string>")
                        .withColumn("name", F.col("slug")), S.STRAINS)
    claims = S.conform(spark.createDataFrame([
        (1, "a", "LINEAGE", "a = Ghost", "u1", True, "UNRESOLVED_PARENT"), (2, "d", "LINEAGE", "d = Real", "u4", True, "UNRESOLVED_PARENT"),
        (3, "e", "LINEAGE", "e = x", "u5", False, None), (4, "e", "NOTE", "n", "u5", False, None), (5, "b", "LINEAGE", "b", "u2", True, None),
    ], "id long, child_slug string, type string, value string, source_url string, quarantined boolean, quarantine_reason string"), S.CLAIMS)
    return obs, strains, claims


def test_gate(spark):
    obs, strains, claims = gate_world(spark)
    out = gt.run_gate(obs, strains, obs)
    got = {(r.child_slug, r.parent_slug): (r.quarantined, r.quarantine_reason) for r in out.collect()}
    assert got == {("a", "ghost"): (True, "UNRESOLVED_PARENT"), ("b", "ghost"): (True, None),
                   ("c", "ghost"): (False, "HUMAN_APPROVED"), ("d", "real"): (False, None),
                   ("e", "spook"): (True, "UNRESOLVED_PARENT"), ("e", "real"): (False, None)}
    synced = {r.id: (r.quarantined, r.quarantine_reason) for r in gt.sync_claims(claims, out).collect()}
    assert synced == {"1": (True, "UNRESOLVED_PARENT"), "2": (False, None), "3": (True, "UNRESOLVED_PARENT"),
                      "4": (False, None), "5": (True, None)}
    assert rows(gt.run_gate(out, strains, out), *VIEW["lineage_sources"]) == rows(out, *VIEW["lineage_sources"])
    known, unknown = gt.split_by_known_parent(obs, strains)
    assert known.count() == 2 and unknown.count() == 4
    q = {r.parent_slug: (r.observation_count, r.total_observations, r.parent_name) for r in gt.pending_parents(out, 1).collect()}
    assert q == {"ghost": (1, 2, "Ghost")}


def test_quarantine_and_resolve(spark):
    obs, strains, claims = gate_world(spark)
    events = spark.createDataFrame([("e", "real", "u5", True, 9, 1), ("a", "ghost", "u1", False, 9, 2), ("x", "y", "z", True, 9, 3)],
                                   "child_slug string, parent_slug string, source_url string, quarantined boolean, at long, seq long")
    o, c, s, bad = cu.apply_quarantines(obs, claims, strains, events)
    got = {(r.child_slug, r.parent_slug): (r.quarantined, r.quarantine_reason) for r in o.collect()}
    assert got["e", "real"] == (True, None) and got["a", "ghost"] == (False, "HUMAN_APPROVED")
    by_id = {r.id: r.quarantined for r in c.collect()}
    assert by_id["1"] is False and by_id["3"] is True and by_id["4"] is False
    assert bad.count() == 1 and s.filter("slug = 'ghost'").first().origin == "resolved"

    ev = spark.createDataFrame([("ghost", "", "", 5, 1), ("spook", "", "real", 5, 2), ("nobody", "", "", 5, 3),
                                ("ghost", "", "nowhere", 5, 0), ("ghost", "Late", "", 5, 9)],
                               "parent_slug string, name string, alias_of string, at long, seq long")
    r = cu.resolve_parents(obs, claims, strains, ev)
    got = {(x.child_slug, x.parent_slug): (x.quarantined, x.quarantine_reason) for x in r["observations"].collect()}
    assert got["a", "ghost"] == (False, None) and got["b", "ghost"] == (True, None) and got["e", "spook"] == (False, None)
    al = {x.slug: (x.name, x.aliases) for x in r["strains"].collect()}
    assert al["ghost"][0] == "Ghost" and al["real"][1] == ["spook"] and "spook" not in al
    assert rows(r["children"], "parent_slug", "child_slug") == {("ghost", "a"), ("ghost", "c"), ("real", "e")}
    assert sorted((x.seq, x.error) for x in r["errors"].collect()) == [
        (0, "alias target unknown"), (3, "nothing pending"), (9, "nothing pending")]


def test_alias_events(spark):
    _, strains, _ = gate_world(spark)
    ev = spark.createDataFrame([
        ("real", "Nick Name", "add", 1), ("a", "nick name", "add", 2), ("real", "nick-name", "remove", 3),
        ("a", "nick name", "add", 4), ("a", "E", "add", 5), ("zz", "q", "add", 6), ("a", "a", "add", 7), ("a", " ", "add", 8),
    ], "slug string, alias string, op string, seq long")
    out, bad = cu.apply_alias_events(strains, ev)
    assert {r.slug: r.aliases for r in out.collect()} == {"real": [], "a": ["nick-name"], "e": []}
    assert sorted(r.seq for r in bad.collect()) == [2, 5, 6, 8]


def test_alias_events_in_chunks(spark, monkeypatch):
    """Moves composed over tiny chunks and many partitions are those of a walk; one alias has most events."""
    monkeypatch.setattr(cu, "CHUNK_BITS", 2)
    rng = random.Random(4)
    strains = S.conform(spark.createDataFrame(
        [("a", ["hot"]), ("b", ["nick"]), ("c", []), ("d", []), ("own", [])], "slug string, aliases array<string>")
        .withColumn("name", F.col("slug")), S.STRAINS)
    events = [(rng.choice(["a", "b", "c", "d", "zz", "nick"]), "hot" if rng.random() < .6 else rng.choice(["nick", "x", "own", "", "c"]),
               rng.choice(["add", "add", "remove", "other"]), i) for i in range(400)]
    want, owner = {}, {"hot": "a", "nick": "b"}
    for slug, alias, op, seq in events:
        slug = {"nick": "b"}.get(slug, slug)
        error, now = None, owner.get(alias)
        if slug == "zz":
            error = "unknown entity"
        elif alias != slug and op == "add":
            if not alias:
                error = "alias is required"
            elif alias in ("own", "c"):
                error = "already an entity slug"
            elif now not in (None, slug):
                error = "already an alias of another entity"
            else:
                now = slug
        elif alias != slug and op == "remove" and now == slug:
            now = None
        owner[alias] = now
        want[seq] = (alias, slug, now, error)
    df = spark.createDataFrame(events, "slug string, alias string, op string, seq long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.seq: (r.alias, r.slug, r.owner, r.error) for r in cu.fold_alias_events(strains, df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want
    assert cu.fold_alias_events(strains, df.limit(0)).count() == 0


def test_reviews(spark):
    _, strains, _ = gate_world(spark)
    edges = spark.createDataFrame([("e", "p", "multi_source", 1, 2)], S.struct_of(
        "child_slug STRING, parent_slug STRING, agreement STRING, source_count BIGINT, domain_count BIGINT"))
    ev = spark.createDataFrame([("A", "verified", " ok ", 5, 1), ("e", "VERIFIED", "", 5, 2), ("e", None, "", 6, 3),
                                ("real", "CONTRADICTED", "", 5, 4), ("none", "VERIFIED", "", 5, 5)],
                               "slug string, tier string, note string, at long, seq long")
    out, bad = cu.apply_reviews(strains, edges, ev)
    got = {r.slug: (r.trust_tier, r.origin, r.curated_note, r.curated_at) for r in out.collect()}
    assert got["a"] == ("VERIFIED", "curated", "ok", 5)
    assert got["e"] == ("COMMUNITY_CONSENSUS", "researched", None, None)
    assert sorted(r.seq for r in bad.collect()) == [4, 5]
    left = cu.remaining_evidence(gate_world(spark)[0], edges, spark.createDataFrame(
        [("e", "real"), ("e", "p")], "child_slug string, parent_slug string"))
    assert {(r.parent_slug, r.remaining_observations, r.source_count) for r in left.collect()} == {("real", 1, 0), ("p", 0, 1)}


def test_captures_and_lookups(spark):
    src = S.conform(spark.createDataFrame([("u1", "t", 1), ("u2", "t", 1)], "url string, title string, fetched_at long"), S.SOURCES)
    cap = spark.createDataFrame([("u1", "w1", 3, 10), ("u1", "w2", 4, 11), (" new ", "w3", None, 12), (" ", "x", 1, 1)],
                                "url string, wayback_url string, archived_at long, at long")
    out = {r.url: (r.title, r.wayback_url, r.archived_at, r.fetched_at) for r in up.record_captures(src, cap).collect()}
    assert out == {"u1": ("t", "w2", 4, 1), "u2": ("t", None, None, 1), "new": ("", "w3", None, 12)}
    visited = spark.createDataFrame([("r", f"u{i}", i) for i in range(1, 15)], "run_id string, url string, seq long")
    avail = spark.createDataFrame([("u2", True, "w", 9), ("u3", False, None, None), ("u14", True, "w", 9)],
                                  "url string, archived boolean, wayback_url string, archived_at long")
    done = {r.url: r.wayback_url for r in up.record_lookups(visited, src, avail, 50).collect()}
    assert done["u2"] == "w" and "u14" not in done     # the eleventh and later wait


def test_captures_of_pages_that_share_a_url(spark):
    """Records told apart by a page number: each has its own lookup and its own capture."""
    src = spark.createDataFrame([(1, "u", "one", None), (2, "u", "two", "w0"), (3, "u", "three", None)],
                                "page long, url string, title string, wayback_url string")
    visited = spark.createDataFrame([("r", "u", n, n) for n in (1, 2, 3)], "run_id string, url string, page long, seq long")
    waiting = up.pending_lookups(visited, src, None, within=["page"])
    assert sorted((r.page, r.rank) for r in waiting.collect()) == [(1, 1), (3, 2)]
    avail = spark.createDataFrame([("u", 1, True, "w1", 9), ("u", 2, True, "w2", 9)],
                                  "url string, page long, archived boolean, wayback_url string, archived_at long")
    done = up.record_lookups(visited, src, avail, 50, None, within=["page"])
    assert sorted((r.page, r.title, r.wayback_url) for r in done.collect()) == [(1, "one", "w1"), (2, "two", "w0"), (3, "three", None)]
