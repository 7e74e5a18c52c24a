"""Payload flattening, ledger, extraction, run derivations, cache, dossier and streams."""

import json
import random

from pyspark.sql import functions as F

from attesta import schemas as S
from attesta.functions import language as lang
from attesta.operators import cache as ca
from attesta.operators import claims as cl
from attesta.operators import dossier as do
from attesta.operators import extract as ex
from attesta.operators import graph as gr
from attesta.operators import readers as rd
from attesta.sources import ledger as lg
from attesta.sources import payloads as pl
from attesta.sources import runs as rn
from attesta.sources import tables as tb
from attesta.streaming import ingest as ig


def payload(spark, doc, **cols):
    text = doc if isinstance(doc, str) else json.dumps(doc)
    row = {"run_id": "r", "query": "blue dream", "provider": "web", "payload": text, **cols}
    return spark.createDataFrame([row])


def test_payloads(spark):
    web = pl.web_search(payload(spark, {"answer": "A", "results": [{"title": "T", "url": "u", "content": "C", "score": .5}]}))
    assert [(r.rank, r.url, r.snippet, r.source) for r in web.orderBy("rank").collect()] == [
        (0, "tavily://answer/blue_dream", "A", "tavily-answer"), (1, "u", "C", "tavily")]
    chat = pl.chat_answer(payload(spark, {"choices": [{"message": {"content": "X"}}], "citations": ["a", "b", "c"]}), 2)
    assert [(r.url, r.title) for r in chat.orderBy("rank").collect()] == [
        ("perplexity://answer/blue_dream", "Perplexity answer: blue dream"),
        ("a", "Perplexity citation 1"), ("b", "Perplexity citation 2")]
    page = ('head<div class="x results_links y"><a class="result__a" href="//r?uddg=https%3A%2F%2Fx.com%2Fa+b&z=1">'
            '<b>Ti</b>&amp;tle</a><a class="result__snippet" href="q">Sni <i>p</i></a></div>'
            '<div class="results_links"><p>no link</p></div>'
            '<div class="results_links"><a class="result__a" href="https://y.com">Y</a></div>')
    html = pl.html_results(payload(spark, page)).orderBy("rank").collect()
    assert [(r.url, r.title, r.snippet) for r in html] == [("https://x.com/a+b", "Ti&tle", "Sni p"), ("https://y.com", "Y", "")]
    wiki = pl.article_summaries(payload(spark, {"extract": " text "}, title="White Widow", pos=3).unionByName(
        payload(spark, {"extract": ""}, title="B", pos=1)))
    assert [(r.url, r.snippet) for r in wiki.collect()] == [("https://en.wikipedia.org/wiki/White_Widow", "text")]
    norm = pl.normalize_results(payload(spark, [{"title": None, "url": "u"}, 5, {"title": "t", "source": "s"}])).orderBy("rank").collect()
    assert [(r.title, r.url, r.source) for r in norm] == [("", "u", "web"), ("t", "", "s")]
    df = spark.createDataFrame([("u", json.dumps({"archived_snapshots": {"closest": {"url": "w", "timestamp": "20200101", "status": "200"}}})),
                                ("v", "nonsense"), ("w", "{}")], "url string, payload string")
    got = {r.url: (r.archived, r.wayback_url, r.archived_at) for r in pl.availability(df).collect()}
    assert got == {"u": (True, "w", 1577836800), "v": (False, None, None), "w": (False, None, None)}


def claim_rows(spark, rows):
    """rows: (run, seq, child, a, b, extras, url, conf)."""
    df = spark.createDataFrame(rows, "run_id string, seq long, child string, parent_a string, parent_b string, "
                                     "extra_parents array<string>, source_url string, confidence double")
    return df.withColumns({"source_title": F.lit("t"), "source_engine": F.lit("e"), "query": F.lit("Q"),
                           "snippet_excerpt": F.lit(""), "parent_roles": F.lit(None).cast("map<string,string>")})


CLAIMS = [
    ("r", 1, "Kid", "A", "B", [], "https://x.com/1", .5), ("r", 2, "kid", "A", "B", [], "https://y.com/1", .6),
    ("r", 3, "Other", "A", "B", [], "https://x.com/2", .7), ("r", 4, "Odd", "A", "B", [], "https://x.com/3", .5),
    ("r", 5, "Odd", "C", "", ["D"], "", .5), ("r", 6, "Sub", "A", "B", [], "u", .5), ("r", 7, "Sub", "A", "", [], "v", .5),
]


def test_run_derivations(spark):
    claims = claim_rows(spark, CLAIMS)
    con = {(r.parent_a, r.parent_b): (r.sources, r.domains, r.avg_confidence) for r in cl.run_consensus(claims).collect()}
    assert con["A", "B"] == (5, 3, .56) and con["C", ""] == (1, 0, .5)
    tiers = {r.seq: r.tier for r in cl.stamp_tiers(claims).collect()}
    assert tiers == {1: "COMMUNITY_CONSENSUS", 2: "COMMUNITY_CONSENSUS", 3: "ANECDOTAL", 4: "CONTRADICTED",
                     5: "CONTRADICTED", 6: "ANECDOTAL", 7: "ANECDOTAL"}
    dis = {(r.child, tuple(r.parents), r.sources, r.summary) for r in cl.run_disagreements(claims).collect()}
    note = "odd has 2 conflicting parent-strain assertions"
    assert dis == {("odd", ("A", "B"), 1, note), ("odd", ("C", "D"), 0, note)}
    subjects = spark.createDataFrame([("r", "Kid")], "run_id string, query string")
    nodes, edges = cl.run_graph(claims, subjects)
    assert {(r.slug, r.is_root) for r in nodes.collect()} == {("kid", True), ("a", False), ("b", False), ("other", False),
                                                             ("odd", False), ("c", False), ("d", False), ("sub", False)}
    e = {r.id: (r.agreement, r.source_count, r.label, r.other_parents) for r in edges.collect()}
    assert e["e::kid::a"] == ("multi_source", 2, "A × B", ["B"]) and e["e::odd::d"][0] == "disagreement"
    assert e["e::sub::a"] == ("single_source", 1, "A", [])      # the later group decides
    spend = cl.llm_spend(spark.createDataFrame(
        [("r", 1, "m1", 5, 5, 10), ("r", 2, "", 1, None, None), ("r", 3, "m3", None, None, None)],
        "run_id string, seq long, model string, prompt_tokens long, completion_tokens long, total_tokens long")).first()
    assert (spend.calls, spend.model, spend.prompt_tokens, spend.total_tokens) == (2, "m1", 6, 10)


def test_ledger_round_trip(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert lg.read_ledger(spark, path).count() == 0
    claims = cl.stamp_tiers(claim_rows(spark, CLAIMS[:3]))
    runs = spark.createDataFrame([("r", "Kid", 1, 9, ["w"], None), ("bad", "X", 1, 8, ["w"], "boom")],
                                 "run_id string, query string, started_at long, completed_at long, providers_used array<string>, error string") \
        .withColumns({"llm_usage": F.lit(None).cast(f"struct<{S.USAGE}>"), "cache_usage": F.lit(None).cast(f"struct<{S.CACHE_USAGE}>")})
    visited = spark.createDataFrame([("r", "u", "e")], "run_id string, url string, engine string")
    lg.append(spark, path, runs, visited, claims)
    lg.append(spark, path, runs, visited, claims)                       # replay
    spark.createDataFrame([("{broken",), ("",), ('{"no": 1}',)], "value string").write.mode("append").text(path)
    rows = lg.read_ledger(spark, path)
    heads = {r.run_id: (r.lineage_claims_count, r.error) for r in rows.filter("kind = 'research_run'").collect()}
    assert heads == {"r": (3, None), "bad": (0, "boom")}
    assert lg.read_claims(spark, path).count() == 3
    assert {r.claim.child for r in lg.claims_of_entity(rows, "kid").collect()} == {"Kid", "kid", "Other"}  # query matches too
    assert lg.claims_of_entity(rows, "b", 2).count() == 2 and lg.claims_of_entity(rows, " ").count() == 0


def test_append_works_out_claims_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def told(child):
        seen.add(1)
        return child

    claims = cl.stamp_tiers(claim_rows(spark, CLAIMS[:3])).withColumn("child", F.udf(told)("child"))
    runs = spark.createDataFrame([("r", "Kid", 1, 9, ["w"], None)],
                                 "run_id string, query string, started_at long, completed_at long, providers_used array<string>, error string") \
        .withColumns({"llm_usage": F.lit(None).cast(f"struct<{S.USAGE}>"), "cache_usage": F.lit(None).cast(f"struct<{S.CACHE_USAGE}>")})
    visited = spark.createDataFrame([("r", "u", "e")], "run_id string, url string, engine string")
    lg.append(spark, str(tmp_path / "ledger"), runs, visited, claims)
    assert seen.value == lg.read_claims(spark, str(tmp_path / "ledger")).count() == 3


def test_raw_files_and_tables(spark, tmp_path):
    res = spark.createDataFrame([("r1", "T", "u", "s", "w")], "run_id string, title string, url string, snippet string, source string")
    rn.write_raw(res, str(tmp_path / "raw"))
    next((tmp_path / "raw").glob("bucket=*")).joinpath("x.json").write_text("[1, 2]\nnot json\n")
    assert [(r.run_id, r.title) for r in rn.read_raw(spark, str(tmp_path / "raw")).collect()] == [("r1", "T")]
    old = spark.createDataFrame([("a", "b", "u")], "child_slug string, parent_slug string, source_url string")
    old.write.parquet(str(tmp_path / "kb" / "lineage_sources"))
    row = tb.read_table(spark, str(tmp_path / "kb"), "lineage_sources").first()
    assert row.quarantined is False and row.confidence == .5 and row.role is None
    assert tb.read_table(spark, str(tmp_path / "kb"), "claims").count() == 0


def test_extraction_and_ingestion(spark):
    res = spark.createDataFrame([
        ("r", "Kid", 0, "Kid", "https://x.com", "Kid is Chem-Dog (male) × Haze (female). Also crossing Kid with Haze.", "web"),
        ("r", "Kid", 1, "Kid", "https://y.com", "Kid is Chem-Dog × Haze.", "web"),
        ("r", "Kid", 2, "None", "https://z.com", "Nothing here.", "web"),
    ], "run_id string, query string, rank int, title string, url string, snippet string, source string")
    found = ex.extract_claims(res).orderBy("rank", "pos").collect()
    assert [(r.parent_a, r.parent_b, r.source_url) for r in found] == [("Chem-Dog", "Haze", "https://y.com")]
    assert found[0].confidence == .5 and found[0].raw_text == "Kid is Chem-Dog × Haze"[7:]
    claims = claim_rows(spark, [
        ("r", 1, "Kid", "Chem Dog", "Haze", [], "u1", .5), ("r", 2, "Kid", "chemdawg", "HAZE", [], "u2", .5),
        ("r", 3, "Kid", "Haze", "Chemdawg", [], "u3", .5), ("r", 4, "Some hybrid", "A", "B", [], "u", .5),
        ("r", 5, "Kid", "A", "", [], "u", .5), ("r", 6, "Kid", "A", "B", ["also X"], "u", .5), ("r", 7, "Kid", "P", "Q", [], "u", .5)])
    kept = {r.seq: r.parent_a for r in ex.ingest_claims(claims).collect()}
    assert kept == {1: "Chemdawg", 3: "Haze", 7: "P"}
    prior = claim_rows(spark, [("r", 0, "Kid", "p", "q", ["Z"], "u", .5)])
    assert {r.seq for r in ex.ingest_claims(claims, prior).collect()} == {1, 3}
    assert {r.seq for r in ex.ingest_claims(claims, scope="pair+url").collect()} == {1, 2, 3, 7}
    both = ex.complement(claims.filter("seq = 1"), claims.filter("seq in (1, 3)"))
    assert sorted(r.seq for r in both.collect()) == [1, 3]


def test_second_passes(spark):
    res = spark.createDataFrame([
        ("r", "White Widow", 0, "White Widow (film)", "https://en.wikipedia.org/wiki/White_Widow_(film)", "a film", "wikipedia"),
        ("r", "White Widow", 1, "White Widow (cannabis)", "https://en.wikipedia.org/wiki/White_Widow", "a strain", "wikipedia"),
    ], "run_id string, query string, rank int, title string, url string, snippet string, source string")
    wiki = "{{Infobox cultivar\n| hybrid = Brazilian Sativa × \n\nSouth Indian Indica\n}} body"
    articles = spark.createDataFrame([("White Widow", wiki), ("White Widow (film)", "")], "title string, wikitext string") \
        .select("title", lang.wikitext_to_text("wikitext").alias("text"))
    dive = ex.deep_dive(res, articles)
    row = ex.extract_claims(dive).first()
    assert (row.parent_a, row.parent_b, row.source_engine) == ("Brazilian Sativa", "South Indian Indica", "wikipedia-full")
    assert articles.count() == 2
    subjects = spark.createDataFrame([("r", "Kid"), ("q", "Ma")], "run_id string, query string")
    corpus = spark.createDataFrame([("Kid parents lineage genetics cross", 0, "a strain", "u1", "x", "w"),
                                    ("Kid parents lineage genetics cross", 1, "a plum", "u2", "x", "w")],
                                   "query string, rank int, title string, url string, snippet string, source string").withColumn("run_id", F.lit(""))
    seen = spark.createDataFrame([("r", "u9")], "run_id string, url string")
    got = ex.follow_up(subjects, spark.createDataFrame([("q",)], "run_id string"), corpus, seen)
    assert [(r.run_id, r.query, r.url) for r in got.collect()] == [("r", "Kid", "u1")]
    cleared = ex.drop_off_subject_summaries(S.conform(spark.createDataFrame(
        [("a", "Blue Dream", "Blue Dream is a song.", "u"), ("b", "Blue Dream", "Blue Dream is a strain.", "u"), ("c", "X", "free text", None)],
        "slug string, name string, summary string, summary_source_url string"), S.STRAINS))
    assert {r.slug: r.summary for r in cleared.collect()} == {"a": None, "b": "Blue Dream is a strain.", "c": "free text"}


def test_packing_matches_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(f"r{g}", "q", i, "t" * rng.randint(0, 40), f"u{i}", "s" * rng.randint(0, 90)) for g in range(6) for i in range(30)]
    df = spark.createDataFrame(rows, "run_id string, query string, rank int, title string, url string, snippet string")
    got = {(r.run_id, r.rank) for r in ex.pack_evidence(df, 60, 700).collect()}
    want = set()
    for g in range(6):
        total = 0
        for r in (r for r in rows if r[0] == f"r{g}"):
            n = len(f"{r[3]}\n{r[5]}"[:60])
            if total + n > 700:
                break
            total += n
            want.add((r[0], r[2]))
    assert got == want
    one = ex.prompt_text(ex.pack_evidence(df.filter("run_id = 'r0' and rank < 2"))).first().evidence
    assert one.startswith("--- result[0] url=u0 ---\n") and "\n\n--- result[1] url=u1 ---" in one


def test_cache(spark):
    blobs = spark.createDataFrame([], "cache_key string, provider string, kind string, identity string, payload string, "
                                      "content_hash string, fetched_at long, expires_at long, hits long")
    put = spark.createDataFrame([("k", "p", "s", "i", "[1]", 10), ("k", "p", "s", "i", "[2]", 20), ("e", "p", "s", "i", "[]", 10)],
                                "cache_key string, provider string, kind string, identity string, payload string, fetched_at long")
    stored = ca.store_payloads(blobs, put, 100)
    row = stored.first()
    assert stored.count() == 1 and (row.payload, row.expires_at, row.hits) == ("[2]", 120, 0)
    bumped = stored.withColumn("hits", F.lit(5).cast("long"))
    assert ca.store_payloads(bumped, put.withColumn("fetched_at", F.lit(30).cast("long")), 100).first().hits == 5
    req = spark.createDataFrame([("k", 50, "r"), ("k", 120, "r"), ("z", 50, "r")], "cache_key string, at long, run_id string")
    got = {(r.cache_key, r.at): r.outcome for r in ca.classify_requests(req, stored, 100).collect()}
    assert got == {("k", 50): "hit", ("k", 120): "expired", ("z", 50): "miss"}
    bad = stored.withColumn("content_hash", F.lit("x"))
    assert ca.classify_requests(req, bad, 100).filter("outcome = 'corrupt'").count() == 1
    assert ca.classify_requests(req, stored, 0).filter("outcome = 'miss'").count() == 3
    s = ca.cache_stats(ca.classify_requests(req, stored, 100), stored).first()
    assert (s.hits, s.misses, s.hit_rate, s.entries) == (1, 2, .3333, 1)


def test_dossier(spark):
    claims = spark.createDataFrame([
        (1, "k", "LINEAGE", "Kid = OG Kush × Haze", "u1", "short", .5, "ANECDOTAL"),
        (2, "k", "LINEAGE", "kid = haze strain × as OG Kush", "u2", "a longer excerpt", .4, "ANECDOTAL"),
        (3, "k", "LINEAGE", "broken", "u3", "", .4, "ANECDOTAL"), (4, "k", "LINEAGE", "Kid = together plants × Haze", "u4", "", .4, "ANECDOTAL"),
        (5, "k", "NOTE", "x", "u5", "", .4, "ANECDOTAL"), (6, "k", "LINEAGE", "Ma = Haze × Thai", "", "", .4, "ANECDOTAL"),
    ], "id long, child_slug string, type string, value string, source_url string, excerpt string, confidence double, trust_tier string")
    parsed = do.parsed_claims(claims)
    groups = do.account_groups(parsed)
    g = {r.account: r for r in groups.collect()}
    kid = g["kid::haze§og-kush"]
    assert (kid.claims, kid.sources, kid.best.claim_id, kid.assertion) == (2, 2, "2", "Kid = OG Kush × Haze")
    assert {r.claim_id for r in do.malformed_claims(parsed, groups).collect()} == {"3", "4"}
    assert [r.account for r in do.ordered_accounts(groups, ["kid"]).collect()] == ["kid::haze§og-kush", "ma::haze§thai"]
    src = spark.createDataFrame([("u2", "Two", "w2"), ("u1", "One", None)], "url string, title string, wayback_url string")
    card = {r.account: r for r in do.provenance_cards(parsed, groups, src).collect()}["kid::haze§og-kush"]
    assert (card.source_count, card.excerpt, card.wayback_url) == (2, "a longer excerpt", "w2")
    assert ("u1", "One") in {(r.source_url, r.title) for r in do.account_sources(parsed, src).collect()}
    top = do.top_claims(claims, ["child_slug"], top=2).collect()
    assert {r.id for r in top} == {1, 2} and top[0].hidden == 4


def test_frontier(spark):
    links = spark.createDataFrame([("s", "a"), ("s", "b"), ("a", "c"), ("b", "s"), ("b", "d"), ("c", "e")], "child string, parent string")
    subj = spark.createDataFrame([("r", "s")], "run_id string, name string")
    got = {(r.name, r.depth) for r in gr.expand_frontier(links, subj, 2, 30).collect()}
    assert got == {("s", 0), ("a", 1), ("b", 1), ("c", 2), ("d", 2)}
    assert {r.name for r in gr.expand_frontier(links, subj, 2, 3).collect()} == {"s", "a", "b", "c"}


def test_pages_and_stats(spark):
    st = S.conform(spark.createDataFrame([(f"s{i}", f"S{i}", .1 * (i % 3), "b" if i == 1 else "") for i in range(6)],
                                         "slug string, name string, confidence double, breeder string"), S.STRAINS)
    page = rd.catalog_page(st, 2, 1).collect()
    assert [r.slug for r in page] == ["s5", "s1"] and page[1].props == {"breeder": "b"}
    assert [r.score for r in rd.search_strains(st, "S1").collect()] == [3]
    assert rd.search_strains(st, " ").count() == 0


def test_one_odd_row_changes_nothing_else(spark):
    roles = spark.createDataFrame(
        [("r", "q", 1, "Kid", "GSC", "Haze", [], "u", {"GSC": "female", "Girl Scout Cookies": "male"})],
        "run_id string, query string, seq int, child string, parent_a string, parent_b string, extra_parents array<string>,"
        " source_url string, parent_roles map<string,string>")
    assert ex.ingest_claims(roles).first().parent_roles == {"Girl Scout Cookies": "male"}

    def line(**kw):
        import json
        return json.dumps({"lineage": [{"child": "Kid", "parents": ["A", "B", "C", "D", "E"], **kw}]})

    answers = [line(source_index=0, parent_roles={"b": "male", "B": "female"}), line(source_index="NaN"),
               line(source_index=1e300), line(source_index="1.7"), line(source_index=" 0 ")]
    responses = spark.createDataFrame([(f"r{i}", "q", a) for i, a in enumerate(answers)], "run_id string, query string, response string")
    results = spark.createDataFrame([(f"r{i}", "q", 0, "u", "t", "s") for i in range(5)],
                                    "run_id string, query string, rank int, url string, title string, source string")
    claims = {r.run_id: r for r in ex.parse_responses(responses, results)[0].collect()}
    assert set(claims) == {"r0", "r4"} and claims["r0"].parent_roles == {"B": "female"}
    assert claims["r0"].extra_parents == ["C", "D", "E"]

    texts = spark.createDataFrame([("r", None, 1, "a"), ("r", None, None, "b"), ("r", "q", 10 ** 15, "c"), (None, "q", 3, "d")],
                                  "run_id string, query string, rank long, snippet string") \
        .withColumns({"title": F.lit("t"), "url": F.lit("u")})
    assert {r.block for r in ex.pack_evidence(texts).collect()} == {"t\na", "t\nb", "t\nc", "t\nd"}
    assert {r.block for r in ex.pack_evidence(texts, total=3).collect()} == {"t\na", "t\nc", "t\nd"}
