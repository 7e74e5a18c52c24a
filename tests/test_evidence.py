"""Derivation against brute force: conflicts, components, edges, tiers."""

import itertools
import random
import re

from pyspark.sql import functions as F

from attesta import schemas as S
from attesta.functions import text as tx
from attesta.functions import urls as ur
from attesta.operators import aliases as al
from attesta.operators import evidence as ev
from attesta.operators import gate as gt
from attesta.operators import graph as gr
from attesta.operators import readers as rd
from attesta.session import spread


def observations(spark, rows):
    """rows: (child, parent, url, conf, at, role, quarantined)."""
    df = spark.createDataFrame(
        rows, "child_slug string, parent_slug string, source_url string, confidence double, "
              "observed_at long, role string, quarantined boolean")
    return S.conform(df, S.OBSERVATIONS)


def strains(spark, rows):
    """rows: (slug, aliases, curated_tier)."""
    df = spark.createDataFrame(rows, "slug string, aliases array<string>, curated_tier string")
    return S.conform(df.withColumn("name", F.initcap("slug")), S.STRAINS)


def clash(a, b):
    return not a <= b and not b <= a


def test_conflicts_and_components_match_union_find(spark):
    rng, rows, families = random.Random(11), [], {}
    for c in range(400):
        family = {}
        for u in range(rng.randint(1, 6)):
            s = frozenset(rng.sample("abcde", rng.randint(1, 4)))
            if rng.random() < .4 and family:
                s = s | rng.choice(list(family.values()))
            family[f"u{u}"] = s
            rows += [(f"c{c}", p, f"u{u}", .5, 1, None, False) for p in s]
        families[f"c{c}"] = family
    obs = observations(spark, rows)
    canon = ev.canonical_observations(obs, spark.createDataFrame([], "alias string, slug string"))
    members = ev.assertion_members(canon)
    got = {r[0] for r in ev.conflicted_children(members).collect()}
    want = {c for c, f in families.items() if any(clash(a, b) for a, b in itertools.combinations(set(f.values()), 2))}
    assert got == want and 0 < len(want) < 400

    expected = set()
    for c, f in families.items():
        sets = list(set(f.values()))
        root = list(range(len(sets)))
        for i, j in itertools.combinations(range(len(sets)), 2):
            if clash(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
        groups = {}
        for i, r in enumerate(root):
            groups.setdefault(r, set()).add("|".join(sorted(sets[i])))
        expected |= {(c, frozenset(g)) for g in groups.values() if len(g) > 1}
    rows = rd.conflicts(canon, strains(spark, [("c1", [], None)])).select(
        "child_slug", "component", F.array_join("parents", "|")).distinct().collect()
    found = {}
    for c, k, p in rows:
        found.setdefault((c, k), set()).add(p)
    assert {(c, frozenset(g)) for (c, _), g in found.items()} == expected


def test_edges_roles_ages_and_tiers(spark):
    obs = observations(spark, [
        ("kid", "ma", "https://a.com/1", .7, 50, "female", False),
        ("kid", "ma", "https://www.a.com/2", .8, 40, "parent", False),
        ("kid", "mum", "https://b.org/", .8, 60, None, False),         # mum is ma
        ("kid", "ma", "https://c.net/", .9, 5, "male", True),          # held: age counts, role not
        ("kid", "pa", "", .5, 9, None, False),                          # blank source
        ("two", "x", "https://a.com/", .5, 1, None, False),
        ("two", "y", "https://b.com/", .5, 1, None, False),
        ("syn", "x", "tavily://answer/q", .5, 1, None, False),
        ("syn", "x", "https://a.com/", .6785, 1, None, False),
        ("gone", "x", "https://a.com/", .5, 1, None, True),
        ("fixed", "x", "https://a.com/", .25, 1, None, False),
    ])
    st = strains(spark, [("kid", [], None), ("ma", ["mum"], None), ("two", [], None), ("syn", [], None),
                         ("gone", [], None), ("fixed", [], "VERIFIED"), ("idle", [], None)])
    edges, out = ev.recompute(obs, st.withColumn("trust_tier", F.coalesce("curated_tier", F.lit("COMMUNITY_CONSENSUS"))))
    e = {(r.child_slug, r.parent_slug): r for r in edges.collect()}
    ma = e["kid", "ma"]
    assert (ma.source_count, ma.domain_count, ma.avg_milli, ma.first_seen, ma.role) == (3, 2, 767, 5, "female")
    assert ma.agreement == "disagreement"        # {ma} from pages, {pa} from the blank source
    assert (e["kid", "pa"].source_count, e["kid", "pa"].domain_count) == (0, 0)
    assert e["two", "x"].agreement == "disagreement"
    assert (e["syn", "x"].source_count, e["syn", "x"].domain_count, e["syn", "x"].agreement) == (2, 1, "single_source")
    assert ("gone", "x") not in e
    t = {r.slug: (r.trust_tier, r.confidence) for r in out.collect()}
    assert t["two"][0] == "CONTRADICTED" and t["gone"] == ("ANECDOTAL", 0.5)
    assert t["fixed"] == ("VERIFIED", 0.25) and t["idle"][0] == "COMMUNITY_CONSENSUS"


def test_aliases(spark):
    st = strains(spark, [("girl-scout-cookies", ["cookies x", "gmo"], None), ("gmo", [], None), ("chemdawg", None, None)])
    seeded = al.seed_aliases(st)
    got = {r.slug: r.aliases for r in seeded.collect()}
    assert "gsc" in got["girl-scout-cookies"] and "chem-d" in got["chemdawg"]
    pairs = dict(al.alias_pairs(seeded).collect())
    assert pairs["gsc"] == "girl-scout-cookies" and "gmo" not in pairs and pairs["cookies-x"] == "girl-scout-cookies"
    named = spark.createDataFrame([(" GSC ",), ("Unknown One",), ("CHEMDAWG",)], "name string")
    ident = {r.name: (r.identity, r.known) for r in al.identify(named, seeded).collect()}
    assert ident[" GSC "] == ("girl-scout-cookies", True) and ident["Unknown One"] == ("unknown-one", False)
    found = {r.name: r.slug for r in al.find_entity(named, seeded).collect()}
    assert found["CHEMDAWG"] == "chemdawg" and found["Unknown One"] is None


def test_neighbours_count_a_loop(spark):
    edges = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a"), ("b", "a")], "child_slug string, parent_slug string")
    got = gr.neighbours(edges, spark.createDataFrame([("a",), ("c",), ("x",)], "seed string"))
    assert sorted(map(tuple, got.collect())) == [("a", "a"), ("a", "b"), ("a", "c"), ("c", "a")]


def test_entities_are_never_broadcast(spark):
    """A lookup side that looks small by its file may be long: rows exploded from one."""
    few = spark.createDataFrame([(1,)], "k long")
    long = few.select(F.explode(F.sequence(F.lit(0), F.lit(2000))).alias("k")).select(
        F.concat(F.lit("n"), "k").alias("slug"), F.concat(F.lit("N"), "k").alias("name"), F.array(F.concat(F.lit("a"), "k")).alias("aliases"))
    names = spark.createDataFrame([("N7",), ("a9",), ("x",)], "name string")
    found = al.identify(names, long)
    assert {r.name: r.identity for r in found.collect()} == {"N7": "n7", "a9": "n9", "x": "x"}
    for df in (al.alias_pairs(long), found.select("name", "display_name"), al.find_entity(names, long)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        builds = plan.count("LeftAnti, BuildRight")
        assert builds == 0 and "SortMergeJoin" in plan
    obs = spark.createDataFrame([("c", "n5"), ("c", "a6"), ("d", "q")], "child_slug string, parent_slug string")
    known = {r.parent_slug: r.parent_known for r in gt.mark_known(obs, long).collect()}
    assert known == {"n5": True, "a6": True, "q": False}


def test_url_rules(spark):
    cases = {
        "https://www.Leafly.com/x": "leafly.com", "http://ca.leafly.com:80/": "leafly.com",
        "https://a.b.co.uk/x": "b.co.uk", "https://co.uk/": "co.uk", "tavily://answer/q": None,
        "PERPLEXITY://answer/q": None, "seedfinder": "seedfinder", "": None, " ": None,
        "http://u:p@h.example.org?x": "example.org", "//cdn.site.net/a": "site.net",
        "http://localhost:3000/a": "localhost", "http://a_b.x.com": "x.com", "ftp://f.x.com.au/": "x.com.au"}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r[0]: r[1] for r in df.select("u", ur.registrable_domain("u")).collect()} == cases


def test_text_rules(spark):
    row = spark.range(1).select(
        tx.slug(F.lit("\tGirl  Scout Cookies ")).alias("slug"),
        tx.slug_title(F.lit("og-kUSH--x")).alias("title"),
        tx.canonical_display(F.lit(" Chem-Dog ")).alias("canon"),
        tx.is_junk_child(F.lit("OG Kush hybrid"), F.lit("GMO")).alias("junk"),
        tx.is_junk_child(F.lit("hybrid"), F.lit("Hybrid")).alias("own"),
        tx.is_junk_parent(F.lit("sources as Kush")).alias("jp"), tx.is_junk_parent(F.lit(" ")).alias("jb"),
        tx.mentions(F.lit("the ak47 page"), F.lit("AK-47")).alias("m"),
        tx.parse_assertion(F.lit("x = as the OG Kush genetics × Haze strain.")).alias("p"),
        tx.parse_assertion(F.lit("no equals")).alias("np"),
        tx.account_key(F.lit("C"), F.array(F.lit("B"), F.lit("A b"))).alias("k"),
        tx.is_generic_phrase(F.lit("together plants")).alias("g"),
        tx.alias_slugs_from_json(F.lit('["B c", "a", "a"]')).alias("al"),
        tx.alias_slugs_from_json(F.lit("{bad")).alias("bad"),
        tx.clean_name(F.lit("the White Widow strain")).alias("cn"),
        tx.split_names(F.lit("Haze, Skunk and Thai / X")).alias("sn"),
        tx.plausible_name(F.lit("cross of")).alias("pn"),
        ur.archive_epoch(F.lit("20200101000000")).alias("e1"), ur.archive_epoch(F.lit("2020")).alias("e2"),
        ur.archive_epoch(F.lit("x")).alias("e3"), tx.utc_date(F.lit(1577836800)).alias("d"),
    ).first()
    assert row.slug == "girl-scout-cookies" and row.title == "Og Kush X" and row.canon == "Chemdawg"
    assert row.junk and not row.own and row.jp and row.jb and row.m
    assert row.p.child == "x" and row.p.parents == ["OG Kush", "Haze"] and row.np is None
    assert row.k == "c::a-b§b" and row.g and row.al == ["a", "b-c"] and row.bad == []
    assert row.cn == "White Widow" and row.sn == ["Haze", "Skunk", "Thai", "X"] and not row.pn
    assert row.e1 == row.e2 == 1577836800 and row.e3 is None and row.d == "2020-01-01"


def test_closure_with_cycles_and_evidence_edges(spark):
    rng = random.Random(5)
    pairs = {(f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 14)}") for _ in range(22)}
    pairs = sorted(p for p in pairs if p[0] != p[1])
    edges = spark.createDataFrame(pairs, "child_slug string, parent_slug string").withColumn("agreement", F.lit("single_source"))

    def up(n):
        seen, todo = set(), [p for c, p in pairs if c == n]
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                todo += [q for c, q in pairs if c == p]
        return seen

    nodes = sorted({n for p in pairs for n in p})
    want = {(n, a) for n in nodes for a in up(n)}
    assert {tuple(r) for r in gr.ancestors(edges).collect()} == want
    seeds = spark.createDataFrame([("n1",), ("n2",)], "seed string")
    assert {tuple(r) for r in gr.ancestors(edges, seeds).collect()} == {w for w in want if w[0] in ("n1", "n2")}
    assert {(b, a) for a, b in want} == {tuple(r) for r in gr.descendants(edges).collect()}

    seed = spark.createDataFrame([(pairs[0][0],)], "seed string")
    reached = gr.reachable(edges, seed, 3)
    labelled = gr.relations(edges, reached, 3)
    out = {r.node: (r.relation, r.child_slug, r.parent_slug) for r in gr.evidence_edge(edges, labelled).collect()}
    for node, (rel, child, parent) in out.items():
        s = pairs[0][0]
        if rel == "parent":
            assert (child, parent) == (s, node)
        elif rel == "child":
            assert (child, parent) == (node, s)
        elif rel == "sibling":
            assert parent == min(p for c, p in pairs if c == s and (node, p) in pairs)
        elif rel == "ancestor":
            hops = [p for c, p in pairs if c == s and node in up(p)]
            assert parent == (min(hops) if hops else None)
        elif rel in ("subject", "related"):
            assert child is None
    assert gr.evidence_edge(edges, labelled, "as_written").count() == labelled.count()


def test_suggestions_match_difflib(spark):
    import difflib
    names = ["Blue Dream", "Blueberry", "Blue Cheese", "Green Crack", "Bleu Dram", "Haze", "Dream Queen", "B"]
    df = strains(spark, [(n, [], None) for n in names]).withColumn("name", F.col("slug"))
    for q in ("Blue Dreem", "haze", "Que", "zzz"):
        got = [r.name for r in rd.suggest_similar(df, q, 4).collect()]
        assert got == difflib.get_close_matches(q, names, n=4, cutoff=.5), q


def test_spread_keeps_filters_above(spark):
    """Rows are dealt first and worked on afterwards."""
    df = spread(spark.range(50).coalesce(1))
    worked = df.withColumn("m", F.md5(F.col("id").cast("string"))).filter(F.col("m").rlike("a"))
    plan = worked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RLIKE") < plan.index("Repartition") and df.rdd.getNumPartitions() > 1
    assert sorted(r.id for r in df.collect()) == list(range(50))


def test_many_nodes_are_joined_by_sorting(spark):
    """A node set whose files are far smaller than its rows stays out of broadcasts."""
    n = 150_000
    edges = spark.range(n).select(F.concat(F.lit("c"), "id").alias("child_slug"), F.lit("hub").alias("parent_slug"))
    reached = gr.reachable(edges, spark.createDataFrame([("hub",)], "seed string"), 2)
    plan = reached._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 2 and all("SortMergeJoin" in line for line in joins), joins
    assert [tuple(r) for r in reached.groupBy("hop").count().orderBy("hop").collect()] == [(0, 1), (1, n)]


def test_deep_pages_sort_few_rows(spark):
    """However large the range a page lies in, few rows are sorted to skip to it."""
    order = [("half", True), ("id", False)]
    df = spark.range(100_000).select("id", F.expr("id div 50000").alias("half"))
    indexed = rd.index_pages(df, order, 2)
    for offset in (0, 48_990, 49_997, 90_000, 99_998, 100_000):
        page = rd.page_at(indexed, order, 5, offset)
        skipped = re.findall(r"Offset (\d+)", page._jdf.queryExecution().optimizedPlan().toString())
        assert all(int(n) <= 20_000 for n in skipped), skipped
        places = range(offset, min(offset + 5, 100_000))
        assert [tuple(r) for r in page.collect()] == [((p + 50_000) % 100_000, p < 50_000, 100_000) for p in places]
