"""Quality rules, near duplicates, exact and line dedup, secrets, against brute force."""

import hashlib
import pathlib
import re
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).parent))

import llm_cases as cases  # noqa: E402
from attesta.llm import chunk_dedup, host_quality, line_dedup, minhash_forest, secret_scan  # noqa: E402
from attesta.llm.components import components  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark, cases.edge_texts()).cache()


def test_quality_metrics_and_verdicts(spark):
    bad = [(100 + i, "short text", "junk") for i in range(60)] + [(190, cases.prose(5, 80), "junk")]
    symbols = [(300 + i, " ".join(f"{w}%%%" for w in cases.prose(i, 60).split()), "noisy") for i in range(60)]
    rows = cases.edge_texts() + bad + symbols + [(400, "a b c d a b c x\na b c\na b c", "s9")]
    docs = cases.frame(spark, rows)
    measured = host_quality.measure(docs).cache()
    got = host_quality.judge(measured, host_quality.host_verdicts(measured)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = cases.metrics(r.text)
        assert {k: r[k] for k in want} == want
        base = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r.base_failed == base
        assert r.kept == (not base and r.source not in ("junk", "noisy"))
        assert r.host_fails == {"junk": "short", "noisy": "symbols"}.get(r.source, "")


def test_quality_prior_moments():
    assert host_quality.prior(0, 0, 0.0) == (0.0, 1.0)
    assert host_quality.prior(100, 0, 0.0)[1] == 10_000.0
    mean, weight = host_quality.prior(200, 100, 100 * 0.9 ** 2 + 100 * 0.1 ** 2)
    assert mean == 0.5 and weight == 1.0


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates(spark, docs, block, monkeypatch):
    monkeypatch.setattr(minhash_forest, "GROUP_BLOCK", block)
    monkeypatch.setattr(minhash_forest, "NODE_BLOCK", 3 if block == 2 else 8192)
    rows = cases.edge_texts()
    base = cases.prose(70, 150).split()
    for i in range(9):
        rows.append((200 + i, " ".join(base[:10 * i] + ["new"] + base[10 * i:]), "s0"))
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    got = minhash_forest.join(cases.frame(spark, rows)).collect()
    classes, links = cases.near_links([t for _, t, _ in rows])
    want = {}
    for (d, t, _), c, n in zip(rows, classes, links):
        want.setdefault((d, rows[c][0], n, classes.count(c)), 0)
        want[(d, rows[c][0], n, classes.count(c))] += 1
    have = {}
    for r in got:
        key = (r.doc_id, r.class_id, r.n_links, r.class_size)
        have[key] = have.get(key, 0) + 1
    assert have == want
    assert sum(r.kept for r in got) == len(set(classes))


def test_near_duplicates_keep_one(spark, docs):
    rows = minhash_forest.keep_one(docs).collect()
    classes, _ = cases.near_links([t for _, t, _ in cases.edge_texts()])
    assert len(rows) == len(set(classes)) and rows[0].asDict().keys() == set(docs.columns)


def test_forest_depth_and_sketches():
    depth = minhash_forest.depth_for(0.99999)
    assert 1 - (1 - 0.8 ** depth) ** minhash_forest.TREES >= 0.99999
    assert 1 - (1 - 0.8 ** (depth + 1)) ** minhash_forest.TREES < 0.99999
    a, b = minhash_forest.shingles(cases.prose(1, 80)), minhash_forest.shingles(cases.prose(1, 90))
    assert len(a) == 76 and len(b) == 86
    sets = [cases.shingles(cases.prose(1, n)) for n in (80, 90, 40)]
    hashed = [minhash_forest.shingles(cases.prose(1, n)) for n in (80, 90, 40)]
    assert minhash_forest.pair_counts(hashed, columns=16).tolist() == [[len(x & y) for y in sets] for x in sets]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)] + [(200, 200 + i) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in (100, 101, 102)}, **{200 + i: 200 for i in range(30)}}


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_dedup(spark, docs, bits):
    got = chunk_dedup.dedup(docs, bits=bits).collect()
    groups = {}
    for d, t, _ in cases.edge_texts():
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(norm, []).append((-len(t or ""), d is None, d or 0, d))
    want = sorted(str((d, min(g)[3], len(g), hashlib.sha256(n.encode()).hexdigest()))
                  for n, g in groups.items() for _, _, _, d in g)
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_chunks_follow_content():
    data = cases.prose(3, 20_000).encode()
    chunks = chunk_dedup.chunks_of(data)
    assert b"".join(chunks) == data and max(map(len, chunks)) <= chunk_dedup.MOST
    moved = chunk_dedup.chunks_of(b"some bytes before " + data)
    assert len(set(chunks) & set(moved)) > 0.9 * len(chunks)


def test_line_dedup(spark):
    shared = [cases.prose(800 + i, n) for i, n in enumerate((20, 15, 20, 60, 5, 45))]
    rows = cases.edge_texts() + [
        (50, "\n".join([cases.prose(1000, 30), *shared[:3], cases.prose(1001, 12)]), "s0"),
        (51, "\n".join([cases.prose(1002, 30), shared[0] + "  ", "", *shared[1:4]]), "s1"),
        (52, "\n".join([shared[3], shared[4], cases.prose(1003, 8)]), "s1"),
        (53, "\n".join([cases.prose(1004, 8), shared[3], shared[4], "\t", shared[5]]), "s1"),
        (54, "\n".join([shared[0], shared[1]]), "s2"), (55, "\n".join([cases.prose(1005, 30)] * 9), "s2"),
        (56, "\n".join([shared[4], shared[5], shared[3]]), "s2")]
    want = cases.line_runs([(d, t) for d, t, _ in rows])
    got = line_dedup.dedup_lines(cases.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    origin = {}
    for d, t, _ in rows:
        origin.setdefault(d, t)
    for r in got:
        t = origin[r.doc_id]
        gone = want[(r.doc_id, t)]
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        assert (r.text, r.n_deleted) == (kept, len(gone)), r.doc_id
        assert r.size == "x"
    assert want[(51, origin[51])] and want[(53, origin[53])] and want[(55, origin[55])]


def test_secret_scan(spark):
    key, token = "AKIA" + "Q7XW2ZPL9M4T6R8V", "ghx0A1b2C3d4E5f6G7h8J9k0"
    texts = [None, "", 'é password="hunter22" and token=token: abcdef', f"x {key} y {key[:15]} z", f"api_KEY : {key}",
             "SECRET = 'ab' secret='abcdefg'", "deadbeef" * 3 + " deadbeef", f"see {token} here", "token=" + token.upper(),
             "passwd:=abcdef password::abcdef Token =\"x\" API-KEY=aaaaaaa", f"{token}", f"{token}{token}"]
    rows = [(i, t, f"s{i % 5}") for i, t in enumerate(texts)] + [(90 + i, f"copied {key.lower()}K1 {token[::-1]}", f"o{i}") for i in range(4)]
    rows.append(rows[3])
    patterns = {
        "assign": re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    least = {"assign": 6, "access": 20, "hex": 24}
    got = secret_scan.scan(cases.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for d, t, _ in rows:
        spans = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(patterns.items())
                 for m in p.finditer(t or "") if len(m.group(2 if k == "assign" else 0)) >= least[k]]
        text = ",".join(s for _, _, s in sorted(spans))
        r = by_id[d]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), (d, t, r.spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s.startswith(k) for _, _, s in spans) for k in patterns]
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
    assert by_id[10].spans == "token:0:24" and by_id[90].spans == "", "owner-specific tokens are added, copied ones are not"
    assert by_id[8].spans == "assign:0:30", "a base span covers its token"


def test_secrets_copied_over_one_owner(spark):
    wide, narrow, copied = "wQ1e2R3t4Y5u6I7o8P9a0S1d", "nZ9x8C7v6B5n4M3q2W1e0R9t", "cL1k2J3h4G5f6D7s8A9p0O1i"
    rows = [(i, f"part {i} shows {wide}", "hot") for i in range(300)]
    rows += [(400 + i, f"part {i} holds {narrow}", "hot") for i in range(secret_scan.MAX_REPOS)]
    rows += [(600 + i, f"one page with {copied}", None) for i in range(300)]
    got = {r.doc_id: r for r in secret_scan.scan(cases.frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].spans == "" and got[i].n_live == 0 for i in range(300)), "many repositories of one owner: an example"
    assert all(got[i].n_live == 1 and got[i].spans.startswith("token:") for i in range(400, 400 + secret_scan.MAX_REPOS))
    assert all(got[i].n_live == 1 for i in range(600, 900)), "exact copies are one repository"


@pytest.mark.parametrize("run", [
    lambda d: host_quality.judge(host_quality.measure(d), host_quality.host_verdicts(host_quality.measure(d))),
    minhash_forest.join, chunk_dedup.dedup, line_dedup.dedup_lines, secret_scan.scan], ids=["1", "2", "6", "8", "5"])
def test_empty_table(spark, run):
    assert run(cases.empty(spark)).count() == 0
