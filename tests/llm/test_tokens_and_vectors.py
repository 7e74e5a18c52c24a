"""Token counts, token alignment and whitening against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer

from attesta.llm import token_alignment, token_counts, whitening
from attesta.llm.common import read

from llm_cases import SCHEMA, edge_texts, empty, frame, prose

BIG = 2 ** 53 + 1


def odd_texts() -> list[str | None]:
    """Long runs of one class, special tokens on and around window ends, every kind of blank."""
    rng = random.Random(5)
    parts = ["a" * 700, " " * 650, "1" * 90, "'re", "'ll", "don't we'll", "<|endoftext|>", "<|endo", "ftext|>", "\n\n  x",
             "日本語のテキスト", "😀👩‍👩‍👧", "  z", "\t\x00\x1c ", "é" * 40, "!!!???", "word words", "▁", "x  y   z "]
    mixed = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(n)) for n in (3, 40, 120)]
    around = ["q" * (256 + k) + "<|endoftext|>" + " tail of words" * 30 for k in range(-14, 3)]
    return [None, "", " ", "<|endoftext|>", "a" * 5000, " " * 3000, "ab '" * 900, *mixed, *around, prose(3, 400), prose(3, 400)]


def rows_of(spark, texts):
    ids = [None, BIG, BIG + 2, *range(len(texts))]
    return frame(spark, [(d, t, "s0") for d, t in zip(ids, texts)])


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_counts.default_model())


def test_windows_give_the_tokenizers_counts(spark, tokenizer):
    texts = odd_texts() + [t for _, t, _ in edge_texts()]
    docs = rows_of(spark, texts)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()),
                    len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    for chunk, overlap in ((256, 64), (32_768, 1024)):
        got = token_counts.count_tokens(docs, chunk=chunk, overlap=overlap, limit=100, keep=("doc_id", "_tag", "n_tokens"))
        rows = got.collect()
        assert got.columns == ["doc_id", "_tag", "n_bytes", "n_tokens", "over_limit"]
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 100) and r["_tag"] == "u" for r in rows)


def test_seams_fail_only_inside_long_runs(spark):
    """An overlap that one run covers has no common boundary; a wider one has."""
    texts = spark.createDataFrame([(1, 1, "b" * 100 + " " + "a" * 900 + " end" * 99), (2, 2, "one two " * 200)],
                                  "_k1 long, _k2 long, _text string")
    first = {r["_k1"]: r["failed"] for r in token_counts._round(texts, token_counts.default_model(), 256, 64).collect()}
    assert first == {1: True, 2: False}
    model = token_counts.default_model()
    k = token_counts.kit(model)
    got = {r["_k1"]: r["n_tokens"] for r in token_counts.count_long(texts, model, 256, 64).collect()}
    assert got == {r["_k1"]: token_counts.count(r["_text"], k) for r in texts.collect()}


def test_windows_cover_a_text():
    for length in (0, 1, 64, 65, 256, 320, 321, 5000):
        spans = token_counts.windows(length, 256, 64)
        assert spans[0][0] == 0 and spans[-1][1] == length
        assert all(b[0] == a[0] + 256 and a[1] == b[0] + 64 < b[1] for a, b in zip(spans, spans[1:]))


def test_overlap_has_to_exceed_the_margin(spark):
    with pytest.raises(ValueError):
        token_counts.count_tokens(empty(spark), chunk=64, overlap=10)
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_token_counts_of_the_table(spark, tokenizer):
    docs = read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    want = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, chunk=2048, overlap=128).collect()}
    assert got == want


def aligned_by_hand(texts: list[str | None]) -> list[tuple]:
    """Whole texts, ends looked up one by one, all pairs of tokens with one end linked."""
    model_a, model_b = token_alignment.default_models()
    import sentencepiece

    a_side = Tokenizer.from_file(model_a)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=model_b)
    both = token_alignment.pair_of(model_a, model_b)
    per_text, count = [], Counter()
    for t in texts:
        a = a_side.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = b_side.encode(t) if t else []
        want = (" " + (t or "")).encode()
        if not t or b"".join(both.bytes_a[i] for i in a) != want or b"".join(both.bytes_b[i] for i in b) != want:
            per_text.append(([], [], "", []))
            continue
        ends_a = np.cumsum([len(both.bytes_a[i]) for i in a]).tolist()
        ends_b = np.cumsum([len(both.bytes_b[i]) for i in b]).tolist()
        groups, links, low = [], [], 0
        for end in [e for e in ends_a if e in ends_b]:
            own_a = [str(i) for i, e in zip(a, ends_a) if low < e <= end]
            own_b = [str(i) for i, e in zip(b, ends_b) if low < e <= end]
            groups.append(",".join(own_a) + "|" + ",".join(own_b))
            links.append((a[ends_a.index(end)], b[ends_b.index(end)]))
            low = end
        count.update(links)
        per_text.append((a, b, ";".join(groups), links))
    best = defaultdict(int)
    for (_, b_id), n in count.items():
        best[b_id] = max(best[b_id], n)
    return [(len(a), len(b), said.count("|") if said else 0, len(links), sum(count[x] == best[x[1]] for x in links),
             sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if said else "")
            for a, b, said, links in per_text]


@pytest.mark.parametrize("broadcast_pairs", [token_alignment.BROADCAST_PAIRS, 0])
def test_alignment_is_that_of_whole_texts(spark, broadcast_pairs):
    texts = [t for t in odd_texts() if not t or "|" not in t] + ["a | b", "say <s> or <0x0A>"] + [t for _, t, _ in edge_texts()]
    docs = rows_of(spark, texts)
    got = token_alignment.align(docs, keep=("doc_id", "_tag", "n_a"), broadcast_pairs=broadcast_pairs)
    assert got.columns == ["doc_id", "_tag", *token_alignment.RESULT]
    stored = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter((d, *x) for (d, _), x in zip(stored, aligned_by_hand([t for _, t in stored])))
    assert Counter(tuple(r[c] for c in ("doc_id", *token_alignment.RESULT)) for r in got.collect()) == want
    assert token_alignment.align(empty(spark)).count() == 0


def test_special_strings_are_plain_text_in_an_alignment(spark):
    docs = rows_of(spark, ["one <|endoftext|> two", "</s><unk>"])
    got = {r["doc_id"]: r["n_a"] for r in token_alignment.align(docs).collect()}
    assert got[None] > 6 and got[BIG] > 2


def test_memo_and_units_do_not_change_an_alignment(monkeypatch):
    both = token_alignment.Pair(*token_alignment.default_models())

    def found(text):
        made = both.align(text)
        links = Counter()
        for pair, n in zip(*(made or ([], []))[-2:]):
            links[pair] += int(n)
        return made and (*made[:4], links)

    monkeypatch.setattr(token_alignment, "MEMO", 3)
    for t in [prose(4, 300), "a  b\n c \n\nd   ", " x", "x ", "tab\t y\u3000 z", "\x1c a\x1c b", *filter(None, odd_texts())]:
        both.split = True
        by_unit = found(t)
        assert found(t) == by_unit
        both.split = False
        assert found(t) == by_unit


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string, `_x` string, size string")


def test_whitening_against_an_eigendecomposition(spark):
    rng = np.random.default_rng(3)
    base = (rng.standard_normal((60, 20)) @ rng.standard_normal((20, 20))).astype(np.float32)
    rows = [(i, [float(x) for x in v], "c", "x", "s") for i, v in enumerate(base)]
    rows += [(BIG, rows[0][1], "c", "x", "s"), (None, rows[0][1], "c", "x", "s"), (None, rows[1][1], "c", "x", "s"),
             (70, None, "c", "x", "s"), (71, [None] + [1.0] * 19, "c", "x", "s"), (72, [float("nan")] * 20, "c", "x", "s"),
             (73, [float("inf")] * 20, "c", "x", "s"), (74, [], "c", "x", "s"), (75, [1.0, 2.0], "c", "x", "s"),
             (76, [3e38] * 20, "c", "x", "s")]
    got = whitening.whiten(vectors(spark, rows), keep=("vec_id", "_x", "component", "size"))
    assert got.columns == ["vec_id", "_x", "size", *whitening.RESULT]
    back = got.collect()
    kept = [r for r in rows if r[1] and len(r[1]) == 20 and None not in r[1] and abs(r[1][0]) < 1e30]
    x = [tuple(int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in r[1]) for r in kept]
    fit = np.array(sorted(set(x)), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    mean = sums / n
    centred = (n * fit - sums) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(back) == 16 * len(kept)
    by_id = defaultdict(list)
    for r in back:
        by_id[r["vec_id"], r["component"]].append(r)
    signs = {}
    for r, own in zip(kept, x):
        off = [n * c - int(s) for c, s in zip(own, sums)]
        white = (np.array(own) - mean) @ u[:, :16] / np.sqrt(e[:16])
        for k in range(16):
            mine = by_id[r[0], k + 1]
            sign = signs.setdefault(k, np.sign(mine[0]["whitened"] * white[k]))
            assert any(abs(m["whitened"] - sign * white[k]) < 1e-9 and m["deviation"] == sum(o * o for o in off) for m in mine)
            assert all(m["n"] == n and abs(m["explained"] - e[k] / e.sum()) < 1e-12 for m in mine)
    assert {r["identity_error"] for r in back} == {back[0]["identity_error"]} and back[0]["identity_error"] < 1e-8


def test_few_vectors_and_low_rank(spark):
    one = vectors(spark, [(1, [1.0, 2.0], "c", "x", "s"), (2, [1.0, 2.0], "c", "x", "s")])
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(one.limit(0)).count() == 0
    line = vectors(spark, [(i, [float(i), 2.0 * i, 7.0], "c", "x", "s") for i in range(5)])
    got = whitening.whiten(line).collect()
    assert {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in got)


def test_sums_stay_exact_beyond_longs():
    rng = np.random.default_rng(0)
    x = rng.integers(-2 ** 40, 2 ** 40, (7, 3))
    want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j])) for j in range(3)] for i in range(3)]
    assert whitening.products(x).tolist() == want
    assert whitening.deviations(np.array([[2 ** 33, 1], [5, 2]])) == [None, 29]
    assert Fraction(int(whitening.products(np.array([[3, 4]]))[0, 1])) == 12


@pytest.mark.parametrize("spec", ["spread", "falling", "tie", "low rank", "cluster", "spike"])
def test_feast_finds_every_leading_eigenvalue(spec):
    rng, d = np.random.default_rng(1), 40
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = np.sort(rng.random(d))[::-1] * 100 + 1
    e = {"spread": e, "falling": 2.0 ** -np.arange(d) * 1e6, "tie": np.array([5.0] * 20 + [1.0] * 20),
         "low rank": np.where(np.arange(d) < 5, e, 0), "cluster": np.where(np.arange(d) < 10, 100, 1 + 1e-9 * np.arange(d)),
         "spike": np.r_[1e9, e[1:]]}[spec]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.leading(v)
    assert len(values) == (5 if spec == "low rank" else 16)
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:len(values)]).max() <= 1e-13 * e[0]
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() <= 1e-13 * e[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_inertia_counts_signs():
    rng = np.random.default_rng(2)
    for d in (1, 2, 5, 30):
        a = rng.standard_normal((d, d))
        e = np.linalg.eigvalsh(a + a.T)
        assert whitening.inertia(a + a.T) == ((e < 0).sum(), 0, (e > 0).sum())
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 0, 1)
    assert whitening.inertia(np.zeros((3, 3))) == (0, 3, 0)
