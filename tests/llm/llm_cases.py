"""Fixtures and brute-force answers for the training-data operators."""

from __future__ import annotations

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "size string, kept string, start string, key string, label string, `_tag` string")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    return " ".join(words)


def edge_texts() -> list[tuple]:
    """Nulls, blanks, ties, copies, near copies, repeated rows, a long text; a source with most rows."""
    long = "\n".join(prose(900 + i, 60) for i in range(60))
    base = prose(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [(1, None, "s0"), (2, "", "s0"), (3, " \t\n\x0b ", None), (4, long, "s0"), (5, long, "s1"), (6, long, "s0"),
            (6, long, "s0"), (None, prose(2, 70), "s0"), (7, base, None), (8, " ".join(near), "s0"),
            (9, base.replace(" ", "  \n"), "s1"), (10, "a b c", "s0"), (11, "a b c", "s2"), (12, "a b d", "s0")]
    rows += [(20 + i, prose(100 + i, 55 + i), "s0") for i in range(12)]
    return rows


def frame(spark, rows):
    clash = ("x", "y", "z", "w", "v", "u")
    return spark.createDataFrame([(d, t, "en", s, 0, *clash) for d, t, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def metrics(text: str | None) -> dict:
    w = words(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def shingles(text: str | None) -> frozenset:
    w = words(text)
    k = min(5, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def near_links(texts: list) -> tuple[list[int], list[int]]:
    """Class (index of its first member) and number of links of every text, by all pairs."""
    sets = [shingles(t) for t in texts]
    parent, links = list(range(len(texts))), [0] * len(texts)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            union = len(sets[i] | sets[j])
            if both * 5 >= union * 4:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], links


def line_runs(docs: list[tuple], least: int = 50) -> dict:
    """Lines that later repeated runs take, per (doc_id, text), by looking at every window."""
    first, out = {}, {}
    for d, t in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        rows = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((t or "").split("\n"))]
        rows = [(i, x, len(words(x))) for i, x in rows if x]
        spans = set()
        for a in range(len(rows)):
            for step in (1, -1):
                n, b = 0, a
                while 0 <= b < len(rows):
                    n += rows[b][2]
                    if n >= least:
                        spans.add((min(a, b), max(a, b)))
                        break
                    b += step
        gone = set()
        for a, b in sorted(spans):
            content = tuple(x for _, x, _ in rows[a:b + 1])
            seen = first.setdefault(content, ((d, t), rows[a][0], rows[b][0]))
            if seen[0] != (d, t) or rows[a][0] > seen[2]:
                gone |= set(range(rows[a][0], rows[b][0] + 1))
        out[(d, t)] = gone
    return out
