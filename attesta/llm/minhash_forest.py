"""Operator 2, n-gram Jaccard join: a MinHash LSH forest and exact verification.

Texts become sets of hashed five-word shingles; equal sets are one
representative with a weight.  Signatures are banded at one fixed depth (a
"tree" is a band, a "node" its key): the largest one at which the bands together
reach the target recall at the similarity bound, known before any row is read.
No tries are built.  The representatives of one node are candidates.  Inside a node, one-byte sketches of the whole signature keep
the representatives together that may be similar (with a margin of more than
five standard deviations); the connected groups are then read again and all
their pairs are verified on the full sets, in blocks that emit one row per
representative: how many documents it is linked to, and its class so far.

Every link between different texts counts in ``n_links``; no pair is emitted.

Defined results: words are separated by blanks; a text of one to four words has
one shingle, its words; null and empty texts have none and are one class; equal
rows are separate documents; the smallest doc_id (null last) names the class; an
empty table gives no rows; further columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import LONG, LONGS, beside, materialize, row_keys, text_of
from attesta.llm.components import components

SHINGLE = 5
#: Similarity bound as a fraction.
SIMILAR = (4, 5)
TREES, DEEPEST = 44, 8
TARGET_RECALL = 0.99999
#: Standard deviations of the sketch estimate that a candidate may lie below the bound.
MARGIN = 5.5
#: Representatives of a node, or of a candidate group, that one block holds.
NODE_BLOCK, GROUP_BLOCK = 8192, 512
#: Bytes of text that one block of a candidate group holds on average.
GROUP_OCTETS = 32 << 20

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, n.bit_length())
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash per word: polynomial in its bytes, mixed with its length."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, _U)
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[:-1], out=sums[1:])
    return _mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U) * _U(_ODD))


def shingles(text: str) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(SHINGLE, len(w))
    total = np.full(len(w) - k + 1, k, _U)
    for i in range(k):
        total = total * _U(_ODD) + w[i:len(w) - k + 1 + i]
        total ^= total >> _U(29)
    return np.unique(_mixed(total))


_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 1 << 32, TREES * DEEPEST, dtype=np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, TREES * DEEPEST, dtype=np.uint32)[:, None]


def depth_for(target: float, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """Shortens the matched prefix until the forest reaches the target at the similarity bound."""
    s = SIMILAR[0] / SIMILAR[1]
    depth = deepest
    while depth > 1 and 1 - (1 - s ** depth) ** trees < target:
        depth -= 1
    return depth


def signature(found: np.ndarray, hashes: int) -> np.ndarray:
    """Minima of the first ``hashes`` permutations over a set that is not empty."""
    x = (found >> _U(32)).astype(np.uint32)
    out = np.full(hashes, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        part = _A[:hashes] * x[None, a:a + 1024]
        part += _B[:hashes]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def _sketch(depth: int):
    hashes = TREES * depth

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = np.arange(TREES, dtype=_U) * _U(_ODD)
        for pdf in batches:
            digest, keys, sketch = [], [], []
            for text in pdf.pop("_text"):
                found = shingles(text)
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                if not len(found):
                    keys.append(None)
                    sketch.append(None)
                    continue
                s = signature(found, hashes)
                label = turn.copy()
                for level in s.reshape(TREES, depth).T:
                    label = _mixed(label * _U(_ODD) + level.astype(_U))
                keys.append(label.view(np.int64).tolist())
                sketch.append((s >> np.uint32(24)).astype(np.uint8).tobytes())
            d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            yield pdf.assign(_d1=d[:, 0], _d2=d[:, 1], keys=keys, sketch=sketch)
    return run


def _grouped(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a partition that is sorted by ``by``, several at a time."""
    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        last = (held[by] == held[by].iloc[-1]).all(axis=1).to_numpy()
        at = len(held) - int(last[::-1].argmin()) if not last.all() else 0
        if at:
            yield held.iloc[:at]
            held = held.iloc[at:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def _bounds(pdf: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Starts of the groups, and the end."""
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for c in by:
        v = pdf[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(pdf))


def _near(depth: int):
    """Links the members of a node whose sketches agree enough, each group to its first member."""
    hashes = TREES * depth
    s = SIMILAR[0] / SIMILAR[1]
    least = (s - MARGIN * (s * (1 - s) / hashes) ** 0.5) * hashes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _grouped(batches, ["key", "i", "j"]):
            rep = pdf["rep"].to_numpy()
            sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), hashes)
            bounds = _bounds(pdf, ["key", "i", "j"])
            size = np.diff(bounds)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            two = bounds[:-1][size == 2]
            ok = two[(sketch[two] == sketch[two + 1]).sum(axis=1) >= least]
            a.append(rep[ok])
            b.append(rep[ok + 1])
            for lo, n in zip(bounds[:-1][size > 2].tolist(), size[size > 2].tolist()):
                left = np.arange(lo, lo + n)
                while len(left) > 1:
                    root, frontier, left = rep[left[0]], [left[0]], left[1:]
                    while frontier and len(left):
                        near = (sketch[left] == sketch[frontier.pop()]).sum(axis=1) >= least
                        found = left[near]
                        frontier.extend(found.tolist())
                        a.append(np.full(len(found), root))
                        b.append(rep[found])
                        left = left[~near]
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
    return run


def pair_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, from incidence matrices of the shared shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[inverse]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, len(shared), columns):
        a, b = np.searchsorted(column, [lo, lo + columns])
        m = np.zeros((len(sets), min(columns, len(shared) - lo)), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    np.fill_diagonal(out, [len(x) for x in sets])
    return out.astype(np.int64)


def similar(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """inter / union >= bound, in integers."""
    return inter * SIMILAR[1] >= (a + b - inter) * SIMILAR[0]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links and local classes of one block of a candidate group, or of two."""
    by = ["comp", "i", "j"]
    for pdf in _grouped(batches, by):
        bounds = _bounds(pdf, by)
        out = {"rep": [], "links": [], "root": []}
        reps, weights, blocks = pdf["rep"].to_numpy(), pdf["weight"].to_numpy(), pdf["block"].to_numpy()
        i, j, texts = pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["_text"].to_numpy()
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi - lo < 2:
                continue
            sets = [shingles(t) for t in texts[lo:hi]]
            size = np.array([len(x) for x in sets], np.int64)
            if hi - lo == 2:
                both = len(np.intersect1d(*sets, assume_unique=True))
                inter = np.array([[size[0], both], [both, size[1]]], np.int64)
            else:
                inter = pair_counts(sets)
            linked = similar(inter, size[:, None], size[None, :])
            np.fill_diagonal(linked, False)
            if i[lo] != j[lo]:
                linked &= blocks[lo:hi, None] != blocks[None, lo:hi]
            root, left = np.arange(hi - lo), np.ones(hi - lo, bool)
            for first in range(hi - lo):
                if left[first]:
                    member = np.zeros(hi - lo, bool)
                    member[first] = True
                    edge = member.copy()
                    while edge.any():
                        edge = linked[edge].any(axis=0) & ~member
                        member |= edge
                    left &= ~member
                    root[member] = np.flatnonzero(member)[reps[lo:hi][member].argmin()]
            out["rep"].append(reps[lo:hi])
            out["links"].append(linked.astype(np.int64) @ weights[lo:hi])
            out["root"].append(reps[lo:hi][root])
        if out["rep"]:
            yield pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})


def _blocks(df: DataFrame, **most: int) -> DataFrame:
    """A row for each pair of blocks (i <= j) of its group that the row's block takes part in.

    ``most`` names columns with a total of the group and how much of it a block may hold.
    """
    n = F.greatest(F.lit(1), *[F.ceil(F.col(c) / m).cast("int") for c, m in most.items()])
    block = F.pmod(F.xxhash64("rep"), n).cast("int")
    df = df.withColumn("_n", n).withColumn("block", block).withColumn(
        "_x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return df.withColumns({"i": F.least("block", "_x"), "j": F.greatest("block", "_x")}).drop("_n", "_x")


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", target: float = TARGET_RECALL) -> DataFrame:
    """Per document: doc_id, class_id, class_size, n_links, kept, and the row's keys (_r1, _r2)."""
    t = text_of(text)
    depth = depth_for(target)
    r1, r2 = row_keys(F.col(doc_id), t)
    slim = docs.select(F.col(doc_id).alias("doc_id"), *row_keys(t), r1.alias("_r1"), r2.alias("_r2"),
                       F.octet_length(t).cast("long").alias("octets"), t.alias("_text"))
    made = beside(slim, _sketch(depth), {"_d1": LONG, "_d2": LONG, "keys": LONGS, "sketch": ("binary", pa.binary())})
    made = materialize(made.withColumn("_tag", F.monotonically_increasing_id()), "sketches")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_tag")
    reps = materialize(made.groupBy("_d1", "_d2").agg(
        F.min(F.struct("_tag", "keys", "sketch", "_k1", "_k2", "octets")).alias("r"), F.count(F.lit(1)).alias("weight"),
        F.min(best).alias("best")).select("_d1", "_d2", "weight", "best", "r.keys", "r.sketch", "r._k1", "r._k2", "r.octets",
                                          F.col("r._tag").alias("rep")), "reps")

    # The forest: representatives under one node of one tree.
    under = reps.select("rep", F.explode("keys").alias("key"))
    nodes = under.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = under.join(nodes, "key", "inner").join(reps.select("rep", "sketch"), "rep", "inner")
    shared = _blocks(shared, members=NODE_BLOCK).select("key", "i", "j", "rep", "sketch")
    near = (shared.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
            .mapInPandas(_near(depth), "a long, b long"))
    groups = components(near).withColumnRenamed("root", "comp").withColumnRenamed("node", "rep")

    # Exact verification of the groups, on texts read again.
    members = materialize(groups.join(reps.select("rep", "weight", "octets", "_k1", "_k2"), "rep", "inner"), "members")
    sizes = materialize(members.groupBy("comp").agg(
        F.count(F.lit(1)).alias("members"), F.sum("octets").alias("volume")), "sizes")
    # The members grow with the corpus, so the plan is the same at every size: both sides are dealt out.
    texts = (docs.select(t.alias("_text"), *row_keys(t))
             .join(members.select("_k1", "_k2").hint("merge"), ["_k1", "_k2"], "left_semi")
             .dropDuplicates(["_k1", "_k2"]))
    rows = _blocks(members.join(sizes, "comp", "inner").join(texts, ["_k1", "_k2"], "inner"),
                   members=GROUP_BLOCK, volume=GROUP_OCTETS)
    checked = (rows.select("comp", "i", "j", "rep", "weight", "block", "_text")
               .repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "rep")
               .mapInPandas(_verify, "rep long, links long, root long"))
    checked = materialize(checked, "checked")
    classes = components(checked.select(F.col("root").alias("a"), F.col("rep").alias("b")))
    links = checked.groupBy("rep").agg(F.sum("links").alias("links"))

    known = (reps.filter("weight > 1").select("rep").union(classes.select("node")).distinct()
             .join(reps.select("rep", "_d1", "_d2", "weight", "best"), "rep", "inner")
             .join(classes.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left")
             .withColumn("root", F.coalesce("root", "rep")))
    known = materialize(known, "known")
    named = known.groupBy("root").agg(F.min("best").alias("head"), F.sum("weight").alias("class_size"))
    known = known.join(named, "root", "inner").select(
        "_d1", "_d2", "head", "class_size", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = made.select("doc_id", "_tag", "_d1", "_d2", "_r1", "_r2").join(known, ["_d1", "_d2"], "left")
    return out.select(
        "doc_id", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("head").isNull() | (F.col("head._tag") == F.col("_tag"))).alias("kept"), "_r1", "_r2")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class."""
    keys = [c.alias(n) for c, n in zip(row_keys(F.col(doc_id), text_of(text)), ("_r1", "_r2"))]
    kept = join(docs, text, doc_id).filter("kept").select("_r1", "_r2")
    return (docs.select("*", *keys).join(kept, ["_r1", "_r2"], "left_semi")
            .dropDuplicates(["_r1", "_r2"]).select(*docs.columns))
