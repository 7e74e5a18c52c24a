"""Operator 11, token counts: huge texts in overlapping chunks, spliced where both chunks agree.

A text longer than ``CHUNK`` becomes windows that overlap their successor.  Each window is encoded
with the offsets of its tokens, and neighbours are spliced at a boundary that both have in the
overlap.  Counts are then sums over windows and seams, so a text of any length spreads over tasks
and no task holds more than a window of it.

Why a common boundary proves the splice.  The tokenizer cuts a text into pieces by a pattern that
is matched from left to right and looks at nothing behind its start, then encodes each piece on its
own; strings of special tokens are cut out before.  The pieces after a boundary therefore depend on
the text after it alone.  A window's own pieces are those of the text from any true boundary on, up
to ``margin`` characters before the window's end, as far as the pattern or a special token can look
ahead.  If a boundary of the left window, true by its left seam, is also one of the right window,
both have the same pieces from there on.  Two windows without a common boundary lie in one long run
(of letters, say): their texts are taken again with overlaps eight times as wide, until every seam
holds or the text is one window.

Defined results: a null text is empty and has no tokens; equal long texts are encoded once, repeated
rows keep their own rows; an empty table gives no rows; further columns come along where ``keep``
names them, those of the result excepted.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import materialize, row_keys, text_of

#: Characters of a window, and how far it goes into the next one at first.
CHUNK = 32_768
OVERLAP = 1_024
WIDER = 8
LIMIT = 1024
RESULT = ("n_bytes", "n_tokens", "over_limit")
#: Characters that the pattern may look at after the end of what it matches.
LOOK_AHEAD = 3


class Kit(NamedTuple):
    fast: object             # the encoder of plain text
    pattern: regex.Pattern   # cuts plain text into pieces
    special: regex.Pattern | None
    sizes: np.ndarray        # bytes of each id
    margin: int


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def kit(model: str) -> Kit:
    """What encodes for a byte-level BPE file and the ranks file beside it (same ids, tested)."""
    import public_tokenizers
    import tiktoken

    with open(model, encoding="utf-8") as f:
        said = json.load(f)
    added = said["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added) or said.get("normalizer"):
        raise ValueError("only plain special tokens and no normalizer")
    with open(model.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    names = sorted((t["content"] for t in added), key=len, reverse=True)
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Kit(fast, regex.compile(public_tokenizers.PATTERN),
               regex.compile("|".join(map(regex.escape, names))) if names else None, sizes,
               LOOK_AHEAD + max(map(len, names), default=0))


def segments(text: str, k: Kit) -> Iterator[tuple[str, bool]]:
    """The text cut at special tokens: (part, whether it is one)."""
    at = 0
    for m in k.special.finditer(text) if k.special else ():
        if m.start() > at:
            yield text[at:m.start()], False
        yield m.group(), True
        at = m.end()
    if at < len(text):
        yield text[at:], False


def count(text: str, k: Kit) -> int:
    return sum(1 if special else len(k.fast.encode_ordinary(part)) for part, special in segments(text, k))


def windows(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each window; the last is longer than the overlap and ends with the text."""
    n = max(1, math.ceil((length - overlap) / chunk))
    return [(i * chunk, (i + 1) * chunk + overlap if i < n - 1 else length) for i in range(n)]


def scan(piece: str, k: Kit, zones: list[tuple[int, int]]) -> tuple[int, list[list[tuple[int, int]]]]:
    """Tokens of a window, and the piece boundaries in each zone of characters.

    A boundary is (bytes after the zone's start, tokens of the window before it).
    """
    ends, cuts, at, base = [], [0], 0, 0
    for part, special in segments(piece, k):
        if special:
            sizes, own = np.array([len(part.encode())]), [len(part)]
        else:
            sizes, own = k.sizes[k.fast.encode_ordinary(part)], [m.end() for m in k.pattern.finditer(part)]
        ends.append(base + np.cumsum(sizes))
        cuts += [at + c for c in own]
        at, base = at + len(part), int(ends[-1][-1])
    ends = np.concatenate([[0], *ends])
    found = []
    for low, high in zones:
        before, last, mine = len(piece[:low].encode()), low, []
        zero = before
        for c in cuts:
            if low <= c <= high:
                before, last = before + len(piece[last:c].encode()), c
                i = int(np.searchsorted(ends, before))
                if i < len(ends) and ends[i] == before:
                    mine.append((before - zero, i))
        found.append(mine)
    return len(ends) - 1, found


def _counts(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = kit(model)
        for b in batches:
            at = b.schema.get_field_index("_text")
            n = pa.array([count(t.as_py(), k) for t in b.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(b.num_columns) if i != at], n],
                [*[name for name in b.schema.names if name != "_text"], "n_tokens"])
    return run


CUT = pa.schema([("_k1", pa.int64()), ("_k2", pa.int64()), ("i", pa.int64()), ("last", pa.bool_()), ("piece", pa.string())])


def _cut(chunk: int, overlap: int):
    """One row for each window of a long text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k1, k2, text in zip(b.column("_k1"), b.column("_k2"), b.column("_text")):
                text = text.as_py()
                spans = windows(len(text), chunk, overlap)
                for i, (start, end) in enumerate(spans):
                    row = [[k1.as_py()], [k2.as_py()], [i], [i == len(spans) - 1], [text[start:end]]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, CUT)], schema=CUT)
    return run


MARK = "array<struct<at: long, before: long>>"


def _encode(model: str, chunk: int, overlap: int):
    kind = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = kit(model)
        for b in batches:
            tokens, heads, tails = [], [], []
            for i, last, piece in zip(b.column("i"), b.column("last"), b.column("piece")):
                zones = [(0, overlap if i.as_py() else -1), (chunk, -1 if last.as_py() else chunk + overlap - k.margin)]
                n, (head, tail) = scan(piece.as_py(), k, zones)
                tokens.append(n)
                heads.append([{"at": a, "before": t} for a, t in head])
                tails.append([{"at": a, "before": t} for a, t in tail])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in ("_k1", "_k2", "i", "last")], pa.array(tokens, pa.int64()),
                 pa.array(heads, kind), pa.array(tails, kind)],
                ["_k1", "_k2", "i", "last", "tokens", "head", "tail"])
    return run


def _round(texts: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """``_k1, _k2, n_tokens, failed`` of every text; windows of equal texts are encoded once."""
    cut = texts.mapInArrow(_cut(chunk, overlap), "_k1 long, _k2 long, i long, last boolean, piece string")
    cut = cut.dropDuplicates(["_k1", "_k2", "i"])
    coded = materialize(cut.mapInArrow(
        _encode(model, chunk, overlap),
        f"_k1 long, _k2 long, i long, last boolean, tokens long, head {MARK}, tail {MARK}"), "windows")
    left = coded.filter("not last").select("_k1", "_k2", "i", "tail")
    right = coded.filter("i > 0").select("_k1", "_k2", (F.col("i") - 1).alias("i"), "head")
    at = F.array_min(F.array_intersect(F.col("tail.at"), F.col("head.at")))
    before = lambda marks: F.filter(marks, lambda m: m["at"] == F.col("at"))[0]["before"]
    seams = (left.join(right, ["_k1", "_k2", "i"], "inner").withColumn("at", at)
             .select("_k1", "_k2", F.when(F.col("at").isNotNull(), before("tail") - before("head")).alias("part")))
    parts = seams.unionByName(coded.filter("last").select("_k1", "_k2", F.col("tokens").alias("part")))
    return parts.groupBy("_k1", "_k2").agg(F.sum("part").alias("n_tokens"),
                                           F.max(F.col("part").isNull()).alias("failed"))


def count_long(texts: DataFrame, model: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``_k1, _k2, n_tokens`` of the texts in ``_text``, by windows."""
    found, waiting = None, texts
    while True:
        totals = materialize(_round(waiting, model, chunk, overlap), "counts")
        done = totals.filter("not failed").drop("failed")
        found = done if found is None else found.unionByName(done)
        failed = totals.filter("failed").select("_k1", "_k2")
        if failed.isEmpty():
            return found
        overlap *= WIDER
        chunk = max(chunk, 4 * overlap)
        waiting = texts.join(failed, ["_k1", "_k2"], "left_semi")


def count_tokens(docs: DataFrame, text: str = "text", model: str | None = None, keep: tuple[str, ...] = ("doc_id",),
                 chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """``keep`` and, for every row, bytes and tokens of its whole text and whether they exceed ``limit``."""
    model = model or default_model()
    if overlap * 4 > chunk or overlap <= kit(model).margin:
        raise ValueError("the overlap is more than the margin and at most a quarter of the chunk")
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(c for c in keep if c not in RESULT)]
    names = [c for c in keep if c not in RESULT]
    slots = [f"k{i}" for i in range(len(names))]
    t = text_of(f"`{text}`")
    rows = docs.select(*kept, F.octet_length(t).cast("long").alias("n_bytes"), t.alias("_text"))
    is_long = F.length("_text") > chunk
    short = rows.filter(~is_long)
    kinds = "".join(f"{s} {short.schema[s].dataType.simpleString()}, " for s in slots)
    short = short.mapInArrow(_counts(model), f"{kinds}n_bytes long, n_tokens long")
    long = rows.filter(is_long).select("*", *row_keys(F.col("_text")))
    counts = count_long(long.select("_k1", "_k2", "_text"), model, chunk, overlap)
    long = long.drop("_text").join(counts, ["_k1", "_k2"], "inner").select(*short.columns)
    return short.unionByName(long).select(*[F.col(s).alias(c) for s, c in zip(slots, names)], "n_bytes", "n_tokens",
                                          (F.col("n_tokens") > limit).alias("over_limit"))
