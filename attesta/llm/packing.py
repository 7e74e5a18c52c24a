"""Operator 7, packing: minimum bin slack over the histogram of remaining lengths.

A document's ids are cut into full windows; what remains has one of fewer than
2048 lengths, so the packing problem of any corpus is a histogram of bounded
size.  Each window takes the longest remaining length and the multiset of
others that a subset-sum search over bitsets brings closest to capacity; the
pattern is repeated while the counts last.  When the best fill leaves more than
the tolerated slack, the rest is laid end to end and cut at window ends.  Ranks
of documents inside a length then say which window and offset each one gets.

Defined results: a null text is empty and has the one end id; repeated rows are
packed apart; an empty table gives no rows; further columns pass through where
``keep`` names them, apart from the piece columns.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import LONG, LONGS, beside, chunked, materialize, row_keys, text_of

CAPACITY = 2048
END_ID = 1
#: Slack that a window of whole remainders may have; beyond it the rest is cut.
TOLERATED = 4
PIECE = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@lru_cache(maxsize=2)
def encoder(model: str):
    """A function from text to ids, as the named tokenizer file gives them.

    Beside ``NAME.json`` lies ``NAME.tiktoken``, the same vocabulary as ranks,
    whose encoder is several times faster and gives the same ids; a text that
    names a special token goes through the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(model)
    with open(model.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text: str, model: str) -> np.ndarray:
    return np.array([*encoder(model)(text), END_ID], dtype="<u4")


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# --- the plan -------------------------------------------------------------------------------

def best_fill(counts: np.ndarray, room: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``room`` of available lengths, and how often each is used.

    Bitset subset-sum: bit s of a set says that s can be reached with the
    lengths so far; counts enter in powers of two.  The sets before each step
    are kept for the way back.  Stops as soon as ``room`` itself is reached.
    """
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, take = min(int(counts[length]), room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    at, used = total, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return total, used


def plan(counts: np.ndarray, capacity: int = CAPACITY, tolerated: int = TOLERATED):
    """Windows for a histogram of lengths below ``capacity``.

    Returns (entries, windows, left): entries are (length, first rank, ranks,
    copies per window, first window, offset), and ``left`` the counts that no
    window within the tolerance takes.  The lengths number less than
    ``capacity``, so the plan's size does not depend on the corpus.
    """
    counts = counts.astype(np.int64).copy()
    used_up = np.zeros_like(counts)
    entries, window, left = [], 0, np.zeros_like(counts)
    top = capacity - 1
    while True:
        while top > 0 and not counts[top]:
            top -= 1
        if top <= 0:
            return entries, window, left
        counts[top] -= 1
        total, used = best_fill(counts, capacity - top)
        counts[top] += 1
        if top + total < capacity - tolerated:
            # The longest remainder finds no partners: it waits to be cut.
            left[top] += counts[top]
            counts[top] = 0
            continue
        used[top] = used.get(top, 0) + 1
        times = min(int(counts[length]) // k for length, k in used.items())
        offset = 0
        for length in sorted(used, reverse=True):
            k = used[length]
            entries.append((length, int(used_up[length]), times * k, k, window, offset))
            used_up[length] += times * k
            counts[length] -= times * k
            offset += length * k
        window += times


# --- the job --------------------------------------------------------------------------------

def _measure(model: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total, crcs = [], []
            for text in pdf.pop("_text"):
                ids = ids_of(text, model)
                total.append(len(ids))
                crcs.append([crc(ids[a:a + capacity]) for a in range(0, len(ids), capacity)])
            yield pdf.assign(doc_tokens=np.array(total, dtype=np.int64), crcs=crcs)
    return run


def _assign(entries: list[tuple], capacity: int):
    """Adds window and offset of the remainder; -1 where the plan leaves it to be cut."""
    table = np.array(sorted((e[0], e[1], e[2], e[3], e[4], e[5]) for e in entries), dtype=np.int64).reshape(-1, 6)
    bounds = table[:, 0] * (1 << 50) + table[:, 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["_rest"].to_numpy(np.int64), pdf["_rank"].to_numpy(np.int64)
            at = np.searchsorted(bounds, length * (1 << 50) + rank, side="right") - 1
            window, offset = np.full(len(pdf), -1, np.int64), np.full(len(pdf), -1, np.int64)
            if len(table):
                row = table[np.maximum(at, 0)]
                into = rank - row[:, 1]
                ok = (at >= 0) & (row[:, 0] == length) & (into < row[:, 2])
                window = np.where(ok, row[:, 4] + into // row[:, 3], -1)
                offset = np.where(ok, row[:, 5] + into % row[:, 3] * length, -1)
            yield pdf.assign(_window=window, _offset=offset)
    return run


def _span_crcs(model: str):
    """CRCs of given spans of ids of a text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {"_k1": [], "_k2": [], "start": [], "length": [], "ids_crc32": []}
            for k1, k2, text, spans in zip(pdf["_k1"], pdf["_k2"], pdf["_text"], pdf["spans"]):
                ids = ids_of(text, model)
                for span in spans:
                    a, n = span["start"], span["length"]
                    for name, v in zip(out, (k1, k2, a, n, crc(ids[a:a + n]))):
                        out[name].append(v)
            yield pd.DataFrame(out)
    return run


def pack(docs: DataFrame, text: str = "text", model: str | None = None, capacity: int = CAPACITY,
         keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The pieces of all documents: ``keep`` and the PIECE columns."""
    model = model or default_model()
    keep = tuple(c for c in keep if c not in PIECE)
    t = text_of(text)
    slim = docs.select(*keep, *row_keys(t), t.alias("_text"))
    sized = beside(slim, _measure(model, capacity), {"doc_tokens": LONG, "crcs": LONGS})
    sized = sized.withColumns({"_tag": F.monotonically_increasing_id(), "_rest": F.col("doc_tokens") % capacity,
                               "_full": F.floor(F.col("doc_tokens") / capacity), "_one": F.lit(1).cast("long")})
    sized = materialize(sized, "tokens")

    histogram = np.zeros(capacity, dtype=np.int64)
    for r in sized.filter("_rest > 0").groupBy("_rest").count().collect():  # fewer rows than the capacity
        histogram[r["_rest"]] = r["count"]
    entries, windows, left = plan(histogram, capacity)

    bits = max(3, (int(histogram.sum()) >> 18).bit_length() + 1)
    mixed = F.xxhash64("_tag")
    rests = chunked(sized.filter("_rest > 0").select("_tag", "_rest", "_one", mixed.alias("_mixed")),
                    ["_rest"], ["_mixed", "_tag"], F.shiftright("_mixed", 64 - bits), {"_rank": "_one"})
    placed = rests.select("_tag", "_rest", "_rank").mapInPandas(
        _assign(entries, capacity), "_tag long, _rest long, _rank long, _window long, _offset long")
    placed = materialize(placed, "placed")
    whole = placed.filter("_window >= 0")

    # Full windows come after the planned ones, by document; then the cut rest.
    fulls = chunked(sized.filter("_full > 0").select("_tag", "_full"), [], ["_tag"],
                    F.shiftright("_tag", 33) * 4096 + F.floor(F.col("_tag") % (1 << 33) / (1 << 16)), {"_before": "_full"})
    n_full = sized.agg(F.coalesce(F.sum("_full"), F.lit(0)).alias("n")).first()["n"]
    full = (sized.join(fulls.select("_tag", "_before"), "_tag", "inner")
            .select("_tag", "crcs", "_before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)).alias("i"))
            .select("_tag", (F.col("i") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"),
                    F.element_at("crcs", F.col("i").cast("int") + 1).alias("ids_crc32"),
                    (F.lit(windows) + F.col("_before") + F.col("i")).alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset")))
    rest = (sized.join(whole, ["_tag", "_rest"], "inner")
            .select("_tag", (F.col("_full") * capacity).alias("start"), F.col("_rest").alias("length"),
                    F.element_at("crcs", -1).alias("ids_crc32"), F.col("_window").alias("sequence_id"),
                    F.col("_offset").alias("offset")))
    pieces = full.unionByName(rest)
    if left.any():
        pieces = pieces.unionByName(_cut(docs, t, sized, placed, model, capacity, windows + n_full))
    return pieces.join(sized.select("_tag", *keep, "doc_tokens"), "_tag", "inner").select(*keep, *PIECE)


def _cut(docs: DataFrame, t, sized: DataFrame, placed: DataFrame, model: str, capacity: int,
         first: int) -> DataFrame:
    """Lays the remaining pieces end to end and cuts them at window ends."""
    rows = chunked(placed.filter("_window < 0").select("_tag", "_rest"), [], ["_tag"],
                   F.shiftright("_tag", 33) * 4096 + F.floor(F.col("_tag") % (1 << 33) / (1 << 16)), {"_at": "_rest"})
    rows = materialize(rows.join(sized.drop("_rest"), "_tag", "inner").withColumns({
        "_a": F.floor(F.col("_at") / capacity), "_b": F.floor((F.col("_at") + F.col("_rest") - 1) / capacity)}), "cut")
    start = F.col("_full") * capacity
    uncut = rows.filter("_a = _b").select(
        "_tag", start.alias("start"), F.col("_rest").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"),
        (F.lit(first) + F.col("_a")).alias("sequence_id"), (F.col("_at") % capacity).alias("offset"))
    return uncut.unionByName(_divided(docs, t, rows.filter("_a < _b"), model, capacity, first))


def _divided(docs: DataFrame, t, rows: DataFrame, model: str, capacity: int, first: int) -> DataFrame:
    """Pieces of remainders that a window end divides; their texts are read again.

    A text has fewer than 2 * capacity different spans here, however many
    copies it has, so it is encoded once and its spans are a bounded list.
    """
    low = lambda w: F.greatest(F.col("_at"), w * capacity)
    high = lambda w: F.least(F.col("_at") + F.col("_rest"), (w + 1) * capacity)
    spans = F.transform(F.sequence("_a", "_b"), lambda w: F.struct(
        (F.col("_full") * capacity + low(w) - F.col("_at")).alias("start"), (high(w) - low(w)).alias("length"),
        (w + first).alias("sequence_id"), (low(w) % capacity).alias("offset")))
    pieces = rows.select("_tag", "_k1", "_k2", F.explode(spans).alias("s")).select("_tag", "_k1", "_k2", "s.*")
    wanted = pieces.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    texts = docs.select(t.alias("_text"), *row_keys(t)).join(wanted.select("_k1", "_k2"), ["_k1", "_k2"], "left_semi")
    texts = texts.dropDuplicates(["_k1", "_k2"]).join(wanted, ["_k1", "_k2"], "inner")
    crcs = texts.select("_k1", "_k2", "_text", "spans").mapInPandas(
        _span_crcs(model), "_k1 long, _k2 long, start long, length long, ids_crc32 long")
    out = pieces.join(crcs, ["_k1", "_k2", "start", "length"], "inner")
    return out.select("_tag", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, pieces: DataFrame, text: str = "text", doc_id: str = "doc_id",
              model: str | None = None) -> DataFrame:
    """The packed sequences with their ids, for documents with unique ids.

    Each document is encoded once with the list of its own pieces; the pieces
    of a sequence, at most its capacity, meet in one row.
    """
    model = model or default_model()

    def run(batches):
        for pdf in batches:
            rows = [(s["sequence_id"], s["offset"], ids[s["start"]:s["start"] + s["length"]].astype(np.int32).tolist())
                    for t, spans in zip(pdf["_text"], pdf["spans"]) for ids in [ids_of(t, model)] for s in spans]
            yield pd.DataFrame(rows, columns=["sequence_id", "offset", "ids"])

    own = pieces.groupBy(doc_id).agg(
        F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("spans"))
    joined = docs.select(doc_id, text_of(text).alias("_text")).join(own, doc_id, "inner")
    filled = joined.select("_text", "spans").mapInPandas(run, "sequence_id long, offset long, ids array<int>")
    return filled.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
