"""Operator 6, exact dedup: content-defined chunk recipes.

The normalised text (all blanks deleted) is cut where a rolling hash of its
bytes says so.  A recipe is the ordered list of chunk hashes.  Only documents
whose recipe occurs more than once are read again: their chunks are
deduplicated by content, which verifies the hash or splits it into variants,
and the ordered lists of verified identifiers decide equality.  A long text
therefore moves only if another one looks equal, and then as distinct chunks.

Defined results: null counts as empty; all empty texts are equal; of equal
texts the one with most code points before normalisation stays, then the
smallest doc_id (null last), then one of equal rows; an empty table gives no
rows; further columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import LONG, LONGS, TEXT, beside, materialize, row_keys, text_of

#: Chunk lengths in bytes.
LEAST, MEAN_BITS, MOST = 512, 11, 8192
WINDOW = 32
BLANKS = b" \t\n\x0b\x0c\r"
RECIPE = "array<bigint>"


def _gear() -> np.ndarray:
    """A fixed random number for each byte value."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed=6) for b in range(256)], dtype=np.uint32)


GEAR = _gear()


def cuts(data: bytes, least: int = LEAST, bits: int = MEAN_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks: where the hash of the last 32 bytes has ``bits`` leading zeros."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    width = 1
    while width < WINDOW:  # h covers `width` bytes; doubling adds the bytes before, shifted
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    marks = np.flatnonzero(h < (1 << (32 - bits))) + 1
    out, at = [], 0
    for m in marks.tolist():
        while m - at > most:
            at += most
            out.append(at)
        if m - at >= least:
            at = m
            out.append(at)
    while n - at > most:
        at += most
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks_of(data: bytes) -> list[bytes]:
    at, out = 0, []
    for end in cuts(data):
        out.append(data[at:end])
        at = end
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _recipes(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf.pop("_text"):
                data = text.encode("utf-8", "surrogatepass").translate(None, BLANKS)
                rows.append((len(text), hashlib.sha256(data).hexdigest(),
                             [_signed(xxhash.xxh64_intdigest(c) >> (64 - bits)) for c in chunks_of(data)]))
            yield pdf.assign(n_points=[r[0] for r in rows], text_sha256=[r[1] for r in rows],
                             recipe=[r[2] for r in rows])
    return run


def _chunk_rows(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {"_k1": [], "_k2": [], "seq": [], "h": [], "chunk": []}
            for k1, k2, text in zip(pdf["_k1"], pdf["_k2"], pdf["_text"]):
                for i, c in enumerate(chunks_of(text.encode("utf-8", "surrogatepass").translate(None, BLANKS))):
                    for name, v in zip(out, (k1, k2, i, _signed(xxhash.xxh64_intdigest(c) >> (64 - bits)), c)):
                        out[name].append(v)
            yield pd.DataFrame(out)
    return run


def recipes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 64) -> DataFrame:
    """One row per document: keys, doc_id, n_points, text_sha256, recipe (written, without the text)."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("_text"), *row_keys(text_of(text)))
    out = beside(slim, _recipes(bits), {"n_points": LONG, "text_sha256": TEXT, "recipe": LONGS})
    return materialize(out.withColumn("_tag", F.monotonically_increasing_id()), "recipes")


def verified(docs: DataFrame, made: DataFrame, text: str = "text", bits: int = 64) -> DataFrame:
    """(_k1, _k2, fix): variants of chunks that share a hash but not their bytes; normally no row.

    Reads the texts whose recipe occurs more than once.  Chunks are grouped by
    content after each task has dropped its own repeats, so copies of a text
    shrink before they move.
    """
    again = (made.groupBy("recipe").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_k1", "_k2")).alias("a"),
                                        F.max(F.struct("_k1", "_k2")).alias("b"))
             .filter("n > 1 and a <> b"))  # equal texts need no proof
    wanted = made.join(again.select("recipe"), "recipe", "left_semi").select("_k1", "_k2").distinct()
    texts = docs.select(text_of(text).alias("_text"), *row_keys(text_of(text)))
    texts = texts.join(wanted, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
    rows = texts.mapInPandas(_chunk_rows(bits), "_k1 long, _k2 long, seq int, h bigint, chunk binary")
    rows = materialize(rows, "chunks")
    doubtful = (rows.groupBy("h").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"))
                .filter("a <> b").select("h"))
    variants = rows.join(doubtful, "h", "left_semi").groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n"))
    named = variants.select("h", "chunk", F.sha2("chunk", 256).alias("variant"))
    return (rows.join(named, ["h", "chunk"], "inner").groupBy("_k1", "_k2")
            .agg(F.sort_array(F.collect_list(F.struct("seq", "variant"))).alias("fix")))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int = 64) -> DataFrame:
    """One row per document with its group.  ``bits`` below 64 forces collisions, for tests."""
    made = recipes(docs, text, doc_id, bits)
    fixes = verified(docs, made, text, bits)
    ids = made.join(fixes, ["_k1", "_k2"], "left")
    ids = ids.withColumn("fix", F.coalesce("fix", F.array().cast(fixes.schema["fix"].dataType)))
    order = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("null"), "doc_id", "_tag")
    # Written, so that adaptive execution can split the documents of a very large group.
    groups = materialize(ids.groupBy("recipe", "fix").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
                         .filter("group_size > 1"), "groups")
    out = ids.join(groups, ["recipe", "fix"], "left")
    return out.select(
        "doc_id", F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("best").isNull() | (F.col("best._tag") == F.col("_tag"))).alias("kept"), "text_sha256")
