"""Operator 3, sharding: sampled splitters, range partition, shards of near equal bytes.

Records are ordered by a key.  A size-weighted sample of keys gives quantile
boundaries; each record finds its range by binary search; ranges that turn out
overfull are sampled again, more densely, and divided.  Exact totals per range
and a running sum inside each range then place every record on one line of
bytes, which is cut into shards.

Defined results: a null key sorts first; a null text has size 1 and CRC 0;
equal texts are neighbours and share a shard unless a cut runs through the
group; an empty table gives no rows; further columns pass through.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.common import chunked, tagged, text_of

#: Ranges hold about so many records; the number of ranges follows the input.
RANGE_ROWS = 4096
#: Sampled keys per range.
PER_RANGE = 16
#: The list of splitters is part of the plan, so it has a fixed bound (and ranges grow beyond it).
MAX_RANGES = 16384
#: A range with more than so many times the mean bytes or rows is divided.
OVERFULL = 2.0


def uniform(*columns: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) per row."""
    return F.pmod(F.xxhash64(F.lit("sample"), *columns), F.lit(1 << 52)) / float(1 << 52)


def range_of(key: Column, splitters: list[tuple]) -> Column:
    """How many of the sorted splitters are at or before the key: a binary search.

    Step widths halve from the largest power of two, so a row makes
    log2(splitters) comparisons.
    """
    if not splitters:
        return F.lit(0)
    fields = [f"k{i}" for i in range(len(splitters[0]))]
    table = F.from_json(F.lit(json.dumps([dict(zip(fields, s)) for s in splitters])),
                        f"array<struct<{','.join(f'{f}:bigint' for f in fields)}>>")
    widths = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(w) for w in widths]), F.lit(0),
        lambda at, w: F.when(F.coalesce(F.get(table, at + w - 1) <= key, F.lit(False)), at + w).otherwise(at))


def _sample(df: DataFrame, keys: list[str], rate: Column) -> DataFrame:
    """A row enters with probability size * rate."""
    return df.filter(uniform(*[F.col(k) for k in keys]) < F.col("_size") * rate).select(*keys, "_size")


def _quantiles(rows: list, per_range: int) -> list[tuple]:
    """Every per_range-th key of a weighted sample, without repeats."""
    ordered = sorted(tuple(r)[:-1] for r in rows)
    return sorted(set(ordered[per_range - 1::per_range]))


def assign(df: DataFrame, size: Column, key: Column, tie: Column, n_shards: int,
           range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``shard`` and ``slot``, in shards of near equal total ``size``.

    ``key`` and ``tie`` are longs; rows with equal key and tie are kept apart
    by their row tag, so a range can always be divided.
    """
    df = tagged(df.withColumns({"_size": size.cast("long"), "_key": F.coalesce(key, F.lit(-(1 << 63))),
                                "_tie": F.coalesce(tie, F.lit(-(1 << 63)))}), "shards")
    keys = ["_key", "_tie", "_tag"]
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("b")).first()
    n, volume = total["n"], total["b"] or 0
    ranges = min(MAX_RANGES, max(n_shards, -(-n // range_rows)))
    composite = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])

    # First splitters: about PER_RANGE weighted draws per range (a bounded number of three longs).
    draws = _sample(df, keys, F.lit(ranges * PER_RANGE / max(1, volume))).collect()
    splitters = _quantiles(draws, PER_RANGE)
    counts = {r["r"]: (r["n"], r["b"]) for r in df.groupBy(range_of(composite, splitters).alias("r")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_size").alias("b")).collect()}
    parts = {r: min(4096, int(max(c[0] * ranges / n, c[1] * ranges / max(1, volume)))) for r, c in counts.items()
             if max(c[0] * ranges / n, c[1] * ranges / max(1, volume)) > OVERFULL}
    if parts:
        # Overfull ranges only: draw PER_RANGE keys for each part that they need.
        rates = {r: k * PER_RANGE / max(1, counts[r][1]) for r, k in parts.items()}
        here = range_of(composite, splitters)
        rate = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), here), F.lit(0.0))
        more = _sample(df, keys, rate).collect()
        splitters = sorted({*splitters, *_quantiles(more, PER_RANGE)})

    df = df.withColumn("_range", range_of(composite, splitters))
    placed = chunked(df.withColumn("_one", F.lit(1).cast("long")), [], keys, F.col("_range"),
                     {"_before": "_size", "_row": "_one"})
    middle = (F.col("_before") + F.col("_size") / 2) * n_shards / max(1, volume)
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle).cast("int")))
    # Rows before a shard: bytes rise along the line, so each shard is one stretch of rows.
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    out = placed.join(firsts, "shard", "left")
    own = [c for c in df.columns if not c.startswith("_")]
    return out.select(*own, "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 8, text: str = "text", doc_id: str = "doc_id",
                    keep: list[str] | None = None) -> DataFrame:
    """Documents with size, shard and slot; equal texts lie side by side."""
    t = text_of(text)
    keep = docs.columns if keep is None else keep
    names = [c for c in keep if c not in ("size", "text_crc32", "shard", "slot")]
    own = [F.col(f"`{c}`") for c in names] or [F.lit(None).cast("int").alias("none")]
    given = F.col(f"`{doc_id}`")
    whole = docs.schema[doc_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    number = given.cast("long") if whole else F.when(given.isNotNull(), F.xxhash64(given))
    # The columns travel in one struct, so that no name of theirs meets one made here.
    made = docs.select(F.struct(*own).alias("doc"), number.alias("doc_id"),
                       (F.octet_length(t) + 1).cast("long").alias("size"),
                       F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("hash_of_text"))
    out = assign(made, F.col("size"), F.col("hash_of_text"), F.col("doc_id"), n_shards)
    return out.select(*[F.col("doc").getField(c).alias(c) for c in names], "size", "text_crc32", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; slots in order inside each file."""
    (sharded.repartition("shard", F.floor(F.col("slot") / RANGE_ROWS))
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
