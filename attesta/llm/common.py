"""Helpers shared by the training-data operators: words, row keys, two-level ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attesta.session import materialize

#: The blank characters of all contracts: space and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, with null as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def words_of(column: str | Column = "text") -> Column:
    """All words of a text, in order."""
    return F.array_remove(F.split(text_of(column), BLANKS), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def row_keys(*columns: Column) -> list[Column]:
    """A 128-bit key of a row's columns (two independently seeded hashes), never null."""
    return [F.xxhash64(*columns).alias("_k1"), F.xxhash64(F.lit(17), *columns).alias("_k2")]


def tagged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder with a unique ``_tag`` per row.

    The tags become fixed with the write, so that later stages that recompute a
    lost partition see the same ones; equal rows stay apart.
    """
    return materialize(df.withColumn("_tag", F.monotonically_increasing_id()), label)


def chunked(df: DataFrame, group: Sequence[str], order: Sequence[str], chunk: Column,
            sums: dict[str, str]) -> DataFrame:
    """Exact running sums inside a group that may hold any share of all rows.

    ``chunk`` is a coarse, monotone function of ``order`` inside each group.
    Only (group, chunk) windows are sorted; the chunk totals, a table of one
    row per chunk, carry the sums across.  ``sums`` maps a new column to the
    column that it adds up over all *earlier* rows of the group.
    """
    df = df.withColumn("_chunk", chunk)
    keys = list(group)
    totals = df.groupBy(*keys, "_chunk").agg(
        *[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "_chunk", *[
        F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_b_{name}") for name in sums])
    inner = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    for name, c in sums.items():
        df = df.withColumn(f"_i_{name}", F.coalesce(F.sum(c).over(inner), F.lit(0)))
    on = [df[k].eqNullSafe(totals[k]) for k in [*keys, "_chunk"]]
    joined = df.join(totals, on, "left")
    keep = [df[c] for c in df.columns if c != "_chunk" and not c.startswith("_i_")]
    return joined.select(*keep, *[(F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums])


def beside(df: DataFrame, run: Callable, made: dict[str, tuple[str, pa.DataType]], text: str = "_text") -> DataFrame:
    """``df`` without its text, and with what ``run`` makes of batches of texts.

    ``made`` names the new columns with their SQL and Arrow types.  All other
    columns stay in Arrow, so that a long next to a null is never made a float.
    """
    rest = [c for c in df.columns if c != text]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pd.DataFrame({text: b.column(b.schema.get_field_index(text)).to_pandas()})
            out = next(iter(run(iter([texts]))))
            new = [pa.array(out[name].tolist(), kind) for name, (_, kind) in made.items()]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in rest], *new], [*rest, *made])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest] + [f"{c} {sql}" for c, (sql, _) in made.items()]
    return df.mapInArrow(go, ", ".join(kinds))


LONG, LONGS, TEXT = ("long", pa.int64()), ("array<long>", pa.list_(pa.int64())), ("string", pa.string())


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others in one column ``_doc``, safe from clashing names."""
    others = [F.col(c) for c in docs.columns if c not in used] or [F.lit(None).cast("int").alias("none")]
    return docs.select(F.struct(*others).alias("_doc"), *used)


def unpacked(rows: DataFrame, columns: Sequence[str], *used: str) -> DataFrame:
    """The original columns in their order, the used ones as they are now."""
    return rows.select(*[F.col(c) if c in used else F.col("_doc").getField(c).alias(c) for c in columns])
