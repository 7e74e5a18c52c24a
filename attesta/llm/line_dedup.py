"""Operator 8, line dedup: winnowing over line hashes.

A window is a shortest run of lines with at least 50 words, from any line on
and up to any line.  The line with the smallest hash in a window is its
fingerprint, so two places with the same run of 50 words share a fingerprint
for certain.  Fingerprints are joined by hash; windows around a fingerprint
that occurs at two positions or more are compared by the content of all their
lines, to the left and to the right of it.  Every window whose content occurred
before is part of a later repeated run; the overlapping ones make up the
maximal runs, and these are deleted.

"Before" is by doc_id (null first), then by a hash of the row, then by line.
No pairs are made: a place is compared with the first place of its content.

Whole lines are the only unit: a repeated passage that lies inside longer lines
stays, unless its whole lines alone have 50 words.

Defined results: lines are equal when they are after trimming blanks; lines
without words are skipped, and deleted inside a run; a run that repeats itself
keeps its first window; rows equal in doc_id and text count as one document; a
null text stays null; an empty table gives no rows; further columns pass
through where ``keep`` names them, apart from the result columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attesta.llm.common import BLANKS, let, materialize, row_keys, text_of

#: Words of the shortest run that is deleted.
LEAST_WORDS = 50
TRIM = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    """Lines with words: place, two hashes, number of words."""
    trimmed = F.transform(F.split(text, "\n"), lambda x, i: F.struct(
        i.alias("pos"), F.btrim(x, F.lit(TRIM)).alias("line")))
    return F.transform(F.filter(trimmed, lambda x: x["line"] != ""), lambda x: F.struct(
        x["pos"].alias("pos"), F.xxhash64(x["line"]).alias("h1"), F.xxhash64(F.lit(17), x["line"]).alias("h2"),
        F.size(F.split(x["line"], BLANKS)).alias("n")))


def _windows(lines: DataFrame, least: int) -> DataFrame:
    """(doc_id, _k1, _k2, fp, place, c1, c2, start, end) of every window."""
    by_line = W.partitionBy("_tag").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumn("before", F.coalesce(F.sum("n").over(by_line), F.lit(0)))
    lines = lines.withColumn("upto", F.col("before") + F.col("n"))
    onward = W.partitionBy("_tag").orderBy("before").rangeBetween(0, least - 1)
    back = W.partitionBy("_tag").orderBy("upto").rangeBetween(-(least - 1), 0)

    def window(over, name):
        rows = F.collect_list(F.struct("h1", "h2", "pos", "before", "upto")).over(over)
        return rows.alias(name)

    def fields(rows: Column) -> dict[str, Column]:
        lowest = let(F.array_min(F.transform(rows, lambda x: F.struct(x["h1"].alias("h"), (-x["pos"]).alias("p")))),
                     lambda m: m)
        return {
            "fp": lowest["h"], "place": F.xxhash64("_k1", "_k2", lowest["p"]),
            "c1": F.xxhash64(F.transform(rows, lambda x: x["h1"])),
            "c2": F.xxhash64(F.lit(17), F.transform(rows, lambda x: x["h2"])),
            "start": rows[0]["pos"], "end": F.element_at(rows, -1)["pos"],
        }

    own = ["doc_id", "_k1", "_k2"]
    both = lines.select(*own, window(onward, "ahead"), window(back, "behind"))
    total = lambda r: F.element_at(r, -1)["upto"] - r[0]["before"]
    # A window that is shortest from both ends comes once, from its first line.
    shorter = lambda r: F.element_at(r, -1)["before"] - r[0]["before"]
    ahead = F.when(total(F.col("ahead")) >= least, F.col("ahead"))
    behind = F.when((total(F.col("behind")) >= least) & (shorter(F.col("behind")) >= least), F.col("behind"))
    each = both.select(*own, F.explode(F.array_compact(F.array(ahead, behind))).alias("rows"))
    return each.select(*own, *[c.alias(n) for n, c in fields(F.col("rows")).items()])


def repeated_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST_WORDS) -> DataFrame:
    """(_k1, _k2, runs): per document the disjoint later repeated runs of lines, in order."""
    t = text_of(text)
    slim = docs.select(F.col(doc_id).alias("doc_id"), *row_keys(F.col(doc_id), t), _lines(t).alias("lines"),
                       F.monotonically_increasing_id().alias("_tag"))
    lines = slim.select("doc_id", "_k1", "_k2", "_tag", F.explode("lines").alias("l"))
    windows = materialize(_windows(lines.select("doc_id", "_k1", "_k2", "_tag", "l.*"), least), "windows")

    # The join sides below are written first: as plain tables of one row per key they let
    # adaptive execution split the windows of a line or passage that very many documents have.
    # They grow with the corpus, so both sides are dealt out at every size.
    shared = materialize(windows.groupBy("fp").agg(F.min("place").alias("a"), F.max("place").alias("b"))
                         .filter("a <> b").select("fp"), "fingerprints")
    place = F.struct("doc_id", "_k1", "_k2", "start", "end")
    around = windows.join(shared.hint("merge"), "fp", "left_semi").select("c1", "c2", place.alias("at"))
    firsts = materialize(around.groupBy("c1", "c2").agg(F.min("at").alias("first"), F.max("at").alias("last"))
                         .filter("first <> last").select("c1", "c2", "first"), "firsts")
    same_doc = (F.col("at._k1") == F.col("first._k1")) & (F.col("at._k2") == F.col("first._k2"))
    later = (around.join(firsts.hint("merge"), ["c1", "c2"], "inner")
             .filter(~same_doc | (F.col("at.start") > F.col("first.end")))
             .select("at._k1", "at._k2", "at.start", "at.end"))

    # Overlapping or touching windows become one run.
    upto = W.partitionBy("_k1", "_k2").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    order = W.partitionBy("_k1", "_k2").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)
    later = later.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(upto) + 1, F.lit(True)).cast("int"))
    runs = (later.withColumn("run", F.sum("new").over(order)).groupBy("_k1", "_k2", "run")
            .agg(F.min("start").alias("start"), F.max("end").alias("end")))
    return runs.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))


def _without(lines: Column, runs: Column) -> Column:
    """The lines outside the runs: the stretches between one run's end and the next one's start."""
    edges = F.concat(runs, F.array(F.struct(F.size(lines).alias("start"), F.size(lines).alias("end"))))
    stretch = F.transform(edges, lambda e, j: let(
        F.coalesce(F.get(runs, j - 1)["end"], F.lit(-1)),
        lambda last: F.slice(lines, last + 2, F.greatest(F.lit(0), e["start"] - last - 1))))
    return F.flatten(stretch)


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST_WORDS,
                keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the runs cut out of the text, and ``n_lines``, ``n_deleted``, ``runs``."""
    made = ("n_lines", "n_deleted", "runs", "_k1", "_k2")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    runs = repeated_runs(docs, text, doc_id, least)
    keyed = docs.select(*keep, *row_keys(F.col(doc_id), text_of(text)))
    out = keyed.join(runs, ["_k1", "_k2"], "left")
    cut = let(F.split(F.col(text), "\n"), lambda x: F.struct(
        F.size(x).alias("n"), F.array_join(_without(x, F.col("runs")), "\n").alias("text")))
    out = out.withColumn("_cut", F.when(F.col("runs").isNotNull(), cut))
    n_lines = F.when(F.col("runs").isNotNull(), F.col("_cut.n")).otherwise(F.size(F.split(text_of(text), "\n")))
    n_deleted = F.aggregate("runs", F.lit(0), lambda a, r: a + r["end"] - r["start"] + 1)
    label = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["start"], r["end"] + 1)), ",")
    return out.select(
        *[F.when(F.col("runs").isNotNull(), F.col("_cut.text")).otherwise(F.col(c)).alias(c) if c == text else c for c in keep],
        n_lines.cast("long").alias("n_lines"), F.coalesce(n_deleted, F.lit(0)).cast("long").alias("n_deleted"),
        F.coalesce(label, F.lit("")).alias("runs"))
