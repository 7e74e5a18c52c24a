"""The unresolved-parent gate over observations and their claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta import vocab as V
from attesta.functions import text as tx
from attesta.operators import aliases as al

OBS_KEY = ["child_slug", "parent_slug", "source_url"]


def _known(obs: DataFrame, strains: DataFrame, column: str) -> DataFrame:
    """The spellings of ``obs`` that are on file, once each."""
    spelled = al.alias_map(strains).select(F.col("alias").alias(column))
    return al.of_keys(obs, spelled, column, "known").distinct()


def split_by_known_parent(obs: DataFrame, strains: DataFrame, column: str = "parent_slug"
                          ) -> tuple[DataFrame, DataFrame]:
    """``(known, unknown)`` rows by whether the parent spelling is on file."""
    names = _known(obs, strains, column)
    return obs.join(names, column, "left_semi"), obs.join(names, column, "left_anti")


def mark_known(obs: DataFrame, strains: DataFrame, column: str = "parent_slug",
               into: str = "parent_known") -> DataFrame:
    names = _known(obs, strains, column).withColumn(into, F.lit(True))
    return obs.join(names, column, "left").withColumn(into, F.coalesce(into, F.lit(False)))


def run_gate(obs: DataFrame, strains: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """Hold fresh rows with unknown parents, then release rows whose parent is known.

    ``fresh`` lists the keys just written.  Rows a person quarantined (no
    reason) or approved are never touched.
    """
    marked = mark_known(obs, strains)
    held = F.col("quarantined") & (tx.text_of("quarantine_reason") == V.GATE_UNRESOLVED)
    release = held & F.col("parent_known")
    if fresh is None:
        gate = F.lit(False)
    else:
        keys = fresh.select(*OBS_KEY).distinct().withColumn("__fresh", F.lit(True))
        marked = marked.join(keys, OBS_KEY, "left")
        gate = (F.coalesce("__fresh", F.lit(False)) & ~F.col("parent_known") & ~F.col("quarantined")
                & (tx.text_of("quarantine_reason") != V.GATE_APPROVED))
    # One flag decides both columns, so neither reads the other's new value.
    decided = marked.withColumn("__move", F.when(release, "out").when(gate, "in"))
    move = F.col("__move")
    return decided.withColumns({
        "quarantined": F.when(move == "out", False).when(move == "in", True)
        .otherwise(F.col("quarantined")),
        "quarantine_reason": F.when(move == "in", V.GATE_UNRESOLVED)
        .when(move == "out", F.lit(None)).otherwise(F.col("quarantine_reason")),
    }).select(*obs.columns)


def sync_claims(claims: DataFrame, obs: DataFrame) -> DataFrame:
    """Keep LINEAGE claims in step with their observations' gate.

    Hidden while any observation of the same (child, url) is gated, shown again
    once none is quarantined; human quarantines stay.
    """
    state = (obs.filter("quarantined").groupBy("child_slug", "source_url")
             .agg(F.max(tx.text_of("quarantine_reason") == V.GATE_UNRESOLVED).alias("__gated"))
             .withColumn("__held", F.lit(True)))
    joined = claims.join(state, ["child_slug", "source_url"], "left")
    hide = (F.col("type") == "LINEAGE") & ~F.col("quarantined") & F.coalesce("__gated", F.lit(False))
    show = (F.col("quarantined") & (tx.text_of("quarantine_reason") == V.GATE_UNRESOLVED)
            & F.col("__held").isNull())
    decided = joined.withColumn("__move", F.when(hide, "in").when(show, "out"))
    move = F.col("__move")
    return decided.withColumns({
        "quarantined": F.when(move == "in", True).when(move == "out", False)
        .otherwise(F.col("quarantined")),
        "quarantine_reason": F.when(move == "in", V.GATE_UNRESOLVED)
        .when(move == "out", F.lit(None)).otherwise(F.col("quarantine_reason")),
    }).select(*claims.columns)


def pending(obs: DataFrame) -> DataFrame:
    """Observations waiting in the review queue."""
    return obs.filter(F.col("quarantined") & (F.col("quarantine_reason") == V.GATE_UNRESOLVED))


def pending_parents(obs: DataFrame, limit: int = 200) -> DataFrame:
    """The newest ``limit`` waiting observations grouped by parent.

    The window of rows is the feature (1..500); ``total_observations`` and
    ``total_parents`` count the whole queue.
    """
    limit = max(1, min(int(limit), 500))
    waiting = pending(obs)
    total = waiting.agg(F.count(F.lit(1))).scalar()
    parents = waiting.select("parent_slug").distinct().agg(F.count(F.lit(1))).scalar()
    order = [F.desc("observed_at"), F.col("parent_slug"), F.col("child_slug"), F.col("source_url")]
    window = waiting.orderBy(*order).limit(limit)
    item = F.struct((-F.col("observed_at")).alias("age"), "child_slug", "source_url", "source_title",
                    "engine", "excerpt", "confidence", "observed_at")
    grouped = window.groupBy("parent_slug").agg(
        F.count(F.lit(1)).alias("observation_count"), F.max("observed_at").alias("newest"),
        F.array_sort(F.collect_list(item)).alias("children"))
    return (grouped.withColumns({"total_observations": total, "total_parents": parents,
                                 "parent_name": tx.slug_title("parent_slug")})
            .orderBy(F.desc("newest"), "parent_slug"))
