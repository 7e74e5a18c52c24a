"""Derivation of edges, conflicts and trust tiers from raw observations.

Nothing here ever gathers the observations of one child, edge or source in one
place.  Every step is a count, sum, minimum or maximum with map-side partial
aggregation, over keys that get coarser step by step:

    (child, parent, url) -> (child, parent, domain) -> (child, parent) -> child

so a child, parent or URL owning a third of all rows shrinks before it is
shuffled on its own key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta import vocab as V
from attesta.functions import numbers as num
from attesta.functions import text as tx
from attesta.functions import urls as ur
from attesta.operators import aliases as al
from attesta.session import materialize

EDGE_KEY = ("child_slug", "parent_slug")


# --- observations -----------------------------------------------------------

def canonical_observations(obs: DataFrame, pairs: DataFrame,
                           drop_self_loops: bool = False) -> DataFrame:
    """Observations with both ends resolved; raw spellings stay alongside."""
    df = obs.withColumns({"raw_child": F.col("child_slug"), "raw_parent": F.col("parent_slug")})
    df = al.resolve(al.resolve(df, pairs, "child_slug"), pairs, "parent_slug")
    return df.filter(F.col("child_slug") != F.col("parent_slug")) if drop_self_loops else df


def assertion_members(canon: DataFrame) -> DataFrame:
    """One row per (child, parent, url) over live observations.

    The blank URL is a legal assertion source.  ``rows`` counts the raw rows
    behind the member; ``total`` is their confidence in micro-units.
    """
    role = tx.role("role")
    return (canon.filter(~F.col("quarantined"))
            .groupBy("child_slug", "parent_slug", tx.text_of("source_url").alias("source_url"))
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.sum(num.micro("confidence")).alias("total"),
                 F.max(role == "female").alias("female"),
                 F.max(role == "male").alias("male")))


# --- conflicts --------------------------------------------------------------

def _size_classes(members: DataFrame) -> DataFrame:
    """How many assertions of each parent-set size a child has.

    A size class s needs s members, so a child with n member rows has at most
    sqrt(2n) classes: windows over this table stay small for any child.
    """
    sizes = members.groupBy("child_slug", "source_url").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("child_slug", "size").agg(F.count(F.lit(1)).alias("sets"))


def _wide(col: str) -> F.Column:
    return F.col(col).cast("decimal(19,0)")


def conflicted_children(members: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """Children with two assertions neither of which contains the other.

    For a family of sets, ``|S ∩ T| <= min(|S|, |T|)`` with equality exactly
    when one contains the other.  Summed over all ordered pairs the left side
    is ``Σ_p freq(p)²`` and the right side ``Σ_k N_k²`` (``N_k`` sets of size
    >= k), so a conflict exists iff the first sum is smaller.  Both sums come
    from plain counts: no pair of sets is ever compared.  ``freq`` may hold the
    members of each (child, parent), if they have been counted.
    """
    freq = members.groupBy(*EDGE_KEY).agg(F.count(F.lit(1)).alias("freq")) if freq is None else freq
    overlap = freq.select("child_slug", (_wide("freq") * _wide("freq")).alias("v"))
    by_size = W.partitionBy("child_slug").orderBy(F.desc("size"))
    ladder = _size_classes(members).select(
        "child_slug",
        (F.col("size") - F.lead("size", 1, 0).over(by_size)).alias("step"),
        F.sum("sets").over(by_size.rowsBetween(W.unboundedPreceding, 0)).alias("at_least"))
    ceiling = ladder.select(
        "child_slug",
        (-F.col("step") * (_wide("at_least") * _wide("at_least"))).cast("decimal(38,0)").alias("v"))
    return (overlap.select("child_slug", F.col("v").cast("decimal(38,0)").alias("v"))
            .unionByName(ceiling)
            .groupBy("child_slug").agg(F.sum("v").alias("slack"))
            .filter(F.col("slack") < 0).select("child_slug"))


def conflict_components(members: DataFrame) -> DataFrame:
    """Which conflict each assertion size of a child belongs to.

    Two different sets of one size always conflict, so a connected component
    of "neither contains the other" covers whole size classes, and components
    follow each other by size.  The border above size s holds iff every parent
    occurring in a set of size <= s occurs in all larger sets.  A parent with
    smallest set ``a`` that is missing from some set of largest size ``b``
    breaks exactly the borders in ``[a, b)``.

    Returns ``(child_slug, size, component, is_conflict)``.
    """
    key = ["child_slug", "parent_slug"]
    sizes = members.groupBy("child_slug", "source_url").agg(F.count(F.lit(1)).alias("size"))
    cells = materialize(members.join(sizes, ["child_slug", "source_url"])
                        .groupBy(*key, "size").agg(F.count(F.lit(1)).alias("present")), "cells")
    # Each set of size s has s members, so the cells of a size count its sets s times.
    down = W.partitionBy("child_slug").orderBy(F.desc("size"))
    classes = materialize(
        cells.groupBy("child_slug", "size").agg(F.sum("present").alias("n"))
        .select("child_slug", "size", F.expr("n div size").alias("sets"))
        .withColumn("rank", F.row_number().over(down)), "classes")
    cells = cells.join(classes, ["child_slug", "size"])
    ladder = W.partitionBy(*key).orderBy("rank")
    cells = cells.withColumn(
        "whole", (F.col("present") == F.col("sets")) & (F.col("rank") == F.row_number().over(ladder)))
    cells = cells.withColumn(
        "run", F.min("whole").over(ladder.rowsBetween(W.unboundedPreceding, 0)))
    spans = cells.groupBy(*key).agg(F.min("size").alias("size"),
                                    (F.count_if("run") + 1).alias("gap_rank"))
    gaps = classes.select("child_slug", F.col("rank").alias("gap_rank"),
                          F.col("size").alias("gap_size"))
    reach = (spans.join(gaps, ["child_slug", "gap_rank"], "left")
             .groupBy("child_slug", "size").agg(F.max("gap_size").alias("reach")))
    mixed = (cells.groupBy("child_slug", "size")
             .agg(F.max(F.col("present") < F.col("sets")).alias("mixed")))

    up = W.partitionBy("child_slug").orderBy("size")
    so_far = up.rowsBetween(W.unboundedPreceding, 0)
    cut = F.coalesce(F.max("reach").over(so_far), F.lit(0)) <= F.col("size")
    numbered = (classes.join(reach, ["child_slug", "size"], "left")
                .join(mixed, ["child_slug", "size"], "left")
                .withColumn("cut", cut.cast("int"))
                .withColumn("component", F.coalesce(
                    F.sum("cut").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    per_component = numbered.groupBy("child_slug", "component").agg(
        ((F.count(F.lit(1)) > 1) | F.max("mixed")).alias("is_conflict"))
    return (numbered.join(per_component, ["child_slug", "component"])
            .select("child_slug", "size", "component", "is_conflict"))


# --- edges ------------------------------------------------------------------

def derive_edges(canon: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Aggregate, agreement, role and age of every canonical edge.

    Expects ``canonical_observations`` and, if at hand, their stored
    ``assertion_members``, which are read twice.  Lists live in
    ``edge_sources`` and ``edge_domains``; this table is fixed-width however
    popular an edge is.
    """
    members = assertion_members(canon) if members is None else members
    domains = (members.withColumn("domain", ur.registrable_domain("source_url"))
               .groupBy(*EDGE_KEY, "domain")
               .agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"),
                    F.count_if(F.col("source_url") != "").alias("urls"), F.count(F.lit(1)).alias("freq"),
                    F.max("female").alias("female"), F.max("male").alias("male")))
    # Age counts every raw row of a spelling, held-back ones included, as long
    # as that spelling still has a live row.
    # The canonical slug travels only where it differs from the spelling.
    raw = {"child_slug": "raw_child", "parent_slug": "raw_parent"}
    ages = (canon.groupBy(*raw.values(), *[F.nullif(c, r).alias(c) for c, r in raw.items()])
            .agg(F.min("observed_at").alias("first_seen"),
                 F.max(~F.col("quarantined")).alias("live"))
            .filter("live").select(*[F.coalesce(c, r).alias(c) for c, r in raw.items()], "first_seen"))
    totals = (domains.unionByName(ages, allowMissingColumns=True)
              .groupBy(*EDGE_KEY)
              .agg(F.sum("urls").alias("source_count"), F.count("domain").alias("domain_count"),
                   F.sum("rows").alias("observation_count"), F.sum("total").alias("total"), F.sum("freq").alias("freq"),
                   F.coalesce(F.max("female"), F.lit(False)).alias("female"),
                   F.coalesce(F.max("male"), F.lit(False)).alias("male"),
                   F.min("first_seen").alias("first_seen")))
    # A step, as both what is in dispute and the edges themselves come from it.
    totals = materialize(totals, "totals")
    disputed = conflicted_children(members, totals.select(*EDGE_KEY, "freq")).withColumn("disputed", F.lit(True))
    agreement = (F.when(F.col("disputed"), V.AGREE_DISPUTED)
                 .when(F.col("domain_count") >= 2, V.AGREE_MULTI)
                 .otherwise(V.AGREE_SINGLE))
    role = (F.when(F.col("female") & ~F.col("male"), "female")
            .when(F.col("male") & ~F.col("female"), "male"))
    milli = num.mean_milli("total", "observation_count")
    return (totals.join(disputed, "child_slug", "left")
            .select(*EDGE_KEY, "source_count", "domain_count", "observation_count",
                    milli.alias("avg_milli"), num.from_milli(milli).alias("avg_confidence"),
                    agreement.alias("agreement"), "first_seen", role.alias("role")))


def edge_sources(members: DataFrame, cap: int = V.EDGE_SOURCE_CAP) -> DataFrame:
    """The first ``cap`` URLs of each edge in URL order.

    The rank filter is pushed below the shuffle (group limit), so at most
    ``cap`` rows per edge and task travel.
    """
    order = W.partitionBy(*EDGE_KEY).orderBy("source_url")
    return (members.filter(F.col("source_url") != "")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)
            .groupBy(*EDGE_KEY)
            .agg(F.array_sort(F.collect_list("source_url")).alias("sources")))


def edge_domains(members: DataFrame) -> DataFrame:
    """Distinct independent domains of each edge, one row each."""
    return (members.select(*EDGE_KEY, ur.registrable_domain("source_url").alias("domain"))
            .filter(F.col("domain").isNotNull()).distinct())


def pack_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with their ``sources`` and ``source_domains`` arrays.

    For the edges a reader is about to show; a domain array has one element per
    independent domain.
    """
    wanted = members.join(edges.select(*EDGE_KEY), list(EDGE_KEY), "left_semi")
    domains = edge_domains(wanted).groupBy(*EDGE_KEY).agg(
        F.array_sort(F.collect_set("domain")).alias("source_domains"))
    none = F.array().cast("array<string>")
    return (edges.join(edge_sources(wanted), list(EDGE_KEY), "left")
            .join(domains, list(EDGE_KEY), "left")
            .withColumns({"sources": F.coalesce("sources", none),
                          "source_domains": F.coalesce("source_domains", none)}))


# --- tiers ------------------------------------------------------------------

def child_tiers(edges: DataFrame, canon: DataFrame) -> DataFrame:
    """Machine tier and confidence of every child with any history.

    ``has_edges`` is false for children whose observations are all held back:
    they fall to the floor tier and keep their confidence.
    """
    votes = edges.select(
        "child_slug", (F.col("agreement") == V.AGREE_DISPUTED).alias("disputed"),
        (F.col("agreement") == V.AGREE_MULTI).alias("multi"), F.col("avg_milli").alias("milli"))
    history = canon.select("child_slug").distinct()
    per_child = (votes.unionByName(history, allowMissingColumns=True)
                 .groupBy("child_slug")
                 .agg(F.max("disputed").alias("disputed"), F.max("multi").alias("multi"),
                      F.sum("milli").alias("milli"), F.count("milli").alias("n")))
    tier = (F.when(F.col("disputed"), V.TIER_CONTRADICTED).when(F.col("multi"), V.TIER_CONSENSUS)
            .otherwise(V.TIER_ANECDOTAL))
    return per_child.select(
        "child_slug", tier.alias("machine_tier"),
        num.mean_of_milli("milli", "n").alias("machine_milli"), (F.col("n") > 0).alias("has_edges"))


def apply_tiers(strains: DataFrame, tiers: DataFrame) -> DataFrame:
    """Write machine verdicts to entities; a curated tier always stands."""
    curated = F.length(tx.text_of("curated_tier")) > 0
    joined = strains.join(tiers, F.col("slug") == F.col("child_slug"), "left")
    return joined.withColumns({
        "trust_tier": F.when(~curated & F.col("machine_tier").isNotNull(), F.col("machine_tier"))
        .otherwise(F.col("trust_tier")),
        "confidence": F.coalesce(num.from_milli("machine_milli"), F.col("confidence")),
    }).select(*strains.columns)


def recompute(obs: DataFrame, strains: DataFrame, pairs: DataFrame | None = None
              ) -> tuple[DataFrame, DataFrame]:
    """Full re-derivation: ``(edges, strains)`` from raw observations."""
    canon = canonical_observations(obs, al.alias_pairs(strains) if pairs is None else pairs)
    canon = materialize(canon, "canon")
    edges = derive_edges(canon, materialize(assertion_members(canon), "members"))
    edges = materialize(edges, "edges")
    return edges, apply_tiers(strains, child_tiers(edges, canon))
