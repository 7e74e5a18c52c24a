"""Run-scoped claim derivations: consensus, disagreement, tiers, run graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta import vocab as V
from attesta.functions import numbers as num
from attesta.functions import text as tx
from attesta.functions import urls as ur
from attesta.operators import evidence as ev

# Input: one row per claim with run_id, seq, child, parent_a, parent_b,
# extra_parents, source_url, source_title, source_engine, confidence.


def claim_parents(claim: str = "") -> F.Column:
    """All non-blank parents of a claim, in order."""
    extra = F.coalesce(F.col("extra_parents"), F.array().cast("array<string>"))
    return F.filter(F.concat(F.array("parent_a", "parent_b"), extra),
                    lambda p: F.coalesce(p, F.lit("")) != "")


def run_consensus(claims: DataFrame) -> DataFrame:
    """Support of each ordered parent pair of a run, whoever the child is.

    ``sources`` counts every citation, ``domains`` only independent ones.
    """
    key = ["run_id", "parent_a", "parent_b"]
    per_domain = (claims.withColumn("domain", ur.registrable_domain("source_url"))
                  .groupBy(*key, "domain")
                  .agg(F.count(F.lit(1)).alias("n"), F.sum(num.micro("confidence")).alias("total")))
    return (per_domain.groupBy(*key)
            .agg(F.sum("n").alias("sources"), F.count("domain").alias("domains"),
                 num.from_milli(num.mean_milli(F.sum("total"), F.sum("n"))).alias("avg_confidence")))


def consensus_sources(claims: DataFrame) -> DataFrame:
    """Every citation behind ``run_consensus``, one row each."""
    return claims.select("run_id", "parent_a", "parent_b", "seq", F.col("source_url").alias("url"),
                         F.col("source_title").alias("title"), F.col("source_engine").alias("engine"))


def _fold(c: str) -> F.Column:
    return F.lower(tx.strip(tx.text_of(c)))


def tuple_domains(claims: DataFrame) -> DataFrame:
    """Independent domains per (child, parent_a, parent_b), case-folded."""
    keyed = claims.select("run_id", _fold("child").alias("child_key"), _fold("parent_a").alias("a_key"),
                          _fold("parent_b").alias("b_key"),
                          ur.registrable_domain("source_url").alias("domain"))
    return (keyed.filter(F.col("domain").isNotNull()).distinct()
            .groupBy("run_id", "child_key", "a_key", "b_key")
            .agg(F.count(F.lit(1)).alias("domains")))


def _run_members(claims: DataFrame) -> DataFrame:
    """(run, child, claim, parent) rows in the shape the conflict test reads."""
    return (claims.select(
        F.concat_ws("\u0001", "run_id", F.lower("child")).alias("child_slug"), "run_id",
        F.lower("child").alias("child_key"),
        F.col("seq").cast("string").alias("source_url"),
        F.explode(F.array_distinct(claim_parents())).alias("parent_slug")))


def disputed_children(claims: DataFrame) -> DataFrame:
    """Children with incomparable parent sets inside one run."""
    members = _run_members(claims)
    hit = ev.conflicted_children(members)
    parts = F.split("child_slug", "\u0001")
    return hit.select(parts[0].alias("run_id"), parts[1].alias("child_key"))


def run_disagreements(claims: DataFrame) -> DataFrame:
    """One row per asserted parent set of every disputed child.

    ``sources`` counts distinct non-blank URLs; ``summary`` is the sentence
    shown for the child.
    """
    sets = claims.select(
        "run_id", F.lower("child").alias("child_key"),
        F.array_sort(F.array_distinct(claim_parents())).alias("parents"), "source_url")
    sets = sets.filter(F.size("parents") > 0)
    per_set = (sets.select("run_id", "child_key", "parents",
                           F.nullif(tx.text_of("source_url"), F.lit("")).alias("url")).distinct()
               .groupBy("run_id", "child_key", "parents").agg(F.count("url").alias("sources")))
    per_set = per_set.join(disputed_children(claims), ["run_id", "child_key"], "left_semi")
    totals = per_set.groupBy("run_id", "child_key").agg(F.count(F.lit(1)).alias("tuples"))
    return (per_set.join(totals, ["run_id", "child_key"])
            .select("run_id", F.col("child_key").alias("child"), "parents", "sources",
                    F.concat("child_key", F.lit(" has "), F.col("tuples").cast("string"),
                             F.lit(" conflicting parent-strain assertions")).alias("summary")))


def stamp_tiers(claims: DataFrame) -> DataFrame:
    """Claims with their claim-time tier."""
    disputed = (disputed_children(claims).withColumn("child_key", F.trim("child_key")).distinct()
                .withColumn("disputed", F.lit(True)))
    keyed = claims.withColumns({"child_key": _fold("child"), "a_key": _fold("parent_a"),
                                "b_key": _fold("parent_b")})
    return (keyed.join(tuple_domains(claims), ["run_id", "child_key", "a_key", "b_key"], "left")
            .join(disputed, ["run_id", "child_key"], "left")
            .withColumn("tier", tx.claim_tier("disputed", F.coalesce("domains", F.lit(0))))
            .drop("child_key", "a_key", "b_key", "domains", "disputed"))


def run_graph(claims: DataFrame, subjects: DataFrame, meta: DataFrame | None = None
              ) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each run's own lineage graph.

    ``subjects(run_id, query)``, ``meta(run_id, slug, summary)``.  Claims group
    by child and ordered parent tuple; if two groups meet on one edge, the one
    that started later decides it.
    """
    grouped = (claims.withColumn("parents", claim_parents()).filter(F.size("parents") > 0)
               .withColumn("child_key", F.lower("child")))
    key = ["run_id", "child_key", "parents"]
    per_url = (grouped.groupBy(*key, tx.text_of("source_url").alias("url"))
               .agg(F.count(F.lit(1)).alias("n"), F.sum(num.micro("confidence")).alias("total"),
                    F.min("seq").alias("seq")))
    tops = W.partitionBy(*key).orderBy("url")
    shown = (per_url.filter(F.col("url") != "").select(*key, "url")
             .withColumn("r", F.row_number().over(tops))
             .filter(F.col("r") <= V.RUN_EDGE_SOURCE_CAP)
             .groupBy(*key).agg(F.array_sort(F.collect_list("url")).alias("sources")))
    per_domain = (per_url.withColumn("domain", ur.registrable_domain("url"))
                  .groupBy(*key, "domain")
                  .agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("seq").alias("seq"),
                       F.count_if(F.col("url") != "").alias("urls")))
    stats = per_domain.groupBy(*key).agg(
        F.sum("urls").alias("source_count"), F.count("domain").alias("domains"),
        num.from_milli(num.mean_milli(F.sum("total"), F.sum("n"))).alias("avg_confidence"),
        F.min("seq").alias("group_order"))
    disputed = disputed_children(claims).withColumn("disputed", F.lit(True))
    agreement = (F.when(F.col("disputed"), V.AGREE_DISPUTED)
                 .when(F.col("domains") >= 2, V.AGREE_MULTI).otherwise(V.AGREE_SINGLE))
    groups = (stats.join(disputed, ["run_id", "child_key"], "left").join(shown, key, "left")
              .withColumn("agreement", agreement))
    per_parent = groups.select(
        "*", tx.slug("child_key").alias("source"), F.posexplode("parents").alias("pos", "parent"))
    payload = F.struct(
        "agreement", tx.edge_color("agreement").alias("color"), "source_count",
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "avg_confidence",
        F.filter("parents", lambda p: p != F.col("parent")).alias("other_parents"),
        F.when(F.col("pos") == 0, F.array_join("parents", " × ")).otherwise("").alias("label"))
    edges = (per_parent.withColumn("target", tx.slug("parent"))
             .groupBy("run_id", "source", "target")
             .agg(F.max_by(payload, F.struct("group_order", "pos")).alias("e"))
             .select("run_id", F.concat_ws("::", F.lit("e"), "source", "target").alias("id"),
                     "source", "target", "e.*"))
    named = (subjects.select("run_id", F.col("query").alias("name"), F.lit(-1).cast("bigint").alias("ord"))
             .unionByName(groups.select("run_id", F.col("child_key").alias("name"),
                                        F.col("group_order").cast("bigint").alias("ord")))
             .unionByName(per_parent.select("run_id", F.col("parent").alias("name"),
                                            F.col("group_order").cast("bigint").alias("ord"))))
    nodes = (named.withColumn("slug", tx.slug("name")).groupBy("run_id", "slug")
             .agg(F.min_by("name", F.struct("ord", "name")).alias("name"),
                  (F.min("ord") == -1).alias("is_root")))
    if meta is not None:
        nodes = nodes.join(meta.select("run_id", "slug", "summary"), ["run_id", "slug"], "left")
    return nodes, edges


def llm_spend(passes: DataFrame) -> DataFrame:
    """Spend per run over extraction passes ``(run_id, seq, model, *_tokens)``.

    A pass counts once it reported any usage, parsed or not; the last
    non-blank model names the run.
    """
    tokens = ("prompt_tokens", "completion_tokens", "total_tokens")
    used = F.coalesce(*tokens).isNotNull()
    model = F.nullif("model", F.lit(""))
    return passes.filter(used).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.max_by(model, F.when(model.isNotNull(), F.col("seq"))).alias("model"),
        *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in tokens])


def run_summaries(runs: DataFrame, visited: DataFrame, claims: DataFrame) -> DataFrame:
    """Ledger summary counts per run: sources, engines, claims, tuples, conflicts, graph size."""
    nodes, edges = run_graph(claims, runs.select("run_id", "query"))

    def n(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))

    parts = [
        visited.groupBy("run_id").agg(F.count(F.lit(1)).alias("sources_count"),
                                      F.count_distinct("engine").alias("engines")),
        n(claims, "lineage_claims_count"),
        n(run_consensus(claims), "consensus_count"),
        n(disputed_children(claims), "disagreement_count"),
        n(nodes, "node_count"), n(edges, "edge_count"),
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    counts = [c for c in stacked.columns if c != "run_id"]
    totals = stacked.groupBy("run_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in counts])
    out = runs.join(totals, "run_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def stage_details(visited: DataFrame, claims: DataFrame, sources: int = 5, links: int = 8) -> DataFrame:
    """First few sources and links of each run, as shown with its stages."""
    by_seq = W.partitionBy("run_id").orderBy("seq")
    hunted = (visited.withColumn("pos", F.row_number().over(by_seq)).filter(F.col("pos") <= sources)
              .select("run_id", F.lit("hunter").alias("stage"), "pos", F.col("url").alias("detail")))
    linked = (claims.withColumn("pos", F.row_number().over(by_seq)).filter(F.col("pos") <= links)
              .select("run_id", F.lit("connector").alias("stage"), "pos",
                      F.concat("child", F.lit(" ← "), "parent_a", F.lit(" × "),
                               tx.text_of("parent_b")).alias("detail")))
    return hunted.unionByName(linked)
