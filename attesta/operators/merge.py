"""Merging completed research runs into the evidence tables.

A batch of runs merges in one plan and gives what merging them one after the
other would give; ``(completed_at, run_id, position)`` is the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta import schemas as S
from attesta import vocab as V
from attesta.functions import text as tx
from attesta.operators import aliases as al
from attesta.operators import evidence as ev
from attesta.operators import extract as ex
from attesta.operators import gate as gt
from attesta.operators import upserts as up
from attesta.session import materialize
from attesta.sources import runs as rn

_LAST = 1 << 62          # position of a run's subject: after all of its claims


def _names(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """Children and subjects in the order they are touched; these create entities."""
    kids = claims.select("run_id", up.order_of("completed_at", "run_id", "seq").alias("seq"),
                         F.col("child").alias("name"))
    subjects = docs.filter(tx.text_of("query") != "").select(
        "run_id", up.order_of("completed_at", "run_id", F.lit(_LAST)).alias("seq"),
        F.col("query").alias("name"))
    return kids.unionByName(subjects).withColumn("slug", tx.slug("name")).filter("slug <> ''")


def _batch_aliases(strains: DataFrame, names: DataFrame) -> DataFrame:
    """Alias pairs with the run after which they hold.

    A dictionary alias is attached when its owner exists at the start of a run
    and the alias has not become an entity of its own by then.
    """
    spark = strains.sparkSession
    standing = al.alias_pairs(strains).select("alias", F.col("slug").alias("owner"),
                                              F.lit(None).cast("bigint").alias("after_at"),
                                              F.lit(None).cast("string").alias("after_run"))
    born = names.groupBy("slug").agg(F.min("seq").alias("born"))
    table = spark.createDataFrame(sorted(V.SAFE_ALIASES.items()), "alias STRING, owner STRING")
    taken = (strains.select(F.col("slug").alias("alias"))
             .unionByName(standing.select("alias")).distinct())
    own = born.select(F.col("slug").alias("owner"), F.col("born").alias("owner_born"))
    self_born = born.select(F.col("slug").alias("alias"), F.col("born").alias("alias_born"))

    def run_of(c: str) -> F.Column:
        return F.struct(F.col(f"{c}.at"), F.col(f"{c}.run_id"))

    created = (table.join(taken, "alias", "left_anti").join(own, "owner")
               .join(al.entity_side(strains.select(F.col("slug").alias("owner"))), "owner", "left_anti")
               .join(self_born, "alias", "left")
               .filter(F.col("alias_born").isNull() | (run_of("owner_born") < run_of("alias_born")))
               .select("alias", "owner", F.col("owner_born.at").alias("after_at"),
                       F.col("owner_born.run_id").alias("after_run")))
    return standing.unionByName(created)


def _resolve(df: DataFrame, pairs: DataFrame, column: str, into: str) -> DataFrame:
    """Resolve a slug column with aliases that hold at the row's run."""
    look = pairs.select(F.col("alias").alias(column), "owner", "after_at", "after_run")
    holds = F.col("after_run").isNull() | (
        F.struct("seq.at", "seq.run_id") > F.struct(F.col("after_at").alias("at"),
                                                    F.col("after_run").alias("run_id")))
    return (df.join(look, column, "left")
            .withColumn(into, F.when(F.col("owner").isNotNull() & holds, F.col("owner"))
                        .otherwise(F.col(column)))
            .drop("owner", "after_at", "after_run"))


def merge_runs(tables: dict[str, DataFrame], docs: DataFrame, raw: DataFrame | None = None
               ) -> dict[str, DataFrame]:
    """All evidence tables after merging the run documents in ``docs``.

    ``tables``: strains, sources, lineage_sources, claims, research_runs.
    ``raw(run_id, query, title, url, snippet, source)`` lets a subject without
    any summary take a verbatim one from its own run's evidence.  The result
    also holds the re-derived ``lineage_edges`` and ``touched(run_id, slug)``,
    the entities each run created or refreshed.
    """
    strains = S.conform(al.seed_aliases(S.conform(tables["strains"], S.STRAINS)), S.STRAINS)
    strains = ex.drop_off_subject_summaries(ex.drop_lead_images(strains))
    claims = rn.lineage_claims(docs)
    names = materialize(_names(docs, claims), "names")
    pairs = materialize(_batch_aliases(strains, names), "aliases")

    visited = rn.visited_sources(docs)
    sources = up.upsert_sources(tables["sources"], visited.select(
        "url", "title", "engine", F.col("completed_at").alias("fetched_at"),
        up.order_of("completed_at", "run_id", "seq").alias("seq")))

    # One row per asserted (child, parent).
    parents = F.filter(F.concat(F.array("parent_a", "parent_b"),
                                F.coalesce("extra_parents", F.array().cast("array<string>"))),
                       lambda p: tx.text_of(p) != "")
    stated = claims.withColumn("parents", parents).withColumn(
        "seq", up.order_of("completed_at", "run_id", "seq"))
    asserted = stated.select("*", F.explode("parents").alias("parent")).withColumns(
        {"child_own": tx.slug("child"), "parent_own": tx.slug("parent")})
    resolved = _resolve(_resolve(asserted, pairs, "child_own", "child_slug"),
                        pairs, "parent_own", "parent_slug")
    resolved = materialize(resolved, "asserted")

    # Who exists when: standing entities, or created earlier in the batch.
    created = (_resolve(names.withColumn("own", F.col("slug")).drop("slug"), pairs, "own", "slug")
               .groupBy("slug").agg(F.min("seq").alias("born")))
    exists = (strains.select("slug").withColumn("born", F.lit(None).cast("struct<at:bigint,run_id:string,pos:bigint>"))
              .unionByName(created.join(al.entity_side(strains.select("slug")), "slug", "left_anti")))
    known = resolved.join(exists.select(F.col("slug").alias("parent_slug"), "born",
                                        F.lit(True).alias("on_file")), "parent_slug", "left")
    known = known.withColumn("parent_known", F.coalesce(
        F.col("on_file") & (F.col("born").isNull() | (F.col("born") <= F.col("seq"))), F.lit(False)))

    # Entity touches: children, subjects and parents already known.
    own_touch = _resolve(names.withColumnRenamed("slug", "own"), pairs, "own", "slug")
    parent_touch = known.filter("parent_known").select(
        "run_id", "seq", F.col("parent").alias("name"), F.col("parent_own").alias("own"),
        F.col("parent_slug").alias("slug"))
    touches = own_touch.select("run_id", "seq", "name", "own", "slug").unionByName(parent_touch)
    meta = rn.entity_meta(docs)
    cols = ("summary", "thc_range", "strain_type", "breeder")
    by_owner = meta.select("run_id", F.col("slug"), F.struct(*cols).alias("m_owner"))
    by_own = meta.select("run_id", F.col("slug").alias("own"), F.struct(*cols).alias("m_own"))
    touched = (touches.join(by_owner, ["run_id", "slug"], "left").join(by_own, ["run_id", "own"], "left")
               .withColumn("m", F.coalesce("m_owner", "m_own"))
               .select("slug", "seq", F.trim("name").alias("name"), "m.*",
                       F.col("seq.at").alias("first_seen"), F.col("seq.at").alias("last_researched")))
    # The stored spelling stays; only a new entity takes the observed name.
    stored = strains.select("slug", F.col("name").alias("stored"))
    opening = touched.groupBy("slug").agg(F.min_by("name", "seq").alias("opening"))
    touched = (touched.join(al.entity_side(stored), "slug", "left").join(opening, "slug")
               .withColumn("name", F.coalesce("stored", "opening")).drop("stored", "opening"))
    entities = up.upsert_strains(strains, touched)
    attach = pairs.filter(F.col("after_run").isNotNull()).groupBy(F.col("owner").alias("slug")).agg(
        F.collect_set("alias").alias("__more"))
    entities = entities.join(attach, "slug", "left").withColumn("aliases", F.array_sort(F.array_union(
        tx.alias_slugs("aliases"), F.coalesce("__more", F.array().cast("array<string>"))))).drop("__more")
    if raw is not None:
        entities = fill_summaries(entities, touched, docs, raw)
    entities = materialize(S.conform(entities, S.STRAINS), "strains")

    role = F.coalesce(F.element_at("parent_roles", F.col("parent")),
                      F.element_at("parent_roles", F.col("parent_own")))
    written = known.select(
        "child_slug", "parent_slug", "source_url", "source_title", F.col("source_engine").alias("engine"),
        "confidence", F.col("snippet_excerpt").alias("excerpt"), F.col("seq.at").alias("observed_at"),
        role.alias("role"), F.lit(False).alias("quarantined"), "seq")
    observations = up.upsert_observations(tables["lineage_sources"], written)
    fresh = known.filter(~F.col("parent_known")).select(
        "child_slug", F.col("parent_own").alias("parent_slug"), "source_url")
    observations = materialize(gt.run_gate(observations, entities, fresh), "observations")

    said = stated.filter(F.size("parents") > 0).select(
        tx.slug("child").alias("child_slug"), F.lit("LINEAGE").alias("type"),
        tx.assertion_text("child", "parents").alias("value"),
        F.lit(V.TIER_ANECDOTAL).alias("trust_tier"), "confidence", "source_url",
        F.col("snippet_excerpt").alias("excerpt"), F.col("seq.at").alias("created_at"),
        F.lit(False).alias("quarantined"), "seq")
    all_claims = gt.sync_claims(up.insert_claims(tables["claims"], said), observations)

    runs = up.upsert_runs(tables["research_runs"], rn.run_rows(docs).withColumn(
        "seq", up.order_of("completed_at", "id", F.lit(0))))
    edges, entities = ev.recompute(observations, entities)
    return {"strains": entities, "sources": sources, "lineage_sources": observations,
            "claims": all_claims, "research_runs": runs, "lineage_edges": edges,
            "touched": touches.select("run_id", "slug").distinct()}


def fill_summaries(entities: DataFrame, touched: DataFrame, docs: DataFrame, raw: DataFrame) -> DataFrame:
    """Fill blank summaries of run subjects with mined, attributed ones.

    A text that was there before the run always wins; the subject is looked up
    under its own slug, never through an alias.
    """
    subject = docs.select("run_id", F.col("query").alias("__query"), tx.slug("query").alias("slug"),
                          up.order_of("completed_at", "run_id", F.lit(_LAST)).alias("seq"))
    mined = ex.best_summaries(raw.drop("query").join(
        docs.select("run_id", "query"), "run_id")).join(subject, "run_id")
    first = mined.groupBy("slug").agg(F.min_by(F.struct(
        "summary", "summary_source_url", "summary_source_title", "seq"), "seq").alias("mined"))
    told = (touched.filter(F.col("summary").isNotNull()).groupBy("slug")
            .agg(F.min("seq").alias("told_at")))
    joined = entities.join(first, "slug", "left").join(told, "slug", "left")
    blank = tx.text_of("summary") == ""
    mined_first = F.col("told_at").isNotNull() & (F.col("mined.seq") < F.col("told_at")) \
        & F.col("summary_source_url").isNull()
    use = F.col("mined").isNotNull() & (blank | mined_first)
    cols = ("summary", "summary_source_url", "summary_source_title")
    flagged = joined.withColumn("__use", use)
    return flagged.withColumns({
        c: F.when(F.col("__use"), F.col(f"mined.{c}")).otherwise(F.col(c)) for c in cols
    }).drop("mined", "told_at", "__use")


def merge_counts(before: dict[str, DataFrame], after: dict[str, DataFrame], docs: DataFrame) -> DataFrame:
    """Per batch: entities touched, edges stated, claims added, sources visited."""
    claims = rn.lineage_claims(docs)
    edges = claims.select(F.size(F.filter(F.concat(
        F.array("parent_a", "parent_b"), F.coalesce("extra_parents", F.array().cast("array<string>"))),
        lambda p: tx.text_of(p) != "")).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("v"))
    touched = after["touched"].agg(F.count(F.lit(1)).alias("v"))
    added = after["claims"].join(before["claims"].select("child_slug", "value", "source_url"),
                                 ["child_slug", "value", "source_url"], "left_anti") \
        .agg(F.count(F.lit(1)).alias("v"))
    seen = rn.visited_sources(docs).agg(F.count(F.lit(1)).alias("v"))
    parts = {"strains": touched, "edges": edges, "claims": added, "sources": seen}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("counter"), F.col("v").cast("bigint").alias("value"))
        out = df if out is None else out.unionByName(df)
    return out
