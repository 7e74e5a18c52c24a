"""Human curation as folds over event tables.

Every function takes current tables and an event table with ``seq`` (order)
and ``at`` (epoch seconds), and returns new tables plus an ``errors`` table of
refused events.  Nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta import schemas as S
from attesta import vocab as V
from attesta.functions import text as tx
from attesta.operators import aliases as al
from attesta.operators import evidence as ev
from attesta.operators import gate as gt
from attesta.session import materialize


def _latest(events: DataFrame, key: list[str]) -> DataFrame:
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("e")).select(*key, "e.*")


def machine_tier(edges: DataFrame) -> DataFrame:
    """Tier the evidence alone gives each child with edges."""
    return (edges.groupBy(F.col("child_slug").alias("slug")).agg(
        F.max(F.col("agreement") == V.AGREE_DISPUTED).alias("d"),
        F.max(F.col("agreement") == V.AGREE_MULTI).alias("m"))
        .select("slug", F.when(F.col("d"), V.TIER_CONTRADICTED).when(F.col("m"), V.TIER_CONSENSUS)
                .otherwise(V.TIER_ANECDOTAL).alias("machine_tier")))


def apply_reviews(strains: DataFrame, edges: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tier verdicts ``(slug, tier, note, at, seq)``; a NULL tier clears the review.

    CONTRADICTED is a data verdict nobody may assign.
    """
    ev = events.withColumns({"slug": tx.slug("slug"), "tier": F.upper(tx.strip("tier"))})
    known = strains.select("slug", F.lit(True).alias("known"))
    checked = ev.join(al.entity_side(known), "slug", "left").withColumn(
        "error", F.when(F.col("known").isNull(), "unknown entity")
        .when(F.col("tier").isNotNull() & ~F.col("tier").isin(*V.CURATABLE_TIERS), "tier not assignable"))
    final = _latest(checked.filter(F.col("error").isNull()).select("slug", "tier", "note", "at", "seq"),
                    ["slug"]).select("slug", F.struct("tier", "note", "at").alias("rv"))
    joined = strains.join(final, "slug", "left").join(machine_tier(edges), "slug", "left")
    rv, tier = F.col("rv"), F.col("rv.tier")
    set_, clear = rv.isNotNull() & tier.isNotNull(), rv.isNotNull() & tier.isNull()
    flagged = joined.withColumn("__do", F.when(set_, "set").when(clear, "clear"))
    do = F.col("__do")

    def pick(on_set, on_clear, keep):
        return F.when(do == "set", on_set).when(do == "clear", on_clear).otherwise(F.col(keep))

    out = flagged.withColumns({
        "curated_tier": pick(tier, F.lit(None), "curated_tier"),
        "curated_note": pick(F.nullif(tx.strip(tx.text_of("rv.note")), F.lit("")), F.lit(None), "curated_note"),
        "curated_at": pick(F.col("rv.at"), F.lit(None), "curated_at"),
        "origin": pick(F.lit("curated"), F.lit("researched"), "origin"),
        "trust_tier": pick(tier, F.coalesce("machine_tier", F.lit(V.TIER_ANECDOTAL)), "trust_tier"),
    }).select(*strains.columns)
    return out, checked.filter(F.col("error").isNotNull()).drop("known")


def apply_quarantines(obs: DataFrame, claims: DataFrame, strains: DataFrame, events: DataFrame
                      ) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Quarantine or restore observations ``(child_slug, parent_slug, source_url, quarantined, at, seq)``.

    LINEAGE claims of the same (child, url) follow.  A restore stamps the human
    approval and brings a parent nobody knows into being.
    Returns ``(observations, claims, strains, errors)``.
    """
    ev = events.withColumns({"child_slug": tx.slug("child_slug"), "parent_slug": tx.slug("parent_slug")})
    keys = obs.select(*gt.OBS_KEY).withColumn("__on_file", F.lit(True))
    checked = ev.join(keys, gt.OBS_KEY, "left")
    sound = checked.filter("__on_file").drop("__on_file")
    errors = checked.filter(F.col("__on_file").isNull()).drop("__on_file") \
        .withColumn("error", F.lit("no such observation"))

    def decide(df: DataFrame, verdicts: DataFrame, key: list[str], applies) -> DataFrame:
        verdict = verdicts.select(*key, F.col("quarantined").alias("__q"))
        hit = df.join(verdict, key, "left").withColumn(
            "__set", F.col("__q").isNotNull() & applies)
        return hit.withColumns({
            "quarantine_reason": F.when(F.col("__set"), F.when(~F.col("__q"), V.GATE_APPROVED))
            .otherwise(F.col("quarantine_reason")),
            "quarantined": F.when(F.col("__set"), F.col("__q")).otherwise(F.col("quarantined")),
        }).select(*df.columns)

    by_key = sound.groupBy(*gt.OBS_KEY).agg(F.max_by("quarantined", "seq").alias("quarantined"))
    new_obs = decide(obs, by_key, gt.OBS_KEY, F.lit(True))
    per_url = ["child_slug", "source_url"]
    by_url = sound.groupBy(*per_url).agg(F.max_by("quarantined", "seq").alias("quarantined"))
    new_claims = decide(claims, by_url, per_url, F.col("type") == "LINEAGE")
    approved = (sound.filter(~F.col("quarantined")).groupBy(F.col("parent_slug").alias("slug"))
                .agg(F.min("at").alias("at")))
    return new_obs, new_claims, materialize_entities(strains, approved), errors


def materialize_entities(strains: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add ``resolved`` entities for ``wanted(slug, at[, name])`` not on file yet."""
    name = tx.slug_title("slug")
    if "name" in wanted.columns:
        name = F.coalesce(F.nullif(tx.strip(tx.text_of("name")), F.lit("")), name)
    fresh = (wanted.withColumn("__name", name)
             .join(al.entity_side(al.alias_map(strains).select(F.col("alias").alias("slug"))), "slug", "left_anti"))
    rows = fresh.select("slug", F.col("__name").alias("name"), F.lit("resolved").alias("origin"),
                        F.col("at").alias("first_seen"), F.col("at").alias("last_researched"))
    defaults = S.conform(rows, S.STRAINS)
    return strains.unionByName(defaults.select(*strains.columns))


def remaining_evidence(obs: DataFrame, edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Live observations and aggregate left on edges ``(child_slug, parent_slug)``."""
    key = ["child_slug", "parent_slug"]
    left = (obs.filter(~F.col("quarantined")).join(keys.select(*key).distinct(), key, "left_semi")
            .groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
    return (keys.select(*key).distinct().join(left, key, "left")
            .join(edges.select(*key, "agreement", "source_count", "domain_count"), key, "left")
            .select(*key, F.coalesce("n", F.lit(0)).alias("remaining_observations"), "agreement",
                    F.coalesce("source_count", F.lit(0)).alias("source_count"),
                    F.coalesce("domain_count", F.lit(0)).alias("domain_count")))


# --- aliases ----------------------------------------------------------------

# What happens to the owner of an alias is a function of the owner before: what nobody's alias becomes,
# and what the alias of each of a few named owners becomes (any other stays).
_MOVE = "struct<none:string,named:map<string,string>>"
#: Events of a chunk are 2**CHUNK_BITS at most; the partitions of the ordered events hold its next level.
CHUNK_BITS, PARTITION_BITS = 10, 33


def _after(move: Column, owner: Column) -> Column:
    named = move["named"]
    return F.when(owner.isNull(), move["none"]).when(
        F.map_contains_key(named, owner), F.element_at(named, owner)).otherwise(owner)


def _compose(moves: Column) -> Column:
    """One move that does what all do in turn."""
    def then(done: Column, move: Column) -> Column:
        new = F.map_filter(move["named"], lambda k, _: ~F.map_contains_key(done["named"], k))
        return F.struct(_after(move, done["none"]).alias("none"),
                        F.map_concat(F.transform_values(done["named"], lambda _, v: _after(move, v)), new).alias("named"))

    nothing = F.struct(F.lit(None).cast("string").alias("none"), F.create_map().cast("map<string,string>").alias("named"))
    return F.aggregate(moves, nothing.cast(_MOVE), then)


def _owners_before(items: Column, owner: Column) -> Column:
    """``(at, owner)`` before each item's move, the first one's owner being given."""
    start = F.struct(owner.alias("now"), F.array().cast("array<struct<at:bigint,owner:string>>").alias("seen"))
    return F.aggregate(items, start, lambda s, x: F.struct(
        _after(x["move"], s["now"]).alias("now"),
        F.concat(s["seen"], F.array(F.struct(x["at"].alias("at"), s["now"].alias("owner")))).alias("seen")))["seen"]


def _in_order() -> Column:
    """Gathered ``(at, move)`` by place (moves hold maps, which have no order)."""
    by_place = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    return F.array_sort(F.collect_list(F.struct("at", "move")), by_place)


def _level(moves: DataFrame, group: Column, label: str) -> DataFrame:
    """``(alias, at, items, move)``: consecutive moves of an alias gathered by a coarser place."""
    made = moves.groupBy("alias", group.alias("up")).agg(_in_order().alias("items"))
    return materialize(made.select("alias", F.col("up").alias("at"), "items", _compose(F.col("items.move")).alias("move")), label)


def fold_alias_events(strains: DataFrame, events: DataFrame) -> DataFrame:
    """Outcome of every alias event ``(slug, alias, op, seq)``, op add or remove.

    Ownership of an alias is a serial history, yet no task walks one.  Events
    are ordered by range partitions, which cut a popular alias where needed;
    each event is a move from owner to owner, moves of a chunk compose to one,
    chunks of a partition and partitions of an alias likewise.  The owner on
    file then goes down the levels: each place passes to its parts the owner
    that they start with.  A move names at most the owners that its events do.
    """
    pairs = al.alias_pairs(strains)
    ev = events.withColumns({"slug": tx.slug("slug"), "alias": tx.slug("alias")})
    ev = al.resolve(ev, pairs, "slug")
    owners = pairs.select("alias", F.col("slug").alias("on_record"))
    slugs = al.entity_side(strains.select("slug"))
    ready = (ev.join(slugs.select(F.col("slug").alias("alias"), F.lit(True).alias("is_slug")), "alias", "left")
             .join(slugs.select("slug", F.lit(True).alias("on_file")), "slug", "left")
             .select("alias", F.col("seq").cast("bigint").alias("seq"), "op", "slug",
                     F.when(F.col("on_file").isNull(), "unknown entity")
                     .when(F.col("alias") == F.col("slug"), "")
                     .when(F.col("op") != "add", F.when(F.col("op") != "remove", ""))
                     .when(F.col("alias") == "", "alias is required")
                     .when(F.col("is_slug"), "already an entity slug").alias("void")))
    placed = ready.repartitionByRange("alias", "seq", "op", "slug").sortWithinPartitions("alias", "seq", "op", "slug")
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()), "alias-events")

    # An event that is void, an error or not, moves nothing.
    none, named = F.lit(None).cast("string"), F.create_map().cast("map<string,string>")
    adds, removes = (F.col("void").isNull() & (F.col("op") == op) for op in ("add", "remove"))
    move = F.struct(F.when(adds, F.col("slug")).otherwise(none).alias("none"),
                    F.when(removes, F.create_map("slug", none)).otherwise(named).alias("named"))
    chunks = _level(placed.select("alias", "at", move.alias("move")), F.shiftright("at", CHUNK_BITS), "chunks")
    parts = _level(chunks.select("alias", "at", "move"), F.shiftright("at", PARTITION_BITS - CHUNK_BITS), "parts")
    tops = parts.groupBy("alias").agg(_in_order().alias("items"))

    def pass_down(level: DataFrame) -> DataFrame:
        told = level.select("alias", F.explode(_owners_before(F.col("items"), F.col("owner"))).alias("b"))
        return told.select("alias", F.col("b.at").alias("at"), F.col("b.owner").alias("owner"))

    at_parts = pass_down(tops.join(owners, "alias", "left").withColumnRenamed("on_record", "owner"))
    at_chunks = pass_down(parts.join(at_parts, ["alias", "at"]))
    before = pass_down(chunks.join(at_chunks, ["alias", "at"])).withColumnRenamed("owner", "was")
    taken = adds & F.col("was").isNotNull() & (F.col("was") != F.col("slug"))
    return placed.join(before, ["alias", "at"]).select(
        "alias", "seq", "op", "slug", _after(move, F.col("was")).alias("owner"),
        F.when(taken, "already an alias of another entity").otherwise(F.nullif("void", F.lit(""))).alias("error"))


def apply_alias_events(strains: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with their aliases after the events, and the refused events."""
    folded = fold_alias_events(strains, events)
    final = (folded.filter("alias <> ''").groupBy("alias")
             .agg(F.max_by(F.struct("owner"), "seq").alias("o"))
             .select("alias", F.col("o.owner").alias("slug")))
    standing = strains.select(F.explode(tx.alias_slugs("aliases")).alias("alias"), "slug")
    kept = standing.join(final.select("alias"), "alias", "left_anti")
    now = kept.unionByName(final.filter(F.col("slug").isNotNull())).groupBy("slug").agg(
        F.array_sort(F.collect_set("alias")).alias("__aliases"))
    out = strains.join(now, "slug", "left").withColumn(
        "aliases", F.coalesce("__aliases", F.array().cast("array<string>"))).select(*strains.columns)
    return out, folded.filter(F.col("error").isNotNull())


def alias_update(tables: dict[str, DataFrame], events: DataFrame) -> dict[str, DataFrame]:
    """Alias events with what follows from them.

    Observations that waited under a name that is now an alias are released,
    their claims shown again, and edges and tiers derived anew.
    """
    strains, refused = apply_alias_events(tables["strains"], events)
    obs = gt.run_gate(tables["lineage_sources"], strains)
    edges, derived = ev.recompute(obs, strains)
    return {"strains": derived, "lineage_sources": obs, "lineage_edges": edges,
            "claims": gt.sync_claims(tables["claims"], obs), "errors": refused}


# --- pending parents --------------------------------------------------------

def resolve_parents(obs: DataFrame, claims: DataFrame, strains: DataFrame, events: DataFrame
                    ) -> dict[str, DataFrame]:
    """Approve gated parents ``(parent_slug, name, alias_of, at, seq)``.

    Creates the entity, or attaches the name as an alias of an existing one,
    and releases the parent's gated rows.  The first sound event of a parent
    counts; later ones find nothing pending.  Plain human quarantines stay.
    """
    pairs = al.alias_pairs(strains)
    waiting = gt.pending(obs).groupBy("parent_slug").agg(F.count(F.lit(1)).alias("waiting"))
    ev = events.withColumns({"parent_slug": tx.slug("parent_slug"), "alias_of": tx.slug("alias_of")})
    slugs = al.entity_side(strains.select("slug"))
    checked = (ev.join(waiting, "parent_slug", "left")
               .join(slugs.select(F.col("slug").alias("alias_of"), F.lit(True).alias("target")), "alias_of", "left")
               .join(slugs.select(F.col("slug").alias("parent_slug"), F.lit(True).alias("is_slug")), "parent_slug", "left")
               .join(pairs.select(F.col("alias").alias("parent_slug"), F.col("slug").alias("owner")), "parent_slug", "left"))
    to_alias = F.col("alias_of") != ""
    same = F.col("alias_of") == F.col("parent_slug")
    checked = checked.withColumn("error", F.when(F.col("waiting").isNull(), "nothing pending")
                                 .when(to_alias & F.col("target").isNull(), "alias target unknown")
                                 .when(to_alias & ~same & F.col("is_slug"), "already an entity slug")
                                 .when(to_alias & (F.col("owner") != F.col("alias_of")),
                                       "already an alias of another entity"))
    sound = checked.filter(F.col("error").isNull())
    rest = [c for c in sound.columns if c != "parent_slug"]
    taken = (sound.groupBy("parent_slug").agg(F.min_by(F.struct(*rest), "seq").alias("e"))
             .select("parent_slug", "e.*"))
    late = (sound.join(taken.select("parent_slug", F.col("seq").alias("won")), "parent_slug")
            .filter(F.col("seq") > F.col("won")).drop("won").withColumn("error", F.lit("nothing pending")))

    created = materialize_entities(
        strains, taken.filter("alias_of = ''").select(F.col("parent_slug").alias("slug"), "name", "at"))
    added = taken.filter((F.col("alias_of") != "") & (F.col("alias_of") != F.col("parent_slug"))).groupBy(
        F.col("alias_of").alias("slug")).agg(F.collect_set("parent_slug").alias("__more"))
    new_strains = created.join(added, "slug", "left").withColumn("aliases", F.array_sort(F.array_union(
        tx.alias_slugs("aliases"), F.coalesce("__more", F.array().cast("array<string>"))))
    ).select(*strains.columns)

    freed = obs.join(taken.select("parent_slug", F.lit(True).alias("__free")), "parent_slug", "left")
    out = F.coalesce("__free", F.lit(False)) & F.col("quarantined") & (
        tx.text_of("quarantine_reason") == V.GATE_UNRESOLVED)
    freed = freed.withColumn("__out", out).withColumns({
        "quarantined": F.when(F.col("__out"), False).otherwise(F.col("quarantined")),
        "quarantine_reason": F.when(~F.col("__out"), F.col("quarantine_reason"))}).select(*obs.columns)
    all_pairs = al.alias_pairs(new_strains)
    spelled = al.resolve(freed.filter(~F.col("quarantined")), all_pairs, "parent_slug")
    targets = taken.select(F.when(F.col("alias_of") != "", F.col("alias_of"))
                           .otherwise(F.col("parent_slug")).alias("parent_slug")).distinct()
    children = al.resolve(spelled.join(targets, "parent_slug", "left_semi"), all_pairs, "child_slug") \
        .select("parent_slug", "child_slug").distinct()
    return {"observations": freed, "claims": gt.sync_claims(claims, freed), "strains": new_strains,
            "resolved": taken.select("parent_slug", "alias_of", F.col("waiting").alias("resolved_observations")),
            "children": children,
            "errors": checked.filter(F.col("error").isNotNull()).unionByName(late)}
