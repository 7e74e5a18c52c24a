"""Operator 5, secret scans: base patterns, and corpus-wide ownership of candidates.

Candidates are found with their positions; their hashes are counted over the
distinct repositories and owners that hold them, exact copies of a repository
under one owner counted once.  A candidate that many owners or many different
repositories hold is a copied example; one that belongs to one or two owners,
lies in few repositories and looks random is live.  Live candidates of the generic token form become spans of
their own, beside the base spans, which stay whatever their verdict.

Positions come from splitting the text at the matches: the lengths of the
pieces between them and of the matches themselves, added up.

Defined results: a null text is empty; a null owner is an owner; repeated rows
are scanned alone and count as one repository, as do all equal texts of an owner; an empty table gives no rows;
further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from attesta.llm.common import let, tagged, text_of
from attesta.session import materialize


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
#: kind -> (pattern, group of the value, least characters of the value), in order of rank.
KINDS = {
    "assign": ("(" + "|".join(_either(k) for k in KEYWORDS)
               + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "token": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")
RANK = {kind: i for i, kind in enumerate(KINDS)}
#: With more owners than this a candidate is a copied example.
MAX_OWNERS = 2
#: With more different repositories than this it is one too, even under one owner.
MAX_REPOS = 20
#: A live candidate has a letter, a digit and so many different characters.
LEAST_DISTINCT = 8


def _hits(t: Column, kind: str) -> Column:
    """All matches of a kind, in order: characters since the last match, length, value."""
    pattern, group, _ = KINDS[kind]
    parts = F.struct(F.split(t, pattern, -1).alias("gaps"),
                     F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("all"),
                     F.regexp_extract_all(t, F.lit(pattern), F.lit(group)).alias("values"))
    found = let(parts, lambda p: F.transform(p["all"], lambda m, k: F.struct(
        F.lit(RANK[kind]).alias("rank"), k.alias("k"), F.length(F.get(p["gaps"], k)).alias("gap"),
        F.length(m).alias("len"), F.get(p["values"], k).alias("value"))))
    none = F.array().cast("array<struct<rank:int,k:int,gap:int,len:int,value:string>>")
    return F.when(t.rlike(pattern), found).otherwise(none)


def looks_live(value: Column) -> Column:
    return (value.rlike("[A-Za-z]") & value.rlike("[0-9]")
            & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT))


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: _tag, owner, content, rank, start, end (exclusive), value.

    ``docs`` has ``_tag``, ``owner``, ``content`` (a digest of the text) and ``hits``.
    """
    each = docs.select("_tag", "owner", "content", F.explode("hits").alias("h")).select("_tag", "owner", "content", "h.*")
    before = W.partitionBy("_tag", "rank").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("start", F.coalesce(F.sum(F.col("gap") + F.col("len")).over(before), F.lit(0)) + F.col("gap"))
    least = F.element_at(F.array(*[F.lit(k[2]) for k in KINDS.values()]), F.col("rank") + 1)
    return each.filter(F.length("value") >= least).select(
        "_tag", "owner", "content", "rank", "start", (F.col("start") + F.col("len")).alias("end"), "value")


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate hash: owners and their different repositories, each step pre-aggregated."""
    by_repo = found.groupBy("hash", "owner", "content").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id",
         max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Per row: ``repo``, base counts, digest of the base spans, all spans, live and example counts."""
    t = text_of(text)
    hits = F.concat(*[_hits(t, kind) for kind in KINDS])
    slim = docs.select(F.col(owner).alias("owner"), F.col(repo).alias("repo"), hits.alias("hits"), t.alias("whole"))
    slim = slim.select("owner", "repo", "hits", F.when(F.size("hits") > 0, F.sha2("whole", 256)).alias("content"))
    slim = tagged(slim, "secrets")
    found = candidates(slim).withColumn("hash", F.sha2("value", 256))

    # A generic token counts where no base span overlaps it.
    base = F.col("rank") < len(BASE)
    upto = W.partitionBy("_tag").orderBy("start", "rank").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("_tag").orderBy("start", "rank").rowsBetween(0, W.unboundedFollowing)
    found = (
        found.withColumns({"base_end": F.max(F.when(base, F.col("end"))).over(upto),
                           "base_start": F.min(F.when(base, F.col("start"))).over(after)})
        .filter(base | (looks_live(F.col("value"))
                        & (F.coalesce("base_end", F.lit(0)) <= F.col("start"))
                        & (F.coalesce("base_start", F.col("end")) >= F.col("end"))))
        .select("_tag", "owner", "content", "rank", "start", "end", "hash", looks_live(F.col("value")).alias("random"))
    )
    # Both are written: the candidates of a value that is copied everywhere are then split by adaptive execution.
    found = materialize(found, "candidates")
    example = (F.col("owners") > max_owners) | (F.col("repos") > max_repos)
    owned = found.join(materialize(ownership(found), "ownership"), "hash", "left").withColumn("example", example)
    owned = owned.withColumn("live", F.col("random") & ~F.col("example"))
    owned = owned.filter((F.col("rank") < len(BASE)) | F.col("live"))

    span = F.struct("start", "rank", "end")
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1)
    label = F.concat_ws(":", name, "start", "end")
    listed = owned.groupBy("_tag").agg(
        *[F.sum((F.col("rank") == RANK[k]).cast("long")).alias(f"n_{k}") for k in BASE],
        F.sort_array(F.collect_list(F.struct(span.alias("at"), label.alias("label")))).alias("spans"),
        F.sum((F.col("live")).cast("long")).alias("n_live"),
        F.sum(F.col("example").cast("long")).alias("n_example"))
    joined = lambda s: F.array_join(F.transform(s, lambda x: x["label"]), ",")
    empty = F.array().cast(listed.schema["spans"].dataType)
    out = slim.select("_tag", "repo").join(listed, "_tag", "left").withColumn("spans", F.coalesce("spans", empty))
    return out.select(
        F.col("repo").alias(repo), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.filter("spans", lambda x: x["at"]["rank"] < len(BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_example")])
