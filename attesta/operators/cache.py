"""Provider-cache freshness over request logs, and its bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import aliases as al

# Payloads not worth keeping.
_EMPTY = ("", "[]", "{}", '""', "null")


def classify_requests(requests: DataFrame, blobs: DataFrame, ttl: int) -> DataFrame:
    """``requests(cache_key, at, …)`` with ``outcome``: hit, expired, corrupt or miss.

    A hit needs a live blob whose digest matches and which is still JSON.  A
    TTL of 0 switches the cache off: everything misses.
    """
    if ttl <= 0:
        return requests.withColumn("outcome", F.lit("miss"))
    state = blobs.select(
        "cache_key", "expires_at",
        ((tx.content_digest("payload") == tx.text_of("content_hash"))
         & F.try_parse_json("payload").isNotNull()).alias("__sound"))
    outcome = (F.when(F.col("expires_at").isNull(), "miss")
               .when(F.col("expires_at") <= F.col("at"), "expired")
               .when(~F.coalesce("__sound", F.lit(False)), "corrupt").otherwise("hit"))
    return (requests.join(state, "cache_key", "left").withColumn("outcome", outcome)
            .drop("__sound", "expires_at"))


def store_payloads(blobs: DataFrame, fetched: DataFrame, ttl: int) -> DataFrame:
    """Blobs after storing ``fetched(cache_key, provider, kind, identity, payload, fetched_at)``.

    The latest fetch of a key wins, its hit count survives, empty payloads are
    never kept.
    """
    if ttl <= 0:
        return blobs
    worth = fetched.filter(~F.trim(tx.text_of("payload")).isin(*_EMPTY)).select(
        "cache_key", "provider", "kind", "identity", "payload",
        tx.content_digest("payload").alias("content_hash"), "fetched_at",
        (F.col("fetched_at") + ttl).alias("expires_at"), F.lit(0).cast("bigint").alias("hits"),
        F.lit(1).alias("__new"))
    rest = [c for c in worth.columns if c not in ("cache_key", "hits")]
    both = blobs.withColumn("__new", F.lit(0)).select(*worth.columns).unionByName(worth)
    return (both.groupBy("cache_key").agg(
        F.max_by(F.struct(*rest), F.struct("__new", "fetched_at", "payload")).alias("b"),
        F.coalesce(F.max(F.when(F.col("__new") == 0, F.col("hits"))), F.lit(0)).alias("hits"))
        .select("cache_key", "b.*", "hits").drop("__new").select(*blobs.columns))


def purge(blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """No blobs, and how many were ``purged``; outcomes of past requests are not touched."""
    return blobs.limit(0), blobs.agg(F.count(F.lit(1)).alias("purged"))


def with_request_keys(requests: DataFrame, strains: DataFrame) -> DataFrame:
    """``requests(provider, kind, query, extra, …)`` with ``identity`` and ``cache_key``.

    The identity of a query is the entity that it names, under any spelling or
    alias, so such queries share one key.
    """
    named = al.identify(requests, strains, "query")
    return named.withColumn("cache_key", tx.request_key("provider", "kind", "identity", "extra"))


def cache_stats(classified: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """Hits, misses and hit rate (four digits, NULL without requests)."""
    hits, n = F.count_if(F.col("outcome") == "hit"), F.count(F.lit(1))
    out = classified.agg(hits.alias("hits"), (n - hits).alias("misses"))
    total = F.nullif(F.col("hits") + F.col("misses"), F.lit(0))
    out = out.withColumn("hit_rate", F.round(F.col("hits") / total, 4))
    if blobs is not None:
        out = out.withColumn("entries", blobs.agg(F.count(F.lit(1))).scalar())
    return out


def run_usage(classified: DataFrame) -> DataFrame:
    """Cache hits and misses of each run."""
    hits = F.count_if(F.col("outcome") == "hit")
    return classified.groupBy("run_id").agg(hits.alias("hits"),
                                            (F.count(F.lit(1)) - hits).alias("misses"))
