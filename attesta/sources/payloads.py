"""Provider payloads (already fetched, one JSON text per request) to result rows.

Input tables carry ``run_id``, ``query``, ``provider`` and ``payload``; output
rows have the provider-result columns plus ``run_id``, ``query`` and ``rank``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta import vocab as V
from attesta.functions import text as tx
from attesta.functions import urls as ur

# Order in which providers are asked.
PROVIDER_ORDER = ("tavily", "perplexity", "duckduckgo", "wikipedia")

RESULT_COLUMNS = ("run_id", "query", "rank", "title", "url", "snippet", "source", "score", "image_url")


def _finish(df: DataFrame) -> DataFrame:
    return df.select(
        "run_id", "query", F.col("rank").cast("int").alias("rank"),
        *[tx.text_of(c).alias(c) for c in ("title", "url", "snippet", "source")],
        F.col("score").cast("double").alias("score"), F.col("image_url").cast("string").alias("image_url"))


def _answer(df: DataFrame, scheme: str, label: str, text: str) -> DataFrame:
    return df.filter(tx.text_of(text) != "").select(
        "run_id", "query", F.lit(0).alias("rank"),
        F.concat(F.lit(f"{label} answer: "), "query").alias("title"),
        F.concat(F.lit(f"{scheme}://answer/"), F.replace("query", F.lit(" "), F.lit("_"))).alias("url"),
        F.col(text).alias("snippet"), F.lit(f"{scheme}-answer").alias("source"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("image_url"))


def normalize_results(payloads: DataFrame) -> DataFrame:
    """Cached result lists: NULLs blank, non-objects dropped, provider as fallback source."""
    item = "title STRING, url STRING, snippet STRING, source STRING, score DOUBLE, image_url STRING"
    rows = (payloads.select("run_id", "query", "provider",
                            F.posexplode(F.from_json("payload", "array<string>")).alias("rank", "raw"))
            .withColumn("r", F.from_json("raw", item))
            .filter(F.startswith(F.ltrim("raw"), F.lit("{")) & F.col("r").isNotNull()))
    return _finish(rows.select(
        "run_id", "query", "rank", "r.title", "r.url", "r.snippet",
        F.coalesce(F.nullif("r.source", F.lit("")), "provider").alias("source"),
        "r.score", "r.image_url"))


def web_search(payloads: DataFrame) -> DataFrame:
    """Web-search payloads: the synthesized answer first, then each hit."""
    doc = "answer STRING, results ARRAY<STRUCT<title: STRING, url: STRING, content: STRING, score: DOUBLE>>"
    df = payloads.withColumn("d", F.from_json("payload", doc)).withColumn("answer", F.col("d.answer"))
    hits = (df.select("run_id", "query", F.posexplode("d.results").alias("pos", "h"))
            .select("run_id", "query", (F.col("pos") + 1).alias("rank"), "h.title", "h.url",
                    F.col("h.content").alias("snippet"), F.lit("tavily").alias("source"), "h.score",
                    F.lit(None).cast("string").alias("image_url")))
    return _finish(_answer(df, "tavily", "Tavily", "answer").unionByName(hits))


def chat_answer(payloads: DataFrame, limit: int = 10) -> DataFrame:
    """Chat payloads: the answer, then the first ``limit`` citations without text."""
    doc = ("choices ARRAY<STRUCT<message: STRUCT<content: STRING>>>, citations ARRAY<STRING>")
    df = (payloads.withColumn("d", F.from_json("payload", doc))
          .withColumn("answer", F.get("d.choices", F.lit(0))["message"]["content"]))
    cited = (df.select("run_id", "query", F.posexplode(F.slice("d.citations", 1, limit)).alias("pos", "url"))
             .select("run_id", "query", (F.col("pos") + 1).alias("rank"),
                     F.concat(F.lit("Perplexity citation "), (F.col("pos") + 1).cast("string")).alias("title"),
                     "url", F.lit("").alias("snippet"), F.lit("perplexity").alias("source"),
                     F.lit(None).cast("double").alias("score"),
                     F.lit(None).cast("string").alias("image_url")))
    return _finish(_answer(df, "perplexity", "Perplexity", "answer").unionByName(cited))


def html_results(payloads: DataFrame, limit: int = 10) -> DataFrame:
    """HTML result pages: first link and snippet of each block, at most ``limit``.

    The page is one row, so its blocks are ranked inside the array.
    """
    blocks = F.slice(F.split("payload", V.RESULT_BLOCK), 2, 1 << 30)
    hits = F.filter(F.transform(blocks, lambda b: F.struct(
        tx.label_text(F.regexp_extract(b, V.RESULT_LINK, 2)).alias("title"),
        ur.unwrap_redirect(F.regexp_extract(b, V.RESULT_LINK, 1)).alias("url"),
        tx.label_text(F.regexp_extract(b, V.RESULT_SNIPPET, 1)).alias("snippet"))),
        lambda h: (h["title"] != "") & (h["url"] != ""))
    rows = payloads.select("run_id", "query", F.posexplode(F.slice(hits, 1, limit)).alias("rank", "h"))
    return _finish(rows.select("run_id", "query", "rank", "h.*", F.lit("duckduckgo").alias("source"),
                               F.lit(None).cast("double").alias("score"),
                               F.lit(None).cast("string").alias("image_url")))


def article_summaries(payloads: DataFrame, limit: int = 10) -> DataFrame:
    """Article-summary payloads, one per title in search order: blanks out, first ``limit``.

    Needs ``title`` and ``pos`` beside the payload.  Search returns a short
    list, so a query's rank window is small; the limit is cut before the shuffle.
    """
    from pyspark.sql import Window as W

    doc = "title STRING, extract STRING, content_urls STRUCT<desktop: STRUCT<page: STRING>>"
    df = payloads.withColumn("d", F.from_json("payload", doc))
    text = tx.strip(tx.text_of("d.extract"))
    page = F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace("title", F.lit(" "), F.lit("_")))
    order = W.partitionBy("run_id", "query").orderBy("pos")
    rows = (df.withColumn("snippet", text).filter("snippet <> ''")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
            .select("run_id", "query", (F.col("rank") - 1).alias("rank"),
                    F.coalesce(F.nullif("d.title", F.lit("")), "title").alias("title"),
                    F.coalesce(F.nullif("d.content_urls.desktop.page", F.lit("")), page).alias("url"),
                    "snippet", F.lit("wikipedia").alias("source"),
                    F.lit(None).cast("double").alias("score"),
                    F.lit(None).cast("string").alias("image_url")))
    return _finish(rows)


def in_provider_order(results: DataFrame, provider: str = "provider") -> DataFrame:
    """Add ``seq``: the order in which a run meets its results."""
    place = F.coalesce(F.element_at(F.create_map(*[
        x for i, p in enumerate(PROVIDER_ORDER) for x in (F.lit(p), F.lit(i))]), F.col(provider)),
        F.lit(len(PROVIDER_ORDER)))
    return results.withColumn("seq", place.cast("bigint") * F.lit(1 << 32) + F.col("rank"))


def availability(payloads: DataFrame) -> DataFrame:
    """Archive-availability answers ``(url, payload)``; anything odd is a miss. Further columns stay."""
    doc = ("archived_snapshots STRUCT<closest: STRUCT<url: STRING, timestamp: STRING, status: STRING>>")
    hit = F.col("d.archived_snapshots.closest")
    df = payloads.withColumn("d", F.from_json("payload", doc))
    ok = tx.text_of(hit["url"]) != ""
    return df.select(*[c for c in payloads.columns if c not in ("url", "payload")], "url", ok.alias("archived"), F.when(ok, hit["url"]).alias("wayback_url"),
                     F.when(ok, ur.archive_epoch(hit["timestamp"])).alias("archived_at"),
                     F.when(ok, hit["status"]).alias("available_status"))
