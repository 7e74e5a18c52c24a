"""One research pass as a staged dataflow: from raw results to claims, visited sources and summaries.

Each later stage runs on what the earlier ones left open, by anti-joins on small keys:

1. a URL counts once per run, where it was seen first, and that holds for all stages;
2. topic filter (lenient with a fallback for a run's subject, strict for a recursed parent), then the
   content gate: only what clearly is on the subject reaches extraction;
3. model claims first, pattern claims of the sources that the model gave nothing for;
4. the best encyclopedia article of each query in full;
5. a targeted second query for subjects that are still without a claim.

Claims of all stages are ingested in that order, the first of each ordered parent pair of a run stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import extract as ex
from attesta.session import materialize

#: Stages in the order in which their claims count.
MODEL, PATTERN, ARTICLE, FOLLOW_UP = range(4)
RESULT = ["run_id", "query", "rank", "title", "url", "snippet", "source"]
_CLAIM = ["run_id", "query", "child", "parent_a", "parent_b", "extra_parents", "source_url", "source_title",
          "source_engine", "snippet_excerpt", "confidence", "parent_roles"]


def topical(results: DataFrame) -> DataFrame:
    """Results on the topic: of a subject leniently, or its first if none is; of a recursed parent strictly.

    ``results`` has ``is_subject``; a query without any strict hit stays empty.
    """
    strict = tx.on_topic("title", "snippet") & tx.strongly_on_topic("title", "snippet")
    return ex.filter_on_topic(results.filter("is_subject")).unionByName(results.filter(~F.col("is_subject") & strict))


def content_gate(results: DataFrame) -> DataFrame:
    """Results whose own text is clearly about the subject; only they are mined."""
    return results.filter(tx.strongly_on_topic("title", "snippet"))


def _staged(claims: DataFrame, stage: int, *place: str) -> DataFrame:
    order = F.struct(F.lit(stage).alias("stage"), *[F.col(c).cast("bigint").alias(f"p{i}") for i, c in enumerate(place)])
    return claims.select(*_CLAIM, order.alias("seq"))


def _patterns(results: DataFrame, stage: int) -> DataFrame:
    return _staged(ex.extract_claims(results), stage, "rank", "pos")


def research(results: DataFrame, responses: DataFrame, articles: DataFrame, corpus: DataFrame,
             prior: DataFrame | None = None) -> dict[str, DataFrame]:
    """Claims, visited sources, kept raw results, metadata and summaries of a batch of queries.

    ``results(run_id, query, is_subject, seq, title, url, snippet, source)`` in
    provider order by ``seq``; ``responses(run_id, query, response)`` of the
    model, which was shown the gated results numbered from 0;
    ``articles(title, text)``; ``corpus(query, rank, title, url, snippet,
    source)`` answers targeted queries; ``prior`` holds claims the runs have.
    """
    fresh = materialize(ex.first_seen_urls(results), "fresh")
    kept = materialize(topical(fresh.withColumnRenamed("seq", "rank")), "kept")
    place = F.row_number().over(W.partitionBy("run_id", "query").orderBy("rank")) - 1
    gated = materialize(content_gate(kept).withColumn("rank", place), "gated")

    model, metadata = ex.parse_responses(responses, gated)
    model = materialize(_staged(model, MODEL, "line_no", "rank"), "model")
    mined = model.select("run_id", F.col("source_url").alias("url")).distinct()
    patterns = _patterns(gated.join(mined, ["run_id", "url"], "left_anti").select(*RESULT), PATTERN)
    dives = materialize(ex.deep_dive(gated, articles).select(*RESULT), "dives")
    found = model.unionByName(patterns).unionByName(_patterns(dives, ARTICLE))
    claims = materialize(ex.ingest_claims(found, prior), "claims")

    held = claims.select("run_id") if prior is None else claims.select("run_id").unionByName(prior.select("run_id"))
    subjects = fresh.filter("is_subject").select("run_id", "query").distinct()
    again = ex.follow_up(subjects, held.distinct(), corpus, fresh).withColumn("seq", F.col("rank"))
    again = materialize(ex.first_seen_urls(again).select(*RESULT), "again")
    # These runs had no claim, so nothing of theirs is on file yet.
    claims = claims.unionByName(ex.ingest_claims(_patterns(again, FOLLOW_UP)))

    said = lambda df, title: df.select("run_id", "url", title.alias("title"), F.col("source").alias("engine"))
    visited = (said(fresh, F.col("title")).unionByName(said(again, F.col("title")))
               .unionByName(said(dives, F.concat("title", F.lit(" (full article)")))))
    return {"claims": claims.withColumn("stage", F.col("seq.stage")), "visited": visited, "raw": kept,
            "metadata": metadata, "summaries": ex.best_summaries(kept)}
