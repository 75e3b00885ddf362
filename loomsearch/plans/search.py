"""A search request end to end, for a batch of queries: understand, retrieve, rank, page, snippet, instant answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsearch.functions.text import index_tokens, snippet
from loomsearch.functions.urls import host
from loomsearch.operators import instant, ranking, retrieval, understand
from loomsearch.operators.index import Index
from loomsearch.schema import Settings


def prepare(docs: DataFrame) -> DataFrame:
    """Documents with the searched fields as text: headings joined over all levels, URL tokens joined."""
    return docs.withColumn("headings", F.array_join(F.transform("headings", lambda h: h["text"]), " ")).withColumn("url_tokens", F.array_join("url_tokens", " "))


def search(docs: DataFrame, queries: DataFrame, now: Column, nodes: DataFrame | None = None, words: DataFrame | None = None, page: int = 1, size: int = 10, settings: Settings = Settings(), index: Index | None = None) -> DataFrame:
    """docs: doc_id, url, the searched fields (as text) and crawled_at. queries: query_id, text. nodes: id (url), pagerank and topic ranks.

    words: the dictionary for spelling. index: the stored index of docs; without one the texts are split anew.
    Stored fields and snippets are joined only for the rows of the page.
    """
    asked = queries.where(F.trim("text") != "")
    parsed = understand.parse_queries(asked, words).withColumn("used", F.coalesce("correction", "text"))
    terms = parsed.select("query_id", index_tokens(F.col("used")).alias("terms"))
    found = index.search(terms, settings) if index else retrieval.search(retrieval.field_tokens(docs, list(retrieval.BOOSTS)), terms, retrieval.BOOSTS, settings)
    # Rounded, so that equal documents tie whatever the order of sums.
    pool = retrieval.top(found.withColumn("score", F.round("score", 9)), settings.pool)
    facts = docs.select("doc_id", "url", "crawled_at")
    topics = [c for c in ("pagerank", "pr_reference", "pr_news", "pr_commercial", "pr_academic")]
    own = pool.join(facts, "doc_id")
    own = own.join(nodes.select(F.col("id").alias("url"), *topics), "url", "left") if nodes is not None else own.withColumns({c: F.lit(0.0) for c in topics})
    age = F.greatest(F.datediff(F.to_date(now), F.to_date(F.coalesce("crawled_at", now))), F.lit(0))
    features = {"bm25": F.col("score"), "age_days": age} | {c: F.coalesce(c, F.lit(0.0)) for c in topics}
    ranked = ranking.rerank(own.withColumn("gbdt", ranking.ensemble(ranking.slots(features))), settings.rerank_head)
    shown = ranking.page(ranked, page, size, settings.page_most).join(pool.select("query_id", "doc_id", "total_hits"), ["query_id", "doc_id"])
    out = shown.join(docs.select("doc_id", "url", "title", "body", "meta_description", F.coalesce("crawled_at", now).alias("last_crawled")), "doc_id").join(parsed.select("query_id", "text", "used", "correction"), "query_id")
    out = out.withColumn("snippet", snippet("body", "used")).withColumn("domain", host(F.col("url")))
    answered = asked if page == 1 and settings.enable_instant_answers else asked.where("false")
    quick = instant.answers(answered, now, least=settings.answer_confidence).select("query_id", "instant")
    out = out.join(quick, "query_id", "left")
    return out.select("query_id", "text", "total_hits", "final_rank", "doc_id", "url", "title", "snippet", F.col("final_score").alias("score"), "domain", "meta_description", "last_crawled", F.lit(None).cast("string").alias("favicon"), ranking.did_you_mean(F.col("correction"), F.col("text")).alias("did_you_mean"), ranking.phases(F.lit(True), F.col("instant").isNotNull()).alias("ranking_phases"), "instant")


def response(results: DataFrame) -> DataFrame:
    """One JSON response a query: results in order, the instant answer, the phases."""
    row = F.struct("final_rank", "doc_id", "url", "title", "snippet", "score", "domain", "meta_description", "last_crawled", "favicon")
    grouped = results.groupBy("query_id").agg(F.first("text").alias("query"), F.max("total_hits").alias("total_hits"), F.array_sort(F.collect_list(row)).alias("results"), F.first("instant").alias("instant_answer"), F.first("did_you_mean").alias("did_you_mean"), F.first("ranking_phases").alias("ranking_phases"))
    return grouped.select("query_id", F.to_json(F.struct("query", "total_hits", "results", "instant_answer", "did_you_mean", "ranking_phases")).alias("json"))
