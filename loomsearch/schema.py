"""Explicit schemas and settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

DOCUMENT = (
    "url string, original_url string, title string, headings array<struct<level:int,text:string>>, body string, url_tokens array<string>, "
    "meta_description string, alt_texts array<string>, structured_data array<string>, outgoing_links array<struct<url:string,anchor_text:string,is_followed:boolean>>, "
    "language string, og_tags struct<title:string,description:string,image:string,og_type:string,site_name:string>, canonical_url string, "
    "simhash long, word_count long, crawled_at timestamp, http_status int, content_type string"
)
FRONTIER = "url string, domain string, priority double, last_crawled timestamp, change_prob double, crawl_count int, next_crawl_at timestamp"
HISTORY = "url string, crawled_at timestamp, content_hash string"
TOMBSTONE = "doc_id long, url string, deleted_at timestamp, reason string, canonical_url string"
VECTOR = "doc_id long, vec array<float>"


class EngineError(Exception):
    """Base of this engine's errors."""


class SnapshotError(EngineError):
    """A snapshot name or path that would leave its folder."""


class VectorError(EngineError):
    """A vector of the wrong dimension."""


@dataclass(frozen=True)
class Settings:
    """Defaults; overridden by spark.loomsearch.<name>, then by LOOMSEARCH_<NAME>."""

    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    rrf_k: int = 60
    pool: int = 1000
    rerank_head: int = 20
    page_most: int = 50
    page_default: int = 10
    damping: float = 0.85
    tolerance: float = 1e-6
    iterations: int = 50
    least_words: int = 20
    near_bits: int = 3
    answer_confidence: float = 0.8
    session_queries: int = 5
    session_ttl_s: int = 1800
    recrawl_least_h: float = 12.0
    recrawl_most_h: float = 720.0
    enable_instant_answers: bool = True

    @classmethod
    def load(cls, spark: SparkSession | None = None) -> Settings:
        own = {}
        for f in fields(cls):
            value = os.environ.get(f"LOOMSEARCH_{f.name.upper()}") or (spark.conf.get(f"spark.loomsearch.{f.name}", None) if spark else None)
            if value is not None:
                kind = type(f.default)
                own[f.name] = value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
        return cls(**own)
