"""Crawl control, quality scores and freshness over frontier, history and document tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomsearch.functions.text import words
from loomsearch.functions.urls import host, normalise_url, top_level
from loomsearch.functions.vectorised import arrow_vectorised, batch_words, vectorised

LINK_PRIORITY = 0.85
# Suspicious top-level domains, advertising terms of one word (longer ones equal no word), stop words, blacklist seeds.
BAD_TLDS = "xyz top club work click gdn loan bid stream racing win download review accountant science faith cricket party date".split()
AD_TERMS = "advertisement sponsored subscribe discount coupon promo".split()
STOPWORDS = "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into through during before after and but or nor not so yet both this that these those it its".split()
BLACKLIST = ("example-spam.com", "buy-cheap-pills.com", "free-casino-bonus.net", "seo-backlinks.biz")


def push(frontier: DataFrame, urls: DataFrame, replace: bool = False) -> DataFrame:
    """Adds URLs (url, domain, priority) that are not there; replace: new rows win instead."""
    empty = {c: F.lit(None) for c in ("last_crawled", "next_crawl_at", "change_prob")}
    new = urls.groupBy("url").agg(F.max_by("domain", "priority").alias("domain"), F.max("priority").alias("priority")).withColumns(empty | {"crawl_count": F.lit(0)}).select(*[F.col(c).cast(t).alias(c) for c, t in frontier.dtypes])
    return frontier.join(new, "url", "left_anti").unionByName(new) if replace else frontier.unionByName(new.join(frontier, "url", "left_anti"))


def due(frontier: DataFrame, now: Column) -> DataFrame:
    return frontier.where(F.col("next_crawl_at").isNull() | (F.col("next_crawl_at") <= now))


def pop(frontier: DataFrame, now: Column, count: int = 1, per_domain: int | None = None) -> DataFrame:
    """The `count` due URLs of highest priority, at most per_domain of one domain, with the time their lease ends."""
    own = due(frontier, now)
    if per_domain is not None:
        own = own.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("priority"), "url"))).where(F.col("_n") <= per_domain).drop("_n")
    return own.orderBy(F.desc("priority"), "url").limit(count).withColumn("next_crawl_at", now + F.expr("INTERVAL 1 HOUR"))


def lease(frontier: DataFrame, popped: DataFrame) -> DataFrame:
    return frontier.join(popped.select("url", F.col("next_crawl_at").alias("_until")), "url", "left").withColumn("next_crawl_at", F.coalesce("_until", "next_crawl_at")).drop("_until")


def record(frontier: DataFrame, crawled: DataFrame) -> DataFrame:
    """Frontier after crawls (url, crawled_at): last time, count, priority 0.5."""
    own = crawled.groupBy("url").agg(F.max("crawled_at").alias("_at"), F.count("*").alias("_n"))
    out = frontier.join(own, "url", "left")
    return out.withColumns({"last_crawled": F.coalesce("_at", "last_crawled"), "crawl_count": (F.col("crawl_count") + F.coalesce("_n", F.lit(0))).cast("int"), "priority": F.when(F.col("_at").isNotNull(), 0.5).otherwise(F.col("priority"))}).drop("_at", "_n")


def last_visits(history: DataFrame, keep: int = 5, key: str = "url", time: str = "crawled_at", tie: str | None = None) -> DataFrame:
    order = [F.desc(time)] + ([F.desc(tie)] if tie else [])
    return history.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("nth") <= keep)


def expand(docs: DataFrame, frontier: DataFrame | None = None) -> DataFrame:
    """(url, domain, priority) of followed http(s) links, without those the frontier knows."""
    links = docs.select(F.explode("outgoing_links").alias("l")).where("l.is_followed").select(normalise_url("l.url").alias("url")).where("url is not null").distinct()
    out = links.select("url", F.coalesce(host(F.col("url")), F.lit("unknown")).alias("domain"), F.lit(LINK_PRIORITY).alias("priority"))
    return out if frontier is None else out.join(frontier, "url", "left_anti")


def status_gate(pages: DataFrame) -> DataFrame:
    """Adds verdict: backoff for 429 and 503, drop from 400, else keep."""
    return pages.withColumn("verdict", F.when(F.col("status").isin(429, 503), "backoff").when(F.col("status") >= 400, "drop").otherwise("keep"))


def parse_robots(text: str | None, agents: tuple[str, ...]) -> dict:
    """Rules for these agents; their own section overrides the one for all. Sitemaps hold for everyone."""
    rules = {False: {"disallow": [], "allow": [], "delay_ms": 0}, True: {"disallow": [], "allow": [], "delay_ms": 0}}
    own_seen, section, maps = False, None, []
    for raw in (text or "").splitlines():
        line = raw.strip()
        name, colon, value = line.partition(":")
        if not line or line.startswith("#") or not colon:
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            mine = value.lower() in agents
            own_seen |= mine
            section = True if mine else False if value == "*" and not own_seen else None
        elif name == "sitemap":
            maps.append(value)
        elif section is not None and name in ("allow", "disallow") and value:
            rules[section][name].append(value)
        elif section is not None and name == "crawl-delay":
            try:
                rules[section]["delay_ms"] = int(float(value) * 1000)
            except ValueError:
                pass
    return rules[own_seen] | {"sitemaps": maps}


def robots_rules(agents: tuple[str, ...] = ("loomsearch", "loomsearchbot")):
    @vectorised("disallow array<string>, allow array<string>, delay_ms long, sitemaps array<string>")
    def parse(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_robots(t, agents) for t in text], columns=["disallow", "allow", "delay_ms", "sitemaps"])

    return parse


def robots_allowed(path: Column, disallow: Column, allow: Column) -> Column:
    """The longest matching prefix decides, allow at ties, allowed without a match."""
    longest = lambda rules: F.coalesce(F.array_max(F.transform(F.filter(rules, lambda r: F.startswith(path, r)), lambda r: F.length(r))), F.lit(-1))
    return longest(allow) >= longest(disallow)


def crawl_delay_ms(own: Column, default_ms: int = 1000) -> Column:
    return F.when(own > 0, own).otherwise(F.lit(default_ms))


def backoff_s(attempt: Column, jitter: Column, base: float = 5.0, most: float = 3600.0) -> Column:
    """min(base * 2^attempt, most), plus up to a fifth of it (jitter within 0 and 1)."""
    own = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
    return own + own * 0.2 * jitter


def hysteresis(series: DataFrame, key: str, time: str, percent: str, pause: int = 50, resume: int = 30) -> DataFrame:
    """Adds paused: from `pause` percent on, until below `resume`. Between the two the last verdict holds."""
    verdict = F.when(F.col(percent) >= pause, True).when(F.col(percent) < resume, False)
    so_far = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("paused", F.coalesce(F.last(verdict, ignorenulls=True).over(so_far), F.lit(False)))


def recrawl_hours(visits: DataFrame, key: str = "url", time: str = "crawled_at", least: float = 12.0, most: float = 720.0) -> DataFrame:
    """(key, hours): mean interval times ln 2 within the limits; their midpoint without two visits."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    gap = (micros - F.lag(micros).over(Window.partitionBy(key).orderBy(time))) / 3.6e9
    mean = visits.withColumn("gap", gap).groupBy(key).agg(F.avg("gap").alias("mean"))
    return mean.select(key, F.when(F.col("mean").isNull(), (least + most) / 2).otherwise(F.least(F.greatest(F.col("mean") * F.log(F.lit(2.0)), F.lit(least)), F.lit(most))).alias("hours"))


def change_probability(elapsed: Column, mean: Column) -> Column:
    return F.when(mean <= 0, 1.0).otherwise(1 - F.exp(-elapsed / mean))


@arrow_vectorised("double")
def stuffing(text: pa.Array) -> pa.Array:
    """By the share of the most frequent content word, from 20 words on."""
    return pa.array(_stuffing(text, *batch_words(text)))


@arrow_vectorised("words int, stuffing double, ads double")
def word_scores(text: pa.Array) -> pa.Array:
    """Number of words, stuffing and density of ads of each text, its words split once."""
    row, word, vocab = batch_words(text)
    count = np.bincount(row, minlength=len(text))
    ad = pc.is_in(pc.utf8_lower(vocab), pa.array(AD_TERMS, vocab.type)).to_numpy(zero_copy_only=False)
    share = np.bincount(row[ad[word]] if len(row) else row, minlength=len(text)) / np.maximum(count, 1)
    ads = np.where(count < 50, 0.0, np.where(share > 0.05, 0.6, np.where(share > 0.02, 0.3, 0.0)))
    return pa.StructArray.from_arrays([pa.array(count.astype(np.int32)), pa.array(_stuffing(text, row, word, vocab)), pa.array(ads)], names=["words", "stuffing", "ads"])


def _stuffing(text: pa.Array, row: np.ndarray, word: np.ndarray, vocab: pa.Array) -> np.ndarray:
    stops = pc.is_in(pc.utf8_lower(vocab), pa.array(STOPWORDS, vocab.type)).to_numpy(zero_copy_only=False)
    long_ = np.bincount(row, minlength=len(text)) >= 20
    kept = long_[row] & ~stops[word] if len(row) else np.zeros(0, bool)
    pair, times = np.unique(row[kept] * max(len(vocab), 1) + word[kept], return_counts=True)
    of = pair // max(len(vocab), 1)
    total = np.bincount(of, times, minlength=len(text))
    most = np.zeros(len(text))
    np.maximum.at(most, of, times)
    ratio = most / np.maximum(total, 1)
    return np.where(ratio > 0.25, 0.8, np.where(ratio > 0.15, 0.4, 0.0))


def link_spam(links: Column, words_: Column) -> Column:
    ratio = links / F.nullif(words_, F.lit(0))
    return F.when(words_ == 0, F.when(links > 5, 0.9).otherwise(0.0)).when(ratio > 0.2, 0.8).when(ratio > 0.1, 0.4).when(ratio > 0.05, 0.15).otherwise(0.0)


def thin(words_: Column) -> Column:
    return F.when(words_ < 50, 0.6).when(words_ < 100, 0.3).when(words_ < 200, 0.1).otherwise(0.0)


def ad_density(text: Column) -> Column:
    own = words(F.lower(text))
    ratio = F.size(F.filter(own, lambda w: w.isin(AD_TERMS))) / F.nullif(F.size(own), F.lit(0))
    return F.when(F.size(own) < 50, 0.0).when(ratio > 0.05, 0.6).when(ratio > 0.02, 0.3).otherwise(0.0)


def spam_score(stuffing_: Column, links: Column, thin_: Column, ads: Column, url: Column, title: Column) -> Column:
    bad = F.coalesce(top_level(host(url)).isin(BAD_TLDS), F.lit(False))
    total = 0.25 * stuffing_ + 0.25 * links + 0.20 * thin_ + 0.15 * ads + F.when(bad, 0.10).otherwise(0.0) + F.when(F.trim(F.coalesce(title, F.lit(""))) == "", 0.05).otherwise(0.0)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def blacklisted(docs: DataFrame, domains: DataFrame, by: Column, keep: bool = False) -> DataFrame:
    """Rows whose domain is not (keep: is) in the set (column domain)."""
    listed = domains.select(F.lower("domain").alias("_domain")).distinct()
    return docs.join(listed, F.lower(by) == F.col("_domain"), "left_semi" if keep else "left_anti")


def live(docs: DataFrame, tombstones: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(tombstones.select(key).distinct(), key, "left_anti")


def tombstone(tombstones: DataFrame | None, docs: DataFrame, reason: str, now: Column) -> DataFrame:
    """Tombstones with these documents (doc_id, url) added; a document has one, its first."""
    new = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "url", now.cast("timestamp").alias("deleted_at"), F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("canonical_url"))
    return new if tombstones is None else tombstones.unionByName(new.join(tombstones, "doc_id", "left_anti"))


def cleared(tombstones: DataFrame) -> DataFrame:
    """An empty list of tombstones."""
    return tombstones.limit(0)


def seeds(urls: DataFrame) -> DataFrame:
    """(url, domain, priority) of a curated list of URLs (column url), of the highest priority."""
    own = urls.select(normalise_url("url").alias("url")).where("url is not null").distinct()
    return own.select("url", F.coalesce(host(F.col("url")), F.lit("unknown")).alias("domain"), F.lit(1.0).alias("priority"))


def frontier_size(frontier: DataFrame) -> DataFrame:
    return frontier.agg(F.count("*").alias("urls"))


def fresh_robots(cache: DataFrame, now: Column, ttl_h: int = 24) -> DataFrame:
    """Cached robots rules (domain, fetched_at, rules) that are not older than ttl_h hours; the latest of each domain."""
    own = cache.where(F.unix_seconds("fetched_at") > F.unix_seconds(now) - ttl_h * 3600)
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("fetched_at")))).where("_n = 1").drop("_n")
