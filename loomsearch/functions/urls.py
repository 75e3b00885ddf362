"""URL functions."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomsearch.functions.vectorised import vectorised

# Host rules by topic, in order of precedence. (ends, contains, starts)
TOPIC_RULES = (
    ("Academic", (".edu", ".edu.au"), (".ac.", "university", "arxiv.", "scholar.", "researchgate."), ()),
    ("Reference", (".gov",), (".gov.", "wikipedia.", "wiktionary.", "wikidata.", "dictionary.", ".gc.ca"), ("reference.", "docs.")),
    ("News", (".news",), ("cbc.ca", "bbc.", "cnn.", "reuters.", "apnews.", "nytimes.", "washingtonpost.", "theglobeandmail.", "radio-canada."), ("news.",)),
    ("Commercial", (".shop", ".store"), ("amazon.", "ebay.", "etsy.", "walmart.", "costco.", "homedepot."), ("shop.", "store.")),
)
TOPICS = ("Reference", "News", "Commercial", "Academic")
DEFAULT_TOPIC = "Reference"


def host(url: Column) -> Column:
    """Lower-case host, null where the URL has none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def topic(url: Column) -> Column:
    own = F.lower(F.regexp_extract(url, r"://([^/]*)", 1))
    out = None
    for name, ends, contains, starts in TOPIC_RULES:
        tests = [own.endswith(x) for x in ends] + [own.contains(x) for x in contains] + [own.startswith(x) for x in starts]
        any_of = tests[0]
        for t in tests[1:]:
            any_of = any_of | t
        out = F.when(any_of, name) if out is None else out.when(any_of, name)
    return out.otherwise(DEFAULT_TOPIC)


def topic_sql(url: str) -> str:
    own = f"lower(regexp_extract({url}, '://([^/]*)', 1))"
    cases = []
    for name, ends, contains, starts in TOPIC_RULES:
        tests = [f"ends_with({own}, '{x}')" for x in ends] + [f"contains({own}, '{x}')" for x in contains] + [f"starts_with({own}, '{x}')" for x in starts]
        cases.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE '{DEFAULT_TOPIC}' END"


def top_level(host_: Column) -> Column:
    return F.element_at(F.split(host_, r"\."), -1)


def path_tokens(url: Column) -> Column:
    """Lower-case parts of the path between / - _ and ."""
    return F.filter(F.split(F.lower(F.try_parse_url(url, F.lit("PATH"))), "[/._-]"), lambda x: x != "")


def normalise(url: str | None, base: str | None = None) -> str | None:
    """Resolved http(s) URL with lower-case scheme and host, no default port or fragment, sorted query, no trailing slash."""
    if not url:
        return None
    try:
        parts = urlsplit(urljoin(base, url.strip()) if base else url.strip())
        port = parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in ("http", "https") or not parts.hostname:
        return None
    place = parts.hostname if port in (None, {"http": 80, "https": 443}[scheme]) else f"{parts.hostname}:{port}"
    if "@" in parts.netloc:
        place = f"{parts.netloc.rpartition('@')[0]}@{place}"
    pairs = sorted((k, v) for k, _, v in (p.partition("=") for p in parts.query.split("&") if p))
    query = "&".join(f"{k}={v}" if v else k for k, v in pairs)
    path = re.sub("/$", "", parts.path) if parts.path != "/" else "/"
    return urlunsplit((scheme, place, path or "/", query, ""))


@vectorised("string", once=True)
def normalise_url(url: pd.Series) -> pd.Series:
    return url.map(normalise)


@vectorised("string")
def resolve_url(url: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([normalise(u, b) for u, b in zip(url, base, strict=True)], dtype=object)
