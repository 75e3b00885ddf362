"""Registered queries: pages, URLs, links, ranking, search end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomsearch.catalog import query
from loomsearch.functions import urls as U
from loomsearch.operators import crawl, linkgraph, parse, ranking
from loomsearch.operators.index import FORMAT, Index
from loomsearch.plans import search as S
from loomsearch.schema import FRONTIER
from loomsearch.sources import tables
from loomsearch.sources.tables import load, shared_dir

HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"


@query(r"SELECT page_id, trim(regexp_split_to_array(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[-|—–]')[1]) AS title FROM pages")
def page_title(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", parse.title_of(F.col("html")).alias("title"))


@query(r"""SELECT page_id, CASE WHEN x = '' THEN 'en' ELSE x END AS lang FROM (SELECT page_id, regexp_extract(html, '<html[^>]*\blang="([^"]*)"', 1) AS x FROM pages)""")
def page_lang(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", parse.language_of(F.col("html")).alias("lang"))


@query(r"""SELECT DISTINCT page_id, 'x' || href AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)""")
def page_links(spark, sf_dir):
    """Links through the parser; the targets' paths are compared with the raw hrefs."""
    own = parse.documents(load(spark, sf_dir, "pages")).select("page_id", F.explode("outgoing_links").alias("l"))
    return own.select("page_id", F.concat(F.lit("x"), F.regexp_replace("l.url", "^[a-z]+://[^/]*", "")).alias("href")).distinct()


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1) <> '' AS has_h1 FROM pages""")
def page_h1(spark, sf_dir):
    return parse.documents(load(spark, sf_dir, "pages")).select("page_id", F.exists("headings", lambda h: h["level"] == 1).alias("has_h1"))


@query()
def page_body(spark, sf_dir):
    return parse.documents(load(spark, sf_dir, "pages")).select("page_id", "title", "language", "body", "word_count")


@query(f"SELECT page_id, {HOST} AS domain, regexp_extract({HOST}, '[^.]*$') AS tld FROM pages")
def url_domain(spark, sf_dir):
    own = U.host(F.col("url"))
    return load(spark, sf_dir, "pages").select("page_id", own.alias("domain"), U.top_level(own).alias("tld"))


@query(f"SELECT page_id, {U.topic_sql('url')} AS topic FROM pages")
def url_topic(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", U.topic(F.col("url")).alias("topic"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
    s AS (SELECT page_id, regexp_extract(u, '^[^?]*') AS a, regexp_extract(u, '\?(.*)$', 1) AS q FROM p)
    SELECT page_id, regexp_replace(a, '/$', '') || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS normal FROM s""")
def url_normalize(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", U.normalise_url("url").alias("normal"))


@query(r"SELECT page_id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '[/._-]'), lambda x: x <> ''), ' ') AS tokens FROM pages")
def url_tokens(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(U.path_tokens(F.col("url")), " ").alias("tokens"))


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.edges(parse.documents(load(spark, sf_dir, "pages")))


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which supplier follows which within an order."""
    own = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_partkey")
    after = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return own.select(F.col("l_suppkey").alias("src"), after.alias("dst")).where("dst is not null").distinct()


EDGES_SQL = "e AS (SELECT DISTINCT l_suppkey AS src, dst FROM (SELECT l_suppkey, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"


def _rank_steps(rounds: int) -> list[str]:
    return [f"""r{k + 1} AS (SELECT v.id, 0.15 * t + 0.85 * (SELECT coalesce(sum(r), 0) FROM r{k} WHERE id NOT IN (SELECT src FROM o)) * t + 0.85 * coalesce(g.g, 0) AS r, t
        FROM v JOIN r{k} x USING (id) LEFT JOIN (SELECT dst AS id, sum(r / n) AS g FROM e JOIN o USING (src) JOIN r{k} ON r{k}.id = e.src GROUP BY dst) g USING (id))""" for k in range(rounds)]


def _pagerank_sql(rounds: int, teleport: str = "1.0 / (SELECT count(*) FROM v)") -> str:
    return f"""WITH {EDGES_SQL}, v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS n FROM e GROUP BY src),
        r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS r, ({teleport})::DOUBLE AS t FROM v), {', '.join(_rank_steps(rounds))}"""


@query(_pagerank_sql(10) + " SELECT id, round(r, 8) AS pagerank FROM r10")
def pagerank(spark, sf_dir):
    return linkgraph.pagerank(supplier_edges(spark, sf_dir), iterations=10).select("id", F.round("pagerank", 8).alias("pagerank"))


@query(_pagerank_sql(6, "CASE WHEN id % 7 = 0 THEN 1.0 / (SELECT count(*) FROM v WHERE id % 7 = 0) ELSE 0 END") + " SELECT id, round(r, 8) AS pr_seed FROM r6")
def topic_pagerank(spark, sf_dir):
    """Teleport to a set of seeds."""
    return linkgraph.pagerank(supplier_edges(spark, sf_dir), {"pr_seed": F.col("id") % 7 == 0}, iterations=6).select("id", F.round("pr_seed", 8).alias("pr_seed"))


@query()
def page_pagerank(spark, sf_dir):
    """The page graph with its topic vectors, until they are stable: all link targets dangle."""
    edges = tables.saved(page_edges(spark, sf_dir), "links")  # pages are parsed once for both
    own = linkgraph.pagerank(edges)
    return own.hint("merge").join(linkgraph.topic_pagerank(edges), "id")


@query(f"WITH {EDGES_SQL} SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM (SELECT dst AS id, count(*) AS i FROM e GROUP BY dst) FULL JOIN (SELECT src AS id, count(*) AS o FROM e GROUP BY src) USING (id)")
def degree(spark, sf_dir):
    return linkgraph.degrees(supplier_edges(spark, sf_dir))


BASE = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
LINKS = f"""SELECT DISTINCT url AS src, {BASE} || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS dst FROM pages"""
PAGE_GRAPH = f"e AS ({LINKS}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS n FROM e GROUP BY src), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM v) AS r, 1.0::DOUBLE / (SELECT count(*) FROM v) AS t FROM v)"


@query(f"WITH {PAGE_GRAPH}, {', '.join(_rank_steps(5))} SELECT {HOST.replace('url', 'id')} AS domain, round(sum(r), 7) AS authority FROM r5 GROUP BY ALL")
def domain_authority(spark, sf_dir):
    return linkgraph.domain_authority(linkgraph.pagerank(page_edges(spark, sf_dir), iterations=5), U.host(F.col("id"))).select("domain", F.round("authority", 7).alias("authority"))


@query(f"""WITH l AS (SELECT page_id, base, html, unnest(range(1, len(hrefs) + 1)) AS k, hrefs, texts FROM (SELECT page_id, {BASE} AS base, html, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS texts FROM pages)),
    d AS (SELECT DISTINCT ON (page_id, base || hrefs[k]) page_id, base || hrefs[k] AS url, trim(texts[k]) AS anchor, k FROM l ORDER BY page_id, base || hrefs[k], k),
    c AS (SELECT url, anchor, count(*) AS n FROM d WHERE anchor <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY n DESC, anchor) AS p FROM c)
    SELECT url, string_agg(anchor, '|' ORDER BY p) AS anchors FROM r WHERE p <= 100 GROUP BY url""")
def anchor_texts(spark, sf_dir):
    return linkgraph.anchors(parse.documents(load(spark, sf_dir, "pages"))).select("url", F.array_join("anchors", "|").alias("anchors"))


FEATURES = {0: "bm25", 1: "title_ratio", 3: "heading_ratio", 6: "log10(pagerank + 1e-10)", 7: "domain_authority", 8: "url_depth", 9: "1 / (1 + exp(age_days - 30))", 16: "spam", 22: "log10(inlinks + 1)", 23: "log10(words + 1)", 24: "cosine", 29: "https"}
#: Stand-in features of documents, as SQL that both engines read alike.
RAW = {
    "bm25": "(doc_id % 97) / 10.0", "title_ratio": "(doc_id % 11) / 10.0", "heading_ratio": "(doc_id % 5) / 10.0", "pagerank": "1.0 / (1 + doc_id)", "domain_authority": "(doc_id % 7) / 10.0", "url_depth": "doc_id % 6",
    "age_days": "doc_id % 40", "spam": "(doc_id % 10) / 10.0", "inlinks": "doc_id % 30", "words": "n_chars / 6", "cosine": "(doc_id % 13) / 13.0", "https": "doc_id % 2",
}
FEATURE_SQL = ", ".join(f"({v})::DOUBLE AS {k}" for k, v in RAW.items())
GBDT_SQL = f"0.1 * ({' + '.join(ranking.tree_sql(t, FEATURES) for t in ranking.TREES)})"


def _features(spark, sf_dir) -> DataFrame:
    own = load(spark, sf_dir, "documents").select("doc_id", *[F.expr(f"cast({v} as double)").alias(k) for k, v in RAW.items()])
    return own.withColumn("gbdt", ranking.ensemble(ranking.slots({k: F.col(k) for k in RAW})))


@query(f"WITH f AS (SELECT doc_id, {FEATURE_SQL} FROM documents) SELECT doc_id, round({GBDT_SQL}, 6) AS gbdt FROM f")
def gbdt_score(spark, sf_dir):
    return _features(spark, sf_dir).select("doc_id", F.round("gbdt", 6).alias("gbdt"))


RERANK_SQL = f"""WITH f AS (SELECT doc_id, {FEATURE_SQL} FROM documents), s AS (SELECT 1::BIGINT AS query_id, doc_id, bm25, round({GBDT_SQL}, 9) AS gbdt, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rank FROM f),
    m AS (SELECT *, row_number() OVER (ORDER BY gbdt DESC, rank) AS model_rank FROM s WHERE rank <= 1000),
    o AS (SELECT query_id, doc_id, model_rank <= 20 AS is_head, round(CASE WHEN model_rank <= 20 THEN gbdt ELSE bm25 END, 6) AS final_score, row_number() OVER (ORDER BY model_rank > 20, CASE WHEN model_rank <= 20 THEN model_rank END, rank)::INT AS final_rank FROM m)"""


def _reranked(spark, sf_dir) -> DataFrame:
    own = _features(spark, sf_dir).withColumn("query_id", F.lit(1).cast("long")).withColumn("gbdt", F.round("gbdt", 9))
    pool = own.orderBy(F.desc("bm25"), "doc_id").limit(1000).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25"), "doc_id")))
    return ranking.rerank(pool.withColumnRenamed("bm25", "score")).withColumn("final_score", F.round("final_score", 6))


@query(RERANK_SQL + " SELECT query_id, doc_id, is_head, final_score, final_rank FROM o")
def gbdt_rerank(spark, sf_dir):
    return _reranked(spark, sf_dir)


@query(RERANK_SQL + " SELECT query_id, doc_id, final_score, final_rank FROM o WHERE final_rank > 10 AND final_rank <= 20")
def result_page(spark, sf_dir):
    return ranking.page(_reranked(spark, sf_dir), 2, 10).drop("is_head")


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.prepare(parse.documents(load(spark, sf_dir, "pages")))
    return parse.indexable(docs).withColumnRenamed("page_id", "doc_id").withColumn("crawled_at", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 40 * 86400))


def _asked(spark) -> DataFrame:
    return spark.createDataFrame([(1, "the edition"), (2, "die und"), (3, "what is 2 + 3 * 4"), (4, "example thther")], "query_id long, text string")


def _found(spark, sf_dir) -> DataFrame:
    """A batch of queries over the stored index of all pages, spelling from its dictionary.

    The index is named after its format and the pages' files, so it is built once for each state of them.
    """
    state = tables.state_of(load(spark, sf_dir, "pages"))
    index = Index(spark, f"{shared_dir(spark)}/pages-index-{FORMAT}-{state}", buckets=8)
    if not index.segments():
        docs = tables.saved(search_docs(spark, sf_dir), "parsed")  # the index reads them twice
        index.commit(docs, "pages")
        tables.discard(docs)
    return S.search(index.documents(), _asked(spark), F.timestamp_seconds(F.lit(1704067200 + 40 * 86400)), words=index.dictionary(), index=index)


@query()
def search_pages(spark, sf_dir):
    """Pages are parsed once, stored and indexed, then searched end to end."""
    return _found(spark, sf_dir).drop("instant")


@query()
def search_responses(spark, sf_dir):
    return S.response(_found(spark, sf_dir))


@query(f"""SELECT page_id, CASE WHEN page_id % 9 = 3 THEN 'backoff' WHEN page_id % 9 = 4 THEN 'drop' ELSE 'keep' END AS verdict FROM pages""")
def status_gate(spark, sf_dir):
    own = load(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 9 == 3, 503).when(F.col("page_id") % 9 == 4, 404).otherwise(200).alias("status"))
    return crawl.status_gate(own).select("page_id", "verdict")


@query(f"""SELECT DISTINCT regexp_replace(dst, '/$', '') AS url, regexp_extract(dst, '^[a-z]+://([^/:?#]+)', 1) AS domain, 0.85::DOUBLE AS priority FROM ({LINKS})""")
def link_expansion(spark, sf_dir):
    return crawl.expand(parse.documents(load(spark, sf_dir, "pages")))


@query(f"""WITH u AS (SELECT DISTINCT regexp_replace(dst, '/$', '') AS url FROM ({LINKS})) SELECT count(*) AS urls FROM u""")
def frontier_count(spark, sf_dir):
    """The size of a frontier that all followed links were pushed into, twice."""
    found = tables.saved(crawl.expand(parse.documents(load(spark, sf_dir, "pages"))), "links")
    frontier = crawl.push(spark.createDataFrame([], FRONTIER), found)
    return crawl.frontier_size(crawl.push(frontier, found))


@query(r"""WITH p AS (SELECT regexp_replace(url, '#.*$', '') AS u FROM pages), s AS (SELECT regexp_extract(u, '^[^?]*') AS a, regexp_extract(u, '\?(.*)$', 1) AS q FROM p)
    SELECT DISTINCT regexp_replace(a, '/$', '') || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS url, regexp_extract(a, '^[a-z]+://([^/:?#]+)', 1) AS domain, 1.0::DOUBLE AS priority FROM s""")
def seed_urls(spark, sf_dir):
    """All pages as a curated list."""
    return crawl.seeds(load(spark, sf_dir, "pages").select("url"))


@query("SELECT 'ok' AS status, '1' AS version, count(*) AS documents FROM pages")
def health(spark, sf_dir):
    return tables.health(load(spark, sf_dir, "pages"), "1")


ROBOTS = ["/admin/", "/en/7", "/fr/"], ["/en/72", "/fr/8"]


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    m AS (SELECT page_id, max(CASE WHEN starts_with(path, x) THEN length(x) ELSE -1 END) AS d FROM p, unnest(['/admin/', '/en/7', '/fr/']) t(x) GROUP BY page_id),
    a AS (SELECT page_id, max(CASE WHEN starts_with(path, x) THEN length(x) ELSE -1 END) AS a FROM p, unnest(['/en/72', '/fr/8']) t(x) GROUP BY page_id)
    SELECT page_id, a >= d AS allowed FROM m JOIN a USING (page_id)""")
def robots_match(spark, sf_dir):
    text = "User-agent: *\n" + "".join(f"Disallow: {p}\n" for p in ROBOTS[0]) + "".join(f"Allow: {p}\n" for p in ROBOTS[1])
    rules = spark.createDataFrame([(text,)], "text string").select(crawl.robots_rules()("text").alias("r"))
    own = load(spark, sf_dir, "pages").crossJoin(F.broadcast(rules))  # one row of rules
    return own.select("page_id", crawl.robots_allowed(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), F.col("r.disallow"), F.col("r.allow")).alias("allowed"))
