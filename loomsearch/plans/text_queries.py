"""Registered queries: text, retrieval, fusion, snippets, vectors, deduplication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomsearch.catalog import query
from loomsearch.functions import text as X
from loomsearch.operators import dedup, ranking, retrieval, understand, vectors
from loomsearch.operators.index import Index
from loomsearch.plans import search as S
from loomsearch.sources.tables import load, shared_dir

TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '' AND strlen(x) < 40)"
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
#: Queries of the benchmark: id and text.
ASKED = ((1, "the and tion"), (2, "der die und"), (3, "que las"), (4, "idiot clown that"), (5, "licensed license version"))
ASKED_SQL = "(VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in ASKED) + ") q(query_id, text)"


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ASKED, "query_id long, text string")


def tokens_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.field_tokens(load(spark, sf_dir, "documents"), ["text"])


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term")
def tok_terms(spark, sf_dir):
    if retrieval.repeats(load(spark, sf_dir, "documents")):
        return retrieval.postings(tokens_of(spark, sf_dir)).groupBy("term").agg(F.count("doc_id").alias("df"), F.sum("tf").alias("tf"))
    return retrieval.term_counts(tokens_of(spark, sf_dir))


@query(f"SELECT 'text' AS field, count(*) AS n_docs, round(avg(len(t)), 6) AS avg_len FROM (SELECT {TOKENS} AS t FROM documents)")
def field_stats(spark, sf_dir):
    return retrieval.field_stats(tokens_of(spark, sf_dir)).select("field", "n_docs", F.round("avg_len", 6).alias("avg_len"))


BM25_SQL = f"""
    WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
    q AS (SELECT DISTINCT query_id, unnest({TOKENS}) AS term FROM {ASKED_SQL}),
    p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM t) GROUP BY ALL),
    m AS (SELECT * FROM p SEMI JOIN q USING (term)), d AS (SELECT term, count(*) AS df FROM m GROUP BY term),
    s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM m JOIN d USING (term) JOIN q USING (term), n GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""


def _bm25(spark, sf_dir) -> DataFrame:
    terms = asked(spark).select("query_id", X.index_tokens(F.col("text")).alias("terms"))
    found, stats = retrieval.matches(tokens_of(spark, sf_dir), terms)
    return retrieval.score(found, stats, terms).withColumn("score", F.round("score", 9))


@query(BM25_SQL + " SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 20")
def bm25_topk(spark, sf_dir):
    return retrieval.top(_bm25(spark, sf_dir), 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(BM25_SQL + " SELECT query_id, doc_id, rank::INT AS rank, (SELECT count(*) FROM r x WHERE x.query_id = r.query_id AND x.rank <= 15) AS total_hits FROM r WHERE rank > 10 AND rank <= 15")
def bm25_page(spark, sf_dir):
    return retrieval.top(_bm25(spark, sf_dir), 5, offset=10).select("query_id", "doc_id", "rank", "total_hits")


@query(BM25_SQL + f""", l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY len DESC, doc_id) AS rank FROM s JOIN (SELECT doc_id, len(w) AS len FROM t) USING (doc_id)),
    u AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS part FROM r WHERE rank <= 100 UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM l WHERE rank <= 100),
    f AS (SELECT query_id, doc_id, sum(part) AS score FROM u GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 6) AS score FROM f""")
def rrf_fusion(spark, sf_dir):
    """BM25 and length order of the same matches, fused."""
    scored = _bm25(spark, sf_dir)
    by_length = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("len"), "doc_id"))).where("rank <= 100")
    return retrieval.fuse([retrieval.top(scored, 100), by_length]).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(r"""
    WITH p AS (SELECT page_id AS doc_id, trim(regexp_split_to_array(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[-|—–]')[1]) AS title, regexp_replace(html, '<[^>]*>', ' ', 'g') AS body, url AS url_tokens FROM pages),
    t AS (SELECT doc_id, field, list_filter(regexp_split_to_array(lower(x), '[^\p{L}\p{N}]+'), lambda x: x <> '' AND strlen(x) < 40) AS w, boost
          FROM (SELECT doc_id, 'title' AS field, title AS x, 5.0 AS boost FROM p UNION ALL SELECT doc_id, 'body', body, 1.0 FROM p UNION ALL SELECT doc_id, 'url_tokens', url_tokens, 2.0 FROM p)),
    n AS (SELECT field, count(*) AS n, avg(len(w)) AS a FROM t GROUP BY field),
    m AS (SELECT field, doc_id, boost, len, term, count(*) AS tf FROM (SELECT field, doc_id, boost, len(w) AS len, unnest(w) AS term FROM t) WHERE term IN ('the', 'die', 'example', 'then') GROUP BY ALL),
    d AS (SELECT field, term, count(*) AS df FROM m GROUP BY ALL),
    s AS (SELECT doc_id, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM m JOIN d USING (field, term) JOIN n USING (field) GROUP BY doc_id)
    SELECT 1::BIGINT AS query_id, doc_id, round(score, 6) AS score FROM s""")
def bm25_multi_field(spark, sf_dir):
    from loomsearch.operators.parse import title_of

    docs = load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), title_of(F.col("html")).alias("title"), F.regexp_replace("html", "<[^>]*>", " ").alias("body"), F.col("url").alias("url_tokens"))
    terms = spark.createDataFrame([(1, ["the", "die", "example", "then"])], "query_id long, terms array<string>")
    out = retrieval.search(retrieval.field_tokens(docs, ["title", "body", "url_tokens"]), terms, retrieval.BOOSTS)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS t FROM documents) WHERE contains(t, ' of the ')")
def phrase_search(spark, sf_dir):
    return retrieval.phrase(tokens_of(spark, sf_dir), ["of", "the"], ["text"])


@query(f"SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string({TOKENS}, ' ') || ' ' AS t FROM documents) WHERE contains(t, ' of the ') AND (contains(t, ' idiot ') OR contains(t, ' version ')) AND NOT contains(t, ' scum ')")
def boolean_search(spark, sf_dir):
    return retrieval.boolean(tokens_of(spark, sf_dir), '"of the" AND (idiot OR version) AND NOT scum', ["text"])


@query("SELECT doc_id, n_sentences::INT AS n_sentences, sentences FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda x: trim(x, ' ')), lambda x: strlen(x) > 10) AS s, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences FROM documents)")
def sentences(spark, sf_dir):
    own = load(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return own.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("sentences"))


@query()
def snippets(spark, sf_dir):
    """Snippets of the best ten documents of each query."""
    best = retrieval.top(_bm25(spark, sf_dir), 10).join(asked(spark), "query_id")
    return best.join(load(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")), "doc_id").select("query_id", "doc_id", "rank", X.snippet("body", "text").alias("snippet"))


@query(r"""SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
    replace(replace(replace(text, ' ', '+'), '&', '%26'), '#', '%23') AS url_escaped, upper(substr(text, 1, 1)) || substr(text, 2) AS capital FROM documents""")
def escapes(spark, sf_dir):
    own = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", X.html_escape(own).alias("escaped"), X.url_escape(own).alias("url_escaped"), X.capitalise(own).alias("capital"))


@query(f"SELECT doc_id, len({WORDS})::INT AS word_count, len({WORDS}) >= 20 AS indexable FROM documents")
def word_counts(spark, sf_dir):
    own = load(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("word_count"))
    return own.withColumn("indexable", F.col("word_count") >= 20)


def _ids_sql(most: int) -> str:
    """Ids of the first words: a hash of each word's bytes, modulo 2^64, into 1,000 to 29,999."""
    code = "list_reduce([5381::HUGEINT] || list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::HUGEINT), lambda h, b: (h * 33 + b) % 18446744073709551616)"
    return f"list_transform(list_slice({WORDS.replace('text', 'lower(text)')}, 1, {most}), lambda w: ({code} % 29000 + 1000)::INT)"


@query(f"SELECT doc_id, array_to_string([101] || {_ids_sql(62)} || [102], ' ') AS ids FROM documents")
def model_tokens(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(X.model_tokens(64)("text").cast("array<string>"), " ").alias("ids"))


@query(f"""WITH p AS (SELECT doc_id, [101] || {_ids_sql(32)} || [102] AS q, {_ids_sql(128)} || [102] AS p FROM documents), n AS (SELECT *, 163 - len(q) - len(p) AS pad FROM p)
    SELECT doc_id, array_to_string(q || p || list_transform(range(pad), lambda x: 0), ' ') AS ids,
        array_to_string(list_transform(range(163), lambda x: (x < 163 - pad)::INT), ' ') AS mask, array_to_string(list_transform(range(163), lambda x: (x >= len(q) AND x < 163 - pad)::INT), ' ') AS types FROM n""")
def pair_tokens(spark, sf_dir):
    own = load(spark, sf_dir, "documents").select("doc_id", X.pair_tokens()("text", "text").alias("x"))
    return own.select("doc_id", *[F.array_join(F.col(f"x.{c}").cast("array<string>"), " ").alias(c) for c in ("ids", "mask", "types")])


@query()
def linguistic_terms(spark, sf_dir):
    """Document frequencies of stemmed terms; documents of all languages are stemmed as English."""
    own = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(X.linguistic_tokens("text"))).alias("term"))
    return own.groupBy("term").agg(F.count("*").alias("df"))


HASHED = r"('0x' || substr(md5(w), 1, 15))::BIGINT"


@query(f"""WITH t AS (SELECT doc_id, unnest({WORDS}) AS w FROM documents), h AS (SELECT doc_id, {HASHED} AS h FROM t),
    v AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, range(60) r(b) GROUP BY ALL),
    s AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS simhash FROM v GROUP BY doc_id)
    SELECT doc_id, coalesce(simhash, 0) AS simhash FROM documents LEFT JOIN s USING (doc_id)""")
def simhash_doc(spark, sf_dir):
    return dedup.simhash(load(spark, sf_dir, "documents"))


@query(f"""WITH t AS (SELECT doc_id, unnest({WORDS}) AS w FROM documents), h AS (SELECT doc_id, {HASHED} AS h FROM t),
    v AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, range(60) r(b) GROUP BY ALL),
    s AS (SELECT DISTINCT sum(CASE WHEN v > 0 THEN 1::BIGINT << b ELSE 0 END)::BIGINT AS simhash FROM v GROUP BY doc_id)
    SELECT x.simhash AS a, y.simhash AS b, bit_count(xor(x.simhash, y.simhash))::INT AS distance FROM s x JOIN s y ON x.simhash < y.simhash AND bit_count(xor(x.simhash, y.simhash)) <= 3""")
def near_dup_pairs(spark, sf_dir):
    return dedup.near_pairs(dedup.simhash(load(spark, sf_dir, "documents")))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def exact_dup(spark, sf_dir):
    own = load(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return dedup.first_of_each(own, "text_md5", [F.col("doc_id")])


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def url_upsert_latest(spark, sf_dir):
    """Events as upserts with the user as key."""
    return dedup.latest(load(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, vec_id, list_cosine_similarity(qv::DOUBLE[], embedding::DOUBLE[]) AS similarity FROM q, embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank::INT AS rank FROM r WHERE rank <= 10""")
def cosine_topk(spark, sf_dir):
    """Searches for every vector whose id is divisible by 50, against all vectors."""
    own = load(spark, sf_dir, "embeddings")
    asked_ = own.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return vectors.exact_top(own, asked_, 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("int").alias("rank"))


@query("SELECT count(*) AS queries, 10 * count(*) AS found, true AS recall_of_0_9 FROM embeddings WHERE vec_id % 50 = 0")
def ann_recall(spark, sf_dir):
    """The approximate top ten of every query against the exact one."""
    own = load(spark, sf_dir, "embeddings")
    asked_ = own.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    near = vectors.lsh_top(own, asked_, 10).select("query_id", "vec_id", F.lit(1).alias("near"))
    both = vectors.exact_top(own, asked_, 10).select("query_id", "vec_id", F.lit(1).alias("exact")).join(near, ["query_id", "vec_id"], "full")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("near").alias("found"), (F.count_if(F.col("near").isNotNull() & F.col("exact").isNotNull()) >= 0.9 * F.count("exact")).alias("recall_of_0_9"))


@query()
def ann_lsh(spark, sf_dir):
    own = load(spark, sf_dir, "embeddings")
    asked_ = own.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return vectors.lsh_top(own, asked_, 10)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS unit_sum FROM embeddings")
def vector_normalise(spark, sf_dir):
    own = load(spark, sf_dir, "embeddings")
    total = F.aggregate(X.l2_normalise(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)
    return own.select("vec_id", F.round(X.l2_norm(F.col("embedding")), 4).alias("norm"), F.round(total, 4).alias("unit_sum"))


@query()
def embed_passages(spark, sf_dir):
    own = load(spark, sf_dir, "documents").select("doc_id", vectors.passage(F.col("source"), F.col("text")).alias("passage"))
    return vectors.non_zero(own.select("doc_id", vectors.embed(vectors.hashed_features)("passage").alias("vec")))


CHANGED = "source = 'src1'"


@query(f"""WITH d AS (SELECT CASE WHEN {CHANGED} THEN 'replaced ' || source ELSE coalesce(text, '') END AS text FROM documents),
    t AS (SELECT row_number() OVER () AS r, {TOKENS} AS w FROM d)
    SELECT term, count(DISTINCT r) AS df, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) GROUP BY term""")
def index_upsert(spark, sf_dir):
    """All documents are indexed, then those of one source come in again with another text."""
    docs = load(spark, sf_dir, "documents").select(F.format_string("u%d", "doc_id").alias("url"), "source", F.coalesce("text", F.lit("")).alias("text"))
    index = Index(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", {"text": 1.0}, buckets=8)
    again = docs.where(CHANGED).withColumn("text", F.concat(F.lit("replaced "), "source"))
    for batch, own in (("all", docs), ("again", again), ("again", again)):
        index.commit(own, batch)
    return index.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


#: Queries of the language, and how SQL scores them: what must hold, and the score.
SYNTAX = {
    1: ("+idiot version -scum", "idiot > 0 AND scum = 0", "idiot + version"),
    2: ('"of the" AND (idiot^2 OR version)', "phrase > 0 AND (idiot > 0 OR version > 0)", "phrase + 2 * idiot + version"),
    3: ("idiot NOT clown", "idiot > 0 AND clown = 0", "idiot"),
    4: ("text:scum OR text:clown", "scum > 0 OR clown > 0", "scum + clown"),
}


@query(rf"""WITH d AS (SELECT doc_id, {TOKENS} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
    c AS (SELECT doc_id, len(w) AS len, {", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS n_{t}" for t in ("idiot", "version", "scum", "clown", "of", "the"))},
        len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS n_phrase FROM d),
    i AS (SELECT {", ".join(f"ln(1 + (any_value(n) - count_if(n_{t} > 0) + 0.5) / (count_if(n_{t} > 0) + 0.5)) AS i_{t}" for t in ("idiot", "version", "scum", "clown", "of", "the"))} FROM c, n),
    s AS (SELECT doc_id, {", ".join(f"i_{t} * 2.2 * n_{t} / (n_{t} + 1.2 * (0.25 + 0.75 * len / a)) AS {t}" for t in ("idiot", "version", "scum", "clown"))},
        (i_of + i_the) * 2.2 * n_phrase / (n_phrase + 1.2 * (0.25 + 0.75 * len / a)) AS phrase FROM c, i, n)
    {" UNION ALL ".join(f"SELECT {q}::BIGINT AS query_id, doc_id, round({score}, 6) AS score FROM s WHERE {test}" for q, (_, test, score) in SYNTAX.items())}""")
def ranked_syntax(spark, sf_dir):
    """Required, excluded and boosted words, a phrase and a field, ranked over the postings."""
    tokens = tokens_of(spark, sf_dir)
    found = retrieval.ranked(retrieval.positional(tokens), retrieval.field_stats(tokens), {q: t for q, (t, *_) in SYNTAX.items()}, {"text": 1.0})
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"))


#: Searched end to end; the second has a letter missing.
SERVED = ((1, "idiot clown that"), (2, "licensd version"))


@query(rf"""WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
    p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM t) GROUP BY ALL),
    x AS (SELECT term AS word, count(*) AS freq FROM p WHERE strlen(term) BETWEEN 2 AND 30 GROUP BY term),
    q AS (SELECT query_id, nth, string_split(text, ' ')[nth] AS term FROM (VALUES {", ".join(f"({i}::BIGINT, '{t}')" for i, t in SERVED)}) v(query_id, text), range(1, 4) r(nth) WHERE nth <= len(string_split(text, ' '))),
    k AS (SELECT term, word, row_number() OVER (PARTITION BY term ORDER BY levenshtein(term, word), freq DESC, word) AS k FROM (SELECT DISTINCT term FROM q WHERE term NOT IN (SELECT word FROM x)), x
        WHERE abs(length(term) - length(word)) = 1 AND levenshtein(term, word) = 1),
    f AS (SELECT query_id, nth, coalesce(word, term) AS term, word IS NOT NULL AS changed FROM q LEFT JOIN (FROM k WHERE k = 1) USING (term)),
    y AS (SELECT query_id, CASE WHEN bool_or(changed) THEN string_agg(term, ' ' ORDER BY nth) END AS did_you_mean FROM f GROUP BY query_id),
    m AS (SELECT * FROM p SEMI JOIN f USING (term)), d AS (SELECT term, count(*) AS df FROM m GROUP BY term),
    s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len / a))), 9) AS bm25 FROM m JOIN d USING (term) JOIN (SELECT DISTINCT query_id, term FROM f) USING (term), n GROUP BY ALL),
    b AS (SELECT *, 1 / (1 + exp(doc_id % 40 + 1 - 30)) AS fresh, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id) AS rank FROM s QUALIFY rank <= 1000),
    g AS (SELECT *, round(0.1 * ({" + ".join(ranking.tree_sql(t, {0: "bm25", 6: "-10.0", 9: "fresh"}) for t in ranking.TREES)}), 9) AS gbdt FROM b),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gbdt DESC, rank) AS model_rank FROM g),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY model_rank > 20, CASE WHEN model_rank <= 20 THEN model_rank END, rank)::INT AS final_rank, count(*) OVER (PARTITION BY query_id) AS total_hits FROM h)
    SELECT query_id, final_rank, doc_id, total_hits, round(CASE WHEN model_rank <= 20 THEN gbdt ELSE bm25 END, 6) AS score, did_you_mean, 'bm25f,gbdt' AS phases FROM o JOIN y USING (query_id) WHERE final_rank <= 10""")
def search_served(spark, sf_dir):
    """Documents as one-field pages, searched with spelling from their own dictionary, reranked and paged."""
    empty = F.lit("")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.format_string("http://e.com/%d", "doc_id").alias("url"), empty.alias("title"), F.coalesce("text", empty).alias("body"), empty.alias("headings"), empty.alias("meta_description"), empty.alias("url_tokens"), F.timestamp_seconds(F.lit(1704067200) - F.col("doc_id") % 40 * 86400).alias("crawled_at"))
    words = understand.dictionary(retrieval.postings(tokens_of(spark, sf_dir)))
    found = S.search(docs, spark.createDataFrame(SERVED, "query_id long, text string"), F.timestamp_seconds(F.lit(1704067200 + 86400)), words=words)
    return found.select("query_id", "final_rank", "doc_id", "total_hits", F.round("score", 6).alias("score"), "did_you_mean", F.array_join("ranking_phases", ",").alias("phases"))
