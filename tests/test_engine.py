"""Facts about the search engine's operators on small tables."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomsearch.functions import text as X
from loomsearch.functions import urls as U
from loomsearch.operators import crawl, dedup, instant, linkgraph, parse, ranking, retrieval, session, understand, vectors
from loomsearch.plans import text_queries
from loomsearch.schema import Settings, SnapshotError
from loomsearch.sources import crawl_log, tables


def one(spark, expression, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, F.lit(value))
    return df.select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "base", "want"),
    [
        ("HTTPS://Example.COM/Path?b=2&a=1#frag", None, "https://example.com/Path?a=1&b=2"),
        ("https://example.com:443/page", None, "https://example.com/page"),
        ("../other.html", "https://example.com/dir/page.html", "https://example.com/other.html"),
        ("http://a.com/x/", None, "http://a.com/x"),
        ("http://a.com/", None, "http://a.com/"),
        ("mailto:x@y.z", None, None),
        ("http://a.com:99999/", None, None),
        (None, None, None),
    ],
)
def test_normalise(url, base, want):
    assert U.normalise(url, base) == want


def test_words_stems_and_snippets():
    stems = [X.stem_english(w) for w in "quick brown foxes jumping jumps running happily relational hopping".split()]
    assert stems == ["quick", "brown", "fox", "jump", "jump", "run", "happili", "relat", "hop"]
    assert X.unicode_words("ﬁnd GitHub.com v1.2.3 state-of")[:4] == ["find", "github.com", "v1.2.3", "state"]
    assert X.bold_spans("Hello world, hello", ["hello", "low"]) == "<b>Hello</b> world, <b>hello</b>"
    got = X.make_snippet("Rust is a language for systems. Nothing here at all. Rust is fast and rust is safe.", "rust fast")
    assert got.count("<b>") >= 2
    assert X.make_snippet("short", "") == "short"


def test_model_tokens(spark):
    ids = one(spark, X.model_tokens(10)(F.col("t")), t="hello world")
    assert (len(ids), ids[0], ids[-1]) == (4, 101, 102)
    assert len(one(spark, X.model_tokens(5)(F.col("t")), t="a b c d e f")) == 5
    pair = one(spark, X.pair_tokens(4, 4)(F.col("t"), F.col("t")), t="a b")
    assert len(pair.ids) == len(pair.mask) == len(pair.types) == 11


def test_distances_and_deletes(spark):
    for a, b, d in (("kitten", "sitting", 3), ("rust", "ruts", 2), ("teh", "the", 2)):
        assert one(spark, F.levenshtein("a", "b"), a=a, b=b) == d
    assert set(one(spark, X.deletes(F.col("w"), 1), w="abc")) == {"abc", "bc", "ac", "ab"}
    assert one(spark, X.l2_normalise(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, X.l2_normalise(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


PAGE = """<html lang="en"><head><title>Test Page - Example Site</title><meta name="description" content="About"><meta property="og:title" content="OG">
<link rel="canonical" href="/c"><script type="application/ld+json">{"a":1}</script></head><body><nav><p>one two three four five six</p></nav>
<h2>Two</h2><h1>One</h1><p>this page has a body of more than five words<p>and an unclosed second paragraph of words here that make twenty in all
<div class="shadow"><p>boilerplate words that must not be in the text</p></div><a href="/x#f" rel="nofollow">X</a><a href="/x#f">again</a><img alt=" pic "></body></html>"""


def test_parse():
    d = parse.parse_page(PAGE, "https://e.com/test-page")
    assert (d["title"], d["language"], d["meta_description"], d["canonical_url"], d["og_tags"]["title"]) == ("Test Page", "en", "About", "/c", "OG")
    assert d["headings"] == [{"level": 1, "text": "One"}, {"level": 2, "text": "Two"}]
    assert d["outgoing_links"] == [{"url": "https://e.com/x#f", "anchor_text": "X", "is_followed": False}]
    assert (d["url_tokens"], d["alt_texts"], d["structured_data"]) == (["test", "page"], ["pic"], ['{"a":1}'])
    assert "second paragraph" in d["body"] and "boilerplate" not in d["body"] and "one two three" not in d["body"]
    assert parse.parse_page(None, "")["word_count"] == 0


def test_simhash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a b c d e f g h i"), (3, "a b c d e f g x y"), (4, "p q r s"), (5, None)], "doc_id long, text string")
    h = {r.doc_id: r.simhash for r in dedup.simhash(docs).collect()}
    assert h[1] == h[2] and h[5] == 0
    assert bin(h[1] ^ h[3]).count("1") < 30 and bin(h[1] ^ h[4]).count("1") > 5
    near = dedup.near_pairs(spark.createDataFrame([(0,), (1,), (7,), (1 << 59,)], "simhash long"))
    assert {(r.a, r.b): r.distance for r in near.collect()} == {(0, 1): 1, (0, 7): 3, (1, 7): 2, (0, 1 << 59): 1, (1, 1 << 59): 2}


def test_near_pairs_are_never_broadcast(spark):
    """Few bytes of fingerprints become 35 rows each: they are merged however small Spark takes them for."""
    hashes = spark.createDataFrame([(k * 0x9E3779B97F4A7 % (1 << 60),) for k in range(300)] + [(1,), (3,)], "simhash long")
    near = dedup.near_pairs(hashes)
    assert (1, 3, 1) in {tuple(r) for r in near.collect()}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_capitals_by_letter(spark):
    """One letter for one letter, as in SQL; what has no single capital stays."""
    for text, want in (("ßa", "ẞa"), ("ﬁn", "ﬁn"), ("ŉa", "ŉa"), ("ᾳx", "ᾼx"), ("éa", "Éa"), ("ab", "Ab"), ("", ""), ("ǆx", "Ǆx"), ("ß", "ẞ")):
        assert one(spark, X.capitalise(F.col("t")), t=text) == want


def tokens(spark):
    docs = spark.createDataFrame([(1, "Rust", "rust is a systems language"), (2, "Python", "python is a dynamic language"), (3, "Other", "nothing")], "doc_id long, title string, body string")
    return retrieval.field_tokens(docs, ["title", "body"])


def test_search(spark):
    q = spark.createDataFrame([(1, ["rust"]), (2, ["language"]), (3, ["javascript"])], "query_id long, terms array<string>")
    got = retrieval.top(retrieval.search(tokens(spark), q, retrieval.BOOSTS), 10).select("query_id", "doc_id", "rank").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 1), (2, 2, 2)]


@pytest.mark.parametrize(("text", "want"), [("rust OR python", {1, 2}), ("language AND rust", {1}), ("+language -rust", {2}), ('"dynamic language"', {2}), ("title:rust^2", {1}), ("language NOT python", {1}), ("-rust", set()), ("+language +(rust python)", {1, 2}), ("title:[p TO q]", {2}), ("(rust OR python) AND NOT dynamic", {1})])
def test_boolean(spark, text, want):
    assert {r.doc_id for r in retrieval.boolean(tokens(spark), text, ["title", "body"]).collect()} == want


@pytest.mark.parametrize("text", ["(rust", "rust)", "AND", ""])
def test_boolean_errors(spark, text):
    with pytest.raises(ValueError):
        retrieval.boolean(tokens(spark), text, ["body"])


def test_fusion(spark):
    lists = [spark.createDataFrame([(1, d, k + 1) for k, d in enumerate(x)], "query_id long, doc_id long, rank int") for x in ([1, 2, 3], [2, 4, 1])]
    got = [r.doc_id for r in retrieval.fuse(lists).orderBy(F.desc("score"), "doc_id").collect()]
    assert got[:2] == [2, 1] and len(got) == 4


def test_trees(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(0.5, 3, 32)]) for k in range(200)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    got = {r.k: r.s for r in df.select("k", ranking.ensemble([F.col("v")[i] for i in range(32)]).alias("s")).collect()}
    for k, v in rows:
        assert abs(got[k] - 0.1 * sum(ranking.evaluate(t, v) for t in ranking.TREES)) < 1e-12


def test_rerank(spark):
    rows = [(1, d, d, 10.0 - d, g) for d, g in ((1, 0.1), (2, 0.5), (3, 0.1), (4, 0.5))]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, rank int, score double, gbdt double")
    got = [(r.doc_id, r.is_head) for r in ranking.rerank(df, 2).orderBy("final_rank").collect()]
    assert got == [(2, True), (4, True), (1, False), (3, False)]
    assert ranking.page(ranking.rerank(df, 2), 0, 99).count() == 4


def test_pagerank(spark):
    cycle = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    assert all(abs(r.pagerank - 1 / 3) < 0.01 for r in linkgraph.pagerank(cycle).collect())
    star = spark.createDataFrame([(0, k) for k in range(1, 5)], "src long, dst long")
    assert abs(sum(r.pagerank for r in linkgraph.pagerank(star).collect()) - 1) < 1e-6
    seeded = {r.id: r.s for r in linkgraph.pagerank(star, {"s": F.col("id") == 0}).collect()}
    assert seeded[0] > seeded[1] > 0


@pytest.mark.parametrize("few", [1000, 0])
def test_spelling(spark, monkeypatch, few):
    monkeypatch.setattr(understand, "FEW", few)
    words = spark.createDataFrame([("the", 9), ("there", 3), ("their", 3), ("they", 3), ("programming", 2), ("python", 1), ("rust", 1), ("java", 1)], "word string, freq long")
    fix = lambda t, most: {r.term: r.word for r in understand.corrections(spark.createDataFrame([(t,)], "term string"), words, most).collect()}.get(t)
    assert (fix("teh", 2), fix("the", 2), fix("pythn", 1), fix("rudt", 1)) == ("the", None, "python", None)
    q = spark.createDataFrame([(1, ["programing", "language"]), (2, ["java"])], "query_id long, terms array<string>")
    assert {r.query_id: r.correction for r in understand.correct(q, words).collect()} == {1: "programming language", 2: None}


def test_intent(spark):
    q = spark.createDataFrame([(1, "github.com login"), (2, 'how does "page rank" work'), (3, "zebra")], "query_id long, text string")
    got = {r.query_id: (r.intent, list(r.phrases), r.enhanced) for r in understand.parse_queries(q).collect()}
    assert got == {1: ("Navigational", [], False), 2: ("Informational", ["page rank"], False), 3: ("Informational", [], True)}


def test_vectors(spark):
    rows = [(k, [float(np.sin(k * (j + 1) / 7)) for j in range(8)]) for k in range(1, 101)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.where("vec_id = 50").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    got = vectors.exact_top(df, q, 5).orderBy("rank").collect()
    assert len(got) == 5 and got[0].vec_id == 50
    assert vectors.lsh_top(df, q, 5, dimension=8).where("rank = 1").first().vec_id == 50
    assert one(spark, vectors.cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))) == 1
    assert sum(one(spark, vectors.embed()(F.col("t")), t="x")) == 0


def test_pair_tokens_reads_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(["internationally"] * 40))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    x = text_queries.pair_tokens(spark, str(tmp_path)).first()
    # 101, the query side up to its own limit of 32 words, 102.
    assert x.types.split().index("1") == 34


def test_linguistic_terms_reads_all_languages(spark, tmp_path):
    rows = [(1, "running dogs", "en"), (2, "läuft schnell", "de"), (3, "running ciudad", "es"), (4, "sans langue", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.term: r.df for r in text_queries.linguistic_terms(spark, str(tmp_path)).collect()}
    assert got["run"] == 2 and {"dog", "läuft", "ciudad", "san", "langu"} <= set(got)


def test_exact_top_in_blocks(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(120)], "vec_id long, embedding array<double>").cache()
    q = df.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    got = lambda **how: {(r.query_id, r.vec_id, r.rank) for r in vectors.exact_top(df, q, 5, **how).collect()}
    assert got(most_queries=12) == got() and len(got()) == 150


def test_lsh_recall(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, rng.normal(size=64).tolist()) for k in range(1000)], "vec_id long, embedding array<double>").cache()
    q = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    pairs = lambda x: {(r.query_id, r.vec_id) for r in x.collect()}
    exact = pairs(vectors.exact_top(df, q, 10))
    assert len(exact) == 200 and len(exact & pairs(vectors.lsh_top(df, q, 10))) >= 0.9 * len(exact)
    # A query with fewer than k vectors in its buckets still gets k.
    few = df.where("vec_id < 12")
    assert vectors.lsh_top(few, q, 10, probes=1).count() == 200


def test_lsh_by_hand(spark):
    """Every vector in one of a query's buckets counts and no other, whatever the tiles and blocks; none of them is shuffled."""
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=64).tolist()) for k in range(1500)]
    rows += [(1500 + k, rows[100][1]) for k in range(20)]  # equal ones go by id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).cache()
    q = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    all_ = np.array([v for _, v in rows])
    normals = np.random.default_rng(7).normal(size=(8, 10, 64))
    sides = np.einsum("nd,tpd->ntp", all_, normals)
    own = ((sides > 0) << np.arange(10)).sum(2)
    flips = [[c >> p & 1 for p in range(10)] for c in range(1024)]
    unit = all_ / np.linalg.norm(all_, axis=1)[:, None]
    want = set()
    for i in range(0, 1520, 50):
        near = [own[i, t] ^ np.argsort(sides[i, t] ** 2 @ np.array(flips, float).T, kind="stable")[:20] for t in range(8)]
        met = np.flatnonzero(np.any([np.isin(own[:, t], near[t]) for t in range(8)], axis=0))
        met = met if len(met) >= 10 else np.arange(1520)
        s = np.round(unit[met] @ unit[i], 9)
        want |= {(i, int(met[j]), n + 1) for n, j in enumerate(np.lexsort((met, -s))[:10])}
    for most in (10_000, 7):
        out = vectors.lsh_top(df, q, 10, probes=20, most_queries=most)
        assert {(r.query_id, r.vec_id, r.rank) for r in out.collect()} == want
    plan = vectors.lsh_top(df, q, 10, probes=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "embedding" not in plan.split("MapInArrow")[0] and "Generate" not in plan


def test_exact_top_orders_as_its_sql(spark):
    """Similarities that agree in nine decimals tie and go by id, over many tiles and batches; a partition gives k rows a query."""
    rows = [(k, [1.0, 1e-5 * (4 - k) ** 0.5, 0.0]) for k in (3, 2, 1)] + [(k, [0.0, 1.0, float(k % 7)]) for k in range(4, 4500)] + [(9000, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "query_id long, vec array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.exact_top(df, q, 3).collect()}
    assert [got[1, n] for n in (1, 2, 3)] == [1, 2, 3] and [got[2, n] for n in (1, 2, 3)] == [7, 14, 21]
    assert vectors._nearest(df, q, 3, "vec_id", "embedding", 100).count() == 6


def test_python_functions_take_bounded_pieces(spark):
    """Whatever a partition holds, a function of pandas gets 2,000 rows at most and one of Arrow 2 MB; results keep their rows."""
    from loomsearch.functions.vectorised import BATCH_ROWS, PIECE, arrow_vectorised, vectorised

    df = spark.range(9000).select("id", F.repeat(F.lit("x"), 3000).alias("t")).coalesce(1)
    rows = vectorised("long")(lambda t: t.map(lambda _: len(t)))
    size = arrow_vectorised("long")(lambda t: pa.array([sum(len(x) for x in t.to_pylist())] * len(t)))
    got = df.select(rows("t").alias("rows"), size("t").alias("size")).agg(F.max("rows").alias("rows"), F.max("size").alias("size"), F.count("*").alias("n")).first()
    assert got.n == 9000 and got.rows <= BATCH_ROWS and got["size"] <= PIECE
    texts = df.select("id", F.concat(F.col("id").cast("string"), F.lit(" "), "t").alias("t"))
    assert texts.select("id", X.model_tokens(8)("t").alias("i")).where(F.expr("i[1] != 1000 + 0") & (F.size("i") == 4)).count() == 9000
    ids = {r.id: r.i[1] for r in texts.select("id", X.model_tokens(8)("t").alias("i")).where("id % 1000 = 7").collect()}
    assert ids == {k: X.model_ids(str(k), 8)[1] for k in ids}
    assert X.model_ids("a b c d", 5) == X.model_ids("a b c", 5) and len(X.model_ids("a b c d", 5)) == 5


def test_pages_are_parsed_once(spark, tmp_path):
    """Filters on what the parser gave are not moved below it, which would parse each page again."""
    from loomsearch.plans import page_queries

    spark.createDataFrame([(1, "http://a.com/x", PAGE), (2, "http://b.com/", '<a href="/y">t</a><a href="z/">u</a>')], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("page_links", "anchor_texts"):
        plan = getattr(page_queries, name)(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
    assert page_queries.frontier_count(spark, str(tmp_path)).first().urls == 2  # one of the three is not followed
    assert "EvalPython" not in page_queries.frontier_count(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.page_id, r.href) for r in page_queries.page_links(spark, str(tmp_path)).collect()} == {(1, "x/x#f"), (2, "x/y"), (2, "x/z/")}


def test_embedding(spark):
    got = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "id long, t string").select("id", vectors.embed(vectors.hashed_features, 16)("t").alias("v")).collect()
    want = {1: vectors.hashed_features("a b a"), 2: np.zeros(16), 3: np.zeros(16)}
    assert all(r.v == pytest.approx(np.asarray(want[r.id][:16], np.float32).tolist()) for r in got)


def test_ranks_are_never_broadcast(spark, tmp_path, monkeypatch):
    """A round's tables would go through the driver each time."""
    plans, saved = [], tables.saved
    monkeypatch.setattr(linkgraph, "saved", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or saved(df, name))
    got = linkgraph.pagerank(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")], "src string, dst string"), iterations=3)
    assert sum(r.pagerank for r in got.collect()) == pytest.approx(1) and any("SortMergeJoin" in p for p in plans)
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_postings_by_hand(spark):
    """Terms with their positions, where the rows are; counts for unique ids, null ids and repeated ones."""
    rows = [(1, ["b", "a", "b"]), (2, []), (None, ["a", "é"]), (3, ["c"] * 3 + ["b"])]
    own = spark.createDataFrame(rows, "doc_id long, tokens array<string>").withColumn("field", F.lit("text")).coalesce(1)
    got = retrieval.positional(own)
    assert {(r.term, r.doc_id, r.tf, r.len, tuple(r.pos)) for r in got.collect()} == {("b", 1, 2, 3, (0, 2)), ("a", 1, 1, 3, (1,)), ("a", None, 1, 2, (0,)), ("é", None, 1, 2, (1,)), ("c", 3, 3, 4, (0, 1, 2)), ("b", 3, 1, 4, (3,))}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in retrieval.term_counts(own).collect()} == {("a", 1, 2), ("b", 2, 3), ("é", 0, 1), ("c", 1, 3)}
    assert not retrieval.repeats(own) and retrieval.repeats(own.union(own))


def test_terms_of_repeated_ids(spark, tmp_path):
    """Two documents of one id count once in a term's document frequency."""
    spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "a"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in text_queries.tok_terms(spark, str(tmp_path)).collect()} == {("a", 2, 3), ("b", 1, 1), ("c", 1, 1)}


def test_index_deals_a_bucket_to_many_tasks(spark, tmp_path):
    """No task writes a whole bucket; ids follow the URLs, and a document without URL is kept."""
    from loomsearch.operators.index import Index

    rows = [(f"u{k:03}", f"common word{k}") for k in range(200)] + [("u000", "common word0"), (None, "no url")]
    index = Index(spark, f"file://{tmp_path}/index", {"text": 1.0}, buckets=1)
    assert index.commit(spark.createDataFrame(rows, "url string, text string").repartition(3), "a")
    got = [r.url for r in index.documents().orderBy("doc_id").collect()]
    assert got == [None, *[f"u{k:03}" for k in range(200)]] and [r.doc_id for r in index.documents().select("doc_id").orderBy("doc_id").collect()] == list(range(201))
    files = list((tmp_path / "index").glob("segment-*/postings/bucket=0/*.parquet"))
    assert len(files) >= 3 and max(spark.read.parquet(str(f)).count() for f in files) < 200
    assert index.postings().where("term = 'common'").count() == 200


def test_robots(spark):
    text = "User-agent: *\nDisallow: /admin/\nDisallow: /private/\nAllow: /admin/public/\nCrawl-delay: 2\nSitemap: http://s/m.xml"
    rules = crawl.parse_robots(text, ("me",))
    assert (rules["delay_ms"], rules["sitemaps"]) == (2000, ["http://s/m.xml"])
    own = crawl.parse_robots("User-agent: *\nDisallow: /\n\nUser-agent: me\nDisallow: /secret/", ("me",))
    assert own["disallow"] == ["/secret/"]
    allowed = lambda path: one(spark, crawl.robots_allowed(F.lit(path), F.array(*map(F.lit, rules["disallow"])), F.array(*map(F.lit, rules["allow"]))))
    assert (allowed("/admin/settings"), allowed("/admin/public/x"), allowed("/x")) == (False, True, True)


def test_quality_and_schedule(spark):
    assert one(spark, crawl.link_spam(F.lit(100), F.lit(10))) == 0.8
    assert one(spark, crawl.thin(F.lit(20))) == 0.6
    score = lambda url: one(spark, crawl.spam_score(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(url), F.lit("t")))
    assert score("http://a.xyz/") > score("http://a.com/") == 0
    assert abs(one(spark, crawl.change_probability(F.lit(3.0), F.lit(3.0))) - 0.632) < 1e-3
    visits = spark.createDataFrame([("a", 0), ("a", 6), ("a", 11), ("a", 18), ("a", 24), ("b", 0)], "url string, h int").withColumn("crawled_at", F.timestamp_seconds(F.col("h") * 3600))
    assert {r.url: r.hours for r in crawl.recrawl_hours(visits).collect()} == {"a": 12.0, "b": 366.0}


def test_frontier(spark):
    frontier = spark.createDataFrame([], "url string, domain string, priority double, last_crawled timestamp, change_prob double, crawl_count int, next_crawl_at timestamp")
    urls = spark.createDataFrame([("u1", "d", 0.5), ("u2", "d", 0.9), ("u1", "d", 0.7)], "url string, domain string, priority double")
    f = crawl.push(frontier, urls)
    assert f.count() == 2 and crawl.push(f, urls).count() == 2
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    popped = crawl.pop(f, now)
    assert popped.first().url == "u2"
    assert crawl.pop(crawl.lease(f, popped), now).first().url == "u1"
    done = crawl.record(f, spark.createDataFrame([("u2",)], "url string").withColumn("crawled_at", now))
    assert {r.url: (r.priority, r.crawl_count) for r in done.collect()} == {"u1": (0.7, 0), "u2": (0.5, 1)}


def test_sessions(spark):
    check = lambda a, b: one(spark, session.is_reformulation(F.lit(a), F.lit(b)))
    assert check("rust async programming", "rust async await programming") and not check("a b", "c d")
    assert not one(spark, session.is_reformulation(F.lit("a"), F.lit(None).cast("string")))


@pytest.mark.parametrize(("text", "want"), [("2 + 3 * 4", "14"), ("7 / -2", "-3"), ("2 ^ 0.5", "1.414214"), ("1 / 0", None), ("(1", None), ("", None), ("5", "5"), ("9" * 30, None), ("what is 3 * (2 + 1)", "9")])
def test_calculator(text, want):
    got = instant.calculate(text)
    assert (got and got[1]) == want


def test_crawl_log(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text {k} é") for k in range(20)], "doc_id long, text string")
    crawl_log.write(df, str(tmp_path / "log"), rotate_bytes=200)
    crawl_log.write(df.limit(1), str(tmp_path / "log"))
    names = sorted(p.name for p in (tmp_path / "log").glob("crawl-*.log"))
    assert len(names) > 2 and names[0] == "crawl-00000000.log"
    assert crawl_log.read(spark, str(tmp_path / "log"), "doc_id long, text string").count() == 21
    data = crawl_log.frame(iter(['{"a":1}', "no json", '{"a":2}']))
    assert list(crawl_log.unframe(data[:-1])) == ['{"a":1}'] and len(list(crawl_log.unframe(data))) == 2


def test_snapshots(spark, tmp_path):
    df = spark.range(3)
    for n in "abcd":
        tables.snapshot(spark, {"t": df}, str(tmp_path), n, keep=3)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["snapshot_b", "snapshot_c", "snapshot_d"]
    for bad in ("../x", "a/b", "a\\b", ""):
        with pytest.raises(SnapshotError):
            tables.snapshot(spark, {"t": df}, str(tmp_path), bad)


def test_settings(monkeypatch):
    monkeypatch.setenv("LOOMSEARCH_RRF_K", "10")
    monkeypatch.setenv("LOOMSEARCH_ENABLE_INSTANT_ANSWERS", "false")
    s = Settings.load()
    assert (s.rrf_k, s.enable_instant_answers, s.bm25_k1) == (10, False, 1.2)


LANGUAGE = [("rust", {1}), ("language -rust", {2}), ('"dynamic language"', {2}), ('"language dynamic"', set()), ("title:rust^2 python", {1, 2}), ("language NOT python", {1}), ("-rust", set()), ("(rust OR python) AND NOT dynamic", {1}), ("+language +(rust python)", {1, 2}), ("title:[p TO q]", {2}), ("is AND (nothing OR systems)", {1})]


def test_index(spark, tmp_path):
    """Ranked queries of the language over a stored index equal the unranked ones; replaced and deleted documents go."""
    from loomsearch.operators.index import Index

    docs = spark.createDataFrame([("u1", "Rust", "rust is a systems language"), ("u2", "Python", "python is a dynamic language"), ("u3", "Other", "nothing")], "url string, title string, body string")
    index = Index(spark, f"file://{tmp_path}/index", {"title": 5.0, "body": 1.0})
    assert index.commit(docs, "a") and not index.commit(docs, "a")
    got = index.ask(dict(enumerate(t for t, _ in LANGUAGE))).join(index.documents().select("doc_id", "url"), "doc_id").collect()
    for k, (_, want) in enumerate(LANGUAGE):
        assert {int(r.url[1:]) for r in got if r.query_id == k} == want
    score = {(r.query_id, r.url): r.score for r in got}
    assert score[(4, "u1")] == pytest.approx(2 * score[(4, "u2")] / 6 * 5, rel=0.5) and score[(4, "u1")] > score[(4, "u2")]
    q = spark.createDataFrame([(0, ["rust", "language"])], "query_id long, terms array<string>")
    plain = {r.doc_id: r.score for r in index.search(q).collect()}
    from_texts = retrieval.search(retrieval.field_tokens(index.documents(), ["title", "body"]), q, index.fields)
    assert plain == pytest.approx({r.doc_id: r.score for r in from_texts.collect()})
    asked = {r.doc_id: r.score for r in index.ask({0: "rust language"}).collect()}
    assert asked == pytest.approx(plain)
    index.commit(spark.createDataFrame([("u2", "Snake", "a snake"), ("u4", "New", "more rust")], docs.schema), "b")
    assert index.count().first().documents == 4 and {r.url for r in index.documents().collect()} == {"u1", "u2", "u3", "u4"}
    assert index.ask({0: "python"}).count() == 0 and index.ask({0: "snake"}).count() == 1
    ids = {r.url: r.doc_id for r in index.documents().collect()}
    assert len(set(ids.values())) == 4 and index.urls(spark.createDataFrame([(ids["u4"],), (99,)], "doc_id long")).first().url == "u4"
    index.delete(spark.createDataFrame([(ids["u1"],)], "doc_id long"))
    assert index.ask({0: "rust"}).count() == 1 and index.stats().where("field = 'body'").first().n_docs == 3
    assert {r.word: r.freq for r in index.dictionary().collect()}["rust"] == 1


def test_dense_ids(spark, tmp_path):
    """Many rows over many partitions get each id once, in order."""
    df = spark.range(3_000_000).selectExpr("xxhash64(id) % 1000000 as url", "id as nth").repartition(7)
    ids = crawl_log.with_ids(df, start=5)
    ids.write.parquet(f"{tmp_path}/ids")
    got = spark.read.parquet(f"{tmp_path}/ids").agg(F.count_distinct("doc_id").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    assert (got.n, got.a, got.b) == (3_000_000, 5, 3_000_004)
    bounds = spark.read.parquet(f"{tmp_path}/ids").groupBy((F.col("doc_id") - 5 >= 1_500_000).alias("half")).agg(F.min("url").alias("a"), F.max("url").alias("b")).orderBy("half").collect()
    assert bounds[0].b <= bounds[1].a


def test_fetch_and_robots_cache(spark):
    rows = [(1, 200, "text/html; charset=x", "a"), (2, 200, "image/png", "a"), (3, 301, "image/png", "a"), (4, 404, "text/html", "a"), (5, 200, "application/xhtml+xml", "a" * 99), (6, 200, None, "a")]
    df = spark.createDataFrame(rows, "page_id long, status int, content_type string, html string")
    assert {r.page_id for r in parse.fetched(df, 50).collect()} == {1, 3}
    assert one(spark, crawl.crawl_delay_ms(F.lit(0))) == 1000 and one(spark, crawl.crawl_delay_ms(F.lit(250))) == 250
    at = lambda h: F.timestamp_seconds(F.lit(1_700_000_000 + h * 3600))
    cache = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 3, -30)], "domain string, rules int, h int").withColumn("fetched_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("h") * 3600))
    assert {(r.domain, r.rules) for r in crawl.fresh_robots(cache, at(21)).collect()} == {("a", 2)}


def test_tombstones(spark):
    docs = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3")], "doc_id long, url string")
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    dead = crawl.tombstone(crawl.tombstone(None, docs.where("doc_id = 1"), "gone", now), docs.where("doc_id < 3"), "spam", now)
    assert {(r.doc_id, r.reason) for r in dead.collect()} == {(1, "gone"), (2, "spam")}
    assert [r.doc_id for r in crawl.live(docs, dead).collect()] == [3] and crawl.live(docs, crawl.cleared(dead)).count() == 3
    seeds = crawl.seeds(spark.createDataFrame([("HTTP://A.com/x/",), ("http://a.com/x",), ("ftp://b",)], "url string")).collect()
    assert [tuple(r) for r in seeds] == [("http://a.com/x", "a.com", 1.0)]


def test_saved_graph_and_vectors(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    linkgraph.save(f"file://{tmp_path}/g", edges, linkgraph.pagerank(edges, iterations=3))
    own, ranks = linkgraph.load(spark, f"file://{tmp_path}/g")
    assert own.count() == 2 and ranks.count() == 3
    got = {r.url: r.pagerank for r in linkgraph.ranks_of(ranks, spark.createDataFrame([("a",), ("z",)], "url string")).collect()}
    assert got["z"] == 0 and got["a"] > 0
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "doc_id long, vec array<float>")
    vectors.save(vecs, f"file://{tmp_path}/v", 2)
    back = vectors.load(spark, f"file://{tmp_path}/v", 2)
    assert back.count() == 2 and vectors.current(back, spark.createDataFrame([(2,)], "doc_id long")).first().doc_id == 2
    assert vectors.non_zero(back).count() == 1
    with pytest.raises(Exception, match="dimension 2"):
        vectors.load(spark, f"file://{tmp_path}/v", 3).collect()


def test_pagerank_by_hand(spark):
    """Until stable and by a fixed number of rounds, against plain loops; some nodes dangle."""
    pairs = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2), (3, 4), (5, 4)]
    seeds = {1, 3}
    df = spark.createDataFrame(pairs, "src long, dst long")

    def plain(teleport, rounds):
        n, out = 6, Counter(a for a, _ in pairs)
        r = {v: 1 / n for v in range(n)}
        for _ in range(rounds):
            lost = sum(r[v] for v in r if not out[v])
            r = {v: (0.15 + 0.85 * lost) * teleport[v] + 0.85 * sum(r[a] / out[a] for a, b in pairs if b == v) for v in r}
        return r

    even, some = dict.fromkeys(range(6), 1 / 6), {v: (v in seeds) / 2 for v in range(6)}
    both = {"pagerank": None, "s": F.col("id").isin(*seeds)}
    for rounds in (1, 4):
        got = {r.id: (r.pagerank, r.s) for r in linkgraph.pagerank(df, both, iterations=rounds).collect()}
        assert got == {v: pytest.approx((plain(even, rounds)[v], plain(some, rounds)[v])) for v in range(6)}
    got = {r.id: (r.pagerank, r.s) for r in linkgraph.pagerank(df, both).collect()}
    assert all(got[v] == pytest.approx((plain(even, 200)[v], plain(some, 200)[v]), abs=1e-5) for v in range(6))


def test_cross_rerank(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 30, 3)], "query_id long, doc_id long, final_rank int")
    cross = spark.createDataFrame([(1, 30, 0.9), (1, 20, 0.1)], "query_id long, doc_id long, cross double")
    assert [r.doc_id for r in ranking.cross_rerank(ranked, cross).orderBy("final_rank").collect()] == [30, 20, 10]
    assert ranking.cross_rerank(ranked, None) is ranked
    assert one(spark, ranking.softmax_second(F.lit(1.0), F.lit(1.0))) == 0.5 and one(spark, ranking.softmax_second(F.lit(0.0), F.lit(3.0))) == pytest.approx(0.9525741)


def test_folders_and_sessions(spark, tmp_path):
    tables.init_dirs(spark, f"file://{tmp_path}/root")
    assert tables.names_in(spark, f"file://{tmp_path}/root") == ["crawl", "graph", "index", "snapshots", "vectors"]
    used, capacity = tables.disk_usage(spark, f"file://{tmp_path}")
    assert 0 < used <= capacity
    own = tables.saved(spark.range(3), "scratch")
    tables.discard(own)
    assert not any(tables.exists(spark, f) for f in own.inputFiles())
    ids = session.new_ids(spark.range(50)).select("session_id").distinct().count()
    assert ids == 50


def test_streams(spark, tmp_path):
    """Session windows, upserts over several batches, and a log that grows while it is tailed."""
    from loomsearch.operators.index import Index
    from loomsearch.streaming import streams

    base = f"file://{tmp_path}"
    at = lambda m: F.timestamp_seconds(F.lit(1_700_000_000) + m * 60)
    rows = [("a", 0), ("a", 10), ("a", 90), ("b", 5)]
    spark.createDataFrame(rows, "k string, m int").withColumn("t", at(F.col("m"))).write.parquet(f"{base}/in")
    stream = streams.files(spark, f"{base}/in", "k string, m int, t timestamp")
    got = {(r.k, r.n) for r in streams.drain(streams.session_windows(stream, "k", "t"), "sessions", "complete").collect()}
    assert got == {("a", 2), ("a", 1), ("b", 1)}
    schema = "k string, t long, v string"
    for part in ([("x", 1, "old"), ("y", 1, "y")], [("x", 2, "new"), ("z", 1, "z")], [("x", 1, "late")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{base}/rows")
        own = streams.files(spark, f"{base}/rows", schema)
        streams.upsert(own, f"{base}/state", f"{base}/check", "k", "t", "v", buckets=3).trigger(availableNow=True).start().awaitTermination()
    assert {(r.k, r.v) for r in streams.state(spark, f"{base}/state", schema).collect()} == {("x", "new"), ("y", "y"), ("z", "z")}
    index = Index(spark, f"{base}/index", {"text": 1.0})
    for part in ([("u1", "first words"), ("u2", "second")], [("u1", "replaced"), ("u3", "third")]):
        crawl_log.write(spark.createDataFrame(part, "url string, text string"), f"{base}/log")
        log = streams.tail(spark, f"{base}/log", "url string, text string").drop("file", "pos")
        streams.index_into(log, index, f"{base}/tail").trigger(availableNow=True).start().awaitTermination()
    assert {(r.url, r.text) for r in index.documents().collect()} == {("u1", "replaced"), ("u2", "second"), ("u3", "third")}
