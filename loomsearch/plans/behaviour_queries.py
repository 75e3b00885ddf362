"""Registered queries: query understanding, spelling, quality, crawl control, sessions, instant answers, sources, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsearch.catalog import query
from loomsearch.functions import text as X
from loomsearch.operators import crawl, instant, session, understand
from loomsearch.operators.index import Index
from loomsearch.plans.text_queries import WORDS
from loomsearch.sources import crawl_log
from loomsearch.sources.tables import histogram, load, metrics, shared_dir
from loomsearch.streaming import streams

#: Queries that reach every branch of query understanding.
LITERAL = (
    "github.com login", "how does page rank work", "pizza near me", "buy cheap shoes", "weather", 'say "hello world" and "good bye"', "python v3.11.2 release",
    "laptop $500-$900", "fast cars and big error", "the meaning of an index is what", "one two three four five six seven eight nine",
)
LITERAL_SQL = "(VALUES " + ", ".join(f"({k}::BIGINT, '{t}')" for k, t in enumerate(LITERAL)) + ") q(query_id, text)"
USERS_SQL = f"(SELECT query_id, text FROM {LITERAL_SQL} UNION ALL SELECT 1000 + conv_id * 100 + turn, text FROM conversations WHERE role = 'user')"
PLAIN = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}.]+'), lambda x: x <> '')"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    literal = spark.createDataFrame(list(enumerate(LITERAL)), "query_id long, text string")
    users = load(spark, sf_dir, "conversations").where("role = 'user'").select((1000 + F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    return literal.unionByName(users)


def plain_terms() -> F.Column:
    return F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}.]+"), lambda x: x != "")


@query(f"SELECT query_id, {understand.intent_sql('t')} FROM (SELECT query_id, {PLAIN} AS t FROM {USERS_SQL})")
def intent(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", understand.intent(plain_terms()).alias("i")).select("query_id", "i.intent", "i.confidence")


@query(f"SELECT query_id, i.confidence < 0.7 OR len(t) >= 8 AS enhanced FROM (SELECT query_id, t, {understand.intent_sql('t').replace('AS intent, ', 'AS intent_, ')} FROM (SELECT query_id, {PLAIN} AS t FROM {USERS_SQL})) i")
def enhanced_flag(spark, sf_dir):
    terms = plain_terms()
    return asked(spark, sf_dir).select("query_id", understand.enhanced(understand.intent(terms)["confidence"], terms).alias("enhanced"))


SYNONYM_SQL = "(VALUES " + ", ".join(f"('{w}', '{s}')" for w, ss in understand.SYNONYMS.items() for s in ss) + ") s(term, synonym)"


@query(f"SELECT query_id, term, synonym, 0.3::DOUBLE AS weight FROM (SELECT query_id, unnest({PLAIN}) AS term FROM {USERS_SQL}) JOIN {SYNONYM_SQL} USING (term)")
def synonyms(spark, sf_dir):
    own = asked(spark, sf_dir).select("query_id", F.explode(understand.synonyms(plain_terms())).alias("s"))
    return own.select("query_id", "s.term", "s.synonym", "s.weight")


@query(f"""SELECT query_id, phrase FROM (SELECT query_id, trim(unnest(regexp_extract_all(text, '"([^"]*)"', 1))) AS phrase FROM {USERS_SQL}) WHERE phrase <> ''""")
def phrases(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", F.explode(X.quoted_phrases(F.col("text"))).alias("phrase"))


@query(rf"""SELECT query_id, version, '' AS numbers FROM (SELECT query_id, unnest({PLAIN}) AS version FROM {USERS_SQL}) WHERE regexp_matches(version, '^v?[0-9.]*\.[0-9.]*$') AND regexp_matches(version, '[0-9]')
    UNION ALL SELECT query_id, '', unnest(list_transform(regexp_extract_all(text, '\$?\d+(?:\.\d+)?-\$?\d+(?:\.\d+)?'), lambda x: replace(x, '$', ''))) FROM {USERS_SQL}""")
def special_tokens(spark, sf_dir):
    own = asked(spark, sf_dir)
    versions = own.select("query_id", F.explode(understand.versions(plain_terms())).alias("version"), F.lit("").alias("numbers"))
    show = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    ranges = own.select("query_id", F.explode(understand.numeric_ranges(F.col("text"))).alias("r")).select("query_id", F.lit("").alias("version"), F.concat(show(F.col("r.min")), F.lit("-"), show(F.col("r.max"))).alias("numbers"))
    return versions.unionByName(ranges)


STOPS = ", ".join(f"'{w}'" for w in understand.REFORMULATION_STOPS)


@query(rf"SELECT query_id, array_to_string(list_filter(regexp_split_to_array(lower(trim(text)), '\s+'), lambda w: w NOT IN ({STOPS})), ' ') AS reworded FROM {USERS_SQL}")
def reformulate(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", understand.reformulate(F.col("text")).alias("reworded"))


@query()
def parsed_queries(spark, sf_dir):
    return understand.parse_queries(asked(spark, sf_dir)).select("query_id", "terms", "phrases", "intent", "confidence", "enhanced", "versions")


NAMES_SQL = "SELECT word, count(*) AS freq FROM (SELECT DISTINCT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[^a-z]+')) AS word FROM part) WHERE strlen(word) BETWEEN 2 AND 30 GROUP BY word"


def part_words(spark, sf_dir) -> DataFrame:
    own = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(F.split(F.lower("p_name"), "[^a-z]+")).alias("term"))
    return understand.dictionary(own)


@query(f"""WITH d AS ({NAMES_SQL}), t AS (SELECT DISTINCT typo AS term FROM (SELECT substr(word, 1, 1) || substr(word, 3) AS typo FROM d UNION ALL SELECT word || 'x' FROM d) WHERE strlen(typo) > 2 AND typo NOT IN (SELECT word FROM d)),
    v AS (SELECT word, freq, word AS part FROM d UNION SELECT word, freq, substr(word, 1, i - 1) || substr(word, i + 1) FROM d, range(1, 31) r(i) WHERE i <= length(word)),
    q AS (SELECT term, term AS part FROM t UNION SELECT term, substr(term, 1, i - 1) || substr(term, i + 1) FROM t, range(1, 32) r(i) WHERE i <= length(term)),
    m AS (SELECT DISTINCT term, word, freq FROM q JOIN v USING (part) WHERE length(term) + length(word) - 2 * length(part) <= 1)
    SELECT term, word FROM m QUALIFY row_number() OVER (PARTITION BY term ORDER BY levenshtein(term, word), freq DESC, word) = 1""")
def spell_candidates(spark, sf_dir):
    """Typos of part names, one letter lost or added, corrected within one edit."""
    words = part_words(spark, sf_dir)
    lost = F.concat(F.substring("word", 1, 1), F.col("word").substr(F.lit(3), F.length("word")))
    typos = words.select(lost.alias("term")).unionByName(words.select(F.concat("word", F.lit("x")).alias("term")))
    return understand.corrections(typos, words, 1)


@query(f"WITH d AS ({NAMES_SQL}) SELECT a.word AS a, b.word AS b, levenshtein(a.word, b.word)::INT AS distance FROM d a JOIN d b ON a.word < b.word AND substr(a.word, 1, 1) = substr(b.word, 1, 1)")
def edit_distance(spark, sf_dir):
    words = part_words(spark, sf_dir).select("word", F.substring("word", 1, 1).alias("k"))
    pairs = words.withColumnRenamed("word", "a").join(words.withColumnRenamed("word", "b"), "k").where("a < b")
    return pairs.select("a", "b", F.levenshtein("a", "b").alias("distance"))


STOP_SQL = ", ".join(f"'{w}'" for w in crawl.STOPWORDS)
STUFFING_SQL = f"""f AS (SELECT doc_id, max(c) / sum(c) AS ratio FROM (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, len({WORDS}) AS n, unnest({WORDS}) AS w FROM documents) WHERE n >= 20 AND lower(w) NOT IN ({STOP_SQL}) GROUP BY ALL) GROUP BY doc_id),
    k AS (SELECT doc_id, coalesce(CASE WHEN ratio > 0.25 THEN 0.8 WHEN ratio > 0.15 THEN 0.4 ELSE 0.0 END, 0.0)::DOUBLE AS stuffing FROM documents LEFT JOIN f USING (doc_id))"""


@query(f"WITH {STUFFING_SQL} SELECT doc_id, stuffing FROM k")
def stuffing(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", crawl.stuffing(F.col("text")).alias("stuffing"))


AD_SQL = ", ".join(f"'{w}'" for w in crawl.AD_TERMS)
PARTS_SQL = rf"""t AS (SELECT doc_id, text, {WORDS} AS w FROM documents),
    m AS (SELECT doc_id, len(w) AS n, (CASE WHEN len(w) < 50 THEN 0.6 WHEN len(w) < 100 THEN 0.3 WHEN len(w) < 200 THEN 0.1 ELSE 0.0 END)::DOUBLE AS thin,
        (CASE WHEN len(w) < 50 THEN 0.0 WHEN len(list_filter(w, lambda x: lower(x) IN ({AD_SQL}))) / len(w) > 0.05 THEN 0.6 WHEN len(list_filter(w, lambda x: lower(x) IN ({AD_SQL}))) / len(w) > 0.02 THEN 0.3 ELSE 0.0 END)::DOUBLE AS ads,
        length(regexp_replace(text, '[^|]', '', 'g')) AS links FROM t)"""


@query(f"WITH {PARTS_SQL} SELECT doc_id, thin, ads FROM m")
def thin_and_ads(spark, sf_dir):
    own = load(spark, sf_dir, "documents")
    return own.select("doc_id", crawl.thin(X.word_count(F.col("text"))).alias("thin"), crawl.ad_density(F.col("text")).alias("ads"))


@query(f"""WITH {STUFFING_SQL}, {PARTS_SQL}, l AS (SELECT doc_id, (CASE WHEN n = 0 THEN CASE WHEN links > 5 THEN 0.9 ELSE 0.0 END WHEN links / n > 0.2 THEN 0.8 WHEN links / n > 0.1 THEN 0.4 WHEN links / n > 0.05 THEN 0.15 ELSE 0.0 END)::DOUBLE AS link FROM m)
    SELECT doc_id, round(least(greatest(0.25 * stuffing + 0.25 * link + 0.2 * thin + 0.15 * ads + CASE WHEN doc_id % 3 = 0 THEN 0.1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 0.05 ELSE 0 END, 0), 1), 6) AS spam FROM k JOIN m USING (doc_id) JOIN l USING (doc_id)""")
def spam_score(spark, sf_dir):
    """Bars stand in for links; every third document has a suspicious host, every fifth no title."""
    own = load(spark, sf_dir, "documents")
    bars = F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))
    url = F.when(F.col("doc_id") % 3 == 0, "http://a.xyz/").otherwise("http://a.com/")
    title = F.when(F.col("doc_id") % 5 == 0, " ").otherwise("t")
    read = own.select("doc_id", bars.alias("bars"), crawl.word_scores(F.col("text")).alias("x"))
    score = crawl.spam_score(F.col("x.stuffing"), crawl.link_spam(F.col("bars"), F.col("x.words")), crawl.thin(F.col("x.words")), F.col("x.ads"), url, title)
    return read.select("doc_id", F.round(score, 6).alias("spam"))


@query("""SELECT event_id, user_id, value FROM (SELECT * FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 2) ORDER BY value DESC, event_id LIMIT 50""")
def frontier_pop(spark, sf_dir):
    """Events as due URLs, the value as priority, the user as domain: at most two of a domain."""
    own = load(spark, sf_dir, "events").where("event_type != 'error'").select(F.format_string("%012d", "event_id").alias("url"), F.col("user_id").cast("string").alias("domain"), F.col("value").alias("priority"), F.lit(None).cast("timestamp").alias("next_crawl_at"))
    return crawl.pop(own, F.timestamp_seconds(F.lit(1704067200)), 50, per_domain=2).select(F.col("url").cast("long").alias("event_id"), F.col("domain").cast("long").alias("user_id"), F.col("priority").alias("value"))


@query("SELECT user_id, event_id, nth::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 5")
def history_last5(spark, sf_dir):
    return crawl.last_visits(load(spark, sf_dir, "events"), 5, "user_id", "ts", "event_id").select("user_id", "event_id", "nth")


GAPS_SQL = "SELECT user_id, avg(gap) AS mean FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 3.6e9 AS gap FROM events) GROUP BY user_id"


@query(f"SELECT user_id, round(CASE WHEN mean IS NULL THEN 366 ELSE least(greatest(mean * ln(2), 12), 720) END, 6) AS hours FROM ({GAPS_SQL})")
def recrawl_delay(spark, sf_dir):
    return crawl.recrawl_hours(load(spark, sf_dir, "events"), "user_id", "ts").select("user_id", F.round("hours", 6).alias("hours"))


@query("SELECT event_id, round(CASE WHEN value - 20 <= 0 THEN 1.0 ELSE 1 - exp(-12 / (value - 20)) END, 6) AS probability FROM events")
def change_prob(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.round(crawl.change_probability(F.lit(12.0), F.col("value") - 20), 6).alias("probability"))


@query("SELECT event_id, round(least(5 * pow(2, event_id % 14), 3600) * (1 + 0.2 * 0.5), 6) AS seconds FROM events")
def backoff(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.round(crawl.backoff_s(F.col("event_id") % 14, F.lit(0.5)), 6).alias("seconds"))


@query("""SELECT event_id, coalesce(last_value(CASE WHEN value >= 50 THEN true WHEN value < 30 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS paused FROM events""")
def hysteresis(spark, sf_dir):
    own = load(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return crawl.hysteresis(own, "user_id", "at", "value").select("event_id", "paused")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def tombstone_filter(spark, sf_dir):
    return crawl.live(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels").where("toxic = 1")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2')")
def blacklist(spark, sf_dir):
    listed = spark.createDataFrame([("SRC1",), ("src2",)], "domain string")
    return crawl.blacklisted(load(spark, sf_dir, "documents"), listed, F.col("source")).select("doc_id")


@query(r"""WITH u AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM conversations WHERE role = 'user'),
    l AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM u)
    SELECT conv_id, turn, coalesce(len(list_intersect(w, p)) / nullif(greatest(len(w), len(p)), 0) > 0.5, false) AS is_reformulation FROM l""")
def session_reformulation(spark, sf_dir):
    own = load(spark, sf_dir, "conversations").where("role = 'user'")
    return session.reformulations(own, "conv_id", "turn", "text").select("conv_id", "turn", "is_reformulation")


@query("""SELECT event_id, array_to_string(list_reverse(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), ',') AS recent FROM events""")
def session_last5(spark, sf_dir):
    own = load(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return session.recent(own, "user_id", "at", "event_type").select("event_id", F.array_join("recent", ",").alias("recent"))


@query("SELECT p_partkey AS query_id, p_size || ' * (' || p_partkey || ' + 3) - ' || p_size || ' / 2 = ' || (p_size * (p_partkey + 3) - p_size // 2) AS answer FROM part")
def instant_calculator(spark, sf_dir):
    """A sum for each part; whole numbers divide without remainder."""
    text = F.format_string("what is %d * (%d + 3) - %d / 2", "p_size", "p_partkey", "p_size")
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), instant.calculation(text)["answer"].alias("answer"))


@query("SELECT p_partkey AS query_id, p_size || ' km = ' || printf('%.4f', p_size * 1000 / 1609.34) || ' miles' AS answer FROM part UNION ALL SELECT -1 - p_partkey, NULL FROM part")
def instant_units(spark, sf_dir):
    """A length for each part, and a question whose first `in` comes too early."""
    own = load(spark, sf_dir, "part")
    asked_ = own.select(F.col("p_partkey").alias("query_id"), F.format_string("%d km in miles", "p_size").alias("text")).unionByName(own.select((-1 - F.col("p_partkey")).alias("query_id"), F.format_string("%d in to cm", "p_size").alias("text")))
    return asked_.select("query_id", instant.units(F.col("text"))["answer"].alias("answer"))


@query("SELECT o_orderkey AS query_id, day(last_day(o_orderdate))::INT AS answer FROM orders")
def instant_days_in_month(spark, sf_dir):
    """The month of each order, by name and year."""
    text = F.concat(F.lit("how many days in "), F.lower(F.date_format("o_orderdate", "MMMM yyyy")))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), instant.days_in_month(text, F.make_date(F.lit(2023), F.lit(6), F.lit(1))).alias("answer"))


LONG_SQL = "strftime({0}, '%B ') || lpad(day({0})::VARCHAR, 2, ' ') || strftime({0}, ', %Y')"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, date_diff('day', DATE '1995-06-17', o_orderdate::DATE) AS n FROM orders)
    SELECT o_orderkey AS query_id, CASE WHEN n > 0 THEN n || ' days from now (' || {LONG_SQL.format('d')} || ')' WHEN n = 0 THEN 'That''s today! (' || {LONG_SQL.format('d')} || ')' ELSE -n || ' days ago (' || {LONG_SQL.format('d')} || ')' END AS answer FROM o""")
def instant_dates(spark, sf_dir):
    """Days until the date of each order, asked in June 1995."""
    text = F.concat(F.lit("days until "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    now = F.to_timestamp(F.lit("1995-06-17 12:30:00"))
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), instant.dates(text, now)["answer"].alias("answer"))


@query("SELECT s_suppkey AS query_id, '(noun) supplies nation ' || s_nationkey AS answer, 0.88::DOUBLE AS confidence FROM supplier")
def instant_define(spark, sf_dir):
    """Suppliers' names as words of the dictionary table."""
    own = load(spark, sf_dir, "supplier")
    table = own.select(F.col("s_name").alias("word"), F.lit("noun").alias("part_of_speech"), F.format_string("supplies nation %d", "s_nationkey").alias("definition"))
    found = instant.define(own.select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("what does "), "s_name", F.lit(" mean")).alias("text")), table)
    return found.select("query_id", "a.answer", "a.confidence")


@query("""WITH m AS (SELECT a.n_nationkey AS query_id, b.n_name, b.n_regionkey, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_name) AS k FROM nation a JOIN nation b ON a.n_name = b.n_name OR contains('the land of ' || lower(b.n_name), lower(a.n_name)))
    SELECT query_id, 'Nation — of region ' || n_regionkey AS answer, n_name AS name FROM m WHERE k = 1""")
def instant_entity(spark, sf_dir):
    """Nations as entities, found by name or by an alias that holds it."""
    own = load(spark, sf_dir, "nation")
    table = own.select(F.col("n_name").alias("name"), F.lit("Nation").alias("entity_type"), F.format_string("of region %d", "n_regionkey").alias("description"), F.concat(F.lit("the land of "), "n_name").alias("aliases"))
    found = instant.entity(own.select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("tell me about "), "n_name").alias("text")), table)
    return found.select("query_id", "a.answer", F.get_json_object("a.details", "$.name").alias("name"))


@query("SELECT doc_id, md5(text) AS text_md5, lang, source FROM documents")
def log_roundtrip(spark, sf_dir):
    """Documents written as a crawl log and read again."""
    path = f"{shared_dir(spark)}/crawl-log-{uuid.uuid4().hex}"
    crawl_log.write(load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), path, rotate_bytes=1 << 20)
    own = crawl_log.read(spark, path, "doc_id long, text string, lang string, source string")
    return own.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source")


@query("SELECT page_id, row_number() OVER (ORDER BY url, page_id) - 1 + 100 AS doc_id FROM pages")
def doc_ids(spark, sf_dir):
    own = load(spark, sf_dir, "pages").select("page_id", F.struct("url", "page_id").alias("k"))
    return crawl_log.with_ids(own, start=100, order="k").select("page_id", "doc_id")


@query("SELECT CASE b WHEN 9 THEN '+Inf' ELSE (['0.005', '0.01', '0.025', '0.05', '0.1', '0.25', '0.5', '1.0'])[b] END AS le, count(*) FILTER (b = 9 OR value / 100 <= ([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0])[b]) AS count FROM events, range(1, 10) r(b) GROUP BY b")
def latency_histogram(spark, sf_dir):
    return histogram(load(spark, sf_dir, "events").select((F.col("value") / 100).alias("s")), "s")


@query("""WITH s AS (SELECT event_type AS endpoint, count(*)::DOUBLE AS a, count_if(event_type = 'error')::DOUBLE AS b, count_if(user_id % 2 = 0)::DOUBLE AS c, count_if(user_id % 2 = 1)::DOUBLE AS d, count_if(value > 50)::DOUBLE AS e, round(sum(value / 100), 4) AS f, max(value / 100) AS g FROM events GROUP BY ALL)
    SELECT endpoint, unnest(['search_requests_total', 'search_errors_total', 'cache_hits_total', 'cache_misses_total', 'instant_answers_total', 'search_latency_seconds_sum', 'search_latency_seconds_max']) AS metric, unnest([a, b, c, d, e, f, round(g, 4)]) AS value FROM s""")
def request_metrics(spark, sf_dir):
    """Events as a request log."""
    log = load(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), (F.col("value") / 100).alias("seconds"), (F.col("user_id") % 2 == 0).alias("cached"), (F.col("value") > 50).alias("answered"))
    return metrics(log).select("endpoint", "metric", F.round("value", 4).alias("value"))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'quality' END AS reason FROM (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id) WHERE toxic = 1 OR quality = 0")
def tombstone_list(spark, sf_dir):
    """Toxic documents go, then those of low quality; what is gone is not listed twice."""
    own = load(spark, sf_dir, "labels").withColumn("url", F.format_string("u%d", "doc_id"))
    now = F.timestamp_seconds(F.lit(1704067200))
    first = crawl.tombstone(None, own.where("toxic = 1").dropDuplicates(["doc_id"]), "toxic", now)
    return crawl.tombstone(first, own.where("quality = 0").dropDuplicates(["doc_id"]), "quality", now).select("doc_id", "reason")


def _events(spark, sf_dir) -> DataFrame:
    return streams.files(spark, f"{sf_dir}/events*.parquet", load(spark, sf_dir, "events").schema)


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def stream_daily(spark, sf_dir):
    """Events as a stream: counts in daily windows."""
    rows = streams.drain(streams.windowed(_events(spark, sf_dir), "ts", "1 day", "1 day", by=("event_type",)), "daily", "complete")
    return rows.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT user_id, event_id, coalesce(last_value(CASE WHEN value >= 50 THEN true WHEN value < 30 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS paused FROM events""")
def stream_hysteresis(spark, sf_dir):
    rows = streams.drain(streams.paused(_events(spark, sf_dir), "user_id", "ts", "value", "event_id"), "paused")
    return rows.select(F.col("key").cast("long").alias("user_id"), F.col("tie").alias("event_id"), "paused")


@query("""SELECT user_id, event_id, array_to_string(list_reverse(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), ',') AS recent,
    coalesce(event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS is_reformulation FROM events""")
def stream_sessions(spark, sf_dir):
    rows = streams.drain(streams.recent_queries(_events(spark, sf_dir), "user_id", "ts", "event_type", "event_id"), "sessions")
    return rows.select(F.col("session_id").cast("long").alias("user_id"), F.col("tie").alias("event_id"), F.array_join("recent", ",").alias("recent"), "is_reformulation")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark, sf_dir):
    """Events as a stream of upserts, the user as key."""
    base = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    own = _events(spark, sf_dir)
    streams.upsert(own, f"{base}/rows", f"{base}/state", "user_id", "ts", "event_id", buckets=8).trigger(availableNow=True).start().awaitTermination()
    return streams.state(spark, f"{base}/rows", own.schema).select("user_id", "event_id", "event_type", "value")


@query("SELECT count(*) AS documents, sum(coalesce(len(regexp_split_to_array(trim(text, ' '), ' ')), 0))::BIGINT AS spaces FROM documents")
def stream_tail(spark, sf_dir):
    """A crawl log tailed into an index: every document arrives."""
    base = f"{shared_dir(spark)}/tail-{uuid.uuid4().hex}"
    crawl_log.write(load(spark, sf_dir, "documents").select(F.format_string("u%d", "doc_id").alias("url"), F.coalesce("text", F.lit("")).alias("text")), f"{base}/log", rotate_bytes=4 << 20)
    index = Index(spark, f"{base}/index", {"text": 1.0}, buckets=8)
    log = streams.tail(spark, f"{base}/log", "url string, text string").drop("file", "pos")
    streams.index_into(log, index, f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return index.documents().agg(F.count("*").alias("documents"), F.sum(F.size(F.split(F.trim("text"), " "))).alias("spaces"))
