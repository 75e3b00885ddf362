"""Query understanding: intent, synonyms, special tokens, spelling, reformulation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomsearch.functions.text import deletes, query_tokens, quoted_phrases
from loomsearch.sources.tables import saved

# Cue words of each intent, in order of precedence, and their confidences.
NAVIGATIONAL = "go goto navigate site login homepage".split()
LOCAL = "near nearby directions map local".split()
TRANSACTIONAL = "buy price cheap deal order purchase download free coupon discount shop".split()
INFORMATIONAL = "how what why when where who which define meaning tutorial guide explain difference vs versus compare".split()
SYNONYMS = {
    "fast": ["quick", "rapid", "speedy"],
    "big": ["large", "huge", "enormous"],
    "small": ["tiny", "little", "compact"],
    "cheap": ["affordable", "inexpensive", "budget"],
    "good": ["great", "excellent", "quality"],
    "bad": ["poor", "terrible", "awful"],
    "fix": ["repair", "solve", "resolve"],
    "error": ["bug", "issue", "problem"],
}
SYNONYM_WEIGHT = 0.3
REFORMULATION_STOPS = "a an the is are was were be".split()


def intent(terms: Column) -> Column:
    """struct(intent, confidence) of query terms."""
    has = lambda words: F.arrays_overlap(terms, F.array(*map(F.lit, words)))
    site = F.exists(terms, lambda t: t.contains(".") & (t.contains("com") | t.contains("org") | t.contains("net")))
    pick = lambda name, c: F.struct(F.lit(name).alias("intent"), F.lit(c).alias("confidence"))
    return F.when(site | has(NAVIGATIONAL), pick("Navigational", 0.85)).when(has(LOCAL), pick("Local", 0.80)).when(has(TRANSACTIONAL), pick("Transactional", 0.75)).when(has(INFORMATIONAL), pick("Informational", 0.80)).otherwise(pick("Informational", 0.55))


def intent_sql(terms: str) -> str:
    has = lambda words: f"list_has_any({terms}, [{', '.join(repr(w) for w in words)}])"
    site = f"len(list_filter({terms}, lambda t: contains(t, '.') AND (contains(t, 'com') OR contains(t, 'org') OR contains(t, 'net')))) > 0"
    cases = [(f"{site} OR {has(NAVIGATIONAL)}", "Navigational", 0.85), (has(LOCAL), "Local", 0.80), (has(TRANSACTIONAL), "Transactional", 0.75), (has(INFORMATIONAL), "Informational", 0.80)]
    name = " ".join(f"WHEN {t} THEN '{n}'" for t, n, _ in cases)
    sure = " ".join(f"WHEN {t} THEN {c}::DOUBLE" for t, _, c in cases)
    return f"CASE {name} ELSE 'Informational' END AS intent, CASE {sure} ELSE 0.55::DOUBLE END AS confidence"


def synonyms(terms: Column) -> Column:
    """array(struct(term, synonym, weight))."""
    table = F.create_map(*[x for w, s in SYNONYMS.items() for x in (F.lit(w), F.array(*map(F.lit, s)))])
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(terms, lambda t: F.transform(F.coalesce(table[t], none), lambda s: F.struct(t.alias("term"), s.alias("synonym"), F.lit(SYNONYM_WEIGHT).alias("weight")))))


def versions(terms: Column) -> Column:
    return F.filter(terms, lambda t: t.rlike(r"^v?[0-9.]*\.[0-9.]*$") & t.rlike("[0-9]"))


def numeric_ranges(text: Column) -> Column:
    """array(struct(min, max)) of a-b in the raw query, dollar signs allowed."""
    pairs = F.regexp_extract_all(text, F.lit(r"(\$?\d+(?:\.\d+)?-\$?\d+(?:\.\d+)?)"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^\$?([\d.]+)-", 1).cast("double").alias("min"), F.regexp_extract(p, r"-\$?([\d.]+)$", 1).cast("double").alias("max")))


def enhanced(confidence: Column, terms: Column) -> Column:
    return (confidence < 0.7) | (F.size(terms) >= 8)


def reformulate(text: Column) -> Column:
    """Lower-case query without articles and forms of be."""
    return F.array_join(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: ~w.isin(REFORMULATION_STOPS)), " ")


def dictionary(postings: DataFrame) -> DataFrame:
    """(word, freq) of lower-case terms of 2 to 30 bytes: documents that hold them."""
    own = postings.select(F.lower("term").alias("word"), "doc_id").where(F.octet_length("word").between(2, 30))
    return own.distinct().groupBy("word").agg(F.count("*").alias("freq"))


#: Unknown terms that are compared directly.
FEW = 1000


def corrections(terms: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """(term, word): the best known word for each unknown term (column term).

    A word counts if the characters removed from both, until they are equal, are `most` in all. Up to FEW
    unknown terms are held against the dictionary, more of them by symmetric deletes: both sides'
    strings with characters removed meet in an equi-join. Ranked by edit distance, then frequency,
    then the word.
    """
    usable = terms.select("term").distinct().where((F.octet_length("term") > 2) & ~F.col("term").rlike("[0-9]"))
    unknown = usable.join(words.select(F.col("word").alias("term")), "term", "left_anti")
    few = [r.term for r in unknown.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        # A stated few against the dictionary, which is read once: lengths and edits rule out nearly all words.
        rows = [(t, n) for t in few for n in range(max(len(t) - most, 1), len(t) + most + 1)]
        asked = terms.sparkSession.createDataFrame(rows, "term string, size int")
        near = words.withColumn("size", F.length("word")).join(F.broadcast(asked), "size").where(F.levenshtein("term", "word") <= most)
        parts = F.array_intersect(deletes(F.col("term"), most), deletes(F.col("word"), most))
        met = near.where(F.exists(parts, lambda p: F.length("term") + F.length("word") - 2 * F.length(p) <= most)).select("term", "word", "freq")
    else:
        left = unknown.select("term", F.explode(deletes(F.col("term"), most)).alias("part"))
        right = words.select("word", "freq", F.explode(deletes(F.col("word"), most)).alias("part"))
        met = left.join(right, "part").withColumn("removed", F.length("term") + F.length("word") - 2 * F.length("part")).where(F.col("removed") <= most).select("term", "word", "freq").distinct()
    order = Window.partitionBy("term").orderBy(F.levenshtein("term", "word"), F.desc("freq"), "word")
    return met.withColumn("k", F.row_number().over(order)).where("k = 1").select("term", "word")


def correct(queries: DataFrame, words: DataFrame) -> DataFrame:
    """queries (query_id, terms) with correction: null where nothing changed. One edit for up to four terms, else two."""
    words = saved(words, "dictionary")
    each = queries.select("query_id", F.size("terms").alias("n"), F.posexplode("terms").alias("pos", "term"))
    short, long_ = (corrections(each.where(test), words, most).withColumn("few", F.lit(few)) for test, most, few in (("n <= 4", 1, True), ("n > 4", 2, False)))
    fixed = each.withColumn("few", F.col("n") <= 4).join(short.unionByName(long_), ["term", "few"], "left")
    out = fixed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("word", "term").alias("w")))), lambda x: x["w"]), " ").alias("text"), F.max(F.col("word").isNotNull()).alias("changed"))
    return queries.join(out.select("query_id", F.when(F.col("changed"), F.col("text")).alias("correction")), "query_id", "left")


def parse_queries(queries: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """queries (query_id, text) with terms, phrases, intent, synonyms, versions, ranges, the enhanced flag and, given a dictionary, the correction."""
    out = queries.withColumn("terms", query_tokens("text")).withColumn("phrases", quoted_phrases(F.col("text"))).withColumn("i", intent(F.col("terms")))
    out = out.select("*", "i.intent", "i.confidence").drop("i").withColumn("synonyms", synonyms(F.col("terms"))).withColumn("versions", versions(F.col("terms"))).withColumn("ranges", numeric_ranges(F.col("text"))).withColumn("enhanced", enhanced(F.col("confidence"), F.col("terms")))
    return out.withColumn("correction", F.lit(None).cast("string")) if words is None else correct(out, words)
