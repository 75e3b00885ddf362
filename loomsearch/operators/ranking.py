"""Feature transform, tree ensemble, rerank, merge and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The ten trees. (feature, threshold, at most, above); numbers are leaves.
TREES = (
    (0, 5.0, (0, 2.0, 0.1, 0.4), (1, 0.5, 0.7, 1.0)),
    (1, 0.3, -0.1, (1, 0.8, 0.3, 0.6)),
    (6, -5.0, -0.2, (7, 0.3, 0.1, (22, 1.0, 0.25, 0.5))),
    (9, 0.5, -0.05, (9, 0.8, 0.1, 0.25)),
    (16, 0.3, 0.05, (16, 0.7, -0.3, -0.8)),
    (23, 2.3, -0.15, (23, 3.0, 0.05, 0.15)),
    (8, 3.0, (29, 0.5, 0.05, 0.1), -0.1),
    (24, 0.3, -0.05, (0, 3.0, 0.15, 0.35)),
    (3, 0.2, 0.0, 0.15),
    (29, 0.5, (7, 0.1, -0.05, 0.0), (7, 0.5, 0.1, 0.2)),
)
RATE = 0.1
#: Raw features by name; missing ones are 0.
RAW = (
    "bm25", "title_ratio", "body_ratio", "heading_ratio", "url_ratio", "exact_phrase", "pagerank", "domain_authority", "url_depth", "age_days",
    "spam", "pr_reference", "pr_news", "pr_commercial", "pr_academic", "inlinks", "words", "cosine", "reformulation", "session_topic", "https", "stuffing", "ai_content",
)


def slots(f: dict[str, Column]) -> list[Column]:
    """The 32 model inputs, one DOUBLE column each."""
    g = lambda name: f.get(name, F.lit(0.0)).cast("double")
    zero = F.lit(0.0)
    return [
        g("bm25"), g("title_ratio"), g("body_ratio"), g("heading_ratio"), g("url_ratio"), g("exact_phrase"),
        F.log10(g("pagerank") + 1e-10), g("domain_authority"), g("url_depth"), 1 / (1 + F.exp(g("age_days") - 30)), g("exact_phrase"),
        F.least(g("title_ratio"), F.lit(1.0)), g("url_ratio"), zero, zero, zero, g("spam"), zero,
        g("pr_reference"), g("pr_news"), g("pr_commercial"), g("pr_academic"), F.log10(g("inlinks") + 1), F.log10(g("words") + 1),
        g("cosine"), 0.95 * g("cosine"), zero, g("reformulation"), g("session_topic"), g("https"), g("stuffing"), g("ai_content"),
    ]


def tree(node, inputs: list[Column]) -> Column:
    """A tree as nested CASE expressions, inside whole-stage code generation."""
    if not isinstance(node, tuple):
        return F.lit(float(node))
    feature, threshold, low, high = node
    return F.when(inputs[feature] <= threshold, tree(low, inputs)).otherwise(tree(high, inputs))


def ensemble(inputs: list[Column], trees=TREES, rate: float = RATE) -> Column:
    total = tree(trees[0], inputs)
    for t in trees[1:]:
        total = total + tree(t, inputs)
    return F.lit(rate) * total


def evaluate(node, values) -> float:
    """The same tree in Python, for tests."""
    while isinstance(node, tuple):
        node = node[2] if values[node[0]] <= node[1] else node[3]
    return node


def tree_sql(node, names: dict[int, str]) -> str:
    if not isinstance(node, tuple):
        return repr(float(node))
    feature, threshold, low, high = node
    return f"CASE WHEN {names.get(feature, '0.0')} <= {threshold} THEN {tree_sql(low, names)} ELSE {tree_sql(high, names)} END"


def rerank(candidates: DataFrame, head: int = 20, query: str = "query_id") -> DataFrame:
    """candidates: query, doc_id, rank (by BM25), score and gbdt. The head of the BM25 order is reordered by the model, ties in BM25 order; the tail follows with its BM25 scores."""
    by_model = Window.partitionBy(query, "is_head").orderBy(F.desc("gbdt"), "rank")
    marked = candidates.withColumn("model_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("gbdt"), "rank")))
    marked = marked.withColumn("is_head", F.col("model_rank") <= head)
    out = marked.withColumn("head_rank", F.row_number().over(by_model))
    final = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("is_head"), F.when(F.col("is_head"), F.col("head_rank")), "rank"))
    return out.select(query, "doc_id", F.when(F.col("is_head"), F.col("gbdt")).otherwise(F.col("score")).alias("final_score"), "is_head", final.alias("final_rank"))


def page(ranked: DataFrame, number: int = 1, size: int = 10, most: int = 50, rank: str = "final_rank") -> DataFrame:
    """One page; numbers start at 1, sizes are within 1 and `most`."""
    number, size = max(number, 1), min(max(size, 1), most)
    return ranked.where((F.col(rank) > (number - 1) * size) & (F.col(rank) <= number * size))


def cross_rerank(ranked: DataFrame, scores: DataFrame | None, query: str = "query_id", rank: str = "final_rank") -> DataFrame:
    """Order by supplied scores (query, doc_id, cross); without any, the order stays."""
    if scores is None:
        return ranked
    order = Window.partitionBy(query).orderBy(F.desc_nulls_last("cross"), rank)
    return ranked.join(scores, [query, "doc_id"], "left").withColumn("new", F.row_number().over(order)).drop(rank).withColumnRenamed("new", rank)


def softmax_second(a: Column, b: Column) -> Column:
    """Probability of the second of two logits."""
    return 1 / (1 + F.exp(a - b))


def phases(reranked: Column, instant: Column) -> Column:
    return F.array_compact(F.array(F.lit("bm25f"), F.when(reranked, F.lit("gbdt")), F.when(instant, F.lit("instant"))))


def did_you_mean(correction: Column, query: Column) -> Column:
    return F.nullif(correction, query)
