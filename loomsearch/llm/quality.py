"""Quality classifier with hierarchical empirical Bayes.

A logistic model over a text's measurements gives each document's own evidence. Documents are
grouped by host and by path below it; the share of good documents of a path is shrunk towards its
host's, the host's towards the global one. How strongly is estimated from the groups themselves
(method of moments: the between-group variance beyond what the group sizes explain). The posterior
share of a document's path, the document itself left out of path, host and whole, shifts its log odds;
a path with few documents shifts them little.

The model is fitted on at most SAMPLE labelled texts (least hash of the id) outside the held-out
fold. Groups are summed before the shuffle, from paths to hosts to the whole, and path statistics
meet the documents in a join that splits hot paths; no text is shuffled.

Defined cases: null and empty texts are judged by their (zero) measurements; null hosts or paths
are a group of their own; labels of one id that differ, null labels and labels without a document
are left out; without both labels the model says 0.5; repeated rows count and are judged each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, collect_bounded, fold_of, materialise, texts_of, tune
from .rules import measures_of

SAMPLE = 20_000
FOLDS, HELD_FOLD = 4, 2
#: How far a path's posterior moves a document's log odds.
SITE_WEIGHT = 0.5
KEEP = 0.5


def features_of(texts: pa.Array) -> np.ndarray:
    """One row of features a text, each within a few units."""
    n_words, chars, symbols, dup, repeat, lines, upper, longest = (x.astype(np.float64) for x in measures_of(texts))
    some, any_line = np.maximum(n_words, 1), np.maximum(lines, 1)
    share = np.maximum(chars, 1)
    pipes = np.array([t.count(" | ") for t in texts.to_pylist()], np.float64)
    return np.stack([np.log1p(n_words) / 5, np.minimum(5 * symbols / share, 3), dup / any_line, repeat / some, 2 * upper / share, np.minimum(chars / some / 5, 3), np.log1p(longest) / 4, np.minimum(5 * pipes / some, 3), (n_words < 10).astype(float), (repeat > 0.2 * some).astype(float), (symbols > 0.1 * share).astype(float)], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (the last is the offset) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * len(y) / 100 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * (ridge * len(y) / 100 + 1e-9)
        delta = np.linalg.solve(hess, grad)
        w -= delta
        if np.abs(delta).max() < 1e-10:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("most")).where("y = most")
    chosen = own.where(fold_of(F.col("doc_id"), FOLDS) != HELD_FOLD).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("y").cast("int").alias("y"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = features_of(texts_of(batch.column("text")))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x))], names=["doc_id", "y", "x"])

        return each

    rows = arrow_map(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text"), make, "doc_id long, y int, x array<double>")
    table = collect_bounded(rows.groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id"), sample)
    y = table.column("y").to_numpy().astype(np.float64)
    return logistic(np.array(table.column("x").to_pylist()), y) if len(set(y)) == 2 else None


def strength(groups: DataFrame, mean: Column) -> Column:
    """Pseudo-counts of the prior over groups (n, good) around their mean: method of moments of the beta-binomial, within 1 and 10,000."""
    n, p = F.sum("n"), F.col("good") / F.col("n")
    spread = F.sum(F.col("n") * (p - mean) * (p - mean))
    k, squares = F.count("*"), F.sum(F.col("n") * F.col("n"))
    noise = F.sum(mean * (1 - mean))  # expected spread of equal groups, about
    between = F.greatest((spread - noise * (1 - 1 / F.greatest(k, F.lit(2)))) / F.greatest(n - squares / n, F.lit(1.0)), F.lit(0.0))
    level = F.avg(mean * (1 - mean))
    return F.least(F.greatest(F.coalesce(level / F.nullif(between, F.lit(0.0)) - 1, F.lit(10_000.0)), F.lit(1.0)), F.lit(10_000.0))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", weights: np.ndarray | None = None) -> DataFrame:
    """doc_id, document_score, host_share, path_share, score and kept for every document."""
    tune(docs.sparkSession)
    weights = fit(docs, labels) if weights is None else weights

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = features_of(texts_of(batch.column("text")))
            z = np.zeros(len(x)) if weights is None else np.column_stack([x, np.ones(len(x))]) @ weights
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "host", "path", "p"])

        return each

    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs[host].cast("string"), F.lit("\0")).alias("host"), F.coalesce(docs[path].cast("string"), F.lit("\0")).alias("path"), docs["text"].cast("string").alias("text"))
    scored = materialise(arrow_map(named, make, "doc_id long, host string, path string, p double"), "evidence")

    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total, good = (float(x or 0) for x in hosts.agg(F.sum("n"), F.sum("good")).first())
    mean = good / total if total else 0.5
    host_k = float(hosts.agg(strength(hosts, F.lit(mean)).alias("k")).first()[0] or 1.0)
    host_share = (F.col("good") + host_k * F.lit(mean)) / (F.col("n") + host_k)
    shares = hosts.select("host", host_share.alias("host_share"), F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    under = paths.join(shares, "host")
    path_k = float(under.agg(strength(under, F.col("host_share")).alias("k")).first()[0] or 1.0)
    logit = lambda x: F.log(x / (1 - x))
    clamp = lambda x: F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    joined = scored.join(under.drop("host_share"), ["host", "path"])
    # Without the document itself.
    others = (F.lit(good) - F.col("p")) / F.lit(max(total - 1, 1.0)) if total > 1 else F.lit(0.5)
    of_host = (F.col("host_good") - F.col("p") + host_k * others) / (F.col("host_n") - 1 + host_k)
    of_path = (F.col("good") - F.col("p") + path_k * of_host) / (F.col("n") - 1 + path_k)
    shift = SITE_WEIGHT * (logit(clamp(of_path)) - logit(clamp(others)))
    final = 1 / (1 + F.exp(-(logit(clamp(F.col("p"))) + shift)))
    joined = joined.withColumns({"host_share": of_host, "path_share": of_path})
    return joined.select("doc_id", F.col("p").alias("document_score"), "host_share", "path_share", final.alias("score"), (final >= KEEP).alias("kept"))
