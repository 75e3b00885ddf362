"""Deduplication of documents: SimHash a batch at a time, near-duplicates by blocks, exact and latest-wins."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomsearch.functions.vectorised import arrow_vectorised, batch_words

#: Bits of a fingerprint made by portable hashes.
BITS = 60


def portable_hash(word: bytes) -> int:
    """The first 60 bits of the word's MD5, which any SQL engine can compute."""
    return int(hashlib.md5(word, usedforsecurity=False).hexdigest()[:15], 16)


def fingerprints_of(texts: pa.Array, hasher: Callable[[bytes], int] = portable_hash, bits: int = BITS) -> np.ndarray:
    """Votes of all words of each text, with multiplicity; each distinct word of the batch is hashed once."""
    row, word, vocab = batch_words(texts)
    codes = np.fromiter((hasher(w.encode()) for w in vocab.to_pylist()), np.uint64, len(vocab))
    pair, times = np.unique(row * max(len(vocab), 1) + word, return_counts=True)
    row, code = pair // max(len(vocab), 1), codes[pair % max(len(vocab), 1)]
    total = np.bincount(row, times, minlength=len(texts))
    out = np.zeros(len(texts), np.int64)
    for b in range(bits):
        ayes = np.bincount(row, times * (code >> np.uint64(b) & np.uint64(1)), minlength=len(texts))
        out |= (2 * ayes > total).astype(np.int64) << b
    return out


@arrow_vectorised("long", once=True)
def fingerprint(text: pa.Array) -> pa.Array:
    return pa.array(fingerprints_of(text))


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, simhash) of every row, by votes of all words; 0 without words. Nothing is shuffled."""
    return docs.select(key, fingerprint(F.col(text).cast("string")).alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(hashes: DataFrame, distance: int = 3, bits: int = BITS, blocks: int = 7) -> DataFrame:
    """Pairs a < b of distinct fingerprints within the distance.

    Two that differ in `distance` bits agree in all but so many of the blocks: they meet on each choice
    of the others, and only the first choice that they share counts, so each pair is found once.
    """
    if not 0 <= distance < blocks:
        raise ValueError(f"a distance of {distance} needs more than so many blocks: {blocks}")
    edges = [bits * k // blocks for k in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    choices = list(itertools.combinations(range(blocks), blocks - distance))
    skipped = F.array(*[F.lit(sum(1 << k for k in range(c[-1]) if k not in c)) for c in choices])
    keys = F.explode(F.array(*[F.struct(F.lit(n).alias("choice"), F.col("simhash").bitwiseAND(F.lit(sum(masks[k] for k in c))).alias("part")) for n, c in enumerate(choices)]))
    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = hashes.select("simhash").distinct().repartition(parts, "simhash").select("simhash", keys.alias("x")).select("simhash", "x.choice", "x.part")
    # 35 rows a fingerprint: merged whatever Spark estimates, so neither side is broadcast.
    left, right = own.toDF("a", "choice", "part").hint("merge"), own.toDF("b", "choice_b", "part_b").hint("merge")
    agree = F.lit(0)
    for k, mask in enumerate(masks):
        agree = agree.bitwiseOR(F.when(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(mask)) == 0, 1 << k).otherwise(0))
    first = agree.bitwiseAND(F.get(skipped, F.col("choice"))) == 0
    within = (F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= distance) & first
    return left.join(right, (F.col("choice") == F.col("choice_b")) & (F.col("part") == F.col("part_b")) & within).select("a", "b", hamming(F.col("a"), F.col("b")).alias("distance"))


def first_of_each(docs: DataFrame, by: str, order: list) -> DataFrame:
    """One row for each value: the first in this order."""
    return docs.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_n = 1").drop("_n")


def latest(docs: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Upsert: the latest row of each key."""
    return first_of_each(docs, key, [F.desc(time), F.desc(tie)])
