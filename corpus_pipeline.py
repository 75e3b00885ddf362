"""A corpus pipeline of five stages: toxicity, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes the documents its predecessor kept; all but the last return documents again, the
last the pieces of the training sequences. A stage's result is written as Parquet and read again
by the next.

Defined cases: null and empty texts are scored, linked, cut and packed like any other (the empty ones
are near-duplicates of each other, so one stays); of repeated rows near-dedup keeps one; a null doc_id
stays null; a text whose words all go in substring dedup stays as an empty document; extra columns pass
through to the last stage; an empty table gives no rows. A row of packing is a piece of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsearch.llm import decontaminate, packing, simhash, substring, toxicity
from loomsearch.llm.common import materialise, read

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below the threshold."""
    scored = toxicity.score(docs, read(spark, sf_dir, "labels"))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one document: the one with the least id, of repeated rows one."""
    return simhash.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated passages; texts without any stay as they are."""
    out = substring.remove_repeats(docs)
    row = F.col("row")
    kept = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(row["text"])
    columns = [kept.alias(c) if c == "text" else row[c].alias(c) for c in docs.columns]
    return out.select(*columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark")).where(F.size("items") == 0).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", one_of_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
