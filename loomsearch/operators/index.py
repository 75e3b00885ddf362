"""A stored inverted index: segments of documents and postings on shared storage.

A commit writes one segment into a folder beside the index and renames it, so readers see all of it or
nothing and a batch that is committed twice under one name counts once. Postings are dealt by the hash
of their term, so a batch of queries reads the buckets of its terms only. A document with the URL of an
earlier one replaces it: the segment lists the ids that it makes void.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsearch.operators import dedup, retrieval, understand
from loomsearch.schema import Settings
from loomsearch.sources import tables
from loomsearch.sources.crawl_log import with_ids

BUCKETS = 64
#: Bytes of stored documents whose postings one task sorts and writes.
TASK_BYTES = 32 << 20
#: Raised when segments are laid out in another way.
FORMAT = 1


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.crc32(term.cast("binary")) % buckets


class Index:
    """Searched fields are text columns; everything else of a document is stored beside them."""

    def __init__(self, spark: SparkSession, path: str, fields: Mapping[str, float] = retrieval.BOOSTS, buckets: int = BUCKETS):
        self.spark, self.path, self.fields, self.buckets = spark, path.rstrip("/"), dict(fields), buckets

    def segments(self) -> list[str]:
        return [f"{self.path}/{n}" for n in tables.names_in(self.spark, self.path) if n.startswith("segment-")]

    def _all(self, part: str) -> DataFrame | None:
        paths = [f"{s}/{part}" for s in self.segments() if tables.exists(self.spark, f"{s}/{part}")]
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p in paths]) if paths else None

    def _read(self, part: str, key: str = "doc_id") -> DataFrame:
        """All segments' rows of live documents."""
        own = self._all(part)
        if own is None:
            raise ValueError(f"no index at {self.path}")
        return own.join(self._all("void"), key, "left_anti")

    def documents(self) -> DataFrame:
        return self._read("documents")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """term, field, doc_id, tf, len, pos; with terms, from their buckets only."""
        own = self._read("postings")
        if terms is not None:
            places = {r.b for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"), self.buckets).alias("b")).collect()}
            own = own.where(F.col("bucket").isin(sorted(places)) & F.col("term").isin(terms))
        return own.drop("bucket")

    def stats(self) -> DataFrame:
        """(field, n_docs, avg_len) over live documents."""
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_lengths.{f}").alias("len")) for f in self.fields]))
        return self.documents().select(each.alias("x")).groupBy("x.field").agg(F.count("*").alias("n_docs"), F.avg("x.len").alias("avg_len"))

    def count(self) -> DataFrame:
        return self.documents().agg(F.count("*").alias("documents"))

    def urls(self, ids: DataFrame) -> DataFrame:
        """(doc_id, url) of ids (doc_id) that live."""
        return self.documents().select("doc_id", "url").join(ids.select("doc_id"), "doc_id", "left_semi")

    def dictionary(self) -> DataFrame:
        """(word, freq) for spelling, from the postings."""
        return understand.dictionary(self.postings())

    def commit(self, docs: DataFrame, name: str | None = None, time: str | None = None) -> bool:
        """Adds documents (url, the searched fields, others), the last by time of each URL; False where a batch of this name is there. docs are read twice."""
        name = name or uuid.uuid4().hex
        if "/" in name or "\\" in name or ".." in name:
            raise ValueError(f"not a batch name: {name!r}")
        have = self.segments()
        if any(s.endswith(f"-{name}") for s in have):
            return False
        before = self._all("documents")
        start = 0 if before is None else (before.agg(F.max("doc_id")).first()[0] if before.take(1) else -1) + 1
        # A struct, so that a document without URL has a key too. Only keys are dealt by range and numbered; the
        # documents are shuffled once, by the same key for the choice among them and for their numbers.
        keyed = docs.drop("doc_id").withColumn("_key", F.struct("url"))
        ids = with_ids(keyed.select("_key").distinct(), start, "_key")
        one = dedup.latest(keyed, "_key", time, time) if time else keyed.dropDuplicates(["_key"])
        lengths = F.struct(*[F.size(retrieval.index_tokens(F.coalesce(F.col(f), F.lit("")))).alias(f) for f in self.fields])
        new = f"{self.path}/_new-{uuid.uuid4().hex}"
        one.join(ids, "_key").drop("_key").withColumn("_lengths", lengths).write.parquet(f"{new}/documents")
        own = self.spark.read.parquet(f"{new}/documents")
        postings = retrieval.positional(retrieval.field_tokens(own, list(self.fields))).withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        # A bucket is dealt to many tasks by document, so that none of them grows with the index.
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), tables.size_of(self.spark, f"{new}/documents") // TASK_BYTES)
        slices = -(-4 * parts // self.buckets)
        postings.repartition(parts, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(slices))).sortWithinPartitions("bucket", "term", "field", "doc_id").write.partitionBy("bucket").parquet(f"{new}/postings")
        void = own.select("doc_id").limit(0) if before is None else self.documents().join(own.select("url"), "url", "left_semi").select("doc_id")
        void.write.parquet(f"{new}/void")
        return tables.rename(self.spark, new, f"{self.path}/segment-{len(have):08d}-{name}")

    def delete(self, docs: DataFrame, name: str | None = None) -> bool:
        """Makes documents (doc_id) void, in a segment of its own."""
        have = self.segments()
        new = f"{self.path}/_new-{uuid.uuid4().hex}"
        docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().write.parquet(f"{new}/void")
        return tables.rename(self.spark, new, f"{self.path}/segment-{len(have):08d}-{name or uuid.uuid4().hex}")

    def search(self, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
        """(query_id, doc_id, score) for queries (query_id, terms): every document with one of the terms."""
        terms = [r.term for r in queries.select(F.explode("terms").alias("term")).distinct().limit(retrieval.SET_TERMS + 1).collect()]
        if len(terms) > retrieval.SET_TERMS:
            wanted = queries.select(F.explode("terms").alias("term")).distinct().withColumn("bucket", bucket_of(F.col("term"), self.buckets))
            found = self._read("postings").join(wanted, ["bucket", "term"], "left_semi")
        else:
            found = self.postings(terms)
        return retrieval.score(found.select("doc_id", "field", "len", "term", "tf"), self.stats(), queries, self.fields, settings).drop("len")

    def ask(self, queries: Mapping[int, str], settings: Settings = Settings()) -> DataFrame:
        """(query_id, doc_id, score) for queries of the query language."""
        asked = [leaf for text in queries.values() for leaf in retrieval.leaves(retrieval.parse(text))]
        terms = None if any(leaf.low is not None for leaf in asked) else sorted({w for leaf in asked for w in leaf.words})
        return retrieval.ranked(self.postings(terms), self.stats(), queries, self.fields, settings)
