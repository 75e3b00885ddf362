"""Delta-maintained token counts.

Documents change by signed deltas: an insert adds a document's counts, a delete takes them back, a
revision is both. Deltas of one batch are summed by source, language and tokenizer version before
anything is written, and a batch is one folder of sums; totals add the batches up. Nothing but the
sums is ever read again.

A batch is written beside its place and moved there by one rename; a batch that is there already
is not committed again, so a retry changes nothing. compact() folds batches into one snapshot
that names them.

Defined cases: null and empty texts count no tokens but one document; null sources and languages
are groups of their own; repeated rows count each; totals of zero documents are left out; an
empty batch commits no sums; a delete may come before its insert, and totals are below zero until
then; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialise, split_words, texts_of, tune
from .tokens import WordBpe

KEY = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Counters by tokenizer version; a version is never changed, a new way of counting is a new version.
WORDS_1, WORDS_2, BPE_1 = "words-1", "words-2", "word_bpe_49k-1"


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, a 128-bit hash of the text (h1, h2), and a column of counts for each tokenizer version.

    words-1: words between white space; words-2: those with a letter or digit; word_bpe_49k-1: ids of the public tokenizer at this path.
    """
    tune(docs.sparkSession)

    def make():
        bpe = WordBpe(tokenizer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column("text"))
            words = split_words(texts)
            plain = pc.match_substring_regex(words.vocab, r"[\p{L}\p{N}]").to_numpy(zero_copy_only=False)[words.ids]
            bounds = bpe.encode(texts)[1]
            counts = [words.counts, np.bincount(words.row_of[plain], minlength=len(texts)), np.diff(bounds)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang", "h1", "h2")), *(pa.array(x.astype(np.int64)) for x in counts)], names=["doc_id", "source", "lang", "h1", "h2", WORDS_1, WORDS_2, BPE_1])

        return each

    text = docs["text"].cast("string")
    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    return arrow_map(columns, make, f"doc_id long, source string, lang string, h1 long, h2 long, `{WORDS_1}` long, `{WORDS_2}` long, `{BPE_1}` long")


def deltas(counts: DataFrame, versions: tuple[str, ...], sign: int) -> DataFrame:
    """Inserts (sign 1) or deletes (-1) of every counted document under these versions."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(f"`{v}`").alias("n")) for v in versions]))
    return counts.select("source", "lang", each.alias("x")).select("source", "lang", "x.tokenizer", F.lit(sign).cast("long").alias("n_docs"), (sign * F.col("x.n")).alias("n_tokens"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._file = jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        at = self._file(f"{self.path}/{kind}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def batches(self) -> set[str]:
        """Ids of all batches committed, folded or not."""
        return set(self._names("batches")) | self._folded()

    def _snapshot(self) -> str | None:
        return max(self._names("snapshots"), default=None)

    def _folded(self) -> set[str]:
        last = self._snapshot()
        if last is None:
            return set()
        return {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/snapshots/{last}/batches").collect()}

    def _place(self, write: Callable[[str], None], at: str) -> bool:
        beside = f"{self.path}/writing/{uuid.uuid4().hex}"
        write(beside)
        target = self._file(f"{self.path}/{at}")
        self._fs.mkdirs(target.getParent())
        if not self._fs.exists(target) and self._fs.rename(self._file(beside), target):
            return True
        self._fs.delete(self._file(beside), True)
        return False

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Adds a batch of deltas; False if it was there already, whatever its rows."""
        if not batch or batch.startswith((".", "_")) or "/" in batch or "\\" in batch:
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self.batches():
            return False
        return self._place(lambda to: summed(rows).write.parquet(to), f"batches/{batch}")

    def totals(self) -> DataFrame:
        folded, last = self._folded(), self._snapshot()
        paths = [f"{self.path}/batches/{b}" for b in self._names("batches") if b not in folded] + ([f"{self.path}/snapshots/{last}/sums"] if last else [])
        parts = [self.spark.read.schema(SUMS).parquet(p) for p in paths] or [self.spark.createDataFrame([], SUMS)]
        return summed(reduce(DataFrame.unionByName, parts)).where("n_docs != 0 or n_tokens != 0")

    def compact(self) -> None:
        """Folds all batches into a new snapshot, then drops their folders."""
        batches, last = self.batches(), self._snapshot()

        def write(to: str) -> None:
            self.totals().write.parquet(f"{to}/sums")
            self.spark.createDataFrame([(b,) for b in sorted(batches)], "batch string").coalesce(1).write.parquet(f"{to}/batches")

        if self._place(write, f"snapshots/{int(last or 0) + 1:08d}"):
            for b in self._names("batches"):
                if b in batches:
                    self._fs.delete(self._file(f"{self.path}/batches/{b}"), True)


def without_copies(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the least doc_id of their text, and the others (exact copies, to be deleted)."""
    # Rows are told apart by their id; the least of each text is found by a sum before the shuffle.
    # Only texts found more than once are joined, from a table: no aggregate stands above the
    # shuffle then, so that Spark can broadcast a small table or split a hot text's rows.
    groups = counts.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    joined = counts.join(materialise(groups.where("n > 1").drop("n"), "first-ids"), ["h1", "h2"], "left")
    own = F.coalesce(F.col("doc_id") == F.col("first"), F.lit(True))
    return joined.where(own).drop("first"), joined.where(~own).drop("first")
