"""Helpers shared by the training-data operators.

Texts are handled in Arrow batches: one C++ pass splits a whole batch into words and encodes
them against the batch's own dictionary, so that hashing or tokenizing happens once per distinct
word and everything per occurrence is a numpy operation.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsearch.functions.vectorised import tune  # noqa: F401  the operators take it from here
from loomsearch.sources.tables import saved as materialise  # noqa: F401  the operators take it from here
from loomsearch.sources.tables import discard, shared_dir  # noqa: F401

U64 = np.uint64
#: Bytes of texts that are taken apart at once.
PIECE = 1 << 21


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """k1, k2: 128 bits of a row's id and text; stable under recomputation, equal for repeated rows only, never null."""
    doc_id, text = docs["doc_id"], docs["text"].cast("string")
    return F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(1), text, doc_id).alias("k2")


@dataclass
class Words:
    """Words of a batch: word ids by position, where each row's words begin, and the dictionary."""

    ids: np.ndarray
    offsets: np.ndarray
    vocab: pa.Array

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hash of each dictionary word."""
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w, seed) for w in self.vocab.to_pylist()), U64, len(self.vocab))


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts as large strings, null as empty."""
    return pc.fill_null(one_array(column).cast(pa.large_string()), "")


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and where each text's begin. For arrays without nulls."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Texts in runs of at most PIECE bytes (a longer text is one of its own), and the number of each run's first."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE, side="right")))
        yield first, texts.slice(first, last - first)
        first = last


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of every text; lower maps A-Z only."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = flat.filter(full).dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), kept[offsets], coded.dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every bit over the word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Hashes of all windows of one batch: sums of hash times base^-position, modulo 2^64."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        inverse = pow(base, -1, 1 << 64)
        self.power = np.ones(n + 1, U64)
        back = np.ones(n + 1, U64)
        with np.errstate(over="ignore"):
            self.power[1:] = np.cumprod(np.full(n, base, U64))
            back[1:] = np.cumprod(np.full(n, inverse, U64))
            self.sums = np.zeros(n + 1, U64)
            np.cumsum(values * back[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end], the same wherever these values stand."""
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.power[start] + (end - start).astype(U64))


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def give_back() -> None:
    """Returns freed memory to the system: a worker serves later stages and operators too, and what it keeps adds to their own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for mapInArrow, giving back what earlier tasks' broadcasts took before, and what its own took after a partition."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return lean_run


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with one function for each partition, made on the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                out = each(batch)
                if out is not None:
                    yield out
    return df.mapInArrow(lean(run), schema)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of df; plans partition counts only, never results."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())


def collect_bounded(df: DataFrame, bound: int) -> pa.Table:
    """Brings a result with a proven bound on its rows to the driver; more rows are an error."""
    table = df.toArrow()
    if table.num_rows > bound:
        raise ValueError(f"{table.num_rows} rows, over the bound of {bound}")
    return table


class CodeTable:
    """Hash table from distinct 64-bit codes to their places, probed for whole arrays at once."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(2 * len(codes)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.int64)
        self.place = np.full(1 << self.bits, -1, np.int32)
        codes = codes.astype(np.int64)
        left, at = np.arange(len(codes)), self._slot(codes)
        while len(left):
            free = self.place[at] < 0
            self.place[at[free]] = left[free]  # of several for a slot the last stays
            self.keys[at[free]] = codes[left[free]]
            won = self.place[at] == left
            won &= free
            if won.any():
                self.keys[at[won]] = codes[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes.view(U64) * U64(BASES[0]) >> U64(64 - self.bits)).view(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code (int64), -1 where it has none."""
        at = self._slot(codes)
        place = self.place[at]
        bad = np.flatnonzero((place >= 0) & (self.keys[at] != codes))
        while len(bad):
            at_bad = (at[bad] + 1) & ((1 << self.bits) - 1)
            at[bad] = at_bad
            place[bad] = self.place[at_bad]
            bad = bad[(place[bad] >= 0) & (self.keys[at_bad] != codes[bad])]
        return place


class Counter64:
    """Counts of 64-bit codes, gathered batch by batch within a bounded memory."""

    def __init__(self, most: int = 4_000_000):
        self.most, self.size, self.parts = most, 0, []

    def add(self, codes: np.ndarray, counts: np.ndarray | None = None) -> None:
        codes = codes.astype(np.int64)
        if counts is None:
            codes = np.sort(codes)
            head = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
            codes, counts = codes[head], np.diff(np.concatenate([head, [len(codes)]]))
        self.parts.append((codes, counts.astype(np.int64)))
        self.size += len(codes)
        if self.size > 2 * self.most:
            self._merge()

    def _merge(self) -> None:
        codes, counts = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        head = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        self.parts = [(codes[head], np.add.reduceat(counts, head) if len(head) else counts[:0])]
        self.size = len(head)

    @property
    def full(self) -> bool:
        return self.size > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """All counts so far; counting starts anew."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._merge()
        out, self.parts, self.size = self.parts[0], [], 0
        return out


def with_row(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """row: the document as it came (or its columns in keep), so no column's name can clash with an operator's; and text where row has it not as a string."""
    names = keep or docs.columns
    row = F.struct(*[docs[c] for c in names]).alias("row")
    if "text" in names and docs.schema["text"].dataType == T.StringType():
        return docs.select(row)
    return docs.select(row, docs["text"].cast("string").alias("text"))


def texts_in(batch: pa.RecordBatch) -> pa.Array:
    """Texts of a batch of `with_row`, null as empty."""
    return texts_of(batch.column("text") if "text" in batch.schema.names else batch.column("row").field("text"))


def strip_terms(vocab: pa.Array) -> pa.Array:
    """Words in lower case without marks at their ends."""
    return pc.replace_substring_regex(pc.utf8_lower(vocab), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
