"""SimHash near-duplicates by segment popcounts.

A fingerprint is mapped to the popcounts of its 2-bit segments. The Manhattan distance of two such
vectors never exceeds the Hamming distance, so links can be sought on a grid of popcounts. The 32
counts are split in groups; a distance of 3 touches at most 3 of them, so of 7 groups 4 have equal
counts at least. Each distinct fingerprint stands in one cell for each choice of 4 groups, and
fingerprints of one cell are compared: the Manhattan distance of all counts discards candidates, and
popcount(xor) decides. Of all cells that two fingerprints share, only the first choice counts, so each
link is found once. A cell's key holds 25.9 bits (collision entropy of random counts) with 7 groups
and 30.2 with 9, which are used for many fingerprints; the links are the same. Exact copies meet as
one fingerprint first, so a group of copies costs one row; linked fingerprints become components by
alternating large-star and small-star rounds.

Defined cases: texts without words (null, empty) have fingerprint zero and link like any other;
fewer words than a shingle form one shingle; repeated rows and null doc_ids stay as they are (a
component of null ids only has a null component_id); an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, arrow_map, bytes_of, discard, materialise, row_keys, split_words, texts_of, tune

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENT_BITS = 2
#: Groups of segments, and from how many distinct fingerprints on there are more of them.
GROUPS, MORE_GROUPS, MANY = 7, 9, 1 << 26
#: Even bits of a word: sums of neighbouring bits stand in fields of two.
EVEN = 0x5555555555555555


def fingerprints_of(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Fingerprint of each text: a bit is set if it is set in over half the shingles' hashes."""
    words: Words = split_words(texts, lower=True)
    size = np.diff(bytes_of(words.vocab)[1])
    vocab = np.array([w.encode() for w in words.vocab.to_pylist()], object)
    out = np.zeros(len(texts), U64)
    lengths = size[words.ids]
    digest = xxhash.xxh64_intdigest
    for k in range(len(texts)):
        a, b = words.offsets[k], words.offsets[k + 1]
        if a == b:
            continue
        own = b" ".join(vocab[words.ids[a:b]])
        if b - a <= shingle:
            out[k] = digest(own, seed)
            continue
        ends = np.cumsum(lengths[a:b] + 1) - 1
        begins = ends - lengths[a:b]
        hashes = np.fromiter((digest(own[p:q], seed) for p, q in zip(begins[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)), U64, b - a - shingle + 1)
        votes = np.zeros(64, np.int64)
        for s in range(0, len(hashes), 1 << 16):
            votes += np.unpackbits(hashes[s : s + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * votes > len(hashes), bitorder="little").view(U64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, a 128-bit key of the row (k1, k2) and the fingerprint, as a long with the same bits."""
    tune(docs.sparkSession)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = pa.array(fingerprints_of(texts_of(batch.column("text")), shingle, seed).view(np.int64))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), own], names=["doc_id", "k1", "k2", "fp"])

        return each

    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *row_keys(docs), docs["text"].cast("string").alias("text"))
    return arrow_map(columns, make, "doc_id long, k1 long, k2 long, fp long")


def segment_counts(fp: Column) -> Column:
    """Popcount of every 2-bit segment, each in its own two bits."""
    low, high = fp.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(EVEN))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def count_distance(x: Column, y: Column) -> Column:
    """Manhattan distance of two words of 2-bit counts in 0..2: |x - y| is 2 where the high or the zero states oppose, else the xor of the low bits."""
    even = F.lit(EVEN)
    low = x.bitwiseXOR(y).bitwiseAND(even)  # one of them is 1, the other 0 or 2
    high = F.shiftrightunsigned(x.bitwiseXOR(y), 1).bitwiseAND(even)
    far = high.bitwiseAND(low.bitwiseXOR(even))  # 0 against 2
    return F.bit_count(low) + 2 * F.bit_count(far)


def signed(word: int) -> int:
    """The long with the same 64 bits."""
    return word - (1 << 64) if word >> 63 else word


def group_masks(groups: int) -> list[int]:
    """Bits of the counts of each group of segments; sizes differ by one at most."""
    edges = [64 // SEGMENT_BITS * g // groups * SEGMENT_BITS for g in range(groups + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def links(fps: DataFrame, distance: int = DISTANCE, groups: int = GROUPS) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in at most `distance` bits, fewer than there are groups."""
    if not 0 <= distance < groups <= 32:
        raise ValueError(f"distance {distance} needs more than so many groups, 32 at most: {groups}")
    masks = group_masks(groups)
    choices = list(itertools.combinations(range(groups), groups - distance))
    # Groups before the last chosen one that are not chosen: where they agree too, an earlier choice has the pair.
    skipped = F.array(*[F.lit(sum(1 << g for g in range(chosen[-1]) if g not in chosen)) for chosen in choices])
    cells = [F.struct(F.lit(k).alias("choice"), F.col("counts").bitwiseAND(F.lit(signed(sum(masks[g] for g in chosen)))).alias("cell")) for k, chosen in enumerate(choices)]
    placed = fps.select("fp", segment_counts(F.col("fp")).alias("counts")).select("fp", F.explode(F.array(*cells)).alias("x")).select("fp", "x.choice", "x.cell")
    # Both sides are the same rows, so they are shuffled once. Spark takes the exploded rows for as few bytes as
    # the fingerprints were, and would broadcast them: they are merged whatever it estimates.
    left, right = placed.toDF("a", "choice", "cell").hint("merge"), placed.toDF("b", "choice_b", "cell_b").hint("merge")
    x, y = segment_counts(F.col("a")), segment_counts(F.col("b"))
    agree = F.lit(0)
    for g, mask in enumerate(masks):
        agree = agree.bitwiseOR(F.when(x.bitwiseXOR(y).bitwiseAND(F.lit(signed(mask))) == 0, 1 << g).otherwise(0))
    within = (F.col("a") < F.col("b")) & (count_distance(x, y) <= distance) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance) & (agree.bitwiseAND(F.get(skipped, F.col("choice"))) == 0)
    return left.join(right, (F.col("choice") == F.col("choice_b")) & (F.col("cell") == F.col("cell_b")) & within).select("a", "b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge: root is the least node reachable.

    Alternates large-star and small-star; each round's edges are written to the shared folder, so
    lineage stays short and a lost executor costs one round at most.
    """
    now = materialise(edges.select("a", "b"), "edges")
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("root").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("root"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(low.select("a", F.col("root").alias("b"))).where("a != b").distinct()
        before, now = now, materialise(small, "edges")
        discard(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        mark = seen
    raise RuntimeError(f"components are not stable after {rounds} rounds")


def grouped(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, k1, k2, fp, root (the least fingerprint of its component) and component_id of every document."""
    own = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    groups = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    # Dealt anew, as few bytes become many rows: the explode should not run in a few merged partitions.
    groups = materialise(groups.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"), "groups")
    roots = components(links(groups.select("fp"), distance, MORE_GROUPS if groups.count() >= MANY else GROUPS))
    of = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # Every fingerprint has its row in `of`; a left join says that the documents are never the side to broadcast, however few bytes copies take.
    return own.join(of.join(least, "root").select("fp", "root", "component_id"), "fp", "left")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the least doc_id reachable over links."""
    return grouped(docs, distance, shingle, seed).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Of each component the document with the least id (null ids last, then by the row's key); of repeated rows one."""
    first = grouped(docs, distance, shingle, seed).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("x")).select("x.k1", "x.k2")
    rows = docs.select(*row_keys(docs), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # The keys are unique but for repeated rows; those meet in the join's own partitions.
    return rows.join(first, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row")).select("row.*")
