"""Substring dedup by De Bruijn compaction.

Every window of `window` words is an edge of the De Bruijn graph over word sequences; its nodes
are the window without its last and without its first word. Edges never leave their document one
by one. Each is assigned to its anchor, the least-hashed seed of `seed` words inside it, and the
consecutive edges of one anchor are compacted into one path, as its words leave no branch between
them: about one row in twelve words, of at most window - seed + 1 edges.

1. Anchors are counted, with the least and greatest content of their paths: partial sums before the
   shuffle, so a passage of very many documents is a few rows. An anchor met once is done with. One
   with a single content is a nonbranching path that repeats as a whole; where contents differ, the
   graph branches inside the path.
2. The texts are read again and give the paths of repeated anchors, those of branching ones with
   their edges. A bit set of fixed size keeps most other paths out of the shuffle; the join on the
   anchor decides.
3. Of branching paths one of each content is taken apart into edges; edges found more than once are
   hits of their content. Contents join their paths, and coordinates become spans.
4. Spans join their documents, which are shuffled once, and the covered words go.

Hot anchors, contents and edges are only ever summed or looked up in a table with one row a key, so
Spark splits the skewed side of such joins; no group is gathered in one task.

Contents and edges are compared by 128 bits: 64 of the anchor and 64 of an independent hash of
all words. Repeats inside one document are merged before the shuffle, so a text of one repeated
word costs one row.

Defined cases: null and empty texts have no words; repeated rows are repeats of each other, so
all their windows go; null doc_ids stay null; an empty table gives no rows; texts shorter than a
window stay whole; other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASES, U64, Rolling, arrow_map, collect_bounded, discard, materialise, row_keys, split_words, texts_in, texts_of, tune

WINDOW = 35
SEED_WORDS = 12
#: Logarithm of the bits that tell paths of anchors met once; a fuller set only lets more of them through.
SET_BITS = 27


def anchors(seeds: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` seeds the place of its least, the rightmost of equals. By doubling."""
    at = np.arange(len(seeds), dtype=np.int64)
    done = 1

    def step(at: np.ndarray, shift: int) -> np.ndarray:
        left, right = at[: len(at) - shift], at[shift:]
        return np.where(seeds[right] <= seeds[left], right, left)

    while done * 2 <= width:
        at = step(at, done)
        done *= 2
    return step(at, width - done) if done < width else at


@dataclass
class Paths:
    """Compacted paths of a batch: row, anchor, content, first window (within its row) and number of windows, by row."""

    row: np.ndarray
    anchor: np.ndarray
    content: np.ndarray
    begin: np.ndarray
    windows: np.ndarray
    start: np.ndarray  # of the first window, within the batch
    rolling: Rolling | None

    def take(self, at: np.ndarray) -> Paths:
        return Paths(*(x[at] for x in (self.row, self.anchor, self.content, self.begin, self.windows, self.start)), self.rolling)

    def edges(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """All paths' edges one after the other, and where each path's begin."""
        at = np.concatenate([[0], np.cumsum(self.windows)])
        start = np.repeat(self.start - at[:-1], self.windows) + np.arange(at[-1])
        return self.rolling.spans(start, start + window).view(np.int64) if self.rolling else np.zeros(0, np.int64), at


def paths_of(texts: pa.Array, window: int, seed: int) -> Paths:
    words = split_words(texts)
    n = len(words)
    if n < window:
        return Paths(*(np.zeros(0, np.int64) for _ in range(6)), None)
    hashes = words.hashes()[words.ids]
    row = words.row_of
    first = np.arange(n - seed + 1)
    seeds = Rolling(hashes, BASES[0]).spans(first, first + seed)
    anchor = anchors(seeds, window - seed + 1)
    start = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    anchor = anchor[start]
    head = np.ones(len(start), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (row[start[1:]] != row[start[:-1]])
    head = np.flatnonzero(head)
    count = np.diff(np.concatenate([head, [len(start)]]))
    begin = start[head]
    rolling = Rolling(hashes, BASES[1])
    content = rolling.spans(begin, begin + count + window - 1)
    of = row[begin]
    return Paths(of, seeds[anchor[head]].view(np.int64), content.view(np.int64), begin - words.offsets[of], count, begin, rolling)


def _anchors(texts: DataFrame, window: int, seed: int) -> DataFrame:
    """(anchor, branches) of all anchors that several paths have."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            paths = paths_of(texts_of(batch.column("text")), window, seed)
            if not len(paths.row):
                return None
            order = np.argsort(paths.anchor, kind="stable")
            anchor, content = paths.anchor[order], paths.content[order]
            head = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            n = np.diff(np.concatenate([head, [len(anchor)]]))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[head], n, np.minimum.reduceat(content, head), np.maximum.reduceat(content, head))], names=["anchor", "n", "low", "high"])

        return each

    parts = arrow_map(texts, make, "anchor long, n long, low long, high long")
    return parts.groupBy("anchor").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("branches"))


def _bit_set(anchors_: DataFrame) -> np.ndarray:
    """2^SET_BITS bits, of which each anchor sets two in one word: at most 2^(SET_BITS - 6) words come to the driver."""
    word = F.shiftrightunsigned("anchor", 70 - SET_BITS)
    bits = F.expr("shiftleft(1L, int(anchor & 63)) | shiftleft(1L, int(shiftright(anchor, 6) & 63))")
    table = collect_bounded(anchors_.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")), 1 << (SET_BITS - 6))
    out = np.zeros(1 << (SET_BITS - 6), U64)
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(U64)
    return out


def _in_set(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """False: surely not in the set."""
    own = anchor.view(U64)
    asked = U64(1) << (own & U64(63)) | U64(1) << (own >> U64(6) & U64(63))
    return bits[(own >> U64(65 - len(bits).bit_length())).astype(np.int64)] & asked == asked


def _repeated_paths(keyed: DataFrame, repeated: DataFrame, window: int, seed: int) -> DataFrame:
    """k1, k2, anchor, content, begins, windows, branches and edges (of branching anchors, else null) of all paths with a repeated anchor."""
    context = keyed.sparkSession.sparkContext
    some, branching = (context.broadcast(_bit_set(repeated.where(test))) for test in ("true", "branches"))

    def make():
        kept, split = some.value, branching.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            paths = paths_of(texts_of(batch.column("text")), window, seed)
            paths = paths.take(np.flatnonzero(_in_set(kept, paths.anchor)))
            if not len(paths.row):
                return None
            order = np.lexsort((paths.begin, paths.content, paths.anchor, paths.row))
            paths = paths.take(order)
            row, anchor, content = paths.row, paths.anchor, paths.content
            head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]))
            begins = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)).astype(np.int32)), pa.array(paths.begin.astype(np.int32)))
            paths = paths.take(head)
            branches = _in_set(split, paths.anchor)
            edges, at = paths.take(np.flatnonzero(branches)).edges(window)
            place = np.zeros(len(head) + 1, np.int64)
            place[1:] = np.cumsum(branches)
            lists = pa.ListArray.from_arrays(pa.array(at[place].astype(np.int32)), pa.array(edges), mask=pa.array(~branches))
            of = pa.array(paths.row)
            return pa.RecordBatch.from_arrays([batch.column("k1").take(of), batch.column("k2").take(of), pa.array(paths.anchor), pa.array(paths.content), begins, pa.array(paths.windows.astype(np.int32)), lists], names=["k1", "k2", "anchor", "content", "begins", "windows", "edges"])

        return each

    return arrow_map(keyed.select("k1", "k2", "text"), make, "k1 long, k2 long, anchor long, content long, begins array<int>, windows int, edges array<long>").join(repeated, "anchor")


def _cut(spanned: DataFrame, window: int, row_type: T.StructType) -> DataFrame:
    """Removes covered words. spanned has row, spans (begin, windows) and, where the row's own is no string, text."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_in(batch).to_pylist()
            spans = batch.column("spans").to_pylist()
            n_words, n_removed, kept, cuts = [], [], [], []
            for text, own in zip(texts, spans, strict=True):
                words = text.encode().split()
                covered = np.zeros(len(words) + 1, np.int32)
                for x in own or ():
                    covered[x["begin"]] += 1
                    covered[x["begin"] + x["windows"] + window - 1] -= 1
                gone = np.cumsum(covered)[:-1] > 0
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).tolist()
                cuts.append([{"begin": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                if n_removed[-1]:
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept.append(b" ".join(words).decode())
            arrays = [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.large_string()).cast(pa.string()), pa.array(cuts, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))]
            return pa.RecordBatch.from_arrays(arrays, names=["row", "n_words", "n_removed", "kept_text", "removed_spans"])

        return each

    schema = T.StructType([T.StructField("row", row_type), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    return arrow_map(spanned, make, schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """row (the document as it came), n_words, n_removed, kept_text (kept words joined by a space) and removed_spans (word positions)."""
    if not 0 < seed < window:
        raise ValueError("a seed must be shorter than a window")
    tune(docs.sparkSession)
    text = docs["text"].cast("string").alias("text")
    keyed = docs.select(*row_keys(docs), text)
    repeated = materialise(_anchors(docs.select(text), window, seed), "anchors")
    paths = materialise(_repeated_paths(keyed, repeated, window, seed), "paths")
    discard(repeated)

    whole = paths.where("not branches").select("k1", "k2", F.explode("begins").alias("begin"), "windows")
    branching = paths.where("branches")
    contents = branching.groupBy("anchor", "content").agg(F.sum(F.size("begins")).alias("n"), F.first("edges").alias("edges"))
    contents = materialise(contents, "contents")
    edges = contents.select("anchor", "content", "n", F.posexplode("edges").alias("place", "edge"))
    often = edges.groupBy("anchor", "edge").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "edge")
    # At most window - seed + 1 places of a content.
    hits = edges.join(often, ["anchor", "edge"]).groupBy("anchor", "content").agg(F.collect_list("place").alias("places"))
    single = branching.join(hits, ["anchor", "content"]).select("k1", "k2", "places", F.explode("begins").alias("begin"))
    single = single.select("k1", "k2", F.explode(F.transform("places", lambda p: F.col("begin") + p)).alias("begin"), F.lit(1).alias("windows"))
    spans = whole.unionByName(single).groupBy("k1", "k2").agg(F.collect_list(F.struct("begin", "windows")).alias("spans"))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    other = [] if docs.schema["text"].dataType == T.StringType() else [text]
    spanned = docs.select(*row_keys(docs), row, *other).join(spans, ["k1", "k2"], "left").select("row", "spans", *(["text"] if other else []))
    return _cut(spanned, window, spanned.schema["row"].dataType)
