"""Toxicity by nearest labelled examples.

Labelled texts are vectors of TF-IDF weights over all their terms; terms that tell the labels apart
weigh more, by their G2 statistic. The index is inverted and block-max: examples stand in blocks of
similar ones, and of each term that is common in its group a block knows the greatest weight. The
lists of all less common terms are added up in full; with the greatest weights of the common ones
they bound the cosines in each block, and only blocks whose bound reaches the k-th best cosine so far are looked
into. Cosines near the k-th best are computed again in full, so the nearest examples are exact.
Their votes, weighted by cosine and shrunk towards the share of toxic examples, are calibrated: a
logistic curve over their log odds is fitted to examples that vote with themselves left out. The nearest
examples' ids are the evidence.

The classifier is fitted on at most SAMPLE labelled texts (those with the least hash of their id);
document frequencies come from all documents, and at most CALIBRATION of the texts fit the curve. The vocabulary is all terms of these texts. Terms,
vectors and index are bounded by the sample, so they are broadcast.

Defined cases: texts without any term of the vocabulary (null and empty ones too) get the share of
toxic examples among the examples without a term; repeated rows score alike; examples at equal
cosine as the k-th all vote; labels of one id that differ, null labels and labels without a document
are left out; without examples every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, collect_bounded, fold_of, lean, materialise, pieces, split_words, strip_terms, texts_in, texts_of, tune, with_row

SAMPLE = 20_000
#: A term's weight grows by its G2 over this.
G2_UNIT = 24.0
NEIGHBOURS = 25
#: The most common terms of a group, whose weights are multiplied as a matrix.
COMMON = 512
#: Examples of one block of the index, and groups of similar examples.
BLOCK = 128
CLUSTERS = 32
#: Texts that are scored at once.
CHUNK = 128
#: Postings that are added up at once.
ADDED = 1 << 18
#: Cosines of the first look are single precision; what lies so near the k-th best is looked at again.
SLACK = 1e-5
SHRINK = 2.0
THRESHOLD = 0.3
#: Examples that calibrate the votes.
CALIBRATION = 5_000
EVIDENCE = 3


def term_ids(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of the vocabulary's terms in each text, by row and term.

    What is kept of each word of a text is bounded by PIECE. A piece's own terms are few, so the vocabulary
    is looked up in a hash table of these, not these in one of the vocabulary.
    """
    found = [(np.zeros(0, np.int64),) * 3]
    for first, part in pieces(texts):
        words = split_words(part)
        own = strip_terms(words.vocab).cast(terms.type).dictionary_encode()
        place = pc.index_in(terms, own.dictionary)
        some = pc.indices_nonzero(place.is_valid())
        known = np.full(len(own.dictionary), -1, np.int64)
        known[place.take(some).to_numpy()] = some.to_numpy()
        term = known[own.indices.to_numpy()][words.ids] if len(words) else words.ids
        at = np.flatnonzero(term >= 0)
        key = words.row_of[at] * (len(terms) + 1) + term[at]
        key, times = np.unique(key, return_counts=True)
        found.append((key // (len(terms) + 1) + first, key % (len(terms) + 1), times))
    return tuple(np.concatenate([x[k] for x in found]) for k in range(3))


def spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of each span, one span after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + length, length)


def clusters_of(rows: np.ndarray, count: int = CLUSTERS, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(cluster of each row, unit centres) by spherical k-means; rows become unit vectors. Only which blocks are looked at depends on it."""
    n = len(rows)
    rows /= np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9)[:, None]
    centres = rows[np.linspace(0, n - 1, min(count, n)).astype(np.int64)].copy()
    for step in range(rounds + 1):
        of = (rows @ centres.T).argmax(1)
        if step < rounds:
            for c in range(len(centres)):
                own = rows[of == c]
                if len(own):
                    total = own.sum(0)
                    centres[c] = total / max(float(np.linalg.norm(total)), 1e-9)
    return of, centres


def nearest_places(cosines: np.ndarray, least: np.float32, k: int) -> np.ndarray:
    """Where the k greatest cosines of at least so much stand, and those within SLACK of the last of them."""
    at = np.flatnonzero(cosines >= least)
    if len(at) > k:
        own = cosines.take(at)
        at = at[own >= np.partition(own, len(at) - k)[len(at) - k] - np.float32(SLACK)]
    return at


def most_common(df: np.ndarray) -> np.ndarray:
    """The COMMON numbers of the highest counts, without those of none."""
    common = np.argsort(-df, kind="stable")[:COMMON]
    return common[df[common] > 0]


def log_odds(share: np.ndarray) -> np.ndarray:
    own = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(own / (1 - own))


def curve(z: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method; (1, 0) where there is no rising one."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    x, w = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2), x.T @ (p - y) + ridge * (w - (1.0, 0.0)))
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-10:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def beside(numbers: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A number (32 bits) and a weight (single precision) in one 64-bit word each."""
    out = np.empty((len(numbers), 2), np.int32)
    out[:, 0] = numbers
    out.view(np.float32)[:, 1] = weights
    return out.reshape(-1).view(np.int64)


@dataclass
class Index:
    """Distinct example vectors: terms and times of all, and where each vector begins."""

    terms: pa.Array
    scale: np.ndarray  # of each term: idf and weight by G2
    offsets: np.ndarray
    term: np.ndarray
    times: np.ndarray
    positive: np.ndarray
    negative: np.ndarray
    first_id: np.ndarray
    empty: float
    prior: float
    slope: float = 1.0  # of the curve over the log odds of the votes
    offset: float = 0.0
    ready: bool = False

    def __getstate__(self) -> dict:
        """What `prepare` makes is left out: it is made again where it is used."""
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "ready"} | {"ready": False}

    @property
    def vectors(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(self.term[a:b].astype(np.int64), self.times[a:b]) for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]

    def weights(self, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        w = (1 + np.log(np.asarray(times, np.float64))) * self.scale[term]
        return w / np.sqrt((w * w).sum())

    def prepare(self) -> None:
        """Groups of similar vectors, their blocks and the postings; made where they are used, once.

        A place is a vector's number in block order. Each group has its own common terms: of these its
        vectors stand as rows of a matrix, and postings hold all other terms.
        """
        if self.ready:
            return
        n, size = len(self.first_id), np.diff(self.offsets)
        self.tf = 1 + np.log(np.arange(1, int(self.times.max(initial=1)) + 1))
        self.norm, squares, df = np.ones(n), np.zeros(n), np.zeros(len(self.scale), np.int64)
        for of, term, own in self._entries(np.arange(n)):
            squares += np.bincount(of, own * own, minlength=n)
            df += np.bincount(term, minlength=len(df))
        self.norm = np.sqrt(squares)
        self.sorter = np.full(len(df), -1, np.int16)
        common = most_common(df)
        self.sorter[common] = np.arange(len(common))
        self.matrix = np.zeros((n, COMMON), np.float32)
        for of, term, own in self._entries(np.arange(n)):
            column = self.sorter.take(term)
            self.matrix[of[column >= 0], column[column >= 0]] = own[column >= 0]
        cluster, self.centres = clusters_of(self.matrix)
        self.order = np.argsort(cluster, kind="stable")
        starts = np.searchsorted(cluster[self.order], np.arange(len(self.centres) + 1))
        members = [self.order[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n, dtype=np.int32)
        self.matrix[:] = 0
        commons = []
        self.length = df  # of each term: entries that are not common in their group
        column = np.full(len(df), -1, np.int16)
        for vectors in members:
            own_df = np.zeros(len(df), np.int64)
            for _, term, _ in self._entries(vectors):
                own_df += np.bincount(term, minlength=len(df))
            commons.append(most_common(own_df))
            df[commons[-1]] -= own_df[commons[-1]]
            column[commons[-1]] = np.arange(len(commons[-1]))
            for of, term, own in self._entries(vectors):
                at = column.take(term)
                self.matrix[place[of[at >= 0]], at[at >= 0]] = own[at >= 0]
            column[commons[-1]] = -1
        # Of terms that are common in some group: a number, and their columns in each group.
        some = np.unique(np.concatenate(commons))
        self.number = np.full(len(df), -1, np.int32)
        self.number[some] = np.arange(len(some))
        self.slot = np.full((len(self.centres), len(some) + 1), -1, np.int16)  # the last for all other terms
        for g, common in enumerate(commons):
            self.slot[g, self.number[common]] = np.arange(len(common))
        # Blocks end with their group.
        cuts = [np.arange(a, b, BLOCK) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self.blocks = np.concatenate(cuts)
        self.ends = np.append(self.blocks[1:], n)
        self.first_block = np.concatenate([[0], np.cumsum([len(c) for c in cuts])])
        self.most = np.maximum.reduceat(self.matrix, self.blocks, axis=0)
        self.longest = np.maximum.reduceat(np.sqrt(np.einsum("ij,ij->i", self.matrix, self.matrix)), self.blocks)
        begin = np.concatenate([[0], np.cumsum(df)])
        posting, free = np.empty(begin[-1], np.int64), begin[:-1].copy()
        for g, vectors in enumerate(members):
            for of, term, own in self._entries(vectors):
                rest = np.flatnonzero(self.slot[g].take(self.number.take(term), mode="wrap") < 0)
                rest = rest[np.argsort(term[rest], kind="stable")]
                term = term[rest]
                posting[free[term] + np.arange(len(term)) - np.searchsorted(term, term)] = beside(place[of[rest]], own[rest])
                free += np.bincount(term, minlength=len(df))
        self.postings = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(posting))
        self.query = np.zeros(len(df))
        self.ready = True

    def _entries(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Vector, term and weight of all entries of some vectors, a few vectors at a time."""
        for first in range(0, len(vectors), 1024):
            part = vectors[first : first + 1024]
            size = self.offsets[part + 1] - self.offsets[part]
            here = spans(self.offsets[part], size)
            of, term = np.repeat(part, size), self.term.take(here)
            yield of, term, self.tf.take(self.times.take(here) - 1) * self.scale.take(term) / self.norm.take(of)

    def rest(self, row: np.ndarray, term: np.ndarray, own: np.ndarray, rows: int) -> np.ndarray:
        """What terms that are not common in an example's group add to the cosines of texts (rows) with it, in single precision."""
        n = len(self.first_id)
        out = np.zeros((rows, n), np.float32)
        length = self.length.take(term)
        total = np.cumsum(length)
        cuts = np.unique(np.searchsorted(total, np.arange(0, (total[-1] if len(total) else 0) + ADDED, ADDED), side="right"))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            # A place (or a text's first cell) and a weight stand side by side in eight bytes, so that both are fetched at once.
            found = self.postings.take(pa.array(term[a:b])).flatten().to_numpy().view(np.int32).reshape(-1, 2)
            asked = np.repeat(beside(row[a:b] * n, own[a:b]), length[a:b]).view(np.int32).reshape(-1, 2)
            np.add.at(out.reshape(-1), found[:, 0] + asked[:, 0], found.view(np.float32)[:, 1] * asked.view(np.float32)[:, 1])
        return out

    def rough(self, row: np.ndarray, term: np.ndarray, own: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of texts (rows): cosines with the examples by place, in single precision, and the least that counts. What cannot reach it may be too low.

        A block's bound: what its terms weigh at most. The two best blocks of each text give a first
        k-th cosine; blocks whose bound stays below it are never looked at.
        """
        out = self.rest(row, term, own, rows)
        bound = np.maximum.reduceat(out, self.blocks, axis=1)
        asked = np.zeros((len(self.centres), rows, self.matrix.shape[1]), np.float32)
        number = self.number.take(term)
        some = np.flatnonzero(number >= 0)
        row, number, own = row.take(some), number.take(some), own.take(some).astype(np.float32)
        group = np.repeat(np.arange(len(self.centres)), np.diff(self.first_block))
        for g, weights in enumerate(asked):
            slot = self.slot[g].take(number)
            common = np.flatnonzero(slot >= 0)
            weights[row.take(common), slot.take(common)] = own.take(common)
            own_blocks = slice(self.first_block[g], self.first_block[g + 1])
            bound[:, own_blocks] += np.minimum(weights @ self.most[own_blocks].T, np.sqrt(np.einsum("ij,ij->i", weights, weights))[:, None] * self.longest[own_blocks])

        def look(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(0)).tolist():
                texts = np.flatnonzero(wanted[:, b])
                run = slice(self.blocks[b], self.ends[b])
                out[texts, run] += asked[group[b]].take(texts, axis=0) @ self.matrix[run].T

        first = np.zeros(bound.shape, bool)
        best = np.argpartition(bound, -min(2, bound.shape[1]), axis=1)[:, -2:]
        first[np.arange(rows)[:, None], best] = True
        look(first)
        place = self.blocks[best][:, :, None] + np.arange(BLOCK)
        seen = np.where(place < self.ends[best][:, :, None], out[np.arange(rows)[:, None, None], np.minimum(place, out.shape[1] - 1)], np.float32(-1)).reshape(rows, -1)
        least = np.partition(seen, seen.shape[1] - k, axis=1)[:, seen.shape[1] - k] - np.float32(SLACK) if seen.shape[1] >= k else np.full(rows, -1.0, np.float32)
        look((bound >= least[:, None] - SLACK) & ~first)
        return out, least

    def exact(self, at: np.ndarray, term: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Cosines of a text with some vectors in double precision."""
        self.query[term] = own * self.scale.take(term)
        begin = self.offsets.take(at)
        length = self.offsets.take(at + 1) - begin
        posting = spans(begin, length)
        value = self.query.take(self.term.take(posting)) * self.tf.take(self.times.take(posting) - 1)
        self.query[term] = 0
        return np.bincount(np.repeat(np.arange(len(at)), length), value, minlength=len(at)) / self.norm.take(at)

    def nearest_of(self, row: np.ndarray, term: np.ndarray, times: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, vector, cosine) by text and falling cosine: of each text (row: ascending numbers, all of them from 0) the vectors of at least k examples with the greatest cosines, ties at the end included.

        Cosines are single precision; where the last vector lies within SLACK of the next one, all near it are taken in double precision.
        """
        self.prepare()
        own = (1 + np.log(np.asarray(times, np.float64))) * self.scale[term]
        rows = int(row[-1]) + 1 if len(row) else 0
        own = own / np.sqrt(np.bincount(row, own * own, minlength=rows))[row]
        cuts = np.searchsorted(row, np.arange(rows + 1))
        votes = self.positive + self.negative
        found = []
        # Texts of one cluster stand together: they look at the same blocks.
        for here in np.array_split(self._by_cluster(row, term, own, rows), -(-rows // CHUNK)) if rows else []:
            size = cuts[here + 1] - cuts[here]
            at = spans(cuts[here], size)
            rough, least = self.rough(np.repeat(np.arange(len(here)), size), term[at], own[at], len(here), k)
            best = [nearest_places(x, y, k) for x, y in zip(rough, np.maximum(least, np.nextafter(np.float32(0), np.float32(1))), strict=True)]
            text, place = np.repeat(np.arange(len(here)), [len(x) for x in best]), np.concatenate(best)
            cosine = rough[text, place].astype(np.float64)
            vector = self.order.take(place)
            near = np.lexsort((vector, -cosine, text))
            text, cosine, vector = text[near], cosine[near], vector[near]
            first = np.searchsorted(text, np.arange(len(here) + 1))
            # Vectors before which there are less than k votes stay, and what ties with the last of them.
            before = np.cumsum(votes[vector]) - votes[vector]
            keep = before - before[np.minimum(first[:-1], len(text) - 1)][text] < k
            last = np.bincount(text[keep], minlength=len(here)) + first[:-1] - 1
            edge = np.flatnonzero((last >= first[:-1]) & (last + 1 < first[1:]))
            close = edge[cosine[last[edge]] - cosine[last[edge] + 1] < SLACK]
            for j in close.tolist():
                mine = np.arange(first[j], first[j + 1])
                mine = mine[cosine[mine] >= cosine[last[j]] - SLACK]
                entries = slice(cuts[here[j]], cuts[here[j] + 1])
                value = self.exact(vector[mine], term[entries], own[entries])
                again = np.lexsort((vector[mine], -value))
                vector[mine], cosine[mine] = vector[mine][again], value[again]
                enough = int(np.searchsorted(np.cumsum(votes[vector[mine]]), k))
                keep[mine] = value[again] >= value[again][min(enough, len(mine) - 1)] - 1e-12
            found.append((here[text[keep]], vector[keep], cosine[keep]))
        if not found:
            return self._nothing()
        text, vector, cosine = (np.concatenate([f[i] for f in found]) for i in range(3))
        near = np.argsort(text, kind="stable")
        return text[near], vector[near], cosine[near]

    @staticmethod
    def _nothing() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def _by_cluster(self, row: np.ndarray, term: np.ndarray, own: np.ndarray, rows: int) -> np.ndarray:
        """Texts in the order of the group next to them."""
        slot = self.sorter.take(term)
        nearest = np.zeros(rows, np.int64)
        for first in range(0, rows, 500):
            last = min(first + 500, rows)
            here = np.flatnonzero((slot >= 0) & (row >= first) & (row < last))
            weights = np.zeros((last - first, self.matrix.shape[1]), np.float32)
            weights[row[here] - first, slot[here]] = own[here]
            nearest[first:last] = (weights @ self.centres.T).argmax(1)
        return np.argsort(nearest, kind="stable")

    def nearest(self, term: np.ndarray, times: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of(np.zeros(len(term), np.int64), term, times, k)[1:]

    def votes(self, row: np.ndarray, term: np.ndarray, times: np.ndarray, rows: int, own: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array]:
        """Share of votes for toxic and evidence of each of so many texts; own: labels of texts that are examples themselves and do not vote."""
        present, place = np.unique(row, return_inverse=True)
        k = NEIGHBOURS + (own is not None)
        text, vector, cosine = self.nearest_of(place, term, times, k) if len(self.first_id) else self._nothing()
        text = present[text]
        nth = np.arange(len(text)) - np.searchsorted(text, text)
        ayes, noes = self.positive[vector].astype(np.float64), self.negative[vector].astype(np.float64)
        if own is not None:
            mine = (nth == 0) & (cosine > 1 - SLACK)
            ayes[mine] -= own[text[mine]] == 1
            noes[mine] -= own[text[mine]] != 1
        pos, neg = np.bincount(text, cosine * ayes, minlength=rows), np.bincount(text, cosine * noes, minlength=rows)
        share = (pos + SHRINK * self.prior) / (pos + neg + SHRINK)
        shown = nth < EVIDENCE
        near = pa.StructArray.from_arrays([pa.array(self.first_id[vector[shown]]), pa.array(cosine[shown])], names=["doc_id", "cosine"])
        size = np.bincount(text[shown], minlength=rows)
        return share, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), near)

    def score(self, row: np.ndarray, term: np.ndarray, times: np.ndarray, rows: int, slope: float | None = None, offset: float | None = None) -> tuple[np.ndarray, pa.Array]:
        """Score and evidence of each of so many texts."""
        share, evidence = self.votes(row, term, times, rows)
        slope, offset = (self.slope, self.offset) if slope is None else (slope, offset)
        scores = 1 / (1 + np.exp(-(slope * log_odds(share) + offset)))
        known = (np.bincount(row, minlength=rows) > 0) & (len(self.first_id) > 0)
        return np.where(known, scores, self.empty), evidence

    def shared(self, spark: SparkSession):
        """The index as a broadcast, made once; the curve is not part of it."""
        if getattr(self, "_shared", None) is None:
            self._shared = spark.sparkContext.broadcast(self)
        return self._shared


def _examples(docs: DataFrame, labels: DataFrame, folds: int, held_fold: int, sample: int) -> DataFrame:
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    chosen = own.where(fold_of(F.col("doc_id"), folds) != held_fold).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # At most `sample` rows of two numbers are broadcast; the documents are not shuffled.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def _term_rows(examples: DataFrame) -> DataFrame:
    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, labels = [pa.array([], pa.string())], [batch.column("toxic").slice(0, 0)]
            for first, part in pieces(texts_of(batch.column("text"))):
                words = split_words(part)
                terms = strip_terms(words.vocab).dictionary_encode()
                own = terms.indices.to_numpy()[words.ids]
                key = np.unique(words.row_of * max(len(terms.dictionary), 1) + own)
                row, term = key // max(len(terms.dictionary), 1) + first, key % max(len(terms.dictionary), 1)
                found.append(terms.dictionary.take(pa.array(term)).cast(pa.string()))
                labels.append(batch.column("toxic").take(pa.array(row)))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(found), pa.concat_arrays(labels)], names=["term", "toxic"])

        return each

    return arrow_map(examples.select("text", F.col("toxic").cast("int").alias("toxic")), make, "term string, toxic int")


def _vocabulary(examples: DataFrame, positive: int, negative: int) -> tuple[pa.Array, np.ndarray]:
    """All terms of the examples, and the G2 of (term in text) against the label of each."""
    table = _term_rows(examples).where("term != ''").groupBy("term").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("a"), F.sum((F.col("toxic") != 1).cast("long")).alias("b")).orderBy("term").toArrow()
    a, b = (table.column(c).to_numpy().astype(np.float64) for c in ("a", "b"))
    n = float(positive + negative)

    def part(seen: np.ndarray, row: np.ndarray, col: int) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) * n / np.maximum(row * max(col, 1), 1)), 0.0)

    g2 = 2 * (part(a, a + b, positive) + part(b, a + b, negative) + part(positive - a, n - a - b, positive) + part(negative - b, n - a - b, negative))
    return table.column("term").combine_chunks().cast(pa.large_string()), np.maximum(g2, 0.0)


def _frequencies(docs: DataFrame, terms: pa.Array) -> tuple[np.ndarray, int]:
    """Texts that hold each term, over all documents, and how many texts there are."""

    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        terms = shared.value
        total = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            _, term, _ = term_ids(texts_of(batch.column(0)), terms)
            total[: len(terms)] += np.bincount(term, minlength=len(terms))[: len(terms)]
            total[-1] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    sums = collect_bounded(docs.select(docs["text"].cast("string").alias("text")).mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), len(terms) + 1)
    out = np.zeros(len(terms) + 1, np.int64)
    out[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    return out[:-1], int(out[-1])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_fold: int = 2, sample: int = SAMPLE, g2_unit: float = G2_UNIT) -> Index:
    """The index of labelled examples outside the held-out fold."""
    tune(docs.sparkSession)
    examples = materialise(_examples(docs, labels, folds, held_fold, sample), "examples")
    positive, total = examples.agg(F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)), F.count("*")).first()
    terms, g2 = _vocabulary(examples, positive, total - positive)
    df, n = _frequencies(docs, terms)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def make():
        terms = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, term, times = term_ids(texts_of(batch.column("text")), terms)
            size = np.bincount(row, minlength=batch.num_rows)
            ends = 2 * np.concatenate([[0], np.cumsum(size)])
            vector = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.stack([term, times], 1).reshape(-1).astype(np.int32)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), vector], names=["doc_id", "toxic", "vector"])

        return each

    vectors = arrow_map(examples.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text"), make, "doc_id long, toxic int, vector array<int>")
    merged = vectors.groupBy("vector").agg(F.sum((F.col("toxic") == 1).cast("long")).alias("pos"), F.sum((F.col("toxic") != 1).cast("long")).alias("neg"), F.min("doc_id").alias("first_id")).orderBy("first_id")
    table = collect_bounded(merged, sample)
    prior = positive / total if total else 0.0
    size = pc.list_value_length(table.column("vector")).to_numpy()
    pos, neg, first_id = (table.column(c).to_numpy() for c in ("pos", "neg", "first_id"))
    none, some = np.flatnonzero(size == 0), size > 0
    empty = (pos[none[0]] + SHRINK * prior) / (pos[none[0]] + neg[none[0]] + SHRINK) if len(none) else prior
    pairs = pc.list_flatten(table.column("vector")).to_numpy().reshape(-1, 2)
    offsets = np.concatenate([[0], np.cumsum(size[some] // 2)]).astype(np.int64)
    scale = (np.log((1 + n) / (1 + df)) + 1) * (1 + g2 / g2_unit)
    times = pairs[:, 1].astype(np.min_scalar_type(int(pairs[:, 1].max(initial=1))))
    index = Index(terms, scale, offsets, pairs[:, 0].astype(np.int32), times, pos[some], neg[some], first_id[some], float(empty), float(prior))
    del table, pairs, size, pos, neg, first_id
    index.slope, index.offset = _calibrated(examples, index)
    return index


def _calibrated(examples: DataFrame, index: Index) -> tuple[float, float]:
    """The curve that turns votes into probabilities, from examples that do not vote for themselves."""
    shared = index.shared(examples.sparkSession)

    def make():
        own = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            row, term, times = term_ids(texts_of(batch.column("text")), own.terms)
            if not len(row) or not len(own.first_id):
                return None
            labels = batch.column("toxic").to_numpy()
            share, _ = own.votes(row, term, times, batch.num_rows, labels)
            some = np.unique(row)
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), pa.array(log_odds(share[some])), pa.array(labels[some])], names=["doc_id", "z", "toxic"])

        return each

    # Ids only pass through one task; the texts stay where they are, and are dealt anew for scoring.
    ids = examples.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(CALIBRATION)
    chosen = examples.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text").join(F.broadcast(ids), "doc_id")
    dealt = chosen.repartition(max(1, examples.sparkSession.sparkContext.defaultParallelism), "doc_id")
    table = collect_bounded(arrow_map(dealt, make, "doc_id long, z double, toxic int").orderBy("doc_id"), CALIBRATION)
    return curve(table.column("z").to_numpy(), (table.column("toxic").to_numpy() == 1).astype(np.float64))


def apply(docs: DataFrame, index: Index, keep: list[str] | None = None) -> DataFrame:
    """row (the document as it came, or its columns in keep), score, and evidence: the nearest examples and their cosines."""
    shared, slope, offset = index.shared(docs.sparkSession), index.slope, index.offset
    rows = with_row(docs, keep)

    def make():
        own = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, term, times = term_ids(texts_in(batch), own.terms)
            scores, evidence = own.score(row, term, times, batch.num_rows, slope, offset)
            return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores), evidence], names=["row", "score", "evidence"])

        return each

    evidence = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType())]))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType()), T.StructField("evidence", evidence)])
    return arrow_map(rows, make, schema)


def score(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **how) -> DataFrame:
    return apply(docs, fit(docs, labels, **how), keep)
