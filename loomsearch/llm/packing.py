"""Hierarchical multi-length packing of documents into training sequences.

Every document becomes its token ids and an end id, and goes to the tier of the smallest context
size that holds it; what is longer is cut into whole longest windows first. A tier fills windows
of exactly its size, cutting the document at a window's edge. At the end of a partition the
longest open window is filled from the next shorter tiers, and what is left becomes windows of
powers of two, so no token of padding is needed. Windows gather into slots as long as the longest
tier, slots into step groups. A group ends at step_slots slots full of tokens; what is left at a
partition's end is a group of its own from half of that on, else its windows go round the groups
before. So groups differ only by such windows, and by the last group of each partition.

Packing is local to an input partition: no shuffle, memory for one Arrow batch and one open window
a tier, and a lost executor's partition is packed again with the same result.

Defined cases: a null or empty text is its end id alone; a null doc_id stays null; repeated rows
are packed each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import lean, texts_of, tune
from .tokens import WordBpe

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Slots of the longest tier that one training step takes.
STEP_SLOTS = 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, tier int, step_group long"


class Packer:
    """Packs the pieces of one partition. A piece: (document's number, start, length)."""

    def __init__(self, tiers: tuple[int, ...], first_id: int, step_slots: int):
        self.tiers, self.next_id, self.first_id = tiers, first_id, first_id
        self.open: dict[int, list] = {t: [] for t in tiers}
        self.room = {t: t for t in tiers}
        self.slots: dict[int, list] = {t: [] for t in tiers}
        self.group: list[tuple] = []  # windows of the step group that is being filled
        self.filled = self.steps = 0
        self.step_tokens = step_slots * tiers[-1]
        self.out: list[tuple] = []

    def waiting(self) -> set:
        """Documents of which pieces are not put out yet."""
        windows = [w for t in self.tiers for w, _ in self.slots[t]] + [w for w, *_ in self.group] + list(self.open.values())
        return {piece[0] for w in windows for piece in w}

    def add(self, doc, tokens: int) -> None:
        start, longest = 0, self.tiers[-1]
        while tokens - start >= longest and start % longest == 0 and self.room[longest] == longest:
            self._put(longest, doc, start, longest)
            start += longest
        if rest := tokens - start:
            self._put(next((t for t in self.tiers if rest <= t), longest), doc, start, rest)

    def _put(self, tier: int, doc, start: int, length: int) -> None:
        while length:
            part = min(length, self.room[tier])
            self.open[tier].append((doc, start, part))
            self.room[tier] -= part
            start, length = start + part, length - part
            if not self.room[tier]:
                self._window(tier, self.open[tier], tier)
                self.open[tier], self.room[tier] = [], tier

    def _window(self, tier: int, pieces: list, size: int) -> None:
        """A full window waits until its slot holds as many tokens as the longest window."""
        self.slots[tier].append((pieces, size))
        if len(self.slots[tier]) * tier >= self.tiers[-1]:
            self._slot(tier)

    def _slot(self, tier: int) -> None:
        for pieces, size in self.slots[tier]:
            self.group.append((pieces, size, tier))
            self.filled += size
        self.slots[tier] = []
        if self.filled >= self.step_tokens:
            self._step()

    def _step(self) -> None:
        for window in self.group:
            self._put_out(window, self.steps)
        self.group, self.filled, self.steps = [], 0, self.steps + 1

    def _put_out(self, window: tuple, step: int) -> None:
        pieces, size, tier = window
        at = 0
        for doc, start, length in pieces:
            self.out.append((doc, start, length, self.next_id, at, size, tier, self.first_id + step))
            at += length
        self.next_id += 1

    def end(self) -> None:
        """Fills the long tiers' open windows from the shorter ones, then cuts the rest at powers of two."""
        pieces = []
        for tier in reversed(self.tiers):
            pieces += self.open[tier]
            self.open[tier], self.room[tier] = [], tier
        left = sum(x[2] for x in pieces)
        pieces.reverse()
        for tier in reversed(self.tiers):
            self._slot(tier)
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            window, need = [], size
            while need:
                doc, start, length = pieces.pop()
                part = min(need, length)
                window.append((doc, start, part))
                if part < length:
                    pieces.append((doc, start + part, length - part))
                need -= part
            tier = next(t for t in self.tiers if size <= t)
            self.slots[tier].append((window, size))
            self._slot(tier)
            left -= size
        if 2 * self.filled >= self.step_tokens or not self.steps:
            self._step()
        for k, window in enumerate(self.group):
            self._put_out(window, k % self.steps)
        self.group = []


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_slots: int = STEP_SLOTS, with_ids: bool = False) -> DataFrame:
    """One row a piece: which tokens of its document it holds and where they stand. with_ids adds the ids themselves.

    tokenizer: path of a tokenizers file, there on every worker. tiers: rising powers of two.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError(f"tiers must be rising powers of two: {tiers}")
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(tokenizer)
        packer = Packer(tiers, TaskContext.get().partitionId() << 32, step_slots)
        live: dict[int, tuple] = {}  # documents of which pieces wait: id, ids
        number = 0

        def emit() -> pa.RecordBatch:
            rows = packer.out
            packer.out = []
            cols: list[list] = [[] for _ in range(11)]
            for doc, start, length, seq, at, size, tier, step in rows:
                doc_id, ids = live[doc]
                own = ids[start : start + length]
                for col, x in zip(cols, (doc_id, start, length, zlib.crc32(own.tobytes()), len(ids), seq, at, size, tier, step), strict=False):
                    col.append(x)
                if with_ids:
                    cols[10].append(own)
            waiting = packer.waiting()
            for doc in [d for d in live if d not in waiting]:
                del live[doc]
            kinds = [pa.int64()] * 8 + [pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=False)] + [pa.array(cols[10], pa.list_(pa.int64()))] * with_ids
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids)

        for batch in batches:
            ids, bounds = bpe.encode(texts_of(batch.column(1)))
            ids = ids.astype("<u4")
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                live[number] = (doc_id, np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4"))
                packer.add(number, len(live[number][1]))
                number += 1
            yield emit()
        packer.end()
        yield emit()

    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return columns.mapInArrow(lean(run), PIECES + ", ids array<long>" * with_ids)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
