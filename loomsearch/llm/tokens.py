"""Token ids of the public word-level BPE, fast enough for whole corpora.

The tokenizer drops white space and treats every run between white space by itself, so a text's
ids are those of its runs, one after the other. A batch's distinct runs are encoded once. Runs of
plain letters go through a BPE that merges many words at a time; every other run goes through the
tokenizers library, which the tests hold the vectorised part against.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Words, bytes_of, split_words

#: Runs for which lower-casing and the split pattern are plain: Latin letters, and ASCII marks but the apostrophe (it begins contractions) and digits.
PLAIN = "^[A-Za-zß-öø-ÿÀ-ÖØ-Þ!-&(-/:-@\\[-`{-~]+$"
SPECIAL = "<|"
#: The rank of a pair that no merge joins.
NONE = 1 << 30
#: Distinct runs that a worker keeps with their ids; beyond it the memory starts anew.
REMEMBER = 600_000


#: Of a plain run's bytes, those of letters.
LETTER = np.array([chr(b).isalpha() or b >= 128 for b in range(256)])


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """ids of texts under a tokenizers file of this kind (byte letters, word ends, lower case)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + end] for x in letters], np.int32)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.width = len(vocab)
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._table(keys, np.arange(len(keys)), made)
        # The first round's pairs are of bytes: [does a word end here][left byte][right byte].
        left = np.repeat(self.inner, 256)
        first = [self._rank(left, np.tile(x, 256)) for x in (self.inner, self.last)]
        self.byte_rank = np.concatenate([x for x, _ in first])
        self.byte_made = np.concatenate([x for _, x in first])
        self.known = pa.array([], pa.large_string())
        self.known_ids, self.known_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _table(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        """An open hash table over the merges, probed for whole arrays at once."""
        self.bits = 18
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.zeros(1 << self.bits, np.int32)
        self.made = np.zeros(1 << self.bits, np.int32)
        at = self._slot(keys)
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = keys[free]  # of several for a slot the last stays
            won = self.slots[at[left]] == keys[left]
            self.rank[at[left[won]]], self.made[at[left[won]]] = ranks[left[won]], made[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair's merge (a large number: none) and what it makes."""
        keys = left.astype(np.int64) * self.width + right
        at = self._slot(keys)
        rank, made = np.full(len(keys), NONE, np.int32), np.zeros(len(keys), np.int32)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.slots[at[open_]]
            hit = found == keys[open_]
            rank[open_[hit]], made[open_[hit]] = self.rank[at[open_[hit]]], self.made[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return rank, made

    def _bpe(self, data: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of many words side by side (head: where one begins), and the byte that each begins at.

        In each round every word applies its lowest-ranked pair wherever it stands, leftmost first.
        """
        ids = self.inner[data]
        ends = np.concatenate([head[1:], [True]]) if len(head) else head
        ids[ends] = self.last[data[ends]]
        word = np.cumsum(head, dtype=np.int32)
        done_at, done_id = [], []
        position = np.arange(len(ids), dtype=np.int32)
        pair = np.zeros(len(ids), np.int64)
        pair[:-1] = data[:-1].astype(np.int64) << 8 | data[1:]
        pair[:-1] |= ends[1:].astype(np.int64) << 16
        rank, made = self.byte_rank[pair], self.byte_made[pair]
        rank[ends] = NONE
        while len(ids):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, begin)
            live = best < (NONE)
            span = np.diff(np.concatenate([begin, [len(ids)]]))
            stay = np.repeat(live, span)
            done_at.append(position[~stay])
            done_id.append(ids[~stay])
            if not live.any():
                break
            hit = (rank == np.repeat(best, span)) & stay
            # Of overlapping equal pairs (a a a) the first merges: a hit right after a taken one is not taken.
            run = np.flatnonzero(hit)
            if len(run) > 1 and (np.diff(run) == 1).any():
                first = np.concatenate([[True], np.diff(run) != 1])
                depth = np.arange(len(run)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                run = run[depth % 2 == 0]
            ids[run] = made[run]
            gone = np.zeros(len(ids), bool)
            gone[run + 1] = True
            keep = stay & ~gone
            touched = np.zeros(len(ids), bool)
            touched[run] = True
            before = np.flatnonzero(keep)
            ids, word, position, rank, made, touched = (x[before] for x in (ids, word, position, rank, made, touched))
            # Only pairs next to a merged symbol change.
            fresh = touched.copy()
            fresh[:-1] |= touched[1:]
            at = np.flatnonzero(fresh)
            rank[at], made[at] = self._pairs_at(ids, word, at)
        order, flat = np.concatenate(done_at or [np.zeros(0, np.int64)]), np.concatenate(done_id or [np.zeros(0, np.int64)])
        sort = np.argsort(order)
        return flat[sort].astype(np.uint32), order[sort]

    def _pairs_at(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.minimum(at + 1, len(ids) - 1)
        rank, made = self._rank(ids[at], ids[after])
        rank[(after == at) | (word[after] != word[at])] = NONE
        return rank, made

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of each run, one after the other, and how many each has."""
        plain = pc.and_(pc.match_substring_regex(runs, PLAIN), pc.invert(pc.match_substring(runs, SPECIAL)))
        plain = plain.to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(runs.filter(pa.array(plain)))
        data, bounds = bytes_of(low)
        size, first = np.diff(bounds), bounds[:-1]
        letter = LETTER[data]
        head = np.ones(len(data), bool)
        head[1:] = letter[1:] != letter[:-1]
        head[first] = True
        flat, at = self._bpe(data, head)
        counts = np.zeros(len(runs), np.int64)
        counts[plain] = np.diff(np.concatenate([np.searchsorted(at, first), [len(at)]]))
        if plain.all():
            return flat, counts
        others = [np.array(x.ids, np.uint32) for x in self.library.encode_batch(runs.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        counts[~plain] = [len(x) for x in others]
        out = np.zeros(int(counts.sum()), np.uint32)
        of_plain = np.repeat(plain, counts)
        out[of_plain], out[~of_plain] = flat, np.concatenate(others)
        return out, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after the other, and where each text's begin."""
        words: Words = split_words(texts)
        if len(self.known) > REMEMBER:
            self.known, self.known_ids, self.known_at = self.known.slice(0, 0), self.known_ids[:0], self.known_at[:1]
        at = pc.index_in(words.vocab, value_set=self.known)
        new = pc.is_null(at)
        runs = words.vocab.filter(new)
        new_ids, size = self._runs(runs)
        where = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        where[new.to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + len(runs))
        self.known = pa.concat_arrays([self.known, runs.cast(pa.large_string())])
        self.known_ids = np.concatenate([self.known_ids, new_ids])
        self.known_at = np.concatenate([self.known_at, self.known_at[-1] + np.cumsum(size)])
        table, first, size = self.known_ids, self.known_at[where], (self.known_at[1:] - self.known_at[:-1])[where]
        lengths = size[words.ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(first[words.ids] - ends[:-1], lengths) + np.arange(ends[-1])
        return table[at], ends[words.offsets]
