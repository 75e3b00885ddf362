"""Language-model scores by prediction by partial matching.

Texts are scored as their lower-case (A-Z) words, one space between, and an end symbol: a byte
string that gives the word sequence back. A trie of byte contexts up to ORDER bytes long, learned
from the training rows, predicts every byte: the longest known context first; where the byte has
not followed it, the model pays for an escape (method C: distinct followers against all) and goes
on with the context one byte shorter, which no longer counts the bytes already ruled out (symbol
exclusion). Below the empty context the unseen bytes share what is left evenly. A text's score is
the log10 probability accumulated over its bytes.

Counting is exact over all training bytes, and every string keeps its whole count: each task counts
its (ORDER+1)-byte strings, a shuffle adds them up, and shorter strings are sums over their
extensions. What a byte costs depends on the (ORDER+1)-byte string that ends with it alone, so each
distinct string of the table, one of held-out texts only too, is priced once. All counts that this
takes share the LOCAL bytes before the last one, except those of strings of at most LOCAL bytes: these
few (at most 256^LOCAL of each length) are broadcast, and the strings are priced partitioned by these
bytes. Prices of strings that end at one training position in SHARE at least are broadcast as a
shortcut (at most SHARE of them), all other positions meet their price in a join; so SHARE changes no
score.

The base score of the word unigram works the same way: words of at least one token in WORD_SHARE
are broadcast (at most WORD_SHARE of them), the others meet their counts in a join.

Words and strings are counted by 64-bit codes: strings exactly, words by their XXH3 hash.

Defined cases: null and empty texts are the end alone; a null doc_id counts as an empty text for
the split and stays null; repeated rows count and are scored each; an empty table gives no rows;
without training rows every byte has the even share; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CodeTable, Counter64, bytes_of, collect_bounded, lean, materialise, pieces, split_words, texts_of, tune

ORDER = 5
#: Strings of up to so many bytes are broadcast; longer ones meet by the so many bytes before the last.
LOCAL = 2
#: Strings that are priced at once, if the same bytes do not begin more.
PRICED = 1 << 18
SHARE = 1 << 21
WORD_SHARE = 1 << 22
#: Bytes that are scored at once, so that the arrays stay in the cache.
CHUNK = 1 << 17
END = 10  # a line feed, which no word contains
END_WORD = np.int64(np.uint64(xxhash.xxh3_64_intdigest("\n")).view(np.int64))


def byte_string(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts as they are scored, and the end of each."""
    words = split_words(texts, lower=True)
    spaced = pc.binary_join_element_wise(words.vocab.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    data, at = bytes_of(spaced.take(pa.array(words.ids)))
    # Each text's last space becomes its end; texts without words get one.
    counts = words.counts
    has = counts > 0
    ends = at[words.offsets[1:]]
    out = np.zeros(len(data) + int((~has).sum()), np.uint8)
    shift = np.cumsum(~has)
    place = ends + shift - 1
    mark = np.ones(len(out), bool)
    mark[place[~has]] = False
    out[mark] = data
    out[place] = END
    return out, place


def strings_of(data: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Code of the `length` bytes that end at each position; before a text stand ends."""
    code, have = data.astype(np.int64), 1
    while have < length:
        step = min(have, length - have)
        own = code if step == have else code & ((1 << (8 * step)) - 1)
        code = code.copy()
        code[have:] |= own[: len(own) - have] << (8 * have)
        code[:have] |= int.from_bytes(bytes([END]) * step, "big") << (8 * have)
        have += step
    # The first bytes of a text reach into the text before: ends stand there instead.
    starts = np.concatenate([[0], ends[:-1] + 1])
    for k in range(length - 1):
        at = starts[starts + k <= ends] + k
        code[at] = code[at] & ((1 << (8 * (k + 1))) - 1) | int.from_bytes(bytes([END]) * (length - 1 - k), "big") << (8 * (k + 1))
    return code


@dataclass
class Level:
    """Contexts of one length: strings with one more byte, and what each context pays."""

    table: CodeTable
    count: np.ndarray  # of each string
    logs: np.ndarray  # log10 of it
    first: np.ndarray  # log10 probability of its last byte where its context is the longest known
    contexts: CodeTable
    total: np.ndarray  # of each context: what its strings' counts add up to
    leave: np.ndarray  # weight of its escape: its distinct followers (method C)
    escape: np.ndarray  # log10 of an escape where it is the longest known
    below: np.ndarray  # log10 of what its suffix's counts add up to without its own bytes and with the escape, or nan: nothing left
    below_escape: np.ndarray  # log10 of the suffix's escape then


@dataclass
class Model:
    levels: list[Level]
    even: float

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each (order + 1)-byte string."""
        order = len(self.levels) - 1
        return np.concatenate([self._score(code[s : s + CHUNK], order) for s in range(0, len(code), CHUNK)])

    def _score(self, code: np.ndarray, order: int) -> np.ndarray:
        out = np.zeros(len(code))
        data = code
        todo = np.arange(len(data))
        ruled = np.zeros(len(data), bool)  # an escape was paid; the shorter context counts without those bytes
        total, escape = np.zeros(len(data)), np.zeros(len(data))
        for k in range(order, -1, -1):
            level = self.levels[k]
            own = code[todo] & ((1 << (8 * (k + 1))) - 1)
            at = level.table.find(own)
            hit = at >= 0
            if k == order:
                np.copyto(out, level.first[at] if len(level.first) else 0.0, where=hit)
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = np.where(ruled, level.logs[at] - total, level.first[at]) if len(level.first) else out[todo]
                out[todo[hit]] += value[hit]
            miss = np.flatnonzero(~hit)
            todo, own, ruled, total, escape = todo[miss], own[miss], ruled[miss], total[miss], escape[miss]
            if not len(todo):
                return out
            at = level.contexts.find(own >> 8)
            known = at >= 0
            if not len(level.escape):
                ruled = known
                continue
            out[todo] += np.where(ruled, escape, np.where(known, level.escape[at], 0.0))
            total = np.where(known, level.below[at], np.nan)
            escape = np.where(known, level.below_escape[at], 0.0)
            ruled = known
        out[todo] += self.even
        return out


def build(strings: list[tuple[np.ndarray, np.ndarray]], shorter_levels: list[Level] | None = None) -> Model:
    """strings[k]: codes and counts of all strings one byte longer than the level before; levels of shorter strings may be given."""
    levels: list[Level] = list(shorter_levels or [])
    with np.errstate(divide="ignore", invalid="ignore"):
        for k, (codes, counts) in enumerate(strings, len(levels)):
            order = np.argsort(codes)
            codes, counts = codes[order], counts[order].astype(np.float64)
            context = codes >> 8
            head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(codes) else np.zeros(0, np.int64)
            size = np.diff(np.concatenate([head, [len(codes)]]))
            total = np.add.reduceat(counts, head) if len(head) else np.zeros(0)
            leave = size.astype(np.float64)
            first = np.log10(counts) - np.repeat(np.log10(total + leave), size)
            below, below_escape = np.full(len(head), np.nan), np.zeros(len(head))
            if k and len(head):
                shorter = levels[k - 1]
                suffix = codes & ((1 << (8 * k)) - 1)
                in_suffix = shorter.table.find(suffix)
                ruled = np.add.reduceat(shorter.count[in_suffix].astype(np.float64), head)
                parent = shorter.contexts.find(context[head] & ((1 << (8 * (k - 1))) - 1))
                rest, out = shorter.total[parent] - ruled, shorter.leave[parent] - size
                below = np.where(out > 0, np.log10(rest + out), np.nan)
                below_escape = np.where(out > 0, np.log10(out) - below, 0.0)
            level = Level(CodeTable(codes), counts, np.log10(counts), first, CodeTable(context[head]), total, leave, np.log10(leave) - np.log10(total + leave), below, below_escape)
            levels.append(level)
    seen = len(levels[0].count) if levels else 0
    even = -np.log10(256 - seen) if seen < 256 else 0.0
    return Model(levels, float(even))


def is_held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _sums(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and what their counts add up to."""
    codes, at = np.unique(codes, return_inverse=True)
    return codes, np.bincount(at, weights=counts, minlength=len(codes)).astype(np.int64)


def scores_of(texts: pa.Array, known_words: tuple[CodeTable, np.ndarray], known_strings: tuple[CodeTable, np.ndarray], order: int, end_n: int) -> Iterator[tuple[int, list[pa.Array]]]:
    """Of one piece of the texts after the other: its first text, and n_tokens, sure, base, score, rare and rare_strings of each text.

    Codes take eight bytes a byte of text, so only a piece has them at a time.
    """
    (table, times), (strings, price) = known_words, known_strings
    for first, part in pieces(texts):
        data, ends = byte_string(part)
        code = strings_of(data, ends, order + 1)
        at = strings.find(code)
        starts = np.concatenate([[0], ends[:-1] + 1])
        sums = np.add.reduceat(np.where(at >= 0, price[at], 0.0) if len(price) else np.zeros(len(code)), starts)
        far = np.flatnonzero(at < 0)
        rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(far, np.concatenate([starts, [len(code)]])).astype(np.int32)), pa.array(code[far]))
        own = split_words(part, lower=True)
        hashes = own.hashes().view(np.int64)
        at = table.find(hashes)
        seen = np.where(at >= 0, times[at], 0) if len(times) else np.zeros(len(at), np.int64)
        word = own.ids
        row = own.row_of
        common = at[word] >= 0
        n = len(part)
        logs = np.log10(seen + 0.5)
        base = np.bincount(row[common], weights=logs[word[common]], minlength=n) + np.log10(end_n + 0.5)
        sure = np.bincount(row[common], minlength=n) + (end_n > 0)
        rest = ~common
        size = np.bincount(row[rest], minlength=n)
        others = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(hashes[word[rest]]))
        yield first, [pa.array(own.counts + 1), pa.array(sure.astype(np.int64)), pa.array(base), pa.array(sums), others, rare]


def string_counts(held_out: pa.Array, texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the texts' strings, held-out ones with 0 more; a piece of the texts has its codes at a time."""
    out = Counter64()
    for _, part in pieces(held_out):
        codes = np.unique(strings_of(*byte_string(part), order + 1))
        out.add(codes, np.zeros(len(codes), np.int64))
    for _, part in pieces(texts):
        out.add(strings_of(*byte_string(part), order + 1))
    return out.take()


def _counts(rows: DataFrame, order: int) -> DataFrame:
    """word (or string), code, n over all rows of training texts; strings of held-out texts alone count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, strings = Counter64(), Counter64()

        def give(kind: bool, counter: Counter64) -> Iterator[pa.RecordBatch]:
            codes, counts = counter.take()
            for s in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes[s : s + 100_000]), kind)), pa.array(codes[s : s + 100_000]), pa.array(counts[s : s + 100_000])], names=["word", "code", "n"])

        for batch in batches:
            held = batch.column(1)
            out, texts = texts_of(batch.column(0).filter(held)), texts_of(batch.column(0).filter(pc.invert(held)))
            for _, part in pieces(texts):
                own = split_words(part, lower=True)
                words.add(own.hashes().view(np.int64), np.bincount(own.ids, minlength=len(own.vocab)))
                words.add(np.array([END_WORD]), np.array([len(part)]))
            strings.add(*string_counts(out, texts, order))
            if words.full:
                yield from give(True, words)
            if strings.full:
                yield from give(False, strings)
        yield from give(True, words)
        yield from give(False, strings)

    return rows.select("text", "held_out").mapInArrow(lean(run), "word boolean, code long, n long").groupBy("word", "code").agg(F.sum("n").alias("n"))


def prices(strings: DataFrame, order: int) -> DataFrame:
    """code, n and log10 probability of each string's last byte, from the whole counts."""
    short = min(LOCAL, order + 1)
    tail = F.col("code").bitwiseAND(F.lit((1 << (8 * short)) - 1))
    few = collect_bounded(strings.where("n > 0").groupBy(tail.alias("code")).agg(F.sum("n").alias("n")), 1 << (8 * short))
    code, n = few.column("code").to_numpy(), few.column("n").to_numpy()
    base = strings.sparkSession.sparkContext.broadcast(build([_sums(code & ((1 << (8 * (k + 1))) - 1), n) for k in range(short)]).levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, have, size = base.value, [], 0

        def give(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            seen = n > 0
            longer = [(code[seen], n[seen])]
            for k in range(order - 1, short - 1, -1):
                longer.insert(0, _sums(longer[0][0] & ((1 << (8 * (k + 1))) - 1), longer[0][1]))
            model = build(longer if order >= short else [], levels)
            logs = model.score(code)
            for s in range(0, len(code), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 100_000]) for x in (code, n, logs)], names=["code", "n", "logs"])

        for batch in batches:
            have.append((batch.column("code").to_numpy(), batch.column("n").to_numpy()))
            size += batch.num_rows
            if size >= PRICED:
                code, n = (np.concatenate([h[k] for h in have]) for k in (0, 1))
                before = code >> 8 & ((1 << (8 * LOCAL)) - 1)
                # Strings with the last bytes so far may go on in the next batch.
                cut = int(np.searchsorted(before, before[-1]))
                if cut:
                    yield from give(code[:cut], n[:cut])
                have, size = [(code[cut:], n[cut:])], len(code) - cut if cut else 0
        if have:
            yield from give(*(np.concatenate([h[k] for h in have]) for k in (0, 1)))

    before = F.shiftright("code", 8).bitwiseAND(F.lit((1 << (8 * LOCAL)) - 1))
    return strings.select("code", "n", before.alias("before")).repartition("before").sortWithinPartitions("before").select("code", "n").mapInArrow(lean(run), "code long, n long, logs double")


def score(docs: DataFrame, held_out: Column | None = None, order: int = ORDER, share: int = SHARE, word_share: int = WORD_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text; rows with held_out false are learned from."""
    spark = docs.sparkSession
    tune(spark)
    held = is_held_out(docs["doc_id"]) if held_out is None else held_out
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), held.alias("held_out"))
    counts = materialise(_counts(rows, order), "counts")
    positions = counts.where("not word").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    priced = materialise(prices(counts.where("not word").select("code", "n"), order), "prices")
    often = collect_bounded(priced.where((F.col("n") > 0) & (F.col("n") * F.lit(share) >= F.lit(positions))).select("code", "logs"), share)
    known_strings = spark.sparkContext.broadcast((CodeTable(often.column("code").to_numpy()), often.column("logs").to_numpy()))
    words = counts.where("word").select("code", "n")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = collect_bounded(words.where(F.col("n") * F.lit(word_share) >= F.lit(tokens)), word_share)
    codes, times = frequent.column("code").to_numpy(), frequent.column("n").to_numpy()
    known_words = spark.sparkContext.broadcast((CodeTable(codes), times))
    end_n = int((words.where(F.col("code") == F.lit(int(END_WORD))).first() or (0, 0))[1])
    unit = float(np.log10(tokens + 0.5 * (distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, columns in scores_of(texts_of(batch.column("text")), known_words.value, known_strings.value, order, end_n):
                n = len(columns[0])
                own = [pa.array(number + np.arange(n)), *(batch.column(c).slice(first, n) for c in ("doc_id", "held_out"))]
                yield pa.RecordBatch.from_arrays(own + columns, names=["row", "doc_id", "held_out", "n_tokens", "sure", "base", "score", "rare", "rare_strings"])
                number += n

    scored = materialise(rows.mapInArrow(lean(run), "row long, doc_id long, held_out boolean, n_tokens long, sure long, base double, score double, rare array<long>, rare_strings array<long>"), "scored")
    rare = scored.select("row", F.explode("rare").alias("code")).join(words, "code", "left").groupBy("row").agg(F.count("n").alias("known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"))
    far = scored.select("row", F.explode("rare_strings").alias("code")).join(priced.select("code", "logs"), "code").groupBy("row").agg(F.sum("logs").alias("far"))
    total = F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)
    whole = F.col("score") + F.coalesce("far", F.lit(0.0))
    joined = scored.drop("rare", "rare_strings").join(rare, "row", "left").join(far, "row", "left")
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("sure") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), total.alias("base_score"), whole.alias("score"))
