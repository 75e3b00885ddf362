"""Benchmark decontamination by template canonicalisation.

Numbers, units and names of documents and benchmark items become typed placeholders; all other
words are lower-cased without marks at their ends. Windows of five template words are joined by
hash: an item's windows are the build side, every document's whole text is the probe side. An
item counts as leaked into a document if at least 0.8 of its windows stand there in its own order
(on neighbouring diagonals, so a few words more or less do no harm) and its slots are consistent:
each number, unit or name of the item is replaced by one value throughout and different values
stay different. So re-parameterised questions are caught, and chance meetings of templates are not.
Every alignment that reaches the share is tested, as a document may hold an item beside its twins.
A capital at the beginning of a sentence may be a name or not: windows with one stand for both, and
where item and text differ there it is a slot (but not in items shorter than a window).

The build side is cut into blocks of at most BLOCK_WINDOWS windows. Each is broadcast and every
document passes it once; nothing is shuffled, and memory is bounded whatever the benchmark's size.

Defined cases: null and empty texts and items without words match nothing; items shorter than a
window are one window of their own length; repeated rows get the same verdict; items of equal
text are all reported; an empty table gives no rows, an empty benchmark no leaks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASES, CodeTable, Rolling, arrow_map, collect_bounded, split_words, strip_terms, texts_in, tune, with_row

WINDOW = 5
LEAST = 0.8
#: Diagonals on either side of the best that count as the same alignment.
SLACK = 3
BLOCK_WINDOWS = 1 << 21

NUMBER = r"^[+\-]?[$€£¥]?[0-9][0-9.,:/]*(st|nd|rd|th|%|[kmb])?[.,;:!?)]*$|^(zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million)$"
# Common unit words.
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years c f k celsius fahrenheit kelvin w kw watt watts v volt volts j joule joules hz mph kph percent dollar dollars euro euros cent cents usd eur"
PLACES = ("<num>", "<unit>", "<name>")


@dataclass
class Template:
    """Template words of a batch as hashes, the words themselves, which are slots, where rows begin, and what may be a name."""

    hashes: np.ndarray
    words: np.ndarray
    slot: np.ndarray
    offsets: np.ndarray
    terms: pa.Array
    soft: np.ndarray  # capitals at the beginning of a sentence
    named: np.ndarray  # hashes with these as names


def template(texts: pa.Array) -> Template:
    import xxhash

    words = split_words(texts)
    vocab = words.vocab
    term = strip_terms(vocab)
    own = lambda x: x.to_numpy(zero_copy_only=False)
    number = own(pc.match_substring_regex(pc.utf8_lower(vocab), NUMBER)) | own(pc.match_substring_regex(term, NUMBER))
    unit = own(pc.is_in(term, value_set=pa.array(UNITS.split(), term.type))) & ~number
    capital = own(pc.match_substring_regex(vocab, r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}")) & ~number & ~unit
    closes = own(pc.match_substring_regex(vocab, r"[.!?:;\"”»)\]|]$"))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in term.to_pylist()), np.uint64, len(term))
    place = np.array([xxhash.xxh3_64_intdigest(p) for p in PLACES], np.uint64)
    ids = words.ids
    begins = np.ones(len(ids), bool)
    begins[1:] = closes[ids[:-1]]
    begins[words.offsets[:-1][words.counts > 0]] = True
    name = capital[ids] & ~begins
    kind = np.where(number, 0, np.where(unit, 1, -1))[ids]
    kind[name] = 2
    out = np.where(kind >= 0, place[kind], hashes[ids]) if len(ids) else np.zeros(0, np.uint64)
    soft = capital[ids] & begins & (kind < 0)
    named = np.where(soft, place[2], out) if len(ids) else out
    empty = own(pc.equal(pc.binary_length(term), 0))[ids]
    # Words of marks only do not count.
    keep = ~empty | (kind >= 0)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return Template(out[keep], ids[keep], (kind >= 0)[keep], kept[words.offsets], term, soft[keep], named[keep])


@dataclass
class Bench:
    """Windows of a block of items: where each stands, by window code."""

    ids: np.ndarray
    table: CodeTable
    first: np.ndarray  # of each window's places
    item: np.ndarray
    at: np.ndarray
    windows: np.ndarray  # distinct places of each item
    sizes: list[int]
    slots: list[list[str | None]]
    soft: list[list[str | None]]  # words that are slots where the text has another one


def bench(item_ids: list, texts: list[str]) -> Bench:
    t = template(pa.array(texts, pa.large_string()))
    roll, named = Rolling(t.hashes, BASES[0]), Rolling(t.named, BASES[0])
    softs = np.concatenate([[0], np.cumsum(t.soft)])
    codes, item, at = [], [], []
    n = np.diff(t.offsets)
    windows = np.where(n > 0, n - np.minimum(n, WINDOW) + 1, 0)
    for i, (a, b) in enumerate(zip(t.offsets[:-1], t.offsets[1:], strict=True)):
        size = min(WINDOW, b - a)
        if not size:
            continue
        start = np.arange(a, b - size + 1)
        codes.append(roll.spans(start, start + size).view(np.int64))
        item.append(np.full(len(start), i))
        at.append(start - a)
        if size == WINDOW:
            start = start[softs[start + size] > softs[start]]
            codes.append(named.spans(start, start + size).view(np.int64))
            item.append(np.full(len(start), i))
            at.append(start - a)
    code, item, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, item, at))
    order = np.lexsort((at, item, code))
    code, item, at = code[order], item[order], at[order]
    head = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    terms = t.terms.to_pylist()
    slots, soft = ([[terms[w] if s else None for w, s in zip(t.words[a:b], x[a:b], strict=True)] for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True)] for x in (t.slot, t.soft))
    return Bench(np.array(item_ids, object), CodeTable(code[head]), np.concatenate([head, [len(code)]]), item, at, windows, sorted({int(min(WINDOW, x)) for x in n if x}), slots, soft)


def leaks(t: Template, own: Bench) -> list[list[dict]]:
    """For each text the items that it holds."""
    rows = len(t.offsets) - 1
    out: list[list[dict]] = [[] for _ in range(rows)]
    n = len(t.hashes)
    if not n or not len(own.item):
        return out
    roll, named = Rolling(t.hashes, BASES[0]), Rolling(t.named, BASES[0])
    softs = np.concatenate([[0], np.cumsum(t.soft)])
    row_of = np.repeat(np.arange(rows), np.diff(t.offsets))
    found, place = [], []
    for size in own.sizes:
        if n < size:
            continue
        start = np.arange(n - size + 1)
        start = start[row_of[: n - size + 1] == row_of[size - 1 :]]
        at = own.table.find(roll.spans(start, start + size).view(np.int64))
        hit = np.flatnonzero(at >= 0)
        found.append(start[hit])
        place.append(at[hit])
        if size == WINDOW:
            start = start[softs[start + size] > softs[start]]
            at = own.table.find(named.spans(start, start + size).view(np.int64))
            hit = np.flatnonzero(at >= 0)
            found.append(start[hit])
            place.append(at[hit])
    if not any(map(len, found)):
        return out
    start, place = np.concatenate(found), np.concatenate(place)
    times = own.first[place + 1] - own.first[place]
    which = np.repeat(own.first[place] - np.cumsum(times) + times, times) + np.arange(times.sum())
    start = np.repeat(start, times)
    item, at, row = own.item[which], own.at[which], row_of[start]
    diagonal = start - t.offsets[row] - at
    order = np.lexsort((at, diagonal, item, row))
    item, at, row, diagonal, start = (x[order] for x in (item, at, row, diagonal, start))
    key = row * len(own.windows) + item
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    for a, b in zip(head, np.concatenate([head[1:], [len(key)]]), strict=True):
        i, total = item[a], own.windows[item[a]]
        if b - a < LEAST * total:
            continue
        share = alignment(diagonal[a:b], at[a:b], start[a:b], int(total), own.slots[i], own.soft[i], t)
        if share:
            out[row[a]].append({"item_id": int(own.ids[i]), "containment": float(share)})
    return out


def alignment(d: np.ndarray, p: np.ndarray, s: np.ndarray, total: int, slots: list, soft: list, t: Template) -> float:
    """Share of an item's windows (p, by diagonal d and place s in the text) in the best consistent alignment, 0 without one."""
    size = min(WINDOW, len(slots))
    centres, exact = np.unique(d, return_counts=True)
    low, high = np.searchsorted(d, centres - SLACK), np.searchsorted(d, centres + SLACK, side="right")
    # Diagonals that hold the most windows themselves come first.
    for c in np.argsort(-exact, kind="stable").tolist():
        if high[c] - low[c] < LEAST * total:
            continue
        here = slice(low[c], high[c])
        near = np.lexsort((np.abs(d[here] - centres[c]), p[here]))
        q, place = p[here][near], s[here][near]
        first = np.concatenate([[True], q[1:] != q[:-1]])
        share = first.sum() / total
        if share >= LEAST and consistent(slots, soft, q[first], place[first], size, t):
            return float(share)
    return 0.0


def consistent(slots: list, soft: list, at: np.ndarray, start: np.ndarray, size: int, t: Template) -> bool:
    """Whether the item's slot values and the text's map one to one over the matched windows."""
    if not any(x is not None for x in slots) and not any(x is not None for x in soft):
        return True
    to, back = {}, {}
    for p, s in zip(at.tolist(), start.tolist(), strict=True):
        for k in range(size):
            value = slots[p + k] if slots[p + k] is not None else soft[p + k]
            if value is None:
                continue
            own = t.terms[int(t.words[s + k])].as_py()
            if slots[p + k] is None and own == value:
                continue
            if to.setdefault(value, own) != own or back.setdefault(own, value) != value:
                return False
    return True


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """row (the document as it came) and items: leaked items with the share of their windows found."""
    spark = docs.sparkSession
    tune(spark)
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("item_id is not null and text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    # A window takes at least two characters of its item.
    blocks = max(1, -(-chars // (2 * block_windows)))
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("containment", T.DoubleType())]))
    rows = with_row(docs).withColumn("items", F.array().cast(kind))
    arrow_kind = pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64())]))
    carried = rows.columns[:-1]
    schema = T.StructType([*(rows.schema[c] for c in carried), T.StructField("items", kind)])
    for block in range(blocks):
        part = collect_bounded(items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id"), 4 * block_windows)
        shared = spark.sparkContext.broadcast(bench(part.column("item_id").to_pylist(), part.column("text").to_pylist()))

        def make(shared=shared):
            own = shared.value

            def each(batch: pa.RecordBatch) -> pa.RecordBatch:
                new = leaks(template(texts_in(batch)), own)
                old = batch.column("items").to_pylist()
                items = pa.array([a + b for a, b in zip(old, new, strict=True)], arrow_kind)
                return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), items], names=[*carried, "items"])

            return each

        rows = arrow_map(rows, make, schema)
    return rows.select("row", F.array_sort("items").alias("items"))
