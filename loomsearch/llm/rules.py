"""Quality rules as a bitmask ledger.

One pass measures every text and evaluates every rule once. The ledger keeps the measurements and
one failure bit for each rule. A policy is a named, versioned mask of rules and is applied by one
AND; ablations (what a policy would keep without one of its rules) are bitwise aggregation over
the ledger, and neither reads a text again.

Defined cases: null and empty texts have zero for every measurement and fail the rules on length
only; ties and repeated rows are judged each by itself; an empty table gives an empty ledger (and
an ablation of zeros); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASES, Rolling, arrow_map, split_words, texts_of, tune

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "longest_word")

#: A rule's place is its bit and never changes; new rules go to the end. (name, SQL condition under which a text fails)
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * word_chars"),
    ("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines"),
    ("upper_case", "n_words >= 10 and 100 * n_upper > 50 * word_chars"),
    ("word_length", "n_words >= 10 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    ("endless_word", "longest_word > 1000"),
)
BASE_RULES = ("too_few_words", "repeated_words")


def bit(name: str) -> int:
    return 1 << [n for n, _ in RULES].index(name)


def mask(*names: str) -> int:
    return sum(bit(n) for n in names)


#: Versioned policies; a published mask is never changed.
POLICIES = {
    "v1": mask(*[n for n, _ in RULES]),
    "v1-base": mask(*BASE_RULES),
}


def measures_of(texts: pa.Array, repeat_window: int = 5) -> list[np.ndarray]:
    words = split_words(texts)
    rows = len(texts)
    row = words.row_of
    per_word = pc.utf8_length(words.vocab).to_numpy().astype(np.int64)[words.ids]
    total = lambda x: np.bincount(row, weights=x, minlength=rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row, per_word)

    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten()
    used = pc.match_substring_regex(flat, "[^\\x20\\x09-\\x0D]").to_numpy(zero_copy_only=False)
    line_row = np.repeat(np.arange(rows), np.diff(lines.offsets.to_numpy()))[used]
    coded = flat.filter(pa.array(used)).dictionary_encode()
    key = line_row * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    n_lines = np.bincount(line_row, minlength=rows).astype(np.int64)
    dup = np.bincount(line_row[~first], minlength=rows).astype(np.int64)

    repeated = np.zeros(len(words), bool)
    n = len(words) - repeat_window + 1
    if n > 0:
        start = np.flatnonzero(row[:n] == row[repeat_window - 1 :])
        hashes = Rolling(words.hashes()[words.ids], BASES[0]).spans(start, start + repeat_window)
        order = np.lexsort((hashes, row[start]))
        h, r = hashes[order], row[start][order]
        same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = start[order[twice]]
        for k in range(repeat_window):
            repeated[at + k] = True
    return [
        words.counts,
        total(per_word),
        pc.count_substring_regex(texts, "[#*$%&|<>]").to_numpy().astype(np.int64),
        dup,
        np.bincount(row[repeated], minlength=rows).astype(np.int64),
        n_lines,
        pc.count_substring_regex(texts, "\\p{Lu}").to_numpy().astype(np.int64),
        longest,
    ]


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and failed: the bits of the rules that the text fails."""
    tune(docs.sparkSession)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, measures_of(texts_of(batch.column(1))))], names=["doc_id", *MEASURES])

        return each

    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    measured = arrow_map(columns, make, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)]
    failed: Column = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def judge(rows: DataFrame, policy: str) -> DataFrame:
    """Adds kept: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: texts that fail it, that fail it alone, and that are kept with and without it."""
    own = F.col("failed").bitwiseAND(F.lit(POLICIES[policy]))
    names = [(n, bit(n)) for n, _ in RULES if POLICIES[policy] & bit(n)]
    sums = rows.select(own.alias("f")).agg(F.count("*").alias("n"), F.count_if(F.col("f") == 0).alias("kept"), *[c for n, b in names for c in (F.count_if(F.col("f").bitwiseAND(F.lit(b)) != 0).alias(f"f_{n}"), F.count_if(F.col("f") == b).alias(f"a_{n}"))])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("failed"), F.col(f"a_{n}").alias("failed_alone"), F.col("kept").alias("kept"), (F.col("kept") + F.col(f"a_{n}")).alias("kept_without")) for n, _ in names]))
    return sums.select(each.alias("x")).select("x.*")
