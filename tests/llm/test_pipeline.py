"""The corpus pipeline against brute force, stage by stage, and the operators on a table of edge cases."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomsearch.llm import chat, decontaminate, packing, ppm, quality, rollups, rules, simhash, substring, toxicity

from .test_operators import ITEM, TOKENIZER, naive_toxicity, slow_fingerprint, words

WINDOW = substring.WINDOW


def corpus(seed=4):
    r = random.Random(seed)
    text = lambda n: " ".join(f"w{int(r.paretovariate(0.6))}" for _ in range(n))
    rows = [text(r.randrange(5, 200)) for _ in range(80)]
    for k in range(0, 80, 5):
        rows[k] = rows[k][:40] + " vile foul nasty " + rows[k][40:]
    shared = text(60)
    rows += [f"{text(30)} {shared} {text(20)}" for _ in range(4)] + [rows[7], rows[7], text(1500), None, "", " ", f"so {ITEM} and on", f"so {ITEM.replace('40', '95')} and on", "x y " * 4000]
    edited = rows[86].split()
    edited[700] = "other"
    rows.append(" ".join(edited))
    return [(k, t, "en", "s", len(t or ""), f"row{k}") for k, t in enumerate(rows)] + [(None, "no id at all", None, None, None, "last")]


def removed(texts):
    """Words of each text that are left where no window repeats."""
    own = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + WINDOW]) for w in own for i in range(len(w) - WINDOW + 1))
    out = []
    for w in own:
        gone = {i + j for i in range(len(w) - WINDOW + 1) if seen[tuple(w[i : i + WINDOW])] > 1 for j in range(WINDOW)}
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_stages(spark, tmp_path):
    rows = corpus()
    columns = "doc_id long, text string, lang string, source string, n_chars int, row string"
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{path}/documents.parquet")
    labelled = [(k, int("vile" in (t or ""))) for k, t, *_ in rows if k is not None and k < 80]
    spark.createDataFrame(labelled, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    key = lambda df: sorted((tuple(x) for x in df.collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]

    kept = stages["toxicity"](spark, docs, path)
    examples = [(k, rows[k][1], y) for k, y in labelled if zlib.crc32(str(k).encode()) % 4 != 2]
    scores = naive_toxicity([t for _, t, *_ in rows], examples)
    want = [x for x, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD]
    assert kept.columns == docs.columns and key(kept) == sorted(want, key=repr) and 0 < len(want) < len(rows)

    kept = stages["simhash_near_dedup"](spark, spark.createDataFrame(want, columns), path)
    fp = [slow_fingerprint(t) for _, t, *_ in want]
    root = list(range(len(want)))
    for _ in want:
        root = [min(root[j] for j in range(len(want)) if bin(fp[i] ^ fp[j]).count("1") <= 3) for i in range(len(want))]
    first = {}
    for i, x in enumerate(want):
        first.setdefault(root[i], []).append(x)
    want = [min(own, key=lambda x: (x[0] is None, x[0])) for own in first.values()]
    assert kept.columns == docs.columns and key(kept) == sorted(want, key=repr)

    kept = stages["substring_dedup"](spark, spark.createDataFrame(want, columns), path)
    left = removed([x[1] for x in want])
    want = [(x[0], x[1] if len(w) == len(words(x[1])) else " ".join(w), *x[2:]) for x, w in zip(want, left, strict=True)]
    assert kept.columns == docs.columns and key(kept) == sorted(want, key=repr)

    kept = stages["benchmark_decontamination"](spark, spark.createDataFrame(want, columns), path)
    want = [x for x in want if "leaves Paris at" not in (x[1] or "")]
    assert kept.columns == docs.columns and key(kept) == sorted(want, key=repr)

    pieces = stages["packing"](spark, spark.createDataFrame(want, columns), path).collect()
    ids = {x[0]: packing.WordBpe(TOKENIZER).library.encode(x[1] or "", add_special_tokens=False).ids + [2] for x in want}
    for doc, own in ids.items():
        parts = sorted((p.start, p.length) for p in pieces if p.doc_id == doc)
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) == len(own)

    out = corpus_pipeline.run(spark, path)
    assert out.agg(F.sum("length")).first()[0] == sum(map(len, ids.values())) and {r.doc_id for r in out.collect()} == set(ids)


EDGES = [(1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "a b c d e f g h", "en", None), (3, "\u00c9 \u65e5\u672c " * 9000, "de", "a"), (4, "one line\n" * 3000, None, "b"), (5, "w" * 70000, "en", "b"), (6, "tie tie tie", "en", "a"), (7, "tie tie tie", "en", "a")]
#: Names that operators use themselves.
CLASHING = "row k1 k2 anchor content begin windows n fp root first_id component_id score items evidence failed kept spans held_out host path".split()


@pytest.fixture(scope="module")
def edges(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.lit(1))
    return df.withColumns({c: F.lit(7) for c in CLASHING}).repartition(2)


LABELS = [(2, 1, 0), (4, 0, 1), (6, 1, 1), (7, 0, 0), (None, 1, 1), (99, 1, 1)]


def test_edges(spark, edges):
    """Every operator on nulls, empty and very long texts, ties, repeated rows and clashing columns: a row for each, and texts unharmed."""
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    ids = sorted((r[0] for r in EDGES), key=repr)
    got = lambda df, c="doc_id": sorted((r[0] for r in df.select(c).collect()), key=repr)
    assert got(substring.remove_repeats(edges).select("row.doc_id")) == ids
    assert got(rules.judge(rules.ledger(edges), "v1")) == ids
    assert got(ppm.score(edges)) == ids
    assert got(toxicity.score(edges, labels).select("row.doc_id")) == ids
    assert got(quality.classify(edges, labels)) == ids
    near = simhash.near_duplicates(edges)
    assert got(near) == ids
    fp = {(i, f"{slow_fingerprint(t):016x}") for i, t, *_ in EDGES}
    assert {(r.doc_id, r.fingerprint) for r in near.collect()} == fp
    assert simhash.one_of_each(edges).columns == edges.columns
    bench = spark.createDataFrame([(1, "tie tie tie"), (2, None), (None, "x")], "item_id long, text string")
    leaks = {(r.doc_id, len(r["items"])) for r in decontaminate.find_leaks(edges, bench).select("row.doc_id", "items").collect()}
    assert leaks == {(r[0], int(r[0] in (6, 7))) for r in EDGES}
    pieces = packing.pack(edges, TOKENIZER).collect()
    library = packing.WordBpe(TOKENIZER).library
    assert sum(p.length for p in pieces) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in EDGES)
    counts = rollups.count_tokens(edges, TOKENIZER)
    assert got(counts) == ids
    talk = spark.createDataFrame([(1, 0, "user", "x " * 30000, 1, 2.0), (1, 1, "assistant", None, 1, 2.0)], "conv_id long, turn long, role string, text string, node int, score double")
    nodes, turns = chat.chain(talk)
    out = chat.formatted(chat.best_paths(nodes), turns).select(chat.parse(F.col("formatted")).alias("t")).first()
    assert [x.text for x in out.t] == ["x " * 30000, ""]


def test_rollups_of_the_query(spark, tmp_path):
    """The query's batches leave the totals of documents without exact copies, counted by words and pieces."""
    from loomsearch.llm import queries

    r = random.Random(2)
    texts = [" ".join(r.choice("it's a new-found word; of 12 kinds!".split()) for _ in range(r.randrange(12))) for _ in range(60)]
    texts += texts[:20] + [None, None, ""]
    rows = [(k, t, r.choice(["en", "de", None]), r.choice(["a", None])) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in queries.op9_token_rollups(spark, str(tmp_path)).collect()}
    library = packing.WordBpe(TOKENIZER).library
    first = {}
    for k, t, lang, source in rows:
        first.setdefault(t, (k, t, lang, source))
    want = {}
    for _, t, lang, source in first.values():
        for version, n in ((rollups.WORDS_2, sum(any(c.isalnum() for c in w) for w in words(t))), (rollups.BPE_1, len(library.encode(t or "", add_special_tokens=False).ids))):
            a, b = want.get((source, lang, version), (0, 0))
            want[(source, lang, version)] = (a + 1, b + n)
    assert got == want
