"""The training-data operators against brute force, and their defined edge cases."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomsearch.llm import chat, common, decontaminate, packing, ppm, quality, rollups, rules, simhash, substring, toxicity
from loomsearch.llm.common import CodeTable, Counter64
from loomsearch.llm.tokens import WordBpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_words long, row string, k1 long"
rng = random.Random(5)
TEXTS = [None, "", " \n\t ", "one", "two words", "a " * 90, " ".join(rng.choice("abc") for _ in range(60)), " ".join(rng.choice("abcdefgh") for _ in range(200)), "x y z " * 20, "x y z " * 20, "É naïve 日本 text\x1cand   more", "w" * 5000, "long " * 3000]
ROWS = [(k, t, "en", "s", 1, "r", 2) for k, t in enumerate(TEXTS)] + [(None, "x y z " * 20, None, None, None, None, None), (7, TEXTS[7], "en", "s", 1, "r", 2), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")


@pytest.mark.parametrize("bits", [27, 7])
def test_substring(docs, none, monkeypatch, bits):
    """Against brute force, with a bit set that lets few paths through and one that lets most of them."""
    monkeypatch.setattr(substring, "SET_BITS", bits)
    for window, seed in ((5, 2), (9, 4), (35, 12)):
        own = [words(r[1]) for r in ROWS]
        seen = Counter(tuple(w[i : i + window]) for w in own for i in range(len(w) - window + 1))
        want = []
        for (doc_id, *_), w in zip(ROWS, own, strict=True):
            gone = [False] * len(w)
            for i in range(len(w) - window + 1):
                if seen[tuple(w[i : i + window])] > 1:
                    gone[i : i + window] = [True] * window
            want.append((doc_id, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
        got = [(r.row.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs, window, seed).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring.remove_repeats(none).count() == 0


def test_rules(docs, none, spark):
    for r in rules.judge(rules.ledger(docs), "v1").collect():
        text = next(t for i, t, *_ in ROWS if i == r.doc_id and len(words(t)) == r.n_words)
        w = words(text)
        assert r.word_chars == sum(map(len, w)) and r.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(5)}
        assert r.n_repeat_words == len(hit)
        assert r.kept == (r.failed == 0)
    assert rules.ledger(none).count() == 0
    ledger = spark.createDataFrame([(0,), (1,), (3,), (2,), (2,)], "failed int")
    got = {r.rule: (r.failed, r.failed_alone, r.kept, r.kept_without) for r in rules.ablation(ledger, "v1-base").collect()}
    assert got == {"too_few_words": (2, 1, 1, 2), "repeated_words": (3, 2, 1, 3)}


def naive_ppm(train, text, order):
    """Method C with exclusion, byte by byte."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    norm = lambda t: " ".join(words((t or "").translate({k: k + 32 for k in range(65, 91)}))).encode() + b"\n"
    for t in train:
        s = b"\n" * order + norm(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k][s[i - k : i]][s[i]] += 1
    s, total = b"\n" * order + norm(text), 0.0
    for i in range(order, len(s)):
        ruled: set = set()
        for k in range(order, -1, -1):
            seen = counts[k].get(s[i - k : i])
            if not seen:
                continue
            left = {b: c for b, c in seen.items() if b not in ruled}
            if not left:
                continue
            # An escape weighs as much as the followers not ruled out.
            whole = sum(left.values()) + len(left)
            if s[i] in left:
                total += math.log10(left[s[i]] / whole)
                break
            total += math.log10(len(left) / whole)
            ruled |= set(left)
        else:
            total -= math.log10(256 - len(ruled))
    return total


def test_ppm(spark, none):
    texts = ["the cat sat on the mat", "The cat ate", "a dog and a cat", None, "zebra quick", "the dog sat on the cat"]
    df = spark.createDataFrame([(k, t, k == 4 or k == 5) for k, t in enumerate(texts)], "doc_id long, text string, held boolean")
    got = {r.doc_id: r for r in ppm.score(df, F.col("held"), order=3).collect()}
    train = [t for k, t in enumerate(texts) if k < 4]
    tokens = Counter(w for t in train for w in [*words((t or "").lower()), "\n"])
    n, v = sum(tokens.values()), len(tokens)
    for k, t in enumerate(texts):
        own = [*words((t or "").lower()), "\n"]
        assert got[k].n_tokens == len(own) and got[k].n_known == sum(tokens[w] > 0 for w in own) and got[k].train_tokens == n
        assert got[k].base_score == pytest.approx(sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own))
        assert got[k].score == pytest.approx(naive_ppm(train, t, 3), abs=1e-9)
    again = {r.doc_id: r for r in ppm.score(df, F.col("held"), order=3, word_share=2).collect()}
    assert all(again[k].base_score == pytest.approx(got[k].base_score) and again[k].n_known == got[k].n_known for k in got)
    assert ppm.score(none).count() == 0


@pytest.mark.parametrize("order", [0, 1, 3, 5])
def test_ppm_from_whole_counts(spark, monkeypatch, order):
    """A small share and small chunks change no score: rare strings keep their counts."""
    monkeypatch.setattr(ppm, "PRICED", 50)
    r = random.Random(11)
    texts = [" ".join(r.choice(["the", "cat", "sat", "é日", "q" + str(r.randrange(30))]) for _ in range(r.randrange(30))) for _ in range(40)] + [None, "zebra quick"]
    df = spark.createDataFrame([(k, t, k % 4 == 1) for k, t in enumerate(texts)], "doc_id long, text string, held boolean").repartition(3)
    train = [t for k, t in enumerate(texts) if k % 4 != 1]
    got = {x.doc_id: x.score for x in ppm.score(df, F.col("held"), order=order, share=20).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(naive_ppm(train, t, order), abs=1e-9)


def test_ppm_takes_pieces(monkeypatch):
    """Codes of a batch's bytes are made piece by piece: counts and scores are the same as at once, within a bounded memory."""
    r = random.Random(6)
    texts = pa.array([" ".join(r.choice(["one", "two", "Three", "f" * 9]) for _ in range(2500)) for _ in range(800)] + ["", " ", "two " * 9], pa.large_string())
    few, known = texts.slice(780), (CodeTable(np.arange(0)), np.zeros(0, np.int64))
    for run in (lambda x: ppm.string_counts(x.slice(0, 1), x, 5), lambda x: [c[3].to_pylist() for _, c in ppm.scores_of(x, known, known, 5, 1)]):
        tracemalloc.start()
        run(texts)
        assert tracemalloc.get_traced_memory()[1] < 120 << 20  # ten million bytes: a code of each is 80 MB, and some arrays of that size would be needed
        tracemalloc.stop()
    at_once = ppm.string_counts(few, few, 5), [x for _, c in ppm.scores_of(few, known, known, 5, 1) for x in zip(*(y.to_pylist() for y in c), strict=True)]
    monkeypatch.setattr(common, "PIECE", 1000)
    by_piece = ppm.string_counts(few, few, 5), [x for _, c in ppm.scores_of(few, known, known, 5, 1) for x in zip(*(y.to_pylist() for y in c), strict=True)]
    assert by_piece[1] == at_once[1] and len(by_piece[1]) == 23 and all((a == b).all() for a, b in zip(*(x[0] for x in (at_once, by_piece)), strict=True))


def test_chat(spark):
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", hard), (-1, 1, "assistant", hard), (None, 0, "us\\er\n<|x", "a\\<|b\\\\|"), (None, 1, "assistant", None), (7, 0, "assistant", "<\\|\\n\\"), (7, 0, "assistant", "<\\|\\n\\"), (7, 3, None, "z😀 <"), (8, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes, turns = chat.chain(df)
    out = chat.formatted(chat.best_paths(nodes), turns)
    got = {r.conv: r for r in out.select("conv", chat.parse(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for key in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == key]
        r = got["null" if key is None else str(key)]
        assert [(t.role, t.text) for t in r.turns] == own
        assert r.loss == "".join(t for role, t in own if role == "assistant")
    nodes, turns = chat.chain(spark.createDataFrame([], df.schema))
    assert chat.formatted(chat.best_paths(nodes), turns).count() == 0


def test_reply_trees(spark):
    rows = [("a", 1, None, 1, 0.5), ("a", 2, 1, 2, 0.1), ("a", 3, 1, 3, 0.9), ("a", 4, 3, 4, 0.2), ("a", 6, 9, 6, 1.0), ("a", 7, 8, 7, 1.0), ("a", 8, 7, 8, 1.0)] + [("deep", k, k - 1, k, 0.0) for k in range(1, 40)]
    nodes = spark.createDataFrame(rows, "conv string, node long, parent long, ord long, score double")
    got = defaultdict(list)
    for r in chat.best_paths(nodes).orderBy("conv", "leaf", F.desc("up")).collect():
        got[(r.conv, r.rank)].append(r.node)
    assert got[("a", 1)] == [6] and got[("a", 2)] == [7, 8] and got[("a", 3)] == [1, 3, 4] and got[("a", 4)] == [1, 2]
    assert got[("deep", 1)] == list(range(1, 40))


def test_toxicity(spark, docs, none):
    r = random.Random(3)
    calm = [f"{r.choice('abcdefgh')}{r.randrange(500)}" for _ in range(300)]
    rows = []
    for k in range(400):
        w = [r.choice(calm) for _ in range(30)]
        if k % 5 == 0:
            w[3:5] = [r.choice(["Vile!", "foul"]), r.choice(["nasty", "foul,"])]
        rows.append((k, " ".join(w), int(k % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").unionByName(spark.createDataFrame([(1, 1), (None, 1), (2, None), (99999, 1)], "doc_id long, toxic int"))
    index = toxicity.fit(df, labels)
    got = {x.doc_id: x.score for x in toxicity.apply(df, index).select("row.doc_id", "score").collect()}
    held = [k for k, *_ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all((got[k] >= 0.3) == (k % 5 == 0) for k in held)
    # Exact: block skipping gives the same as looking at every vector.
    every = [index.weights(*v) for v in index.vectors]
    for t, f in index.vectors[:20]:
        own = index.weights(t, f)
        dense = np.array([sum(a * dict(zip(v[0].tolist(), w, strict=True)).get(x, 0.0) for x, a in zip(t.tolist(), own, strict=True)) for v, w in zip(index.vectors, every, strict=True)])
        at, cosine = index.nearest(t, f, 5)
        order = sorted(dense[dense > 0])[::-1]
        assert np.allclose(sorted(cosine)[::-1], order[: len(cosine)]) and len(at) >= 1
    assert toxicity.apply(docs, index).count() == len(ROWS)
    assert toxicity.score(none, labels).count() == 0 and toxicity.score(docs, labels.limit(0)).where("score != 0").count() == 0


def naive_toxicity(texts, examples, k=toxicity.NEIGHBOURS):
    """Scores of texts by brute force: examples (id, text, toxic) and document frequencies over all texts; votes that a logistic curve over left-out examples turns into probabilities."""
    bag = lambda t: Counter(x for x in (re.sub(r"^[^\w]+|[^\w]+$", "", w.lower()) for w in words(t)) if x)
    n, df = len(texts), Counter(w for t in texts for w in bag(t))
    pos, neg = ([bag(t) for _, t, y in examples if y == label] for label in (1, 0))
    total, g2 = len(examples), {}
    for w in {w for _, t, _ in examples for w in bag(t)}:
        cells = []
        for own in (pos, neg):
            has = sum(w in x for x in own)
            cells += [(has, len(own), True), (len(own) - has, len(own), False)]
        share = sum(c for c, _, has in cells if has)
        g2[w] = 2 * sum(c * math.log(c * total / ((share if has else total - share) * size)) for c, size, has in cells if c)

    def vector(t):
        own = {w: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[w])) + 1) * (1 + g2[w] / toxicity.G2_UNIT) for w, c in bag(t).items() if w in g2}
        size = math.sqrt(sum(x * x for x in own.values()))
        return {w: x / size for w, x in own.items()}

    prior = len(pos) / total
    known = [(vector(t), y) for _, t, y in examples]

    def vote(own, known, k):
        near = sorted(((sum(x * v.get(w, 0.0) for w, x in own.items()), y) for v, y in known), reverse=True)
        near = [x for x in near if x[0] > 0 and x[0] >= near[min(k, len(near)) - 1][0] - 1e-9]
        yes, no = (sum(c for c, y in near if y == label) for label in (1, 0))
        share = min(max((yes + toxicity.SHRINK * prior) / (yes + no + toxicity.SHRINK), 1e-6), 1 - 1e-6)
        return math.log(share / (1 - share))

    z = np.array([vote(v, known[:i] + known[i + 1 :], k) for i, (v, _) in enumerate(known) if v])
    slope, offset = toxicity.curve(z, np.array([float(y) for v, y in known if v]))
    out = []
    for t in texts:
        own = vector(t)
        none = [y for v, y in known if not v]
        if own:
            out.append(1 / (1 + math.exp(-(slope * vote(own, known, k) + offset))))
        else:
            out.append((sum(none) + toxicity.SHRINK * prior) / (len(none) + toxicity.SHRINK) if none else prior)
    return out


@pytest.mark.parametrize("sizes", [(8, 5, 20, 7), (64, 64, 1024, 64)])
def test_toxicity_votes(spark, monkeypatch, sizes):
    """Scores equal brute force, whatever the blocks: texts of two vocabularies, copies, empty and long ones."""
    for name, value in zip(("BLOCK", "CLUSTERS", "COMMON", "CHUNK"), sizes, strict=True):
        monkeypatch.setattr(toxicity, name, value)
    r = random.Random(21)
    texts = [" ".join(f"{'ab'[k % 2]}{int(r.paretovariate(0.7))}" for _ in range(r.randrange(1, 60))) for k in range(300)]
    texts += [texts[5], texts[5], None, "", "?!", "Unheard of", texts[6].upper() + ", and " + texts[7], "a1 " * 20000]
    rows = [(k, t, int("3" in (t or "")[:6])) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    index = toxicity.fit(df, df.select("doc_id", "toxic"))
    want = naive_toxicity(texts, [(k, t, y) for k, t, y in rows if zlib.crc32(str(k).encode()) % 4 != 2])
    row, term, times = toxicity.term_ids(pa.array([t or "" for t in texts], pa.large_string()), index.terms)
    assert index.score(row, term, times, len(texts))[0] == pytest.approx(want, abs=1e-6)
    got = {x.doc_id: x.score for x in toxicity.apply(df, index).select("row.doc_id", "score").collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(want, abs=1e-6)


def test_toxicity_splits_pieces(monkeypatch):
    """Terms of a batch are counted piece by piece: the same as at once, within a bounded memory."""
    r = random.Random(4)
    texts = [" ".join(f"{r.choice('abc')}{int(r.paretovariate(0.6)) % 5000}" for _ in range(1500)) for _ in range(700)] * 4 + ["", "Foul, foul a1", "?!", "a1 " * 5000, ""]
    terms = pa.array(sorted({f"{c}{k}" for c in "abc" for k in range(0, 5000, 2)} | {"foul"}), pa.large_string())
    batch, where = pa.array(texts, pa.large_string()), {t: k for k, t in enumerate(terms.to_pylist())}
    tracemalloc.start()
    got = toxicity.term_ids(batch, terms)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = [sorted(Counter(where[x] for x in (w.strip(",?!").lower() for w in t.split()) if x in where).items()) for t in texts]
    assert list(zip(*(x.tolist() for x in got), strict=True)) == [(k, t, n) for k, own in enumerate(counts) for t, n in own]
    assert peak < 60 << 20  # four million words; a few arrays of eight bytes for each would be more
    monkeypatch.setattr(common, "PIECE", 100)
    few = toxicity.term_ids(batch.slice(2790), terms)
    assert all((a == b[got[0] >= 2790]).all() for a, b in zip(few, (got[0] - 2790, *got[1:]), strict=True))
    assert [len(x) for x in toxicity.term_ids(batch.slice(0, 0), terms)] == [0, 0, 0] and len(toxicity.term_ids(batch, terms.slice(0, 0))[0]) == 0


def test_workers_give_memory_back(monkeypatch):
    """Before a partition and once its own arrays are gone."""
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("back"))
    assert [seen.append(x) or x for x in common.lean(lambda batches: (2 * b for b in batches))(iter([1, 2]))] == [2, 4]
    assert seen == ["back", 2, 4, "back"]
    monkeypatch.undo()
    common.give_back()


def test_curve():
    """The curve's expected share equals the true one, and it rises or stays as it is."""
    r = np.random.default_rng(3)
    z = r.normal(size=2000)
    y = (r.random(2000) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(float)
    slope, offset = toxicity.curve(z, y)
    assert (slope, offset) == pytest.approx((2, -1), abs=0.3)
    assert (1 / (1 + np.exp(-(slope * z + offset)))).mean() == pytest.approx(y.mean(), abs=1e-3)
    assert toxicity.curve(z, np.zeros(2000)) == toxicity.curve(z, (z < 0).astype(float)) == toxicity.curve(z[:0], y[:0]) == (1.0, 0.0)


def test_toxicity_of_rare_terms(spark):
    """A text finds its neighbour by terms that do not tell the labels apart."""
    r = random.Random(9)
    rows = [(k, " ".join(f"w{r.randrange(4000)}" for _ in range(40)), int(k % 7 == 0)) for k in range(200)]
    learned = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 != 2]
    near = next(x for x in learned if x[2])
    held = next(k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 4 == 2)
    df = spark.createDataFrame([*rows, (held, near[1] + " unheard", 1)], "doc_id long, text string, toxic int")
    index = toxicity.fit(df, df.select("doc_id", "toxic"))
    assert len(index.terms) == len({w for x in learned for w in x[1].split()})
    got = toxicity.apply(df, index).where(F.col("row.doc_id") == held).first()
    assert got.evidence[0].doc_id == near[0] and got.evidence[0].cosine == pytest.approx(1)
    assert got.score > sum(x[2] for x in learned) / len(learned)


TOKENIZER = packing.tokenizer_path()


def test_tokens():
    own = WordBpe(TOKENIZER)
    texts = [t or "" for t in TEXTS] + ["I'm can't WE'LL 'S it's--x", "abc<|endoftext|>def <|startoftext|>", "İstanbul ſ Å é ﬁ 123 4a5 a1b!!x&*%%% ***", "aaaa aaaaa ababab bbbbbbb", "a\u0085b \x1c d", "'' 's' don't'''", "µ ª ×÷ Ÿ", "́ a"]
    for _ in range(2):
        ids, at = own.encode(pa.array(texts, pa.large_string()))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == own.library.encode(t, add_special_tokens=False).ids


def test_packing(docs, none):
    library = WordBpe(TOKENIZER).library
    rows = packing.pack(docs, TOKENIZER, with_ids=True).collect()
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length, r.sequence_length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for own in windows.values():
        at = 0
        for offset, length, size in sorted(own):
            assert offset == at
            at += length
        assert at == size <= 4096 and size & (size - 1) == 0
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t, *_ in ROWS)
    pieces = defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.doc_tokens)].append((r.start, r.ids))
    joined = Counter()
    for (i, n), own in pieces.items():
        copies = sum(start == 0 for start, _ in own)
        text = {start: ids for start, ids in own}
        if copies == 1:
            joined[(i, tuple(x for start in sorted(text) for x in text[start]))] += 1
        else:
            assert sum(len(ids) for _, ids in own) == copies * n
            joined += Counter({key: c for key, c in want.items() if key[0] == i and len(key[1]) == n})
    assert joined == want
    assert packing.pack(none, TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packer(seed):
    """Tiers, gaps and step groups of one partition: every token once, no padding, groups equal but for what is left at the end."""
    r = random.Random(seed)
    tiers, slots = (8, 16, 32), 4
    packer = packing.Packer(tiers, 5 << 32, slots)
    sizes = [r.choice([1, 3, 8, 9, 20, 32, 33, 100, 500]) for _ in range(r.choice([0, 1, 5, 300]))]
    for doc, size in enumerate(sizes):
        packer.add(doc, size)
        assert len(packer.waiting()) <= 32 * (slots + 2)  # of the open group, slots and windows only
    packer.end()
    assert not packer.waiting()
    seen, windows, groups = defaultdict(list), defaultdict(list), Counter()
    for doc, start, length, sequence, offset, size, tier, step in packer.out:
        seen[doc].append((start, length))
        windows[sequence].append((offset, length, size, tier))
        groups[step] += length
        assert step >> 32 == sequence >> 32 == 5
    for doc, size in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == size
    for own in windows.values():
        assert sum(length for _, length, *_ in own) == own[0][2] <= own[0][3] and own[0][2] & (own[0][2] - 1) == 0
    full = slots * 32
    if sum(sizes) >= 2 * full:
        assert all(full // 2 <= n for n in groups.values()) and max(groups.values()) <= full + 32 * -(-slots * 3 // len(groups))
        assert sum(n != full for n in groups.values()) <= slots * 8


def test_packer_fills_gaps():
    """The open window of the longest tier is filled from shorter ones at the end; nothing is padded."""
    packer = packing.Packer((8, 16, 32), 0, 4)
    for doc, size in enumerate((20, 5, 7)):
        packer.add(doc, size)
    packer.end()
    # The second and third make a window of 8; the rest of the third fills up what the first leaves open.
    assert sorted({(x[3], x[5], x[7]) for x in packer.out}) == [(0, 8, 0), (1, 16, 0), (2, 8, 0)]
    assert [x[:5] for x in sorted(packer.out)] == [(0, 0, 16, 1, 0), (0, 16, 4, 2, 0), (1, 0, 5, 0, 0), (2, 0, 3, 0, 5), (2, 3, 4, 2, 4)]
    # Documents go to the shortest tier that holds them.
    packer = packing.Packer((8, 16, 32), 0, 4)
    for doc, size in enumerate((8, 8, 8, 8, 16, 16, 32)):
        packer.add(doc, size)
    packer.end()
    assert [(x[0], x[6]) for x in sorted(packer.out)] == [(0, 8), (1, 8), (2, 8), (3, 8), (4, 16), (5, 16), (6, 32)]


def test_quality(spark, docs, none):
    good = ["Some plain words in a sentence that goes on for a while and then ends " + str(k) for k in range(60)]
    bad = ["### *** $$$ %%% ||| <<< >>> &&& a b c " * 3 + str(k) for k in range(60)]
    df = spark.createDataFrame([(k, t, "en", "h" + str(k % 3)) for k, t in enumerate(good + bad)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.classify(df, labels).collect()}
    assert all(got[k] == (k < 60) for k in got) and len(got) == 120
    w = quality.fit(df, labels)
    assert quality.classify(docs, labels, weights=w).count() == len(ROWS) and quality.classify(none, labels).count() == 0


def moments(groups, mean):
    """Pseudo-counts of groups [(n, good)] around mean(group)."""
    n, squares, k = sum(g[0] for g in groups), sum(g[0] ** 2 for g in groups), len(groups)
    spread = sum(g[0] * (g[1] / g[0] - mean(g)) ** 2 for g in groups)
    noise = sum(mean(g) * (1 - mean(g)) for g in groups)
    between = max((spread - noise * (1 - 1 / max(k, 2))) / max(n - squares / n, 1.0), 0.0)
    return min(max(noise / k / between - 1 if between else 10_000.0, 1.0), 10_000.0)


def test_quality_shares(spark):
    """Posteriors of sparse and large sites against plain sums; the document itself is left out."""
    r = random.Random(6)
    rows = []
    for h in range(25):
        bad = r.random()
        for k in range(r.choice([1, 1, 2, 5, 60])):
            text = "### *** $$$ %%% ||| a b c " * 3 if r.random() < bad else "some plain words in a sentence that goes on for a while and then ends"
            rows.append((len(rows), text + f" {r.randrange(99)}", r.choice(["p", "q", None]), f"h{h}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    w = np.array([0.3, -2.0, 0.1, -0.4, 0.2, 1.0, -0.3, 0.0, -1.0, 0.2, -0.5, 0.4])
    x = quality.features_of(pa.array([t for _, t, *_ in rows], pa.large_string()))
    p = 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -30, 30)))
    by_path, by_host = defaultdict(list), defaultdict(list)
    for (k, _, path, host), own in zip(rows, p, strict=True):
        by_path[(host, path)].append(own)
        by_host[host].append(own)
    mean = p.mean()
    host_k = moments([(len(v), sum(v)) for v in by_host.values()], lambda g: mean)
    share = {h: (sum(v) + host_k * mean) / (len(v) + host_k) for h, v in by_host.items()}
    path_k = moments([(len(v), sum(v), share[h]) for (h, _), v in by_path.items()], lambda g: g[2])
    logit = lambda z: math.log(z / (1 - z))
    got = {g.doc_id: g for g in quality.classify(df, df.select("doc_id"), weights=w).collect()}
    assert len(got) == len(rows)
    for (k, _, path, host), own in zip(rows, p, strict=True):
        others = (p.sum() - own) / (len(p) - 1)
        of_host = (sum(by_host[host]) - own + host_k * others) / (len(by_host[host]) - 1 + host_k)
        of_path = (sum(by_path[(host, path)]) - own + path_k * of_host) / (len(by_path[(host, path)]) - 1 + path_k)
        score = 1 / (1 + math.exp(-(logit(own) + quality.SITE_WEIGHT * (logit(of_path) - logit(others)))))
        assert (got[k].host_share, got[k].path_share, got[k].score) == pytest.approx((of_host, of_path, score), abs=1e-9)
        assert got[k].kept == (got[k].score >= quality.KEEP)


def slow_fingerprint(text):
    w = words((text or "").translate({k: k + 32 for k in range(65, 91)}))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, none):
    got = {(r.doc_id, r.fingerprint) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(i, f"{slow_fingerprint(t):016x}") for i, t, *_ in ROWS}
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == simhash.near_duplicates(docs).select("component_id").distinct().count()


def test_simhash_components(spark):
    """Classes of the whole operator against brute force: chains of edited texts, copies, empty texts, clashing columns."""
    r = random.Random(12)
    texts = [None, "", "one", "One", "!"]
    for _ in range(12):
        w = [f"w{r.randrange(300)}" for _ in range(r.choice([4, 60, 500, 1500]))]
        for _ in range(6):
            texts.append(" ".join(w))
            w = list(w)
            w[r.randrange(len(w))] = f"n{r.randrange(300)}"
    texts += texts[::9]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = list(zip(ids, texts, ids, strict=True))
    fp = {i: int(slow_fingerprint(t)) for i, t, _ in rows}
    root = {i: i for i in ids}
    for _ in ids:
        for i in ids:
            root[i] = min(root[j] for j in ids if bin(fp[i] ^ fp[j]).count("1") <= 3)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp long").repartition(3)).collect()}
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in ids}
    assert len(set(root.values())) < len({*fp.values()})


def test_links(spark):
    r = random.Random(8)
    fps = {0, (1 << 64) - 1, 0x5555555555555555, 0xAAAAAAAAAAAAAAAA}
    for _ in range(60):
        base = r.getrandbits(64)
        fps.add(base)
        for _ in range(4):
            x = base
            for b in r.sample(range(64), r.randrange(1, 6)):
                x ^= 1 << b
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    for groups in (simhash.GROUPS, simhash.MORE_GROUPS, 4):
        edges = [(e.a, e.b) for e in simhash.links(df, groups=groups).collect()]
        assert sorted(edges) == sorted(want) and len(want) > 50  # each link once
    near = {(a, b) for a, b in want if bin((a ^ b) & (1 << 64) - 1).count("1") <= 1}
    assert {(e.a, e.b) for e in simhash.links(df, 1).collect()} == near
    with pytest.raises(ValueError):
        simhash.links(df, 7)
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(100, 101), (101, 102)], "a long, b long")
    assert {(x.node, x.root) for x in simhash.components(chain).collect()} == {(k, 1) for k in range(1, 31)} | {(k, 100) for k in (100, 101, 102)}


def test_links_are_not_broadcast(spark, tmp_path):
    """A few bytes of fingerprints become 35 rows each: by their estimate they would be broadcast."""
    spark.range(1000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/groups")
    joined = simhash.links(spark.read.parquet(f"{tmp_path}/groups"))
    assert joined.count() == 0
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_copies_are_not_broadcast(spark):
    """The documents are the side that streams, however few bytes they are."""
    plan = simhash.near_duplicates(spark.createDataFrame([(k, "one text") for k in range(1000)], "doc_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan.splitlines()[1]


def test_rollups(spark, docs, none, tmp_path):
    counts = rollups.count_tokens(docs, TOKENIZER).cache()
    store = rollups.Rollup(spark, f"file://{tmp_path}/r")
    versions = (rollups.WORDS_1, rollups.BPE_1)
    assert store.commit("a", rollups.deltas(counts, versions, 1)) and not store.commit("a", rollups.deltas(counts, versions, 1))
    total = lambda: {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    want = defaultdict(lambda: [0, 0])
    for _, t, lang, source, *_ in ROWS:
        want[(source, lang)][0] += 1
        want[(source, lang)][1] += len(words(t))
    assert {k[:2]: list(v) for k, v in total().items() if k[2] == rollups.WORDS_1} == dict(want)
    before = total()
    store.compact()
    assert total() == before and store.batches() == {"a"} and not store.commit("a", rollups.deltas(counts, versions, 1))
    store.commit("b", rollups.deltas(counts, versions, -1))
    assert total() == {}
    assert rollups.deltas(rollups.count_tokens(none, TOKENIZER), versions, 1).count() == 0
    for bad in ("", "a/b", "_x", "..", "a\\b"):
        with pytest.raises(ValueError):
            store.commit(bad, rollups.deltas(counts, versions, 1))
    first, copies = rollups.without_copies(counts)
    assert first.count() + copies.count() == len(ROWS)


ITEM = "A train leaves Paris at 40 km per hour and reaches old Lyon after 40 minutes while another goes on for 7 hours"


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, ITEM), (2, "short item"), (3, None), (None, "x y z x y z x y z")], "item_id long, text string")
    changed = ITEM.replace("40", "95").replace(" 7 ", " 3 ").replace("Lyon", "Metz")
    mixed = ITEM.replace("40 km", "95 km").replace(" 7 ", " 3 ")
    rows = [(1, "before it. " + ITEM + " and after"), (2, changed), (3, mixed), (4, "nothing of this kind"), (5, None), (6, " ".join(ITEM.split()[:9])), (7, "a short item here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [x.item_id for x in r["items"]] for r in decontaminate.find_leaks(df, bench).select("row.doc_id", "items").collect()}
    assert got == {1: [1], 2: [1], 3: [], 4: [], 5: [], 6: [], 7: [2]}
    blocks = {r.doc_id: [x.item_id for x in r["items"]] for r in decontaminate.find_leaks(df, bench, block_windows=16).select("row.doc_id", "items").collect()}
    assert blocks == got
    assert decontaminate.find_leaks(docs, bench).count() == len(ROWS) and decontaminate.find_leaks(none, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).where("size(items) > 0").count() == 0


def test_decontamination_of_twins_runs_and_first_words(spark):
    names = "Paris lies far from old Lyon and the train needs 3 hours for it while no other way is known"
    run = "press the keys 1 2 3 4 5 6 7 then wait"
    bench = spark.createDataFrame([(1, ITEM), (2, run), (3, names)], "item_id long, text string")
    mixed = ITEM.replace("40 km", "95 km").replace(" 7 ", " 3 ")
    rows = [(1, mixed + " | " + ITEM), (2, ITEM + " | " + mixed), (3, mixed + " | " + mixed), (4, run), (5, "so " + run.replace("3", "8")), (6, run.replace("3", "2"))]
    rows += [(7, names.replace("Paris", "Metz").replace("Lyon", "Genf")), (8, names.replace("Paris", "Genf").replace("Lyon", "Genf")), (9, "Now he knows it. " + names)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [x.item_id for x in r["items"]] for r in decontaminate.find_leaks(df, bench).select("row.doc_id", "items").collect()}
    assert got == {1: [1], 2: [1], 3: [], 4: [2], 5: [2], 6: [], 7: [3], 8: [], 9: [3]}
    short = spark.createDataFrame([(1, "Ada knew that Bob likes tea")], "item_id long, text string")
    text = spark.createDataFrame([(1, "we say: Eve knew that Tom likes tea")], "doc_id long, text string")
    assert decontaminate.find_leaks(text, short).where("size(items) = 1").count() == 1


def naive_leak(text, item, window=5, least=0.8, slack=3):
    """Whether an item of lower-case words and numbers stands in a text, with numbers replaced one to one."""
    is_number = lambda w: w.isdigit()
    t, w = text.split(), item.split()
    size = min(window, len(w))
    shape = lambda x: tuple("#" if is_number(y) else y for y in x)
    hits = [(i - j, j, i) for j in range(len(w) - size + 1) for i in range(len(t) - size + 1) if shape(w[j : j + size]) == shape(t[i : i + size])]
    for c in {d for d, *_ in hits}:
        near = {}
        for d, j, i in sorted(hits):
            if abs(d - c) <= slack and (j not in near or abs(d - c) < abs(near[j][0] - c)):
                near[j] = (d, i)
        if len(near) < least * (len(w) - size + 1):
            continue
        pairs = {(w[j + k], t[i + k]) for j, (_, i) in near.items() for k in range(size) if is_number(w[j + k])}
        if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
            return True
    return False


def test_decontamination_by_brute_force(spark):
    r = random.Random(17)
    word = lambda: str(r.randrange(4)) if r.random() < 0.3 else r.choice("abcde") * 3
    items = [" ".join(word() for _ in range(r.choice([3, 5, 8, 14]))) for _ in range(25)]
    texts = []
    for _ in range(150):
        w = r.choice(items).split()
        swap = dict(zip("0123", r.sample("0123456789", 4), strict=True))
        w = [swap.get(x, x) for x in w] if r.random() < 0.5 else w
        if r.random() < 0.5:
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w.insert(r.randrange(len(w)), word())
        texts.append(" ".join([word() for _ in range(r.randrange(6))] + w + [word() for _ in range(r.randrange(6))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if naive_leak(t, item)}
    for windows in (1 << 21, 64):
        got = decontaminate.find_leaks(df, bench, block_windows=windows).select("row.doc_id", F.explode("items.item_id").alias("i")).collect()
        assert {(x.doc_id, x.i) for x in got} == want and 50 < len(want) < 2000


def test_tables():
    codes = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000))
    table = CodeTable(codes)
    assert (table.find(codes) == np.arange(len(codes))).all() and (table.find(codes + 1)[~np.isin(codes + 1, codes)] == -1).all()
    assert (CodeTable(codes[:0]).find(codes) == -1).all()
    counter = Counter64(most=100)
    for part in np.array_split(np.repeat(codes, 3), 7):
        counter.add(part)
    got, n = counter.take()
    assert (got == codes).all() and (n == 3).all()


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
