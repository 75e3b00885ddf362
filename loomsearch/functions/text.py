"""Text functions: Catalyst expressions where one exists, Arrow-batched UDFs where none does."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomsearch.functions.vectorised import arrow_vectorised, vectorised

INDEX_SPLIT = r"[^\p{L}\p{N}]+"
LONGEST_TOKEN = 40
#: Letters and digits, joined by marks that do not break a word between them.
UNICODE_WORD = re.compile(r"[^\W_]+(?:(?:['’.:·](?=[^\W\d_])|[.,;'](?=\d)|_+)[^\W_]+)*")


def index_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits under 40 bytes."""
    return F.filter(F.split(F.lower(text), INDEX_SPLIT), lambda x: (x != "") & (F.octet_length(x) < LONGEST_TOKEN))


def words(text: Column) -> Column:
    """White-space words."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    """Parts between . ! ? that are longer than ten bytes when trimmed."""
    return F.filter(F.transform(F.split(text, "[.!?]"), lambda x: F.trim(x)), lambda x: F.octet_length(x) > 10)


def html_escape(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def url_escape(text: Column) -> Column:
    for mark, code in ((" ", "+"), ("&", "%26"), ("#", "%23")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


#: Letters whose capital is one letter though their upper case in a word is two: sharp s, and Greek ones with iota below.
CAPITALS = {"ß": "ẞ"} | {chr(c): chr(c).title() for c in (*range(0x1F80, 0x1FB0), 0x1FB3, 0x1FBC, 0x1FC3, 0x1FCC, 0x1FF3, 0x1FFC)}


def capital(letter: Column) -> Column:
    """The one letter that is its capital, as SQL engines map letter by letter; the letter itself where there is none."""
    upper = F.upper(letter)
    return F.when(F.length(upper) == 1, upper).otherwise(F.translate(letter, "".join(CAPITALS), "".join(CAPITALS.values())))


def capitalise(text: Column) -> Column:
    return F.concat(capital(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def quoted_phrases(text: Column) -> Column:
    """Trimmed, non-empty text between pairs of double quotes."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def deletes(word: Column, most: int) -> Column:
    """All strings with up to `most` characters removed, the word itself first."""
    every = F.array(word)
    level = every
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))).otherwise(F.array().cast("array<string>")))))
        every = F.array_union(every, level)
    return every


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalise(vector: Column) -> Column:
    """vector / norm where the norm exceeds 1e-8, else the vector itself."""
    norm = l2_norm(vector)
    return F.transform(vector, lambda x: F.when(norm > 1e-8, x.cast("double") / norm).otherwise(x.cast("double")))


def unicode_words(text: str | None) -> list[str]:
    return [w.lower() for w in UNICODE_WORD.findall(unicodedata.normalize("NFKC", text or ""))]


@vectorised("array<string>")
def query_tokens(text: pd.Series) -> pd.Series:
    """NFKC, Unicode words, lower case."""
    return text.map(unicode_words)


def bold_spans(text: str, terms: list[str]) -> str:
    """Wraps case-insensitive occurrences of the terms, overlapping or touching ones together."""
    spans = sorted(m.span() for t in {t.lower() for t in terms if t} for m in re.finditer(f"(?={re.escape(t)})", text, re.IGNORECASE) for m in [_Span(m.start(), len(t))])
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at = [], 0
    for a, b in merged:
        out += [text[at:a], "<b>", text[a:b], "</b>"]
        at = b
    return "".join([*out, text[at:]])


class _Span:
    def __init__(self, start: int, size: int):
        self._span = (start, start + size)

    def span(self) -> tuple[int, int]:
        return self._span


def make_snippet(body: str, query: str, most: int = 300) -> str:
    terms = [w.lower() for w in (query or "").split() if len(w.encode()) >= 2]
    body = body or ""
    if not terms:
        return body[:most]
    parts = [s for s in (p.strip() for p in re.split("[.!?]", body)) if len(s.encode()) > 10]
    if not parts:
        return bold_spans(body[:most], terms)
    ranked = sorted(range(len(parts)), key=lambda i: (-sum(t in parts[i].lower() for t in terms), i))
    taken, size = [], 0
    for i in ranked:
        more = len(parts[i].encode()) + (2 if taken else 0)
        if size + more > most:
            break
        taken.append(i)
        size += more
    if not taken:
        return bold_spans(parts[ranked[0]][: most - 3] + "...", terms)
    return bold_spans(". ".join(parts[i] for i in sorted(taken)), terms)


@vectorised("string")
def snippet(body: pd.Series, query: pd.Series) -> pd.Series:
    """The best sentences for a query within 300 bytes, its words in bold."""
    return pd.Series([make_snippet(b, q) for b, q in zip(body, query, strict=True)])


def model_ids(text: str | None, most: int, framed: bool = True) -> list[int]:
    ids = []
    for word in (text or "").lower().split(maxsplit=most)[:most]:
        h = 5381
        for byte in word.encode():
            h = (h * 33 + byte) & 0xFFFFFFFFFFFFFFFF
        ids.append(h % 29000 + 1000)
    return [101, *ids[: most - 2], 102] if framed else ids[:most]


def model_tokens(most: int):
    """ids framed by 101 and 102, cut to `most`."""

    @arrow_vectorised("array<int>")
    def tokens(text: pa.Array) -> pa.Array:
        return pa.array([model_ids(t, most) for t in text.to_pylist()], pa.list_(pa.int32()))

    return tokens


def pair_tokens(query_most: int = 32, passage_most: int = 128):
    """ids, mask and types of 101 query 102 passage 102, padded to query_most + passage_most + 3."""

    @vectorised("ids array<int>, mask array<int>, types array<int>")
    def tokens(query: pd.Series, passage: pd.Series) -> pd.DataFrame:
        rows = []
        width = query_most + passage_most + 3
        for q, p in zip(query, passage, strict=True):
            left, right = [101, *model_ids(q, query_most, False), 102], [*model_ids(p, passage_most, False), 102]
            pad = [0] * (width - len(left) - len(right))
            rows.append((left + right + pad, [1] * (len(left) + len(right)) + pad, [0] * len(left) + [1] * len(right) + pad))
        return pd.DataFrame(rows, columns=["ids", "mask", "types"])

    return tokens


VOWEL = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in VOWEL and w[i - 1] in VOWEL:
                return i + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWEL and w[1] not in VOWEL
    return len(w) > 2 and w[-3] not in VOWEL and w[-2] in VOWEL and w[-1] not in VOWEL + "wxY"


# Fixed values of the published English stemmer: whole-word exceptions and suffix tables.
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
KEPT = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")


def stem_english(word: str) -> str:
    """The published English (Porter2) stemmer."""
    w = word.replace("’", "'").lstrip("'")
    if len(w) <= 2:
        return w
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWEL) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in VOWEL for c in w[:-2]):
        w = w[:-1]
    if w in KEPT:
        return w
    for s in ("eedly", "eed"):
        if w.endswith(s):
            w = w[: -len(s)] + "ee" if len(w) - len(s) >= r1 else w
            break
    else:
        for s in ("ingly", "edly", "ing", "ed"):
            if w.endswith(s):
                if any(c in VOWEL for c in w[: -len(s)]):
                    w = w[: -len(s)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(DOUBLES):
                        w = w[:-1]
                    elif len(w) <= r1 and _short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWEL:
        w = w[:-1] + "i"

    def suffix(table) -> str:
        return next((s for s in sorted(table, key=len, reverse=True) if w.endswith(s)), "")

    s = suffix([*STEP2, "ogi", "li"])
    if s and len(w) - len(s) >= r1:
        if s == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif s == "li":
            w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
        else:
            w = w[: -len(s)] + STEP2[s]
    s = suffix([*STEP3, "ative"])
    if s and len(w) - len(s) >= r1:
        if s != "ative":
            w = w[: -len(s)] + STEP3[s]
        elif len(w) - len(s) >= r2:
            w = w[: -len(s)]
    s = suffix([*STEP4, "ion"])
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@arrow_vectorised("array<string>")
def linguistic_tokens(text: pa.Array) -> pa.Array:
    """NFKC, Unicode words, lower case, two bytes or more, stemmed as English; each distinct word of a batch once."""
    stem = functools.cache(stem_english)
    return pa.array([[stem(w) for w in unicode_words(t) if len(w.encode()) >= 2] for t in text.to_pylist()], pa.list_(pa.string()))
