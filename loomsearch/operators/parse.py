"""Web pages to documents: one Arrow-batched UDF over the standard library's HTML parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsearch.functions.vectorised import arrow_vectorised

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt".split())
# Class or id parts and tags of boilerplate.
BOILERPLATE = "sidebar nav navigation footer header menu comment ad advertisement widget social share related popup modal cookie banner promo sponsor".split()
BOILERPLATE_TAGS = {"nav", "footer", "header", "aside"}
MAIN_TAGS = ("article", "main", "section")

PARSED = (
    "title string, meta_description string, canonical_url string, language string, og_tags struct<title:string,description:string,image:string,og_type:string,site_name:string>, "
    "headings array<struct<level:int,text:string>>, outgoing_links array<struct<url:string,anchor_text:string,is_followed:boolean>>, structured_data array<string>, alt_texts array<string>, "
    "url_tokens array<string>, body string, word_count long"
)
#: The same as an Arrow type.
_TEXTS = pa.list_(pa.string())
STRUCT = pa.struct([
    ("title", pa.string()), ("meta_description", pa.string()), ("canonical_url", pa.string()), ("language", pa.string()), ("og_tags", pa.struct([(k, pa.string()) for k in ("title", "description", "image", "og_type", "site_name")])),
    ("headings", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))), ("outgoing_links", pa.list_(pa.struct([("url", pa.string()), ("anchor_text", pa.string()), ("is_followed", pa.bool_())]))), ("structured_data", _TEXTS), ("alt_texts", _TEXTS),
    ("url_tokens", _TEXTS), ("body", pa.string()), ("word_count", pa.int64()),
])


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, tag: str):
        return (n for n in self.walk() if n.tag == tag)


class Tree(HTMLParser):
    """A forgiving element tree: void tags close themselves, blocks close an open paragraph, stray ends are dropped."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._close("p", {"article", "section", "div", "td", "body", "main", "li"})
        if tag == "li":
            self._close("li", {"ul", "ol"})
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _close(self, tag: str, stop: set) -> None:
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def is_boilerplate(node: Node) -> bool:
    while node is not None:
        marks = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()
        if node.tag in BOILERPLATE_TAGS or any(b in marks for b in BOILERPLATE):
            return True
        node = node.parent
    return False


def _flat(text: str) -> str:
    return " ".join(text.split())


def main_text(root: Node, title: str) -> str:
    """The first article, main or section of 50 words or more; else paragraphs by density and words shared with the title."""
    for tag in MAIN_TAGS:
        for node in root.find(tag):
            text = _flat(node.text())
            if len(text.split()) >= 50:
                return text
    wanted = {w.lower() for w in title.split()}
    blocks = []
    body = next(root.find("body"), root)
    for p in body.find("p"):
        text = _flat(p.text())
        words = text.split()
        if len(words) < 5 or is_boilerplate(p):
            continue
        tags = max(sum(isinstance(c, Node) for c in p.children), 1)
        hits = sum(w.lower() in wanted for w in words)
        blocks.append((len(words) / tags + 2 * hits / max(len(wanted), 1), text))
    best = sorted(blocks, key=lambda b: -b[0])
    chosen = " ".join(t for s, t in best if s > 0.5)
    return chosen if len(chosen.split()) >= 20 else " ".join(t for _, t in best)


def clean_title(text: str) -> str:
    return re.split("[-|—–]", text, maxsplit=1)[0].strip()


def parse_page(html: str | bytes | None, url: str) -> dict:
    text = html.decode("utf-8", "replace") if isinstance(html, bytes | bytearray) else html or ""
    tree = Tree()
    tree.feed(text)
    tree.close()
    root = tree.root
    metas = list(root.find("meta"))
    named = next((m.attrs.get("content", "") for m in metas if m.attrs.get("name") == "description"), "")
    og = {k: next((m.attrs.get("content") for m in metas if m.attrs.get("property") == f"og:{p}"), None) for k, p in (("title", "title"), ("description", "description"), ("image", "image"), ("og_type", "type"), ("site_name", "site_name"))}
    title = clean_title(next((n.text() for n in root.find("title")), ""))
    links, seen = [], set()
    for a in root.find("a"):
        if "href" not in a.attrs:
            continue
        try:
            to = urljoin(url, a.attrs["href"].strip())
        except ValueError:
            continue
        if to not in seen:
            seen.add(to)
            links.append({"url": to, "anchor_text": _flat(a.text()), "is_followed": "nofollow" not in a.attrs.get("rel", "")})
    body = main_text(root, title)
    try:
        path = urlsplit(url).path
    except ValueError:
        path = ""
    return {
        "title": title,
        "meta_description": named,
        "canonical_url": next((n.attrs.get("href") for n in root.find("link") if n.attrs.get("rel") == "canonical"), None),
        "language": next((n.attrs["lang"] for n in root.find("html") if n.attrs.get("lang")), "en"),
        "og_tags": og,
        "headings": [{"level": k, "text": t} for k in range(1, 7) for n in root.find(f"h{k}") if (t := n.text().strip())],
        "outgoing_links": links,
        "structured_data": [t for n in root.find("script") if n.attrs.get("type") == "application/ld+json" and (t := n.text().strip())],
        "alt_texts": [t for n in root.find("img") if (t := n.attrs.get("alt", "").strip())],
        "url_tokens": [t.lower() for t in re.split("[/._-]", path) if t],
        "body": body,
        "word_count": len(body.split()),
    }


@arrow_vectorised(PARSED, once=True)
def parsed(html: pa.Array, url: pa.Array) -> pa.Array:
    return pa.array([parse_page(h, u or "") for h, u in zip(html.to_pylist(), url.to_pylist(), strict=True)], STRUCT)


def fetched(pages: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """Pages that a fetcher would pass on: status 200 needs an HTML or plain content type; statuses of 400 and more and large bodies go."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    html = kind.contains("text/html") | kind.contains("xhtml") | kind.contains("text/plain")
    return pages.where((F.col("status") < 400) & ((F.col("status") != 200) | html) & (F.octet_length("html") <= most_bytes))


def documents(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as documents with all extracted fields."""
    return pages.withColumn("x", parsed("html", "url")).select("page_id", "url", "x.*")


def indexable(docs: DataFrame, least_words: int = 20) -> DataFrame:
    return docs.where(F.col("word_count") >= least_words)


def title_of(html: Column) -> Column:
    """The title as an expression: text before the first dash or bar, trimmed."""
    return F.trim(F.element_at(F.split(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "[-|—–]"), 1))


def language_of(html: Column) -> Column:
    own = F.regexp_extract(html, r'<html[^>]*\blang="([^"]*)"', 1)
    return F.when(own == "", "en").otherwise(own)
