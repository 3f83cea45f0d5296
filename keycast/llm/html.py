"""Main text of web pages by removal of site templates.

Every page becomes a tree of elements. What is never article text goes by its
element or its role, and by a name in its class or id if it is a small part of
the page beside the article; of the rest, the hash of each element's subtree is counted
over the pages of its host, and subtrees that recur on many of them go too:
menus, notices and adverts that no name gives away. A subtree counts once for
each distinct page that holds it, so copies of one page do not make a template
of their own text; and plain paragraphs and headings inside an article stay,
since passages may recur in articles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keycast.llm.shared import in_python, stored

# Fixed values of HTML: elements without content, elements that are never article text, elements that make a block.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {
    "head", "title", "script", "style", "noscript", "template", "nav", "aside", "footer", "form", "button", "select", "textarea", "input", "label", "dialog", "menu",
    "iframe", "object", "embed", "canvas", "svg", "math", "audio", "video", "map",
}
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br",
}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "td", "th", "dd", "dt", "figcaption"}
# An element that opens while one of these is open ends it first.
CLOSES_P = BLOCKS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "aside", "nav", "footer", "header", "form"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status"}
# Classes and ids, as whole names, that make an element such a part unless it holds the article.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice",
    "notices", "alert", "popup", "modal", "overlay", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "aside", "widget",
    "footer", "masthead", "comment", "comments", "disqus", "respond", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup",
    "login", "search", "toolbar", "skip",
}


@dataclass(frozen=True)
class Settings:
    """A subtree is a template if it recurs on this many distinct pages of its host, and on this share of them or on enough pages."""

    least_pages: int = 3
    least_share: float = 0.2
    enough_pages: int = 20  # whatever the share
    enough_prose: int = 1000  # for a lone paragraph, heading or item: short ones recur by chance


class _Node:
    __slots__ = ("tag", "parent", "parts", "gone", "kept_as_article")

    def __init__(self, tag: str, parent: _Node | None, gone: bool, article: bool):
        self.tag, self.parent, self.parts, self.gone, self.kept_as_article = tag, parent, [], gone, article


class _Tree(HTMLParser):
    """Elements and texts of a page; what is dropped by element or role leaves an empty node."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Node("html", None, False, False)
        self.named: list[_Node] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        here = self.here
        if tag in CLOSES_P:
            self._end("p", {"article", "section", "div", "main", "body", "table", "ul", "ol", "button"})
        if tag in SIBLINGS:
            for name in SIBLINGS[tag]:
                self._end(name, {"ul", "ol", "dl", "table"} | ({"select"} if tag == "option" else set()))
        here = self.here
        gone = here.gone or tag in DROPPED or (tag == "header" and not here.kept_as_article) or (tag not in ("html", "body", "article", "main") and _by_role(attrs))
        if tag in VOID:
            if not here.gone:
                here.parts.append(" " if tag not in BLOCKS else None)
            return
        node = _Node(tag, here, gone, here.kept_as_article or tag in ("article", "main"))
        if not gone:
            here.parts.append(node)
            if tag not in ("html", "body", "article", "main") and _named(attrs):
                self.named.append(node)
        self.here = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def _end(self, tag: str, scope: set) -> None:
        node = self.here
        while node is not None and node.tag != tag:
            if node.tag in scope:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_endtag(self, tag: str) -> None:
        if tag in ("p", "b", "i", "em", "strong", "a", "span", "u", "small", "font", "code"):
            self._end(tag, SCOPES)
        elif tag not in ("html", "body"):
            self._end(tag, set())

    def handle_data(self, data: str) -> None:
        if not self.here.gone:
            self.here.parts.append(data)


def _by_role(attrs: list) -> bool:
    for key, value in attrs:
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and (value or "").strip().lower() in ROLES:
            return True
    return False


def _named(attrs: list) -> bool:
    return any(key in ("class", "id") and value and not NAMES.isdisjoint(value.lower().split()) for key, value in attrs)


def _drop_named(root: _Node, named: list[_Node]) -> None:
    """Drop the named elements that hold less than half of the page's text, and no article unless a longer one stands outside such elements."""
    nodes, names = [root], set(map(id, named))
    for node in nodes:  # parents before their parts
        nodes.extend(part for part in node.parts if isinstance(part, _Node))
    under: dict[int, bool] = {}
    size: dict[int, int] = {}
    holds: dict[int, bool] = {}
    outside = 0
    for node in nodes:
        under[id(node)] = id(node) in names or (node.parent is not None and under[id(node.parent)])
        size[id(node)] = sum(len(part.strip()) for part in node.parts if isinstance(part, str))
        if node.kept_as_article and not under[id(node)]:
            outside += size[id(node)]
    for node in reversed(nodes):
        holds[id(node)] = holds.get(id(node), False) or node.tag in ("article", "main")
        if node.parent is not None:
            size[id(node.parent)] += size[id(node)]
            holds[id(node.parent)] = holds.get(id(node.parent), False) or holds[id(node)]
    for node in named:
        if 2 * size[id(node)] < size[id(root)] and (not holds[id(node)] or outside > size[id(node)]):
            node.parts = []
            node.gone = True


def parse(html: str) -> _Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    if tree.named:
        _drop_named(tree.root, tree.named)
    return tree.root


def blocks(root: _Node, templates: frozenset = frozenset()) -> tuple[list[str], set[int]]:
    """Texts of the blocks in page order, and hashes of the subtrees that may be templates.

    Walks without recursion, as pages may nest without bound.
    """
    texts: list[str] = []
    hashes: set[int] = set()
    open_text: list[str] = []

    def flush() -> None:
        text = " ".join("".join(open_text).split())
        open_text.clear()
        if text:
            texts.append(text)

    stack = [(root, 0, xxhash.xxh64(root.tag), len(texts))]
    while stack:
        node, at, digest, mark = stack.pop()
        if at == len(node.parts):
            if node.tag in BLOCKS:
                flush()
            # The lowest bit tells prose from what holds it.
            value = ((digest.intdigest() - (1 << 63)) & ~1) | (node.tag in PROSE)
            shielded = node.kept_as_article and (node.tag in PROSE or node.tag not in BLOCKS or node.tag in ("article", "main"))
            eligible = node.parent is not None and node.tag != "body" and not shielded and node.tag in BLOCKS
            if eligible and len(texts) > mark:
                hashes.add(value)
                if value in templates:
                    del texts[mark:]
            if stack:
                stack[-1][2].update(b"<" + digest.digest())
            continue
        part = node.parts[at]
        stack.append((node, at + 1, digest, mark))
        if part is None:
            flush()
        elif isinstance(part, str):
            open_text.append(part)
            digest.update(" ".join(part.split()).encode("utf-8", "surrogatepass"))
        elif not part.gone:
            if part.tag in BLOCKS:
                flush()
            stack.append((part, 0, xxhash.xxh64(part.tag), len(texts)))
    flush()
    return texts, hashes


def _whole(texts: list[str]) -> int:
    """What tells one page from another: all its blocks, so that only copies are one page."""
    return xxhash.xxh64("\n".join(texts).encode("utf-8", "surrogatepass")).intdigest() - (1 << 63)


def _host(url):
    """Host of an address, in lower case and without user, port and a leading www; empty if there is none.

    Without a scheme, what stands before the first slash is the host if it has a dot or follows two slashes.
    """
    full = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    bare = F.regexp_extract(url, r"^([^/?#:@\s]+\.[^/?#:@\s]+)(?:[/?#:]|$)", 1)
    return F.coalesce(F.regexp_replace(F.lower(F.when(full != "", full).otherwise(bare)), r"^www\.", ""), F.lit(""))


def subtrees(pages: DataFrame) -> DataFrame:
    """page (row hash), host, whole (what tells it from others) and the hashes of the subtrees that may be templates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            wholes, found = [], []
            for html in batch["html"].fillna(""):
                texts, hashes = blocks(parse(html))
                wholes.append(_whole(texts))
                found.append(np.array(sorted(hashes), dtype=np.int64))
            yield pd.DataFrame({"page": batch["page"], "host": batch["host"], "whole": wholes, "subtrees": found})

    return in_python(pages, run, "page long, host string, whole long, subtrees array<long>")


def templates(found: DataFrame, settings: Settings) -> DataFrame:
    """host and subtree of what recurs on many distinct pages of the host.

    Counting runs on distinct (host, subtree, page), first within tasks, so
    a host with a third of all pages is spread over its subtrees.
    """
    each = found.select("host", "whole", F.explode("subtrees").alias("subtree")).distinct()
    count = each.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= settings.least_pages)
    all_ = found.select("host", "whole").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all_pages"))
    enough = F.when(F.col("subtree").bitwiseAND(1) == 1, settings.enough_prose).otherwise(settings.enough_pages)
    return count.join(all_, "host").where(F.col("pages") >= F.least(enough, settings.least_share * F.col("all_pages"))).select("host", "subtree")


def main_text(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per page: page_id, url, text and n_chars, from the whole html.

    A null or empty html has the empty text. Pages without a host count as pages
    of one host. Null ids and repeated rows stay rows of their own; other
    columns are not read.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    source = source.withColumn("host", _host(F.col("url"))).withColumn("page", F.xxhash64("page_id", "url", "html"))
    found = stored(subtrees(source.select("page", "host", "html")), "subtrees")
    recurring = stored(templates(found, settings), "templates")
    # Only pages that hold a template have a row here; a table of known size, so the planner sends it to the pages if it is small.
    marked = found.select("page", "host", F.explode("subtrees").alias("subtree")).join(recurring, ["host", "subtree"])
    marked = stored(marked.groupBy("page").agg(F.collect_set("subtree").alias("templates")), "marked")
    rows = source.join(marked, "page", "left").select("page_id", "url", "html", "templates")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for html, gone in zip(batch["html"], batch["templates"], strict=True):
                known = frozenset() if gone is None or (isinstance(gone, float) and gone != gone) else frozenset(map(int, gone))
                texts.append(" ".join(blocks(parse(html or ""), known)[0]))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return in_python(rows, run, "page_id long, url string, text string, n_chars long")
