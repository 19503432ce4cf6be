"""Main text of html pages, without what a site repeats on its pages."""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import new_folder
from .common import text_slices
from .url_filter import url_host

#: A subtree is a template of its host if so many distinct pages, and this share of the host's, have it.
LEAST_PAGES, LEAST_SHARE = 5, 0.1
#: Share of a list's or box's characters within links from which it can be a template inside an article.
LINKED = 0.5

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is no markup.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option "
    "p pre search section select summary table tbody tfoot thead tr td th ul".split()
)
#: Elements that are never part of the main text.
DROPPED = frozenset("aside audio button canvas dialog footer head iframe menu nav noembed noframes noscript object option script search select style svg template textarea title video xmp".split())
#: Elements that are dropped unless the main text stands in them.
AROUND = frozenset(["form", "header"])
#: Words of a class, an id or a role that mark an element as no part of the main text.
HINTS = frozenset(
    "ad ads adbox adsense adslot advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies discussion disqus footer gdpr login masthead menu "
    "modal nav navbar navigation navigations newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
COMMENTS = frozenset("comment comments reply replies".split())
#: Names of boxes that hold the main text where no element says so.
BODY = re.compile(r"(?i)\b(?:article|post|entry|story|main|page)[-_ ]?(?:body|content|text|main)\b")
CLOSED_BY = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "optgroup": ("option optgroup", "select")}
CLOSED_BY = {tag: (frozenset(ends.split()), frozenset(within.split())) for tag, (ends, within) in CLOSED_BY.items()}
CELLS = frozenset(["td", "th"])
#: Parts of a page at which a menu that was left open ends.
PARTS = frozenset(["article", "main", "footer"])
LISTS = frozenset("div dl ol section table ul".split())


class Page:
    """The element tree of a page as flat lists; only blocks, and other elements that attributes mark, are nodes. Node 0 is the page."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.marked, self.root = [-1], [""], [False], [0]
        self.parts: list[list[bytes]] = [[]]
        self.chars, self.linked = [0], [0]
        self.digest: list[int] = [0]
        self.pieces: list[tuple[int, int, str]] = []  # (block, node, text)
        self._open, self._held, self._links, self._block = [0], {}, 0, 0
        at = 0
        while found := TAG.search(html, at):
            self._text(html[at : found.start()])
            at = found.end()
            if found[2]:
                tag = found[2].lower()
                if found[1]:
                    self._end(tag)
                elif tag in RAW:
                    end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
                    at = len(html) if end is None else end.start()
                    at = len(html) if end is None else (html.find(">", at) + 1 or len(html))
                else:
                    self._start(tag, found[3])
        self._text(html[at:])
        while self._open:
            self._close()

    def _text(self, raw: str) -> None:
        if not raw:
            return
        text = references.unescape(raw) if "&" in raw else raw
        node = self._open[-1]
        self.pieces.append((self._block, node, text))
        if words := text.split():
            size = sum(map(len, words))
            self.parts[node].append(" ".join(words).encode("utf-8", "replace"))
            self.chars[node] += size
            self.linked[node] += size if self._links else 0

    def _start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCK
        if block:
            self._block += tag not in CELLS
            for i in range(len(self._open) - 1, 0, -1):
                above = self.tag[self._open[i]]
                if above == "p":
                    self._close_to(i)
                if above in BLOCK:
                    break
            if tag in CLOSED_BY:
                ends, within = CLOSED_BY[tag]
                for i in range(len(self._open) - 1, 0, -1):
                    above = self.tag[self._open[i]]
                    if above in ends:
                        self._close_to(i)
                    if above in ends or above in within:
                        break
            if tag in PARTS and self._held.get("nav"):
                self._close_to(max(i for i, n in enumerate(self._open) if self.tag[n] == "nav"))
        if tag in CELLS or tag in VOID:
            self.pieces.append((self._block, self._open[-1], " "))
        if tag in VOID:
            return
        self._links += tag == "a"
        marked, root = self._judged(tag, attributes)
        if block or marked or tag in DROPPED or self._held.get(tag):
            self.parent.append(self._open[-1])
            self.tag.append(tag)
            self.marked.append(marked)
            self.root.append(root)
            self.parts.append([tag.encode("utf-8", "replace")])
            self.chars.append(0)
            self.linked.append(0)
            self.digest.append(0)
            self._open.append(len(self.tag) - 1)
            self._held[tag] = self._held.get(tag, 0) + 1

    def _judged(self, tag: str, attributes: str) -> tuple[bool, int]:
        """(whether attributes mark the element as no part of the main text, how surely it holds it: 3 article, 2 main, 1 a box named so)."""
        root = {"article": 3, "main": 2}.get(tag, 0)
        if not attributes.strip(" /"):
            return False, root
        held = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        named = " ".join(held.get(k, "") for k in ("class", "id", "role"))
        tokens = {t.lower() for t in TOKEN.findall(named)}
        hidden = "hidden" in held or held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", "").lower()
        if tag in ("html", "body"):
            return False, 0
        if root == 3:
            return hidden or bool(tokens & (COMMENTS | {"teaser", "related", "promo"})), root
        if not root and held.get("role") == "main":
            root = 2
        if not root and (held.get("itemprop", "").lower() == "articlebody" or BODY.search(named)):
            root = 1
        return hidden or (not root and bool(tokens & HINTS)), root

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._block += tag not in CELLS
        self._links -= tag == "a" and self._links > 0
        if self._held.get(tag):
            for i in range(len(self._open) - 1, 0, -1):
                above = self.tag[self._open[i]]
                if above == tag:
                    self._close_to(i)
                    return
                if above in PARTS:
                    return  # a stray end does not leave the article

    def _close_to(self, place: int) -> None:
        while len(self._open) > place:
            self._close()

    def _close(self) -> None:
        node = self._open.pop()
        self.digest[node] = xxhash.xxh64_intdigest(b"\0".join(self.parts[node]))
        self._held[self.tag[node]] = self._held.get(self.tag[node], 1) - 1
        if node:
            above = self.parent[node]
            self.parts[above].append(self.digest[node].to_bytes(8, "little"))
            self.chars[above] += self.chars[node]
            self.linked[above] += self.linked[node]
        self.parts[node] = []

    def _judge(self) -> tuple[list[bool], list[bool], int]:
        """(dropped by its kind, holds a root of the page's, rank of its roots): a page's main text stands in its articles, else in its main elements, else in boxes named so, else anywhere."""
        count = len(self.tag)
        out = [False] * count
        for n in range(1, count):  # within what is always dropped
            out[n] = out[self.parent[n]] or self.tag[n] in DROPPED or (self.marked[n] and self.root[n] > 0)
        best = max((self.root[n] for n in range(1, count) if not out[n] and self.chars[n]), default=0)
        holds = [False] * count
        for n in range(count - 1, 0, -1):
            holds[n] = holds[n] or (best > 0 and self.root[n] == best and not out[n])
            holds[self.parent[n]] = holds[self.parent[n]] or holds[n]
        return out, holds, best

    def shape(self) -> tuple[list[bool], list[bool], list[bool]]:
        """(not of the main text by its kind, within the main text, can be a template) of each node."""
        out, holds, best = self._judge()
        count = len(self.tag)
        inside, template = [best == 0] * count, [False] * count
        for n in range(1, count):
            above = self.parent[n]
            within = best > 0 and inside[above]
            inside[n] = inside[above] or (best > 0 and self.root[n] == best and not out[n])
            dropped = self.tag[n] == "form" or self.marked[n] or (self.tag[n] == "header" and not within)
            out[n] = out[n] or out[above] or (dropped and not holds[n])
            if self.chars[n] and self.tag[n] not in ("html", "body") and not holds[n]:
                template[n] = not within or (self.tag[n] in LISTS and self.linked[n] >= LINKED * self.chars[n])
        return out, inside, template

    def subtrees(self) -> list[int]:
        """Digests of the subtrees that can be templates, each once."""
        return sorted({self.digest[n] for n, can in enumerate(self.shape()[2]) if can})

    def text(self, templates: frozenset[int] | set[int] = frozenset()) -> str:
        out, inside, template = self.shape()
        for n in range(1, len(out)):
            out[n] = out[n] or out[self.parent[n]] or (template[n] and self.digest[n] in templates)
        found, last, held = [], None, []
        for block, node, text in [*self.pieces, (-1, 0, "")]:
            if block != last:
                if held and (words := "".join(held).split()):
                    found.append(" ".join(words))
                last, held = block, []
            if block >= 0 and inside[node] and not out[node]:
                held.append(text)
        return "\n\n".join(found)


def _signed(digests: list[int]) -> np.ndarray:
    return np.array(digests, np.uint64).view(np.int64)


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, templates): the digests of element subtrees that recur on at least ``least_pages`` and ``least_share`` of the distinct pages of a host.

    pages(host, html). Pages with the same tree are one. A host has at most 1 / least_share times the subtrees of its average page.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column("host")
            for start, texts in text_slices(batch, "html"):
                read = [Page(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [hosts.slice(start, len(texts)), pa.array(_signed([p.digest[0] for p in read])), pa.array([_signed(p.subtrees()) for p in read], pa.list_(pa.int64()))], names=["host", "page", "subtrees"]
                )

    seen = pages.select("host", "html").mapInArrow(digests, "host string, page long, subtrees array<long>").dropDuplicates(["host", "page"])
    met = seen.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    sizes = seen.groupBy("host").agg(F.count("*").alias("pages"))
    return met.join(sizes, "host").where(F.col("n") >= least_share * F.col("pages")).groupBy("host").agg(F.collect_list("subtree").alias("templates"))


def extract_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html).

    text is the article: what stands in article elements, else in main ones, else in boxes whose names say so (post-content and the like), else on the page. Elements that are never
    part of it are left out (scripts, styles, menus, footers, asides, forms, headers of the page), those whose class, id or role marks them (adverts, notices, sidebars, comments, ...), hidden ones,
    and templates: each element subtree is hashed by its tags and text, Spark counts the distinct pages of a host that have it, and subtrees that recur on many are deleted. Within an
    article only lists and boxes of links can be templates, so that a passage that many articles share, or copies of an article, stay. The nearer element of an article decides: a
    marked box around it does not delete it.

    Character references are decoded once, white space (Unicode's) within a block becomes one space, blocks are trimmed and joined by two line ends; a block without text is none. Cells of a
    table's row are parted by a space. Broken markup is read as browsers do where it matters: open paragraphs, items and cells end at the next, a menu left open ends
    at the article, stray ends do not leave an article, an open comment or script goes to the end of the page.

    Null and empty html have empty text. Pages of any length are read whole. A null url, or one without ``://``, has the empty host, whose pages are a site like any other. Repeated rows
    each give a row and count as one page; other columns play no part; an empty table gives no rows. The templates are written as a file, so that the planner broadcasts them only where
    they are small, and else joins by host, with skewed hosts split.
    """
    hosted = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), "html")
    path = new_folder(pages.sparkSession, "templates")
    site_templates(hosted, least_pages, least_share).write.parquet(path)
    joined = hosted.join(pages.sparkSession.read.parquet(path), "host", "left").select("page_id", "url", "host", "html", "templates")
    kind = pages.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, templates = None, frozenset()
        for batch in batches:
            hosts, lists = batch.column("host").to_pylist(), batch.column("templates")
            for start, texts in text_slices(batch, "html"):
                made = []
                for i, html in enumerate(texts, start):
                    if hosts[i] != last:
                        last, templates = hosts[i], frozenset(x % 2**64 for x in lists[i].as_py() or ())
                    made.append(Page(html).text(templates))
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(start, len(made)), batch.column("url").slice(start, len(made)), pa.array(made), pa.array([len(t) for t in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
