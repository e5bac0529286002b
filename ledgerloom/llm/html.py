"""HTML extraction with a site style tree.

The pages of a host are merged by style: elements with the same chain of tags and classes are one
node. A node's content importance is one less the mean entropy of its texts over pages, and its
presentation importance is the entropy of the child sequences seen there; the larger of the two,
times the share of its text that is in no link, is its importance. A node holds the text that is
directly in it. Outside article and main, the text of nodes of low importance is removed and that of
others stays; so a branch goes exactly when all of its nodes do, and menus go as lists of links.
Hosts with few pages are merged with each other, where the texts of a template repeat. Nodes outside
without such figures follow the page: if article and main elements hold at least half of the words
in no link, they are the main content, and else all of it stays.

By rule alone go tags and names that declare noise (nav, footer, advert, comments), inside the main
content too: their texts often differ from page to page, so importance would keep some of them.
Nothing else is removed inside article and main, however often it repeats.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A node is removed below this importance, if so many different pages of its host have it.
LEAST_IMPORTANCE, LEAST_PAGES = 0.5, 8
#: Stands for all hosts with fewer pages than that; no host has such a name.
FEW = "(few pages)"
#: Lists of removed nodes are broadcast up to so many nodes in all (8 bytes each).
BROADCAST_NODES = 1_000_000

_SPLIT = lambda s: frozenset(s.split())
VOID = _SPLIT("area base br col embed hr img input link meta param source track wbr")
RAW = _SPLIT("script style textarea title")
#: Dropped only if they are closed by an end tag of their own; those of the second group hold what
#: stands in for something else, and are dropped only outside the main content.
EMBEDDED, FALLBACK = _SPLIT("template iframe svg select canvas audio video"), _SPLIT("noscript object")
DROPPED = _SPLIT("head nav footer aside form button menu dialog")
MAIN = _SPLIT("article main")
INLINE = _SPLIT("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr")
#: Closed by the start of one of the same group.
IMPLIED = {"li": _SPLIT("li"), "dt": _SPLIT("dt dd"), "dd": _SPLIT("dt dd"), "tr": _SPLIT("tr td th"), "td": _SPLIT("td th"), "th": _SPLIT("td th"), "option": _SPLIT("option")}
#: Words of class, id or role that say an element is not content.
NOISE_WORDS = _SPLIT(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs
    footer sidebar aside notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login
    comment comments commentlist disqus respond reply replies pagination pager search form"""
)
#: Such only outside the main content: an article has a header, a copyright, notes of its own.
OUTER_WORDS = _SPLIT(
    """header masthead topbar contentinfo complementary widget share sharing social related recommended skip copyright disclaimer toolbar"""
)
#: Words that may stand beside those in a class name of several words.
NEUTRAL_WORDS = _SPLIT("area bar block bottom box button buttons container content global icon icons inner item items left link links list outer page right section site slot top unit wrap wrapper")
#: Readers' words, which stay out even if each is an article; a name that ends in one says so,
#: whatever is before it, unless it tells of a state.
READER_WORDS = _SPLIT("comment comments commentlist disqus respond reply replies")
STATE_WORDS = _SPLIT("with without has have no hide hidden show allow open closed enable disable count")
#: Never the main content, even if they hold an article.
STRONG = _SPLIT("nav footer aside")
#: Never dropped by their class, id or role.
SPARED = _SPLIT("html body article main")

# Attributes as HTML reads them: a quote inside a name or an unquoted value is a character like others.
_ATTR = r"""(?>[^\s/>=][^\s/>=]*|=[^\s/>=]*)(?>\s*=\s*(?:"[^"]*"|'[^']*'|(?!["'])[^\s>]+)?)?"""
_ATTRS = rf"(?>[\s/]+|{_ATTR})*+"
_TOKEN = re.compile(
    rf"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<raw>{"|".join(sorted(RAW))})(?=[\s/>]){_ATTRS}(?:(?<=/)>|>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z))"""
    rf"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{_ATTRS})>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|((?!["'])[^\s>]+))?)?""")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@lru_cache(50_000)
def _path(above: int, tag: str, style: str) -> int:
    return _hash(f"{above}/{tag}.{style}")


def _noise(token: str, names: frozenset) -> bool:
    """Whether a class token says names and nothing else but where or how much of it."""
    parts = set(re.findall(r"[a-z]+", token))
    return bool(parts & names) and parts <= names | NEUTRAL_WORDS


def _readers(token: str) -> bool:
    """Whether a class token says readers' comments."""
    parts = re.findall(r"[a-z]+", token)
    return _noise(token, READER_WORDS) or bool(parts) and parts[-1] in READER_WORDS and not STATE_WORDS & set(parts)


@dataclass(frozen=True)
class _Style:
    """What attributes say: the style (class and role without digits), noise anywhere, noise outside
    the main content, readers' comments, the role main, and hidden."""

    style: str = ""
    noise: bool = False
    outer: bool = False
    readers: bool = False
    main: bool = False
    hidden: bool = False


@lru_cache(50_000)
def _style(attrs: str) -> _Style:
    found: dict[str, str] = {}
    for name, *values in _NAMED.findall(attrs):
        found.setdefault(name.lower(), unescape("".join(values)))
    values = {n: found.get(n, "").lower() for n in ("class", "id", "role")}
    tokens = {t for v in values.values() for t in v.split()}
    noise, outer = (any(_noise(t, names) for t in tokens) for names in (NOISE_WORDS, OUTER_WORDS))
    readers = any(map(_readers, tokens))
    style = " ".join(re.sub(r"\d+", "0", values[n]) for n in ("class", "role") if values[n])
    return _Style(style, noise or readers, outer, readers, "main" in values["role"].split(), "hidden" in found)


_PLAIN = _Style()


class _Open(NamedTuple):
    """An open element. lost: hidden, or in such; inside: in the main content; around: the numbers of
    the elements around its text that may be dropped; number: its own, or 0; link: in an `a`."""

    tag: str = ""
    lost: bool = False
    inside: bool = False
    node: int = 0
    around: tuple = ()
    number: int = 0
    link: bool = False


class Page:
    """The text blocks of a page: (node, in main, text), in order.

    Declared noise is left out, and outside article and main the own texts of `removed` nodes. What
    is in none of these and not in `kept` nodes stays if it has more words in no link than they;
    `whole` keeps all of it. Noise that holds an article or main, as a form around a page does,
    is none if that has more text than all the rest, unless it is a nav, footer, aside or comments;
    and where nothing else is left, a form is none either.
    shapes: the child tags of each node. linked: the words in links of each block.
    """

    def __init__(self, html: str, removed: frozenset = frozenset(), kept: frozenset = frozenset(), whole: bool = False):
        self.shapes: dict[int, list[str]] = {}
        everything: list[tuple[int, bool, str, tuple, int]] = []
        stack = [_Open()]
        dropped: set[int] = set()
        around_main: set[int] = set()
        strong: set[int] = set()
        forms: set[int] = set()
        is_open: Counter[str] = Counter()
        held: list[str] = []
        linked, owner, drops, seen = 0, stack[0], (), 0

        def flush():
            nonlocal linked
            if held:
                if text := " ".join(unescape("".join(held)).split()):
                    everything.append((owner.node, owner.inside, text, drops, min(linked, text.count(" ") + 1)))
                held.clear()
            linked = 0

        def hold(text: str):
            nonlocal owner, drops, linked
            if held and stack[-1].around != drops:
                flush()
            if not held:
                owner, drops = next(x for x in reversed(stack) if x.tag not in INLINE), stack[-1].around
            held.append(text)
            if stack[-1].link:
                linked += len(unescape(text).split())

        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at and not stack[-1].lost:
                hold(html[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["raw"] is not None and m["raw"].lower() == "title":
                    flush()
                continue
            tag = tag.lower()
            inline = tag in INLINE
            if not inline:
                flush()
            if m["end"]:
                k = len(stack) - 1 if is_open[tag] > 0 else 0
                while k and stack[k].tag != tag:
                    k -= 1
                if k:
                    if stack[k].number and tag in EMBEDDED | FALLBACK:
                        dropped.add(stack[k].number)
                    is_open.subtract(x.tag for x in stack[k:])
                    del stack[k:]
                continue
            if not inline:
                self._imply(stack, tag, is_open)
            if tag in VOID or tag in EMBEDDED | FALLBACK and m["attrs"].endswith("/"):
                continue
            above = stack[-1]
            style = _style(m["attrs"]) if m["attrs"].strip() else _PLAIN
            node = above.node if inline else _path(above.node, tag, style.style)
            starts = not above.inside and (tag in MAIN or style.main and tag == "div")
            if starts:
                around_main.update(above.around)
            named = style.noise or not above.inside and style.outer
            declared = tag in DROPPED or not above.inside and tag == "header"
            declared = declared or named and not starts and (tag not in SPARED or above.inside)
            embedded = tag in EMBEDDED or tag in FALLBACK and not above.inside
            around, number = above.around, 0
            if declared or embedded:
                seen = number = seen + 1
                around = (*around, number)
                if declared:
                    dropped.add(number)
                if tag in STRONG or style.readers:
                    strong.add(number)
                if tag == "form":
                    forms.add(number)
            lost = above.lost or tag == "head" or style.hidden
            if not (lost or around or inline):
                shape = self.shapes.setdefault(above.node, [])
                if not shape or shape[-1] != tag:
                    shape.append(tag)
            stack.append(_Open(tag, lost, above.inside or starts, node, around, number, above.link or tag == "a"))
            is_open[tag] += 1
        if at < len(html) and not stack[-1].lost:
            hold(html[at:])
        flush()

        def left(dropped: set) -> list[tuple]:
            return [x for x in everything if dropped.isdisjoint(x[3])]

        def size(blocks) -> int:
            return sum(text.count(" ") + 1 - links for *_, text, _, links in blocks)

        blocks = left(dropped)
        held_main = [x for x in left(dropped - (around_main - strong)) if x[1] and not dropped.isdisjoint(x[3])]
        if size(held_main) > size(blocks):
            dropped -= around_main - strong
            blocks = left(dropped)
        if not blocks:
            blocks = left(dropped - forms)
        blocks = [x for x in blocks if x[1] or x[0] not in removed]
        inner, outer = (size(x for x in blocks if x[1] == side and (side or x[0] not in kept)) for side in (True, False))
        if not whole and inner >= outer:
            blocks = [x for x in blocks if x[1] or not inner or x[0] in kept]
        self.blocks: list[tuple[int, bool, str]] = [x[:3] for x in blocks]
        self.linked = [x[4] for x in blocks]

    def identity(self) -> int:
        """Equal for pages with the same main content, or all content where none is declared."""
        main = any(inside for _, inside, _ in self.blocks)
        return _hash("\n".join(text for _, inside, text in self.blocks if inside or not main))

    @staticmethod
    def _imply(stack: list, tag: str, is_open: Counter) -> None:
        """Close what the start of a block element ends: an open paragraph, or a like item."""
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k].tag
            if name == "p" and tag not in VOID or name in IMPLIED.get(tag, ()):
                is_open.subtract(x.tag for x in stack[k:])
                del stack[k:]
                return
            if name not in INLINE and name != "p":
                return

    def text(self) -> str:
        return " ".join(text for *_, text in self.blocks)


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


_NODES = "host string, page bigint, node bigint, main boolean, content bigint, shape bigint, words bigint, linked bigint"


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, page, node, main, content, shape, words, linked): the hashed text and child sequence of
    each node that holds text, for each page, whether the node is in an article or main element, and
    its words, in all and in links.

    page is the page's identity: copies of a page's content are one page, whatever is around it.
    """
    source = pages.select(_host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    names = [c.split()[0] for c in _NODES.split(", ")]

    def parse(batches):
        for batch in batches:
            out = [[] for _ in names]
            for host, html in zip(*(batch.column(c).to_pylist() for c in ("host", "html")), strict=True):
                found = Page(html, whole=True)
                texts: dict[tuple[int, bool], list[tuple[str, int]]] = {}
                for (node, main, text), linked in zip(found.blocks, found.linked, strict=True):
                    texts.setdefault((node, main), []).append((text, linked))
                page = found.identity() if texts else 0
                for (node, main), parts in texts.items():
                    shape, whole = _hash(" ".join(found.shapes.get(node, ()))), "\n".join(t for t, _ in parts)
                    row = (host, page, node, main, _hash(whole), shape, sum(t.count(" ") + 1 for t, _ in parts), sum(k for _, k in parts))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, out, kinds)), names=names)

    return source.mapInArrow(parse, _NODES)


def importance(nodes: DataFrame) -> DataFrame:
    """(host, node, main, pages, content, presentation, links) of stored rows of style_nodes;
    importances are from 0 to 1, and so is links, the share of the text that is in links. Of pages
    with one identity, one counts."""
    key = ["host", "node", "main"]
    least = (F.min(c).alias(c) for c in ("content", "shape", "words", "linked"))
    nodes = nodes.groupBy(*key, "page").agg(*least)

    def spread(column: str, name: str, *more: Column) -> DataFrame:
        """pages m, and sum of n log n over the values' page counts n: the entropy is log m less its m-th."""
        seen = nodes.groupBy(*key, column).agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.sum("linked").alias("linked"))
        return seen.groupBy(*key).agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias(name), *more)

    links = (F.sum("linked") / F.sum("words")).alias("links")
    both = spread("content", "_c", links).join(spread("shape", "_s").drop("pages"), key)
    share = lambda c: F.when(F.col("pages") > 1, F.col(c) / F.col("pages") / F.log("pages")).otherwise(F.lit(0.0))
    # A text on n of m pages has entropy log n / log m, so both measures are 1 less a mean of log n / log m.
    return both.select(*key, "pages", (1 - share("_c")).alias("content"), (1 - share("_s")).alias("presentation"), "links")


def judged_nodes(pages: DataFrame, least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, removed, kept): the nodes outside article and main of each host, on enough pages, whose
    importance is low, and those whose is not. The row of FEW is for hosts that have none."""
    nodes = common.stored(style_nodes(pages).distinct())
    own = nodes.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("_n"))
    few = own.filter(F.col("_n") < least_pages).select("host")
    merged = nodes.join(few, "host", "left_semi").withColumn("host", F.lit(FEW)).distinct()
    large = nodes.join(few, "host", "left_anti")
    judged = importance(large.unionByName(merged)).filter((F.col("pages") >= least_pages) & ~F.col("main"))
    low = F.greatest("content", "presentation") * (1 - F.col("links")) < least
    # Of different hosts, texts of one place differ even if they are no content: FEW keeps nothing.
    kept = F.when(~low & (F.col("host") != FEW), F.col("node"))
    return judged.groupBy("host").agg(F.collect_list(F.when(low, F.col("node"))).alias("removed"), F.collect_list(kept).alias("kept"))


def extract(pages: DataFrame, least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    Null html, and pages without content, give an empty text. Pages without a host, or with a null
    url, are merged as one host. Copies of a page's content count once in their host's tree, so they
    do not turn into noise. Repeated rows and page_ids are extracted each by itself. Other columns of
    pages are ignored; an empty table gives an empty result.
    """
    judged = common.stored(judged_nodes(pages, least, least_pages))
    held = judged.agg(F.coalesce(F.sum(F.size("removed") + F.size("kept")), F.lit(0))).first()[0]
    own = pages.select("page_id", "url", "html", _host().alias("host"))
    if held <= BROADCAST_NODES:
        judged = F.broadcast(judged)
    by_host = own.join(judged, "host", "left")
    other = judged.filter(F.col("host") == FEW).select(F.col("host").alias("_few"), F.col("removed").alias("_removed"))
    key = F.when(F.col("removed").isNull(), F.lit(FEW))
    joined = by_host.join(other, key == F.col("_few"), "left").select("page_id", "url", "html", F.coalesce("removed", "_removed").alias("removed"), "kept")
    page_type = joined.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("html", "removed", "kept"))
            texts = [Page(html or "", frozenset(removed or ()), frozenset(kept or ())).text() for html, removed, kept in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {page_type}, url string, text string, n_chars bigint")


def op6_extract_html(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
