"""Main-text extraction by consensus container paths of each host.

First pass: each page is parsed and its containers are scored by the text they hold that
is no link and lies in no menu, form, advert or the like; the page votes for the
generalised tag-class path of the smallest container that holds nearly all of it. Votes
are counted by (host, path) in Spark, with map-side sums, so a hot host is no large group;
each host keeps the paths with at least a ``LEAST_SHARE`` of its votes. Second pass: each page takes the text of the
first of its host's winning paths that it has, or of its own best container if it has
none. A path is a 64-bit chain hash of tags and classes without digits.

Winning paths go back to the pages by a broadcast if their counted number is small, else
by a join on the host, which adaptive execution splits where a host is hot.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import as_batches, materialise

#: Share of a host's votes that a path needs: a hundred paths can have it.
LEAST_SHARE = 0.01
#: Share of the page's main text that a container must hold to be preferred over one around it.
ENOUGH = 0.9
#: Most (host, path) rows that are broadcast.
BROADCAST_PATHS = 100_000

# The HTML standard's block elements, void elements and elements of raw text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose text is never part of an article.
JUNK_TAGS = frozenset("aside button canvas datalist dialog footer form head header iframe input label map math menu nav noscript object option script search select style svg template textarea title".split())
#: Words of class, id and role that mark the same, where a name consists of them and of neutral words alone.
JUNK_WORDS = frozenset(
    "ad ads adbox adsense adslot adunit advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment commentary commentlist comments consent contentinfo cookie cookies copyright discussion disqus dropdown footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion recommended register related replies reply respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar tracking widget widgets".split()
)
#: Words that say where or what kind of box something is, not what it is about.
NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box btn close col cols column columns container content end entry fixed float grid group holder icon inner item items js left link links list main mobile module outer page panel post primary right row secondary section site slot small start sticky strip sub text the top unit wrap wrapper zone article story".split()
)
#: Of the junk words, those of a heading area, whose headings belong to an article that it lies in.
HEADER_WORDS = frozenset(("header", "masthead"))
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
#: Of the junk words, those of readers' comments.
COMMENT_WORDS = frozenset("comment commentary commentlist comments discussion disqus replies reply respond".split())
#: Inline elements that hold whatever stands in them, blocks too, even within a paragraph.
HOLDERS = frozenset("button canvas map math noscript object select svg template".split())
#: A form, or an element of a junk word, that holds this share of a page's text is the page, and not a part of it.
WHOLE_PAGE = 0.5

_TOKEN = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$))[^>\"']*)*)(?:>|$))", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


#: No junk, junk, a heading area, junk by its words or as a form, and readers' comments.
_NONE, _JUNK, _HEADER, _SOFT, _COMMENTS = range(5)


def _is_junk(tag: str, attrs: dict[str, str]) -> int:
    """Whether an element's text is no part of an article, and why."""
    if tag in JUNK_TAGS:
        return _HEADER if tag == "header" else _SOFT if tag == "form" else _JUNK
    if not attrs or tag in ("html", "body", "main", "article"):
        return _NONE
    found: set[str] = set()
    for name in ("class", "id", "role"):
        for value in attrs.get(name, "").split():
            if value.lower() in JUNK_WORDS:
                found.add(value.lower())
                continue
            words = {w.lower() for w in _WORD.findall(value)}
            junk = words & JUNK_WORDS
            # One word of another kind, as in "search-engine-guide", and the name is about something.
            if junk and words - junk <= NEUTRAL_WORDS:
                found |= junk
    return _NONE if not found else _HEADER if found <= HEADER_WORDS else _COMMENTS if found & COMMENT_WORDS else _SOFT


class Page:
    """Elements in document order, and blocks of text with the element that holds each."""

    def __init__(self, html: str | None):
        self.parent: list[int] = [-1]
        self.path: list[int] = [0]
        self.tag: list[str] = ["#"]
        self.kind: list[int] = [_NONE]
        self.bonus: list[bool] = [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._read(html or "")
        self.junk = self._judge()
        if kept := self._rescued():
            for e in kept:
                self.kind[e] = _NONE
            self.junk = self._judge()

    def _judge(self) -> list[int]:
        """Of each element 0 if its text counts, 1 if it is junk, 2 if it lies in a heading area."""
        junk, main = [0] * len(self.kind), [False] * len(self.kind)
        for e in range(1, len(self.kind)):
            up, kind = self.parent[e], self.kind[e]
            own = 2 if kind == _HEADER else 1 if kind else 0
            if junk[up] == 2 and own != 1:  # of a heading area, an article's own headings
                own = 0 if self.tag[e] in HEADINGS and main[up] else 2
            junk[e] = 1 if junk[up] == 1 else own
            main[e] = main[up] or self.bonus[e]
        return junk

    def _mass(self, counts) -> list[float]:
        """Characters outside links below each element, of the blocks whose element counts."""
        mass = [0.0] * len(self.parent)
        for e, t, linked in self.blocks:
            if counts(e):
                mass[e] += max(0.0, len(t) - 2.0 * linked)
        for e in range(len(mass) - 1, 0, -1):
            mass[self.parent[e]] += mass[e]
        return mass

    def _rescued(self) -> list[int]:
        """Forms and elements of a junk word that hold the page's article and are no junk therefore."""
        soft = [e for e, k in enumerate(self.kind) if k == _SOFT]
        if not soft:
            return []
        hard = [False] * len(self.kind)  # within junk of any other kind
        for e in range(1, len(hard)):
            hard[e] = hard[self.parent[e]] or self.kind[e] in (_JUNK, _COMMENTS) or self.kind[e] == _HEADER and self.tag[e] == "header"
        left, whole = self._mass(lambda e: not self.junk[e]), self._mass(lambda e: not hard[e])
        if any(self.tag[e] in ("article", "main") and not self.junk[e] for e in range(len(hard))):
            return []
        held = [e for e in range(len(hard)) if not hard[e] and 4 * left[0] < whole[e]]  # far more than all that is no junk
        inner = [e for e in held if self.tag[e] in ("article", "main")]
        goals = [max(inner, key=lambda e: (whole[e], -e))] if inner else []
        goals += [e for e in soft if not hard[e] and whole[e] > 0 and whole[e] >= WHOLE_PAGE * whole[0]]
        out = set()
        for e in goals:
            while e > 0:
                if self.kind[e] == _SOFT:
                    out.add(e)
                e = self.parent[e]
        return sorted(out)

    def _read(self, s: str) -> None:
        stack, tags, opened = [0], ["#"], Counter({"#": 1})
        held: list[str] = []
        linked, in_link = 0, False
        sub = 0  # open inline junk, such as a span of class "ad"
        inline: list[tuple[str, int]] = []
        within: Counter[str] = Counter()  # open inline elements by tag

        def flush():
            nonlocal held, linked
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self.blocks.append((stack[-1], text, linked))
                held, linked = [], 0

        def text(x: str):
            nonlocal linked
            if x and not sub:
                x = _html.unescape(x) if "&" in x else x  # here, as a reference does not go across tags
                held.append(x)
                if in_link:
                    linked += len(x)

        def pop_to(i: int):
            while len(stack) > i:
                stack.pop()
                opened[tags.pop()] -= 1

        def pop(tag: str):
            """Close the innermost open element of that tag and all in it."""
            i = len(tags) - 1
            while tags[i] != tag:
                i -= 1
            pop_to(i)

        def push(tag: str, path: int, kind: int, bonus: bool):
            self.parent.append(stack[-1])
            self.path.append(path)
            self.tag.append(tag)
            self.kind.append(kind)
            self.bonus.append(bonus)
            stack.append(len(self.parent) - 1)
            tags.append(tag)
            opened[tag] += 1

        at = 0
        while True:
            lt = s.find("<", at)
            if lt < 0:
                text(s[at:])
                break
            text(s[at:lt])
            m = _TOKEN.match(s, lt)
            if not m:  # a bare "<" is text
                text("<")
                at = lt + 1
                continue
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag in BLOCKS:
                    flush()
                    if opened[tag] > 0:
                        inline, within, sub, in_link = [], Counter(), 0, False
                        pop(tag)
                elif opened[tag] > 0 and not within[tag]:  # inline junk that blocks lie in
                    flush()
                    inline, within, sub, in_link = [], Counter(), 0, False
                    pop(tag)
                    continue
                elif tag == "a":
                    in_link = False
                elif tag == "br":
                    text(" ")
                if within[tag] > 0:
                    while True:
                        t, j = inline.pop()
                        within[t] -= 1
                        sub -= j > 0
                        if t == tag:
                            break
                continue
            if tag in _RAW_END:
                end = _RAW_END[tag].search(s, at)
                at = end.end() if end else len(s)
                continue
            attrs = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(m[3])} if "=" in m[3] else {}
            if tag not in BLOCKS:
                if tag == "a":
                    in_link = True
                if tag == "br":
                    text(" ")
                elif tag not in VOID and not m[3].rstrip().endswith("/"):
                    j = _is_junk(tag, attrs)
                    inline.append((tag, j))
                    within[tag] += 1
                    sub += j > 0
                continue
            flush()
            around = [x for x in inline if x[1]] if sub else []
            inline, within, sub, in_link = [], Counter(), 0, False
            if opened["p"] > 0 and not any(t in HOLDERS for t, _ in around):
                # A paragraph ends where a block begins, and all that is open in it, unless something between holds the block.
                i = len(tags) - 1
                while tags[i] != "p" and tags[i] not in HOLDERS:
                    i -= 1
                if tags[i] == "p":
                    pop_to(i)
                    around = []
            for t, kind in around:
                push(t, xxhash.xxh64_intdigest(f"{self.path[stack[-1]]:x}>{t}") >> 1, kind, False)
            closes = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}.get(tag)
            if closes and any(opened[t] > 0 for t in closes[0]):
                for i in range(len(tags) - 1, 0, -1):
                    if tags[i] in closes[0]:
                        pop_to(i)
                        break
                    if tags[i] in closes[1]:
                        break
            if tag == "hr":
                continue
            names = sorted({_DIGITS.sub("#", c.lower()) for c in attrs.get("class", "").split()})
            words = {w.lower() for k in ("class", "id", "role", "itemprop") for w in _WORD.findall(attrs.get(k, ""))} if attrs else set()
            bonus = tag in ("article", "main") or tag not in ("html", "body") and bool(words & MAIN_WORDS)
            push(tag, xxhash.xxh64_intdigest(f"{self.path[stack[-1]]:x}>{tag}.{'.'.join(names)}") >> 1, _is_junk(tag, attrs), bonus)
        flush()

    def best(self) -> tuple[int, float] | None:
        """(element, score) of the container that holds the main text, or None if there is none."""
        mass = self._mass(lambda e: not self.junk[e])
        if mass[0] <= 0:
            return None
        at = 0
        named = [e for e in range(1, len(mass)) if self.bonus[e] and not self.junk[e] and mass[e] >= 0.5 * mass[0]]
        children: dict[int, int] = {}
        for e in range(1, len(mass)):
            p = self.parent[e]
            if p not in children or mass[e] > mass[children[p]]:
                children[p] = e
        leaf = {e for e, _, _ in self.blocks}
        while (c := children.get(at)) is not None and mass[c] >= ENOUGH * mass[0] and not (c in leaf and c not in children and not self.bonus[c]):
            at = c
        if named and not self.bonus[at]:
            at = max(named, key=lambda e: (mass[e], -e))
        return at, mass[at]

    def text_of(self, path: int | None = None, element: int | None = None) -> str | None:
        """Blocks below all elements of a path, or below one element; None if the page has no such path."""
        inside = [False] * len(self.parent)
        found = False
        for e in range(len(inside)):
            own = self.path[e] == path if element is None else e == element
            found |= own
            inside[e] = own or e > 0 and inside[self.parent[e]]
        return "\n".join(t for e, t, _ in self.blocks if inside[e] and not self.junk[e]) if found else None


def host_of(url):
    """The URL's host in lower case; empty if null or without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1)):
                p = Page(page.as_py())
                if top := p.best():
                    yield host, p.path[top[0]], top[1]

    return as_batches(pa.schema([("host", pa.string()), ("path", pa.int64()), ("score", pa.float64())]), rows())


def vote(pages: DataFrame, url: str = "url", html: str = "html", least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, paths): each host's winning paths, most votes first, then most text, then the smaller hash."""
    src = pages.select(host_of(F.col(url)).alias("host"), F.col(html).cast("string").alias("html"))
    counted = materialise(src.mapInArrow(_votes, "host string, path long, score double").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score")), "votes")
    total = counted.groupBy(F.col("host").alias("of")).agg(F.sum("votes").alias("total"))
    won = counted.join(total, F.col("host") == F.col("of")).where(F.col("votes") >= F.col("total") * least_share)
    return won.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("votes"), -F.col("score"), "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_paths: int = BROADCAST_PATHS) -> DataFrame:
    """(page_id, url, text, n_chars) of each page.

    Null or empty html, and pages without main text, give the empty text and 0. Pages with
    a null url, or one without a host, vote together. Malformed markup is read as far as it
    goes; text without any tag is main text. A very long page is parsed whole, one page at a time
    in a task. Repeated rows vote and are returned each; an empty table gives an empty
    result. Other columns do not matter, whatever their names.
    """
    winners = materialise(vote(pages, url, html), "paths")
    right = winners.withColumnRenamed("host", "w_host")
    if winners.limit(broadcast_paths + 1).count() <= broadcast_paths:
        right = F.broadcast(right)
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    joined = src.join(right, F.col("host") == F.col("w_host"), "left").select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for page, paths in zip(b.column(2), b.column(3).to_pylist()):
                p = Page(page.as_py())
                out = next((t for w in paths or () if (t := p.text_of(path=w))), None)
                if out is None and (top := p.best()):
                    out = p.text_of(element=top[0])
                texts.append(out or "")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, src.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))
