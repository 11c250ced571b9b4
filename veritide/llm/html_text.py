"""Main text of web pages by consensus host paths.

1. Each page's containers are scored: a block's text counts for the element around it
   and half for the one around that; text in links counts against it. The best
   container votes for its generalised path, tags with classes from the body down, with
   digits made alike.
2. Spark counts the votes of each host and path; a host's winning path has most votes,
   then the highest score, then the first name.
3. Each page is extracted again from all elements on its host's winning path. A page
   without such an element, or with no text there, falls back on its own best one.

The scanner is a regular expression over tags, whose quotes are paired once for a page; elements are closed as HTML closes
them (paragraphs, list items and cells by their like, everything by its parent), so
broken and cut pages are read to their end. Paths are numbered step by step and written
out for a chosen container only, and open tags are known by their places on the stack,
so work grows with a page's size and not with its depth.

What isn't main text is known by tags and roles, and by classes and ids: a name all of
whose words are of that kind or say nothing (``comment-list``) counts by itself; one
that has further words (``related-work``) only if much of the element's text is in links
or it has hardly any text.

Defined results: null, empty and tag-less pages without text give the empty text; a
null or malformed URL counts as the host ""; pages with ids that repeat or are null
are extracted each; elements may be nested to any depth; a tag or comment that the
page's end cuts off is no text; columns other than page_id, url and html are left out,
whatever their names; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritide.scratch import written

#: Winning paths may be broadcast up to this many hosts (about 20 MB); beyond, they are joined by a shuffle.
HOSTS_BROADCAST = 200_000

TAG = re.compile(r"<(?:!--(?:.*?-->|.*)|(/?)([a-zA-Z][^\s/>]*+)|[!?/][^>]*(?:>|\Z))", re.S)  # a tag without its attributes
EVENT = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSED_BY_LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# What isn't main text, by tag, role and word of a class or id.
DROPPED = frozenset("nav footer aside form header script style noscript template svg canvas button select option textarea iframe object dialog menu head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion sidebar sidebars menu menus nav navbar navigation navi breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices banner popup modal overlay comment comments commentlist disqus reply replies respond share sharing social related recommended "
    "newsletter subscribe signup login footer header masthead toolbar pagination pager widget widgets skip".split()
)
#: Words of a class or id that say nothing about what an element holds.
NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons center col column container content div el form group head header holder icon icons inner item items layout left link links list main "
    "message module outer page panel right row section site slot small text title top unit wrap wrapper js is has with no the of and to in on for by global primary secondary desktop mobile".split()
)
#: An element whose name only hints at something else stays with so much text and so small a share of it in links.
TEXT_KEPT, LINKS_KEPT = 80, 0.3
KEPT_TAGS = frozenset(("html", "body", "main", "article"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Element:
    __slots__ = ("dropped", "hinted", "link", "links", "outer", "parent", "path", "score", "size", "tag")

    def __init__(self, tag: str, parent: Element | None, path: int, dropped: bool, link: bool, hinted: bool = False):
        self.tag, self.parent, self.path, self.dropped, self.link, self.hinted = tag, parent, path, dropped, link, hinted
        self.outer = parent.outer if parent is not None and tag in INLINE else self
        self.score, self.size, self.links = 0.0, 0, 0


NO, HINT, YES = 0, 1, 2


def boilerplate(tag: str, attributes: dict[str, str], strict: bool) -> int:
    """Whether an element isn't main text: by tag, role or name, or only by a hint in its name."""
    if tag in DROPPED:
        return YES
    if not attributes or not strict:
        return NO
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES:
        return YES
    found = NO
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = set(re.findall(r"[a-z]+", name))
        if words & WORDS and (tag not in KEPT_TAGS or words & {"comment", "comments", "reply", "ad", "ads", "sponsored"}):
            found = max(found, YES if words <= WORDS | NEUTRAL else HINT)
    return found


def attributes_of(raw: str) -> dict[str, str]:
    return {n.lower(): unescape(v.strip("\"'")) for n, v in ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t") else {}


def tag_end(html: str, at: int, quotes: dict[int, int]) -> int:
    """Behind the ``>`` that ends a tag and stands in no quotes; behind the first one if a quote on the way has no partner.

    ``quotes`` remembers what is found from each opening quote on (-1: no partner), so a
    page's quotes are paired once and not once for each tag.
    """
    begin, passed, end = at, [], -1
    while e := EVENT.search(html, at):
        q = e.start()
        if e[0] == ">":
            end = q + 1
            break
        if q in quotes:
            end = quotes[q]
            break
        passed.append(q)
        if (at := html.find(e[0], q + 1) + 1) == 0:
            break
    else:
        end = len(html)
    quotes.update(dict.fromkeys(passed, end))
    if end < 0:
        end = html.find(">", begin) + 1 or len(html)
    return end


def step_of(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted(re.sub(r"\d+", "0", c).replace(">", "") for c in attributes.get("class", "").lower().split())
    return ".".join((tag.replace(">", ""), *classes))


class Page:
    """A page's blocks in order and its elements that aren't inline, parents first."""

    def __init__(self, html: str, strict: bool = True):
        self.steps: list[tuple[int, str]] = [(-1, "")]  # of each path: the path before it and its last step
        self.numbers: dict[tuple[int, str], int] = {}
        self.made: list[Element] = []
        self.blocks: list[tuple[Element, str, int]] = []  # innermost element that isn't inline, text, letters in links
        self._read(html, strict)
        self._judge()

    def path(self, number: int) -> str:
        parts = []
        while number > 0:
            number, step = self.steps[number]
            parts.append(step)
        return "".join(f">{x}" for x in reversed(parts))

    def number(self, path: str) -> int:
        """Of a path as ``path`` writes it; -1 if no element is on it."""
        number = 0
        for step in path.split(">")[1:]:
            number = self.numbers.get((number, step), -1)
            if number < 0:
                break
        return number

    def _step(self, before: int, step: str) -> int:
        number = self.numbers.get((before, step))
        if number is None:
            number = self.numbers[before, step] = len(self.steps)
            self.steps.append((before, step))
        return number

    def _read(self, html: str, strict: bool) -> None:
        root = Element("html", None, 0, False, False)
        self.made.append(root)
        stack: list[Element] = [root]
        places: dict[str, list[int]] = {}  # of the open elements of each tag on the stack, the root left out
        text: list[str] = []
        at, pos, linked, block = 0, 0, 0, root

        def flush() -> None:
            nonlocal linked
            if text:
                if (joined := " ".join("".join(text).split())) and not block.dropped:
                    self.blocks.append((block, joined, linked))
                text.clear()
            linked = 0

        def add(raw: str) -> None:
            nonlocal linked
            t = unescape(raw) if "&" in raw else raw
            text.append(t)
            if stack[-1].link:
                linked += len(t)

        def cut(size: int) -> None:
            """Close all elements from this place of the stack on."""
            while len(stack) > size:
                places[stack.pop().tag].pop()

        def last(tags: tuple[str, ...]) -> int:
            return max((own[-1] for t in tags if (own := places.get(t))), default=0)

        quotes: dict[int, int] = {}
        while m := TAG.search(html, pos):
            if m.start() > at:
                add(html[at : m.start()])
            at = pos = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            at = pos = tag_end(html, m.end(), quotes)
            if pos == len(html) and html[-1] != ">":
                break
            if m[1]:
                if tag not in INLINE or block.tag == tag:
                    flush()
                if tag == "br":
                    text.append(" ")
                elif tag not in ("html", "body") and (size := last((tag,))):
                    cut(size)
                block = stack[-1].outer
                continue
            attributes = attributes_of(html[m.end() : pos - 1])
            if tag in VOID:
                if tag == "br":
                    text.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag == "html":
                continue
            if tag not in INLINE:
                flush()
                if size := last(("p",)):
                    cut(size)
                for like in CLOSED_BY_LIKE.get(tag, ()):
                    if (size := last((like,))) > last(SCOPES[tag]):
                        cut(size)
            parent = stack[-1]
            kind = boilerplate(tag, attributes, strict)
            if tag in INLINE:
                e = Element(tag, parent, parent.outer.path, parent.dropped or kind == YES, parent.link or tag == "a")
                if e.dropped and not parent.dropped:
                    flush()
            else:
                around = parent.outer
                e = Element(tag, around, self._step(around.path, step_of(tag, attributes)), parent.dropped or kind == YES, parent.link, kind == HINT)
                self.made.append(e)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
                at = pos = end.end() if end else len(html)
                continue
            places.setdefault(tag, []).append(len(stack))
            stack.append(e)
            if e.dropped and tag in INLINE or tag not in INLINE:
                block = e
        else:
            if at < len(html):
                add(html[at:])
        flush()

    def _judge(self) -> None:
        """Drop what only a name hints at, if its text agrees; then score containers by what is left."""
        if any(e.hinted for e in self.made):
            for e, joined, linked in self.blocks:
                e.size += len(joined)
                e.links += linked
            for e in reversed(self.made):  # children before parents
                if e.parent is not None:
                    e.parent.size += e.size
                    e.parent.links += e.links
            for e in self.made:
                hinted = e.hinted and not (e.size >= TEXT_KEPT and e.links <= LINKS_KEPT * e.size)
                e.dropped = e.dropped or hinted or (e.parent is not None and e.parent.dropped)
            self.blocks = [b for b in self.blocks if not b[0].dropped]
        for e, joined, linked in self.blocks:
            weight = len(joined) * (0.2 if e.tag in HEADINGS else 1.0) - 2 * linked
            own = e if e.parent is None or e.tag not in ("p", "pre", "blockquote", "li", "td", *HEADINGS) else e.parent
            own.score += weight
            if own.parent is not None:
                own.parent.score += weight / 2

    def best(self) -> Element | None:
        """The container with the highest score; articles and mains count half as much again."""
        if not self.blocks:
            return None
        bonus = {"article": 1.5, "main": 1.5}
        return max((e for e in self.made if not e.dropped), key=lambda e: e.score * bonus.get(e.tag, 1.0), default=None)

    def under(self, test) -> str:
        """The text of all blocks within elements that pass."""
        inside: set[int] = set()
        for e in self.made:
            if test(e) or (e.parent is not None and id(e.parent) in inside):
                inside.add(id(e))
        return " ".join(t for e, t, _ in self.blocks if id(e) in inside)


def parsed(html: str | None) -> Page:
    page = Page(html or "")
    if not page.blocks and html:  # a wrapper's class names something that isn't main text
        page = Page(html, strict=False)
    return page


def vote(html: str | None) -> tuple[str, float] | None:
    """A page's best path and its score."""
    page = parsed(html)
    top = page.best()
    return None if top is None else (page.path(top.path), top.score)


def main_text(html: str | None, path: str | None) -> str:
    """Text of all elements on ``path``; of the page's own best container if there is none."""
    page = parsed(html)
    text = ""
    if path is not None and (number := page.number(path)) >= 0:
        text = page.under(lambda e: e.path == number)
    if not text and (top := page.best()) is not None:
        text = page.under(lambda e: e is top)
    return text


def with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"), F.lower(host).alias("host"))


def host_paths(pages: DataFrame) -> DataFrame:
    """The winning path of each host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *v) for h, v in zip(batch.column(0).to_pylist(), (vote(x.as_py()) for x in batch.column(1))) if v]
            hosts, paths, scores = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], ["host", "path", "score"])

    votes = with_host(pages).select("host", "html").mapInArrow(run, "host string, path string, score double")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.round(F.sum("score")).alias("score"))
    first = F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), "path"))
    return counted.groupBy("host").agg(first.alias("first")).select("host", F.col("first.path").alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    paths = written(host_paths(pages), "host-paths")
    if paths.count() <= HOSTS_BROADCAST:
        paths = F.broadcast(paths)
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), p) for h, p in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return with_host(pages).join(paths, "host", "left").select(F.col("page_id").cast("long"), "url", "html", "path").mapInArrow(run, schema)
