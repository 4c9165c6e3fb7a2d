"""Main text of web pages by consensus of a host's pages.

Each page's containers are scored by the prose they hold; from the best one the page goes out to the outermost container
that adds prose or headings but few links, and votes for its generalised path of tags and classes. Spark sums the votes of a
host and keeps the winning path; every page is then read again by the path that won at its host, or by its own container
where the page has clearly less under that path (a host may have several templates).
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.texts import sliced
from vitalspan.session import settle

#: A comment, a tag or a declaration. A quote opens a value after an equals sign only.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>|<[!?][^>]*+>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
WORD = re.compile(r"[a-z0-9]+")

# Tags of each kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset(
    "head script style title noscript template iframe object canvas svg nav header footer aside form button select textarea "
    "dialog menu xmp noembed noframes".split())
CONTAINERS = frozenset("html body main article section div td".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr th caption figure figcaption address "
    "hr details summary center hgroup".split()) | DROPPED
KEPT = frozenset("html body main article".split())
# Words of classes, ids and roles of what is no main text
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb "
    "breadcrumbs header masthead footer comment comments disqus reply replies respond discussion related recommended "
    "recommendations share sharing social newsletter subscribe subscription signup login toolbar pagination pager skip "
    "contentinfo complementary search".split())
NOT_ASIDE = frozenset("no has with without not".split())
#: Opening one of these ends an open one of those.
ENDS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
        "option": {"option"}}
#: One of these around it keeps it open.
HOLDS = frozenset("ul ol table dl select".split())
WEIGHT = {"article": 4, "main": 3}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A step outwards may add one character of links to so many characters, and counts if it adds a heading or a block of so
#: many words.
LINK_SHARE = 2
PROSE_WORDS = 5
#: A page keeps its own container where that has so many times the prose under the host's path and other pages of the host
#: have the same one, or so many times where none has.
MORE_PROSE = 1.25
FAR_MORE_PROSE = 5


@dataclass(slots=True)
class Container:
    step: str  # tag and classes
    size: int  # characters of the path, which is the steps from the outermost container on
    parent: int
    tag: str
    in_main: bool  # it or one around it is a main element
    score: int = 0
    length: int = 0
    linked: int = 0
    prose: int = 0  # blocks that are prose or headings


@dataclass
class Page:
    """Parents come before their children in ``containers``; all methods take time in proportion to the page."""

    containers: list[Container] = field(default_factory=list)
    blocks: list[tuple[str, int, int, bool]] = field(default_factory=list)  # text, its container, characters of links, heading

    def add(self, step: str, parent: int, tag: str) -> int:
        around = self.containers[parent]
        self.containers.append(Container(step, around.size + len(step), parent, tag, around.in_main or tag == "main"))
        return len(self.containers) - 1

    def path(self, container: int) -> str:
        steps = []
        while container >= 0:
            steps.append(self.containers[container].step)
            container = self.containers[container].parent
        return "".join(reversed(steps))

    def best(self) -> int | None:
        """The container of most prose: a block counts for its container, and half as much a step further out."""
        for text, container, linked, _ in self.blocks:
            worth = 4 * max(0, len(text) - 2 * linked)
            while worth and container >= 0:
                c = self.containers[container]
                c.score += worth * WEIGHT.get(c.tag, 2) // 2
                worth, container = worth // 2, c.parent
        scored = [i for i, c in enumerate(self.containers) if c.score > 0]
        return max(scored, key=lambda i: (self.containers[i].score, -self.containers[i].size), default=None)

    def whole(self) -> int | None:
        """The outermost container around the best one to which each step adds prose or a heading and little link text."""
        best = self.best()
        if best is None:
            return None
        for text, container, linked, heading in self.blocks:
            c = self.containers[container]
            c.linked += linked
            c.length += len(text)
            c.prose += heading or len(text.split()) >= PROSE_WORDS and 2 * linked <= len(text)
        for c in reversed(self.containers):
            if c.parent >= 0:
                out = self.containers[c.parent]
                out.length, out.linked, out.prose = out.length + c.length, out.linked + c.linked, out.prose + c.prose
        kept = best
        inner = self.containers[best]
        while inner.parent >= 0 and inner.tag != "main":
            out = self.containers[inner.parent]
            if inner.tag == "article" and not out.in_main:
                break
            if LINK_SHARE * (out.linked - inner.linked) > out.length - inner.length:
                break
            if out.prose > inner.prose:
                kept = inner.parent
            inner = out
        return kept

    def under(self, path: str | None) -> list[tuple[str, int, int, bool]]:
        """The blocks in containers of that path or inside them."""
        if path is None:
            return []
        begins, inside = [], []  # whether the container's path begins ``path``, and whether it is it or inside one that is
        for c in self.containers:
            own = (c.parent < 0 or begins[c.parent]) and path.startswith(c.step, c.size - len(c.step))
            begins.append(own)
            inside.append(c.parent >= 0 and inside[c.parent] or own and c.size == len(path))
        return [b for b in self.blocks if inside[b[1]]]

    def prose(self, path: str | None) -> int:
        """Characters outside links of the blocks under the path."""
        return sum(len(text) - linked for text, _, linked, _ in self.under(path))

    def text(self, path: str | None) -> str:
        return "\n\n".join(text for text, *_ in self.under(path))


@dataclass(slots=True)
class Open:
    """An element that is open."""

    tag: str
    container: int
    dropped: bool
    link: bool  # it or one around it is a link, and so on
    heading: bool
    holders: int  # containers among it and those around it


class Stack:
    """Open elements, and where each tag is open, so that no search walks through them."""

    def __init__(self) -> None:
        self.elements: list[Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)

    def __len__(self) -> int:
        return len(self.elements)

    @property
    def last(self) -> Open:
        return self.elements[-1] if self.elements else OUTSIDE

    def push(self, tag: str, container: int, dropped: bool) -> None:
        around = self.last
        self.places[tag].append(len(self.elements))
        self.elements.append(Open(tag, container, dropped, around.link or tag == "a", around.heading or tag in HEADINGS,
                                  around.holders + (tag in CONTAINERS)))

    def place(self, *tags: str) -> int:
        """The innermost place where one of the tags is open; -1 if none is."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def pop(self, place: int) -> None:
        while len(self.elements) > place:
            self.places[self.elements.pop().tag].pop()

    def has_block(self, place: int) -> bool:
        return any(self.elements[i].tag in BLOCKS for i in range(place, len(self.elements)))


OUTSIDE = Open("", 0, False, False, False, 0)


def decoded(text: str) -> str:
    """Character references replaced; a number of any length is one, beyond the last code point if it is too large."""
    if "&#" in text:
        text = re.sub(r"&#[0-9]{8,}+", lambda m: f"&#{m[0][2:].lstrip('0')[:8] or '0'}", text)
    return references.unescape(text)


def _is_aside(tag: str, attributes: dict[str, str]) -> bool:
    if tag in DROPPED or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if tag in KEPT:
        return False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".split():
        words = WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
        if not ASIDE_WORDS.isdisjoint(words) and NOT_ASIDE.isdisjoint(words):
            return True
    return False


def read_page(source: str | None) -> Page:
    """Containers and text blocks of a page, without what is no main text. Never fails: unknown markup is passed over.

    The time is in proportion to the page, whatever it holds: the search ends behind the last sign that ends a tag, which
    no quote can hold there, so every opened tag has an end and is read once.
    """
    page, source = Page(), source or ""
    page.containers.append(Container("", 0, -1, "", False))
    stack = Stack()
    pieces: list[str] = []
    linked = at = 0
    last = source.rfind(">") + 1
    if "<!--" in source[last:]:
        last = len(source)  # an open comment goes on to the end

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(decoded("".join(pieces)).split())
            if text:
                page.blocks.append((text, stack.last.container, min(linked, len(text)), stack.last.heading))
            pieces.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text and not stack.last.dropped:
            pieces.append(text)
            if stack.last.link:
                linked += len(text)

    def pop(place: int) -> None:
        if stack.has_block(place):
            close_block()
        stack.pop(place)

    while m := TAG.search(source, at, last):
        take(source[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(source)
            continue
        tag, closing, rest = m[2].lower(), m[1], m[3]
        if closing:
            place = stack.place(tag)
            if place >= 0 and (tag in BLOCKS or stack.last.holders == stack.elements[place].holders):
                pop(place)
            elif place < 0 and tag in BLOCKS and not stack.last.dropped:
                close_block()
            continue
        if tag == "br":
            take(" ")
        if tag in BLOCKS:
            if not stack.last.dropped:
                close_block()
            if stack.last.tag == "p":
                pop(len(stack) - 1)
            if tag in ENDS and (place := stack.place(*ENDS[tag])) > stack.place(*HOLDS):
                pop(place)
        if tag in VOID:
            continue
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if rest else {}
        outside = stack.last.dropped
        dropped = outside or _is_aside(tag, attributes)
        if dropped and not outside and tag not in BLOCKS:
            take(" ")
        if rest.endswith("/") and tag in ("svg", "path", "use", "iframe"):
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[^>]*+>", re.IGNORECASE).search(source, at, last)
            at = end.end() if end else len(source)
            continue
        own = stack.last.container
        if tag in CONTAINERS and not dropped:
            classes = sorted({re.sub(r"\d+", "#", c) for c in attributes.get("class", "").split()})
            own = page.add(f"/{'.'.join([tag, *classes])}", own, tag)
        if tag in BLOCKS or dropped or tag == "a":
            stack.push(tag, own, dropped)
    take(source[at:])
    close_block()
    return page


def host_of(url: Column) -> Column:
    """The host of a URL in lower case without user, port and ``www.``; empty without one."""
    place = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(place, r"^.*@|:\d*$", ""), r"^www\.", "")


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of each slice of pages, summed by host and path."""
    for batch in sliced(batches, "_html"):
        votes: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
        for host, source in zip(batch.column("_host").to_pylist(), batch.column("_html").to_pylist(), strict=True):
            page = read_page(source)
            best = page.whole()
            if best is not None:
                cast = votes[host, page.path(best)]
                cast[0] += 1
                cast[1] += page.containers[best].score
        rows = [(*k, *v) for k, v in votes.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))],
            ["_host", "path", "votes", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "_html"):
        texts, paths = [], []
        for source, path, others in zip(*(batch.column(c).to_pylist() for c in ("_html", "_path", "_others")), strict=True):
            page = read_page(source)
            text = page.text(path)
            best = page.whole()
            own = None if best is None else page.path(best)
            more = MORE_PROSE if own in (others or ()) else FAR_MORE_PROSE
            if own is not None and (not text or page.prose(own) > more * page.prose(path)):
                path, text = own, page.text(own)
            texts.append(text)
            paths.append(path if text else None)
        rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("_html", "_path", "_others", "_host")]
        yield pa.RecordBatch.from_arrays(
            [c for _, c in rest] + [pa.array(texts, pa.string()), pa.array(paths, pa.string())], [n for n, _ in rest] + ["text", "path"])


def host_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """The winning path of each host: (host, host_path, others); most votes, then most prose, then the later path by name.

    ``others`` are the paths that more than one page voted for.
    """
    votes = pages.select(host_of(F.col(url)).alias("_host"), F.col(source).cast("string").alias("_html")).mapInArrow(
        _votes, "_host string, path string, votes bigint, score bigint")
    summed = votes.groupBy("_host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    return summed.groupBy(F.col("_host").alias("host")).agg(
        F.max(F.struct("votes", "score", "path")).alias("won"),
        F.collect_list(F.when(F.col("votes") > 1, F.col("path"))).alias("others")).select(
        "host", F.col("won.path").alias("host_path"), "others")


def extract(pages: DataFrame, url: str = "url", source: str = "html", carried: list[str] | None = None) -> DataFrame:
    """The carried columns (default: all but the source) with ``text`` and the ``path`` it was found under.

    Blocks of text are decoded, white space in a block becomes one space, and blocks are joined by two line feeds in page
    order. A null or empty source, or one without main text, gives an empty text and a null path. Rows of equal ids are
    read each; pages without a host vote together; an empty table gives an empty one; a column that has the name of an
    added one gives way to it, and one whose name begins with an underscore is not carried. The table of winning paths is written before the join, so that the planner knows its size.
    """
    won = settle(host_paths(pages, url, source)).toDF("_of", "_path", "_others")
    carried = [c for c in (pages.columns if carried is None else carried) if c not in (source, "text", "path") and c[:1] != "_"]
    own = pages.select(*carried, host_of(F.col(url)).alias("_host"), F.col(source).cast("string").alias("_html"))
    joined = own.join(won, F.col("_host") == F.col("_of"), "left").drop("_of")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name not in ("_html", "_host")]
    return joined.mapInArrow(_extract, ", ".join([*types, "text string", "path string"]))
