"""Main text of HTML pages by minimum cuts.

A page is read into blocks of text with the elements around them. A linear classifier over what
those elements are called and what the block looks like gives each block a cost for being content
and one for being boilerplate: the capacities of its edges to the two terminals. Blocks that follow
each other, and blocks of one parent, are joined by smoothness edges, weaker where something like a
footer begins or ends between them. The minimum cut, found by maximum flow, is the labelling of
least cost; blocks on the content side, in page order, are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lectern.llm.common import fresh

#: A comment or declaration, or a tag with its name and attributes; what the page's end leaves open reaches to it.
MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|[^>])*+)(?:>|\Z)"
    r"|</[^a-zA-Z][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and those whose text is never shown as part of an article.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("noscript template select option button datalist svg math canvas audio video object map".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Which open elements a start tag ends (any block ends a paragraph), and the elements that they are looked for inside of.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
FENCES = {"li": ("ul", "ol", "menu", "dir", "table"), "dt": ("dl", "table"), "dd": ("dl", "table"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
CELLS = ("table", "caption", "td", "th")

#: What an element is by its tag or role, and by words of its class or id (a * takes any ending).
TAG_MARKS = {"nav": "menu", "menu": "menu", "footer": "foot", "aside": "side", "form": "form", "dialog": "notice", "header": "head", "search": "form", "article": "main", "main": "main"}
ROLE_MARKS = {"navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "form", "form": "form", "dialog": "notice", "alertdialog": "notice", "alert": "notice", "note": "text", "main": "main", "article": "main"}
WORD_MARKS = {
    "comments": "comment* disqus respond reply replies".split(),
    "ad": "ad ads adv adbox adslot adunit adsbygoogle advert* sponsor* promo promos promoted promotion* outbrain taboola".split(),
    "notice": "cookie* consent gdpr notice notices popup modal overlay newsletter* subscri* paywall signup toast alert announcement*".split(),
    "menu": "nav navbar navigation menu menus breadcrumb* pagination pager toc topbar toolbar tabs".split(),
    "side": "sidebar* aside rail widget* related recommend* share sharing social* trending".split(),
    "foot": "footer* foot copyright colophon legal".split(),
    "head": "header masthead banner".split(),
    "form": "form forms login signin search searchbox".split(),
    "text": "article* content post posts entry story body maintext prose main".split(),
}
_WORD_MARK = {w: k for k, ws in WORD_MARKS.items() for w in ws if "*" not in w}
_STEM_MARK = tuple((w[:-1], k) for k, ws in WORD_MARKS.items() for w in ws if "*" in w)
#: Marks that a page's layout may put around everything: they don't count where they hold the page's article.
LAYOUT = frozenset({"menu", "side", "foot", "head", "form"})

#: Costs, in units of a label's log-odds: of the closest mark, of each other trait of a block, and of parting neighbours.
MARK_COST = {"main": 4.0, "text": 1.6, "comments": -6.0, "ad": -6.0, "notice": -6.0, "menu": -6.0, "side": -6.0, "foot": -6.0, "head": -6.0, "form": -6.0}
START, PER_WORD, MOST_WORDS, SENTENCE, PARAGRAPH, HEADING, LIST_ITEM, LINKS, MAIN_LINKS, STOCK = -1.2, 0.06, 40, 0.7, 0.9, 0.8, -0.6, -4.0, -2.0, -3.0
NEXT, SIBLINGS, ACROSS = 0.3, 0.4, 0.05
#: Phrases of notices and of headings over what isn't the article.
STOCK_PHRASE = re.compile(r"^©|\(c\) ?\d{4}|all rights reserved|^(leave a (reply|comment)|(\d+ )?comments?( \(\d+\))?|related (articles|posts|stories)|share this.*|advertisement)$", re.I)
SCALE = 1000
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(eq=False)
class Element:
    """An open element; marked, inside a main one, unseen and linked hold for what is inside of it too."""

    tag: str
    parent: Element | None = None
    mark: str = ""
    soft: bool = False
    in_main: bool = False
    in_other: bool = False
    unseen: bool = False
    link: bool = False
    kinds: frozenset = frozenset()
    zone: tuple | None = None


@dataclass
class Block:
    parent: Element
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _mark(tag: str, attributes: dict[str, str]) -> tuple[str, bool]:
    """An element's mark, and whether only its class or id says so."""
    by_role = ROLE_MARKS.get(attributes.get("role", "").strip().lower()) or ("main" if attributes.get("itemprop", "").lower() == "articlebody" else "")
    found = []
    if tag not in ("html", "body"):
        names = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f"{attributes.get('class', '')} {attributes.get('id', '')}")
        for w in re.findall(r"[a-z]+", names.lower()):
            found.append(_WORD_MARK.get(w) or next((k for stem, k in _STEM_MARK if w.startswith(stem)), ""))
    if "comments" in found:
        return "comments", True
    known = by_role or TAG_MARKS.get(tag, "")
    if known and known != "main":
        return known, False
    bad = next((k for k in found if k not in ("", "text")), "")
    if bad == "head" and "text" in found:  # an article's own header
        bad = ""
    return (bad, True) if bad else (known or ("text" if "text" in found else ""), False)


class _Page:
    """The elements that are open while a page is read, and the blocks of text that are done."""

    def __init__(self) -> None:
        self.root = Element("")
        self.top, self.done, self.block = self.root, [], Block(self.root)
        self.open: Counter[str] = Counter()
        self.main_seen = False

    def end_block(self) -> None:
        self.block.text = " ".join("".join(self.block.pieces).split())
        if self.block.text:
            self.done.append(self.block)
        self.block = Block(self.top)

    def take(self, raw: str) -> None:
        if not raw or self.top.unseen:
            return
        said = html.unescape(raw) if "&" in raw else raw
        self.block.pieces.append(said)
        if self.top.link:
            self.block.linked += len("".join(said.split()))

    def leave(self, element: Element) -> None:
        """Closes an element and all that is open inside of it."""
        while True:
            closed, self.top = self.top, self.top.parent
            self.open[closed.tag] -= 1
            if closed is element:
                break
        self.block.parent = self.top if not self.block.pieces else self.block.parent

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.end_block()
        if not self.open[name]:
            return
        opened, walled = self.top, False
        while opened.tag != name:
            walled |= opened.tag in BLOCKS
            opened = opened.parent
        if name in BLOCKS or not walled:
            self.leave(opened)

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name in BLOCKS:
            self.end_block()
            ends, fences = (*ENDS.get(name, ()), "p"), FENCES.get(name, CELLS)
            if any(self.open[x] for x in ends):
                e, last = self.top, None
                while e is not self.root and e.tag not in fences:
                    last = e if e.tag in ends else last
                    e = e.parent
                if last is not None:
                    self.leave(last)
        up = self.top
        mark, soft = _mark(name, attributes)
        if mark == "head" and not soft and up.in_main:
            mark = ""
        if mark == "main" and not self.main_seen and not up.in_other:
            self.main_seen, x = True, up
            while x is not self.root:
                if x.soft and x.mark in LAYOUT:
                    x.mark = ""
                x = x.parent
        hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attributes.get("style", "")) is not None
        other = mark not in ("", "main", "text") and not soft
        kinds = up.kinds | {name} if name in ("p", "li") else up.kinds
        self.top = Element(name, up, mark, soft, up.in_main or mark == "main", up.in_other or other, up.unseen or hidden or name in UNSEEN, up.link or (name == "a" and "href" in attributes), kinds)
        self.open[name] += 1
        if name in BLOCKS:
            self.block.parent = self.top


def blocks_of(page: str) -> list[Block]:
    """Blocks of text of a page in order, with decoded character references and single spaces."""
    read, at = _Page(), 0
    while tag := MARKUP.search(page, at):
        read.take(page[at : tag.start()])
        at, name = tag.end(), (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            read.end(name)
        elif name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = MARKUP.match(page, close.start()).end() if close else len(page)
        elif name == "br":
            read.take(" ")
        elif name in VOID:
            if name == "hr":
                read.end_block()
        else:
            known = {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(tag[3])} if tag[3].strip(" /") else {}
            read.start(name, known)
    read.take(page[at:])
    read.end_block()
    return read.done


def _zone(element: Element) -> tuple[Element | None, str]:
    """The outermost element around one that is marked as anything but text; else the closest main one; else the closest text."""
    way = []
    while element.zone is None and element.parent is not None:
        way.append(element)
        element = element.parent
    zone = element.zone or (None, "")
    for x in reversed(way):
        if zone[1] in ("", "main", "text") and x.mark and (x.mark != "text" or zone[1] != "main"):
            zone = (x, x.mark)
        x.zone = zone
    return zone


def log_odds(block: Block, mark: str) -> float:
    """How much more likely a block is content than not, by the classifier's fixed costs."""
    words = block.text.count(" ") + 1
    z = START + MARK_COST.get(mark, 0.0) + PER_WORD * min(words, MOST_WORDS)
    z += (MAIN_LINKS if mark == "main" else LINKS) * min(1.0, block.linked / max(1, len(block.text.replace(" ", ""))))
    if "li" in block.parent.kinds:
        z += LIST_ITEM
    elif "p" in block.parent.kinds or block.parent.tag in ("blockquote", "pre"):
        z += PARAGRAPH
    elif block.parent.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        z += HEADING
    if block.text[-1] in ".!?…。":
        z += SENTENCE
    if words < 30 and STOCK_PHRASE.search(block.text):
        z += STOCK
    return z


def maximum_flow(n: int, terminals: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each of n nodes is on the source's side of a minimum cut (that of the fewest sink nodes).

    terminals: capacities from the source and to the sink; edges: (a, b, capacity both ways).
    Shortest augmenting paths by levels; what a node passes from source to sink itself goes first.
    """
    into, room, links = [], [], [[] for _ in range(n + 2)]

    def edge(a: int, b: int, forth: int, back: int) -> None:
        links[a].append(len(into))
        links[b].append(len(into) + 1)
        into.extend((b, a))
        room.extend((forth, back))

    source, sink = n, n + 1
    for i, (s, t) in enumerate(terminals):
        through = min(s, t)
        if s > through:
            edge(source, i, s - through, 0)
        elif t > through:
            edge(i, sink, t - through, 0)
    for a, b, c in edges:
        edge(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in links[a]:
                if room[e] and level[into[e]] < 0:
                    level[into[e]] = level[a] + 1
                    queue.append(into[e])
        if level[sink] < 0:
            break
        tried, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if not room[e])
                a = into[path[cut] ^ 1]
                del path[cut:]
            while tried[a] < len(links[a]):
                e = links[a][tried[a]]
                if room[e] and level[into[e]] == level[a] + 1:
                    path.append(e)
                    a = into[e]
                    break
                tried[a] += 1
            else:
                if a == source:
                    break
                a = into[path.pop() ^ 1]
                tried[a] += 1
    # a node is content unless it can't do without the sink: reach backwards from it
    lost = [False] * (n + 2)
    lost[sink] = True
    queue = deque([sink])
    while queue:
        b = queue.popleft()
        for e in links[b]:
            if room[e ^ 1] and not lost[into[e]]:
                lost[into[e]] = True
                queue.append(into[e])
    return [not lost[i] for i in range(n)]


def graph_of(blocks: list[Block]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Terminal capacities and smoothness edges of a page's blocks."""
    zones, terminals, edges = [], [], []
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        zone, mark = _zone(block.parent)
        zones.append(zone)
        z = log_odds(block, mark)
        content, boiler = (math.log1p(math.exp(-abs(z))) + max(-z, 0.0), math.log1p(math.exp(-abs(z))) + max(z, 0.0))
        terminals.append((round(boiler * SCALE), round(content * SCALE)))
        if i:
            edges.append((i - 1, i, round((NEXT if zones[i - 1] is zone else ACROSS) * SCALE)))
        family = id(block.parent.parent)  # elements live as long as their blocks
        if family in last and last[family] < i:
            j = last[family]
            edges.append((j, i, round((SIBLINGS if zones[j] is zone else ACROSS) * SCALE / (i - j))))
        last[family] = i
    return terminals, [e for e in edges if e[2]]


def extract(page: str) -> str:
    """A page's main text: its content blocks, joined by two line feeds."""
    blocks = blocks_of(page)
    content = maximum_flow(len(blocks), *graph_of(blocks)) if blocks else []
    return "\n\n".join(b.text for b, own in zip(blocks, content, strict=True) if own)


def main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Adds the main text of each page in text_col, in place of a column of that name; other columns stay.

    A null page and one without main text give an empty string. A page is one value, however long:
    reading it is linear, and its graph has some two edges a block. Repeated rows come back each; an
    empty table gives none.
    """
    own = fresh(pages, "_html")
    sent = pages.withColumn(own, F.coalesce(F.col(html_col), F.lit(""))).drop(text_col)
    names = [c for c in sent.columns if c != own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(x.as_py()) for x in batch.column(own)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), texts], names=[*names, text_col])

    return sent.mapInArrow(run, StructType([*(sent.schema[c] for c in names), StructField(text_col, StringType())]))
