"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks.  A linear classifier (fixed weights over tags, class and id words, roles, links,
length and punctuation) says how much a block looks like content.  Its score is a terminal capacity: from the source
for content, to the sink for boilerplate.  Neighbouring blocks, and neighbours under one parent, are joined by
smoothness edges that weaken with their distance in the document tree and at the border of a landmark.  The minimum
cut is the labelling with the least total cost.  Blocks whose own capacity outweighs all their edges have the same
label in some minimum cut; they are labelled at once and their edges folded into their neighbours, and max-flow solves
what remains, so large pages stay cheap and the result exact.

Defined results: null, empty and text-free pages give an empty text; broken markup is read like a browser would
(unclosed elements end with their parents or where HTML says so, a head without end tag with the first thing that is no
head content, stray end tags are ignored); pages of any length and depth are read whole; repeated pages give equal
rows; other columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.text_blocks import appended, fresh, with_fields

# Fixed values of the classifier: words of HTML and of common page templates.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
HEAD_CONTENT = set("base link meta noscript script style template title".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
UNSEEN = set("head title script style template noscript iframe object svg math canvas audio video select option datalist textarea button".split())
BOILER_TAGS = set("nav footer aside form dialog menu fieldset".split())
SECTIONS = set("article main section aside nav header footer form dialog".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
BOILER_WORDS = set("ad ads adv dfp gdpr hidden nav pager rail reply replies rss side toc tools".split())
BOILER_STEMS = (
    "advert", "sponsor", "promo", "banner", "cookie", "consent", "notice", "popup", "modal", "overlay", "newsletter",
    "subscri", "signup", "signin", "login", "sidebar", "related", "recommend", "share", "sharing", "social", "comment",
    "disqus", "respond", "menu", "navig", "navbar", "breadcrumb", "footer", "masthead", "toolbar", "topbar", "widget",
    "pagination", "copyright", "disclaimer", "alert", "feedback", "trending", "outbrain", "taboola", "skip",
)
HEADER_STEMS = ("header", "head")
CONTENT_WORDS = set("article content post entry story body main text prose".split())
# Words that stand beside the stems in ids of templates.  Other company makes an id an anchor, such as related-work.
COMPANY = set(
    "area articles bar block box button buttons container content form icons inner items links list media more outer posts "
    "section slot stories this to unit us wrap".split()
)
LAYOUT = {"has", "with", "without", "no", "layout", "wrapper", "container"}
CUES = re.compile(
    r"©|\(c\) \d{4}|all rights reserved|\bcookies?\b|\bsubscribe\b|\bsign (?:up|in)\b|\badvertisement\b|\bsponsored\b|"
    r"\bshare (?:this|on)\b|\blog ?in\b|\bprivacy policy\b|\bread more\b",
    re.IGNORECASE,
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
# Weights of the classifier.
W_BOILER, W_MAIN, W_OUTSIDE, W_CONTENT, W_ANCHOR = -12.0, 4.0, -5.0, 2.0, -1.5
W_TAG = {"p": 0.7, "h1": 0.6, "h2": 0.5, "h3": 0.5, "blockquote": 0.6, "pre": 0.5, "li": -0.2, "td": -0.3, "th": -0.3}
W_LINKS, W_LENGTH, W_START, W_END, W_CUE = -4.0, 0.7, -1.2, 0.5, -2.0
SMOOTH, SMOOTH_BORDER, DISTANCE = 1.0, 0.15, 3.0
FAR = 64  # steps in the tree beyond which an edge has no weight

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node(NamedTuple):
    """An open element: its number, its depth, and the element around it."""

    number: int
    depth: int
    outer: Node | None


@dataclass
class Block:
    """A stretch of text with the element around it."""

    tag: str
    bias: float
    main: bool
    node: Node
    section: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())

    @property
    def parent(self) -> int:
        return self.node.outer.number if self.node.outer else 0


def _word_bias(words: list[str], anchor: bool, in_main: bool) -> float:
    """Bias of the words of a class or id.  An id inside the main part may be the anchor of a heading or a section."""
    boiler = [w in BOILER_WORDS or w.startswith(BOILER_STEMS) for w in words]
    if any(boiler):
        template = all(b or w in COMPANY or w.isdigit() for b, w in zip(boiler, words, strict=True))
        return W_ANCHOR if anchor and in_main and not template else W_BOILER
    if CONTENT_WORDS.intersection(words):
        return W_CONTENT
    return W_BOILER if not in_main and any(w in HEADER_STEMS for w in words) else 0.0


def _attribute_bias(tag: str, attrs: list[tuple[str, str | None]], in_main: bool) -> tuple[float, bool]:
    """Bias of an element's own attributes, and whether it opens the main part."""
    bias, main = 0.0, tag in ("article", "main")
    for name, value in attrs:
        value = value or ""
        if name in ("class", "id") and tag not in ("html", "body"):
            words = [w.lower() for w in _WORD.findall(value)]
            # Words such as has-sidebar tell of the page, not of the element; ids of headings and inline tags are anchors.
            if not LAYOUT.intersection(words) and not (name == "id" and (tag in HEADINGS or tag in INLINE)):
                bias += _word_bias(words, name == "id", in_main)
        elif name == "role":
            bias += W_BOILER if value.lower() in BOILER_ROLES else 0.0
            main = main or value.lower() in ("main", "article")
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
            name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE)
        ):
            bias += 2 * W_BOILER
    if tag in BOILER_TAGS or (tag == "header" and not in_main):
        bias += W_BOILER
    return bias, main


class Blocks(HTMLParser):
    """Cuts a page into blocks of text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Open elements: tag, bias, main, unseen, links, place in the tree, section number.
        self.open: list[tuple[str, float, bool, bool, bool, Node, int]] = [("", 0.0, False, False, False, Node(0, 0, None), 0)]
        self.blocks: list[Block] = []
        self.current: Block | None = None
        self.elements = 0
        self.has_main = False

    def _end_head(self) -> None:
        """The end tag of the head may be left out: it ends where something else begins."""
        if self.open[-1][0] == "head":
            del self.open[-1]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in HEAD_CONTENT:
            self._end_head()
        if tag in VOID:
            if tag == "br" and self.current:
                self.current.parts.append(" ")
            elif tag == "hr":
                self.current = None
            return
        if tag == "body":
            self._close({"head"}, set())
        if tag not in INLINE:
            self._close({"p"}, {"table", "button", "td", "th", "caption"} if tag != "p" else {"button", "table"})
        if tag in CLOSED_BY:
            self._close(CLOSED_BY[tag], SCOPES.get(tag, set()))
        _, bias, main, unseen, links, node, section = self.open[-1]
        own, opens_main = _attribute_bias(tag, attrs, main)
        self.elements += 1
        self.has_main = self.has_main or (opens_main and bias + own > W_BOILER / 2)
        if tag not in INLINE or own < W_BOILER / 2:
            self.current = None
        self.open.append((
            tag, bias + own, main or opens_main, unseen or tag in UNSEEN, links or tag == "a",
            Node(self.elements, node.depth + 1, node), self.elements if tag in SECTIONS else section,
        ))

    def _close(self, tags: set[str], within: set[str]) -> None:
        """End the innermost of ``tags``, unless one of ``within`` stands in between."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] in tags:
                del self.open[k:]
                self.current = None
                return
            if self.open[k][0] in within or self.open[k][0] in SECTIONS:
                return

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if any(t not in INLINE or b < self.open[k - 1][1] + W_BOILER / 2 for t, b, *_ in self.open[k:]):
                    self.current = None
                del self.open[k:]
                return
            if tag in INLINE and self.open[k][0] not in INLINE:
                return
        if tag == "p":
            self.current = None

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head()
        tag, bias, main, unseen, links, _, section = self.open[-1]
        if unseen:
            return
        if self.current is None:
            if not data.strip():
                return
            outer = next((e for e in reversed(self.open) if e[0] not in INLINE), self.open[0])
            self.current = Block(outer[0], bias, main, outer[5], section)
            self.blocks.append(self.current)
        self.current.parts.append(data)
        if links:
            self.current.linked += len(data)


def score(block: Block, text: str, has_main: bool) -> float:
    words = text.count(" ") + 1
    share = min(1.0, block.linked / max(1, len(text)))
    total = block.bias + W_TAG.get(block.tag, 0.0) + W_START + min(2.5, W_LENGTH * math.log1p(words))
    total += W_LINKS * share * (0.3 if block.main else 1.0)
    total += W_END if text[-1] in ".!?…:”\"" else 0.0
    total += W_CUE if words < 40 and CUES.search(text) else 0.0
    return total + (W_MAIN if block.main else W_OUTSIDE if has_main else 0.0)


def _distance(a: Block, b: Block) -> int:
    """Steps from one block to the other over their nearest common element, at most ``FAR``."""
    x, y = a.node, b.node
    for steps in range(FAR):
        if x.number == y.number:
            return steps
        if x.depth >= y.depth:
            x = x.outer
        else:
            y = y.outer
    return FAR


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between neighbours on the page and neighbours under one parent."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for k, block in enumerate(blocks):
        for j in {k - 1, last.get(block.parent, -1)} - {-1}:
            other = blocks[j]
            weight = SMOOTH if other.section == block.section else SMOOTH_BORDER
            edges[j, k] = edges.get((j, k), 0.0) + weight * math.exp(-_distance(other, block) / DISTANCE)
        last[block.parent] = k
    return edges


def minimum_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (True: content) of least cost: -score of content blocks plus the edges between unlike labels."""
    scores, n = list(scores), len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:
        k = waiting.popleft()
        if label[k] is not None or abs(scores[k]) < sum(near[k].values()):
            continue
        label[k] = scores[k] > 0
        for j, w in near[k].items():
            scores[j] += w if label[k] else -w
            del near[j][k]
            waiting.append(j)
        near[k] = {}
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        reached = _max_flow(rest, scores, near)
        for k in rest:
            label[k] = k in reached
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], scores: list[float], near: list[dict[int, float]]) -> set[int]:
    """Shortest augmenting paths from the source; the nodes that it still reaches in the end."""
    left: dict[int, dict[int, float]] = {k: dict(near[k]) for k in nodes}
    supply = {k: max(0.0, scores[k]) for k in nodes}
    drain = {k: max(0.0, -scores[k]) for k in nodes}
    while True:
        queue = deque(k for k in nodes if supply[k] > 1e-12)
        before: dict[int, int] = {k: -1 for k in queue}
        end = None
        while queue:
            k = queue.popleft()
            if drain[k] > 1e-12:
                end = k
                break
            for j, w in left[k].items():
                if w > 1e-12 and j not in before:
                    before[j] = k
                    queue.append(j)
        if end is None:
            return set(before)
        path = [end]
        while before[path[-1]] != -1:
            path.append(before[path[-1]])
        flow = min([drain[end], supply[path[-1]], *(left[b][a] for a, b in zip(path, path[1:], strict=False))])
        drain[end] -= flow
        supply[path[-1]] -= flow
        for a, b in zip(path, path[1:], strict=False):
            left[b][a] -= flow
            left[a][b] += flow


def main_blocks(html: str | None) -> list[str]:
    """Content blocks in page order."""
    reader = Blocks()
    reader.feed(html or "")
    reader.close()
    found = [(b, t) for b in reader.blocks if (t := b.text())]
    blocks = [b for b, _ in found]
    scores = [score(b, t, reader.has_main) for b, t in found]
    keep = minimum_cut(scores, smoothness(blocks))
    return [t for (_, t), k in zip(found, keep, strict=True) if k]


def with_main_text(pages: DataFrame, html: str = "html") -> tuple[DataFrame, str]:
    """``pages`` plus the main text (blocks apart by an empty line); the name of that column comes second."""
    name = fresh(pages, "main_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(main_blocks(h)) for h in batch.column(html).to_pylist()]
            yield appended(batch, {name: pa.array(texts, pa.string())})

    return pages.mapInArrow(run, with_fields(pages, T.StructField(name, T.StringType()))), name
