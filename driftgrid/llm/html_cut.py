"""Main text of web pages by minimum cut.

A page is read into blocks of text with their ancestors. A linear classifier
on markup and text gives each block a score; scores become the capacities of
edges to the two terminals. Neighbouring blocks, and blocks that follow each
other under one parent, are joined by smoothness edges that are stronger the
more ancestors they share. The minimum cut labels each block content or
boilerplate with least total cost. Neighbouring siblings whose scores have one
sign are one node, so that the graph stays small on long pages.

The classifier's weights are the fixed values below; they are set by hand and
not learned, since no table labels blocks.

Defined cases: a null or empty page has empty text; unclosed and stray tags are
repaired as browsers do for the common cases; a page without markup is one
block; a drawing or formula without an end tag ends at the next block tag of the
page; rows are independent, so repeated rows repeat. Other columns are not
carried unless named in ``keep``.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.deploy import ship

SILENT = frozenset("script style noscript template title iframe object embed svg math canvas audio video textarea select datalist head noframes".split())
BLOCKS = frozenset(
    "html body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a new element of the kind ends, and where the search for them stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
SCOPE = frozenset("table td th button article aside section main body html".split())
#: Containers that are never part of the main text, and those that hold it.
AWAY_TAGS = frozenset("nav footer aside form menu dialog button fieldset search".split())
MAIN_TAGS = frozenset("article main".split())
AWAY_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets related recommended recommendations share sharing social comment comments disqus reply replies respond discussion menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead copyright legal toolbar skip search contentinfo complementary dialog".split()
)
MAIN_WORDS = frozenset("article content post entry story main body text".split())
#: Scores: hard and soft boilerplate containers, main elements, main names, links, length, heading, sentence, short text, copyright line, start.
HARD, SOFT, MAIN, NAMED, LINKS, LENGTH, HEADING, SENTENCE, SHORT, RIGHTS, BASE = -8.0, -6.0, 5.0, 2.0, -4.0, 2.5, 0.7, 0.5, -0.8, -3.0, -0.4
#: Strength of smoothness edges: neighbours in page order, followers under one parent.
NEAR, SIBLING = 0.8, 1.0

#: Elements whose content is not markup, and the two whose content is another language.
RAW = frozenset("script style noscript template title iframe textarea svg math".split())
FOREIGN = frozenset("svg math".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_MARKS = re.compile(r"[>\"']")
_CLOSED = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW - FOREIGN}
#: What ends a drawing or a formula: its end tag, or a block tag that only a document can hold.
_LEFT = {
    name: re.compile(rf"</{name}\s*+>|<(?=(?:blockquote|body|center|dd|div|dl|dt|h[1-6]|hr|li|menu|ol|p|pre|table|ul)[\s/>])|<(?:foreignobject|annotation-xml)(?=[\s/>])", re.I)
    for name in FOREIGN
}
_HELD = re.compile(r"</(?:foreignobject|annotation-xml)\s*+>", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]*+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Za-z]+")


def _hidden(attributes: str) -> bool:
    """Whether the attribute ``hidden`` is set or the style shows nothing; the word in a value hides nothing."""
    if not _MAY_HIDE.search(attributes):
        return False
    return any(name.lower() == "hidden" or name.lower() == "style" and _UNSEEN.search(a or b or c) for name, a, b, c in _ATTRIBUTE.findall(attributes))


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """The places of ``>`` and quotes, and for each where a tag ends that meets it outside quotes (-1: nowhere)."""
    places = [m.start() for m in _MARKS.finditer(page)]
    ends = [-1] * (len(places) + 1)
    later = {}
    for k in range(len(places) - 1, -1, -1):
        mark = page[places[k]]
        if mark == ">":
            ends[k] = places[k]
            continue
        if mark in later:
            ends[k] = ends[later[mark] + 1]
        later[mark] = k
    return places, ends


def _raw_end(page: str, name: str, at: int) -> int:
    """Where the element ends whose content starts at ``at``; one that is never closed lasts to the end of the page."""
    if name not in FOREIGN:
        m = _CLOSED[name].search(page, at)
        return m.end() if m else len(page)
    while (m := _LEFT[name].search(page, at)) is not None:
        if m[0] == "<" or m[0].startswith("</"):
            return m.end() if m[0] != "<" else m.start()
        held = _HELD.search(page, m.end())  # blocks inside belong to the drawing
        if held is None:
            return len(page)
        at = held.end()
    return len(page)


def tokens(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Start, end, whether it closes, name and attributes of the pieces of markup; the name is empty where no tag is meant.

    A walk that finds no end of its tag runs once per page: from then on the
    ends are read off a table, so the time grows with the page's length only.
    """
    last, known, at = page.rfind(">"), None, 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(page)
            yield at, end, False, "", ""
            at = end
            continue
        if at > last:  # nothing but a comment can follow
            at = page.find("<!--", at)
            if at < 0:
                return
            continue
        m = _TAG.match(page, at) if known is None else None
        name = m[2] if m else (n[1] if (n := _NAME.match(page, at)) else "")
        if not name:
            if page[at + 1] in "!?/":
                end = page.find(">", at + 2) + 1
                if end:
                    yield at, end, False, "", ""
                    at = end
                    continue
            at += 1
            continue
        closes = page[at + 1] == "/"
        after = at + 1 + closes + len(name)
        if m is not None:
            end, attributes = m.end(), m[3]
        else:
            if known is None:
                known = _tag_ends(page)
            end = known[1][bisect_left(known[0], after)] + 1
            attributes = page[after : end - 1] if end else ""
        tag = name.lower()
        if not closes and tag in RAW and not (end and tag in FOREIGN and attributes.endswith("/")):
            end = _raw_end(page, tag, page.find(">", after) + 1)
            yield at, end, False, "", ""
        elif not end or tag in FOREIGN and not closes:
            end = end or page.find(">", after) + 1
            yield at, end, False, "", ""
        else:
            yield at, end, closes, tag, attributes
        at = end


class Element:
    __slots__ = ("tag", "number", "depth", "state", "parent", "silent", "link")

    def __init__(self, tag: str, number: int, parent: Element | None, names: str = "", hidden: bool = False):
        self.tag, self.number, self.parent = tag, number, parent
        self.depth = parent.depth + 1 if parent else 0
        state = parent.state if parent else 0.0
        if tag in AWAY_TAGS or hidden or tag == "header" and state <= 0:
            state = HARD
        elif tag in MAIN_TAGS:
            state = state if state == HARD else MAIN
        elif names and tag not in ("html", "body"):
            words = {w.lower() for w in _WORD.findall(names)}
            if words & AWAY_WORDS and tag not in HEADINGS:
                state = min(state, SOFT)
            elif words & MAIN_WORDS and state >= 0:
                state = max(state, NAMED)
        self.state = state
        self.silent = tag in SILENT or bool(parent and parent.silent)
        self.link = tag == "a" or bool(parent and parent.link)


class Block:
    __slots__ = ("text", "linked", "element")

    def __init__(self, text: str, linked: int, element: Element):
        self.text, self.linked, self.element = text, linked, element


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page in order: character references decoded, white space collapsed."""
    root = top = Element("#", 0, None)
    number, found, pieces, linked = 0, [], [], 0
    opened: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked
        if pieces:
            raw = "".join(pieces)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                holder = top
                while holder.parent and holder.tag not in BLOCKS:
                    holder = holder.parent
                found.append(Block(text, linked, holder))
            pieces.clear()
        linked = 0

    def leave(until: Element) -> None:
        """Ends every open element down to ``until``."""
        nonlocal top
        e, crossed = top, False
        while e is not until.parent:
            crossed |= e.tag in BLOCKS
            opened[e.tag] -= 1
            e = e.parent
        if crossed:
            flush()
        top = until.parent

    def find(tags, stop) -> Element | None:
        e = top
        while e is not root and any(opened[tag] for tag in tags):
            if e.tag in tags:
                return e
            if e.tag in stop:
                return None
            e = e.parent
        return None

    at = 0
    for start, end, closes, tag, attributes in tokens(page):
        if start > at and not top.silent:
            piece = page[at:start]
            pieces.append(piece)
            if top.link:
                linked += len(piece)
        at = end
        if not tag:
            continue
        if closes:
            if tag == "br" or tag == "p" and find({"p"}, SCOPE) is None:
                flush() if tag == "p" else pieces.append(" ")
            elif (e := find({tag}, () if tag in BLOCKS else SCOPE)) is not None:
                leave(e)
            elif tag in BLOCKS:
                flush()
            continue
        if tag in ("br", "wbr"):
            if tag == "br":
                pieces.append(" ")
            continue
        if tag in BLOCKS:
            if tag not in ("html", "body") and (e := find({"p"}, SCOPE)) is not None:
                leave(e)
            if tag in ENDS:
                while (e := find(*ENDS[tag])) is not None:
                    leave(e)
            if tag in HEADINGS and top.tag in HEADINGS:
                leave(top)
            flush()
        elif tag == "body" or top.tag == "head" and tag not in ("meta", "link", "base"):
            leave(top)
        if tag in BLOCKS and (e := find({"head"}, ())) is not None:
            leave(e)
        if tag in VOID:
            continue
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if "=" in attributes else ""
        number += 1
        if not attributes.endswith("/") or tag in BLOCKS:
            opened[tag] += 1
            top = Element(tag, number, top, names, bool(attributes) and _hidden(attributes))
    if at < len(page) and not top.silent:
        pieces.append(page[at:])
    flush()
    return found


def score(block: Block) -> float:
    """Log-odds style score: above 0 for main text."""
    text, size = block.text, len(block.text)
    words = text.count(" ") + 1
    value = BASE + block.element.state + LINKS * min(1.0, block.linked / size) + LENGTH * min(1.0, size / 160)
    if block.element.tag in HEADINGS:
        value += HEADING
    elif words < 4:
        value += SHORT
    if text[-1] in ".!?…。":
        value += SENTENCE
    if block.element.state <= 0 and (text.startswith(("©", "(c)", "(C)")) or text[:9].lower() == "copyright"):
        value += RIGHTS
    return value


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay on the source's side. Capacities are integers; edges go both ways."""
    n = len(source)
    s, t = n, n + 1
    ends: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(ends))
        out[b].append(len(ends) + 1)
        ends.extend((b, a))
        room.extend((there, back))

    for i in range(n):
        if source[i]:
            add(s, i, source[i], 0)
        if sink[i]:
            add(i, t, sink[i], 0)
    for a, b, w in edges:
        add(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        waiting = deque([s])
        while waiting:
            a = waiting.popleft()
            for e in out[a]:
                if room[e] and level[ends[e]] < 0:
                    level[ends[e]] = level[a] + 1
                    waiting.append(ends[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt, path = [0] * (n + 2), []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if not room[e])
                a = ends[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[a] < len(out[a]):
                e = out[a][nxt[a]]
                if room[e] and level[ends[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(out[a]):
                path.append(out[a][nxt[a]])
                a = ends[path[-1]]
            elif a == s:
                break
            else:
                level[a] = -2
                e = path.pop()
                a = ends[e ^ 1]


def _shared(a: Element, b: Element) -> float:
    """The part of the deeper path that two elements share."""
    deep = max(a.depth, b.depth, 1)
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return (a.depth + 1) / (deep + 1)


def label(found: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    scores = [score(b) for b in found]
    node, first = [], []
    for i, (b, x) in enumerate(zip(found, scores)):
        p = found[i - 1] if i else None
        if p is None or p.element.parent is not b.element.parent or p.element.state != b.element.state or (scores[i - 1] > 0) != (x > 0):
            first.append(i)
        node.append(len(first) - 1)
    weight = [0.0] * len(first)
    for k, x in zip(node, scores):
        weight[k] += x
    edges: list[tuple[int, int, int]] = []
    last: dict[int, int] = {}
    for k, i in enumerate(first):
        b = found[i].element
        if k:
            edges.append((k - 1, k, round(100 * NEAR * _shared(found[i - 1].element, b))))
        key = id(b.parent)
        if key in last and last[key] < k - 1:
            edges.append((last[key], k, round(100 * SIBLING)))
        last[key] = k
    cut = minimum_cut([max(0, round(100 * w)) for w in weight], [max(0, round(-100 * w)) for w in weight], edges)
    return [cut[k] for k in node]


def extract(page: str) -> str:
    """The main text: content blocks in page order, one line each."""
    found = blocks(page)
    return "\n".join(b.text for b, main in zip(found, label(found)) if main)


def main_text(pages: DataFrame, page: str = "html", keep: list[str] = ("page_id", "url"), out: str = "text") -> DataFrame:
    """The columns of ``keep`` and the main text of the whole page."""
    keep = list(keep)
    if out in keep:
        raise ValueError(f"{out!r} is both carried and computed")
    ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [extract(x.as_py()) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*keep, out])

    rows = pages.select(*keep, F.coalesce(F.col(page), F.lit("")).alias("_".join(["input", *keep])))
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField(out, T.StringType())])
    return rows.mapInArrow(run, schema)
