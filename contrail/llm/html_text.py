"""Visible text of HTML with its layout: blocks, lists and aligned tables.

A small tree builder closes what HTML lets authors leave open (head, p, li, dt, dd, option, table parts); what browsers don't
show is left out (head, scripts, styles, templates, comments, hidden, display:none, what svg and math only define). The tree is walked
without recursion, and a writer collapses blanks and keeps block distances; cells of a table are rendered apart and padded to
columns. Time grows with the page: the places of open elements are kept by name, and a tag that never ends takes what follows.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import column, slices

# Fixed values of HTML: elements by behaviour.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link base iframe object datalist video audio canvas".split())
#: Not shown within svg or math.
DEFINED = frozenset("desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml".split())
#: Whatever else comes in an open head closes it.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template head".split())
RAW = frozenset("script style textarea title iframe".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer main nav address form fieldset figcaption details summary li dt dd tr caption center legend option select".split())
#: An opening tag closes these if they are open within the given bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
#: These close an open paragraph.
ENDS_P = BLOCK - {"option", "select", "li", "tr", "caption", "html", "body"}
SCOPE = frozenset({"td", "th", "caption", "table", "html", "button"})
#: End tags of other elements don't reach past these.
CELLS = ("table", "td", "th")
TABLE_PARTS = frozenset("table tr td th tbody thead tfoot body html".split())
#: Lists and tables nested deeper are laid out as at this depth: the indents of a line take room in proportion to its depth.
DEEPEST = 100
#: Fixed values of HTML: the most columns and rows that a cell may span; rowspan 0 stands for all rows that follow.
WIDEST, TALLEST = 1000, 65_534
#: Blanks that stand between two cells of a line, or before its first, at most: rows that begin ever further to the right would else grow without bound.
FARTHEST = 1024
#: In what order parts of a table are shown.
PART_ORDER = {"thead": 0, "tfoot": 2}

_MARKUP = re.compile(r"<(?:!--|[!?/a-zA-Z])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|))*+)>")
_MAY_HIDE = re.compile(r"hidden|none|visib", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none(?![\w-])", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)(?![\w-])", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    """visible: what the element's own visibility says, which holds for what is in it until an element says otherwise; None: nothing."""

    __slots__ = ("attributes", "kids", "shown", "tag", "visible")

    def __init__(self, tag: str, shown: bool = True, attributes: str = "", visible: bool | None = None):
        self.tag, self.shown, self.attributes, self.kids, self.visible = tag, shown, attributes, [], visible


def attributes_of(source: str) -> dict[str, str]:
    """Attribute values by lower-cased name, the first of a name; without a value: empty."""
    named: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        named.setdefault(name.lower(), entities.unescape("".join(values)))
    return named


def sight(tag: str, attributes: str) -> tuple[bool, bool | None]:
    """(shown, visible) of an element: attributes and values that merely hold such words don't count."""
    if tag == "dialog" and "open" not in attributes_of(attributes):
        return False, None
    if not attributes or not _MAY_HIDE.search(attributes):
        return True, None
    named = attributes_of(attributes)
    style = named.get("style", "")
    said = _VISIBILITY.findall(style)
    return not ("hidden" in named or _UNSEEN.search(style)), said[-1].lower() == "visible" if said else None


class Open:
    """The open elements: a stack, and for each name the places of its elements in it."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.stack[-1].kids.append(node)
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The innermost place of any of the tags, the root apart; 0 if none is open."""
        found = 0
        for tag in tags:
            places = self.places.get(tag)
            if places and places[-1] > found:
                found = places[-1]
        return found

    def cut(self, place: int) -> None:
        """Close the element at a place and all within it."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def close(self, tags, bounds) -> None:
        """Close the tags that are open within the bounds."""
        place = self.last(tags)
        if not place:
            return
        bound = self.last(bounds)
        while place > bound:
            self.cut(place)
            place = self.last(tags)


def pieces(source: str) -> Iterator[tuple[str, re.Match | None, int]]:
    """(text, tag after it, place after the tag); comments and declarations are left out. A tag or comment that never ends takes
    the rest of the page. The caller may send a later place to go on from."""
    at = 0
    text: list[str] = []
    while True:
        m = _MARKUP.search(source, at)
        text.append(source[at : m.start() if m else len(source)])
        if not m:
            break
        kind = m[0]
        if kind == "<!--":
            end = source.find("-->", m.start() + 2)
            at = end + 3
        elif kind in ("<!", "<?") or kind == "</" and not source[m.end() : m.end() + 1].isalpha():
            end = source.find(">", m.start())
            at = end + 1
        else:
            tag = _TAG.match(source, m.start())
            end = tag.end() if tag else -1
            if tag:
                at = (yield "".join(text), tag, tag.end()) or tag.end()
                text = []
        if end < 0:
            break
    yield "".join(text), None, len(source)


def parse(source: str) -> Node:
    """The tree of a document; unknown end tags are ignored, open elements end with the document."""
    root = Node("html")
    opened = Open(root)
    stack = opened.stack
    reader = pieces(source)
    resume = None
    while True:
        text, m, at = reader.send(resume)
        resume = None
        if text:
            if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
                opened.cut(len(stack) - 1)
            stack[-1].kids.append(entities.unescape(text))
        if not m:
            return root
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            place = opened.last((tag,))
            if tag == "br" or tag == "p" and place <= opened.last(SCOPE):
                stack[-1].kids.append(Node(tag))  # an end without its beginning stands for an empty element
                continue
            if place and (tag in TABLE_PARTS or place > opened.last(CELLS)):
                opened.cut(place)
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD and tag != "html":
            opened.cut(len(stack) - 1)
        if tag == "html" or tag == "body" and opened.places.get("body"):
            continue
        if tag in CLOSES:
            opened.close(*CLOSES[tag])
        if tag in ENDS_P:
            opened.close(("p",), SCOPE)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            opened.push(Node("tr"))
        foreign = bool(opened.places.get("svg") or opened.places.get("math"))
        if foreign and tag == "text":
            stack[-1].kids.append(" ")  # labels stand apart
        shown, visible = sight(tag, attributes)
        node = Node(tag, tag not in HIDDEN and not (foreign and tag in DEFINED) and shown, attributes, visible)
        if tag in RAW and not (foreign and attributes.endswith("/")):
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            if node.shown:
                node.kids.append(entities.unescape(source[at : end.start() if end else len(source)]))
            stack[-1].kids.append(node)
            resume = end.end() if end else len(source)
        elif tag in VOID or attributes.endswith("/") and (foreign or tag in ("svg", "math")):
            stack[-1].kids.append(node)
        else:
            opened.push(node)


class Writer:
    """Lines of text with collapsed blanks; `gap` blank lines are due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the current line
        self.gap = 0
        self.first = ""  # stands before the next line once, as a list mark
        self.indent: list[str] = []

    def text(self, s: str, pre: bool = False) -> None:
        if pre:
            for i, part in enumerate(s.split("\n")):
                if i:
                    self.end(1, keep=True)
                self._add(part)
            return
        s = _BLANKS.sub(" ", s)
        if not self.parts or self.parts[-1].endswith(" "):
            s = s.lstrip(" ")
        self._add(s)

    def _add(self, s: str) -> None:
        if s:
            self.parts.append(s)

    def end(self, spacing: int, keep: bool = False) -> None:
        """End the line; spacing 2 asks for a blank line before what follows."""
        if self.parts or keep:
            line = "".join(self.parts).rstrip(" ")
            self.parts = []
            if line or keep:
                self.put(line)
                self.gap = 0
        if spacing > 1:
            self.gap = 1

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        mark = self.first or "".join(self.indent[:DEEPEST])
        self.first = ""
        self.lines.append((mark + line).rstrip(" "))


def number_in(node: Node, name: str) -> int | None:
    """The whole number that an attribute begins with."""
    value = attributes_of(node.attributes).get(name, "") if name in node.attributes.lower() else ""
    digits = re.match(r"\s*(-?[0-9]{1,9})", value)
    return int(digits[1]) if digits else None


def spans_of(node: Node) -> tuple[int, int]:
    """Columns and rows of a cell, 1 where nothing sensible is said."""
    wide, high = number_in(node, "colspan"), number_in(node, "rowspan")
    return min(max(wide or 1, 1), WIDEST), TALLEST if high == 0 else min(max(high or 1, 1), TALLEST)


class Free:
    """The columns that no cell of an earlier row stands in, as sorted intervals."""

    def __init__(self):
        self.starts, self.ends = [0], [1 << 60]

    def next(self, at: int) -> int:
        """The first free column from `at` on."""
        i = bisect_right(self.starts, at) - 1
        return at if i >= 0 and self.ends[i] > at else self.starts[i + 1]

    def take(self, start: int, end: int) -> list[tuple[int, int]]:
        """The free parts of the interval, which are free no longer."""
        out = []
        i = max(bisect_right(self.starts, start) - 1, 0)
        while i < len(self.starts) and self.starts[i] < end:
            a, b = self.starts[i], self.ends[i]
            if b <= start:
                i += 1
                continue
            rest = [x for x in ((a, start), (end, b)) if x[0] < x[1]]
            self.starts[i : i + 1], self.ends[i : i + 1] = [x for x, _ in rest], [x for _, x in rest]
            out.append((max(a, start), min(b, end)))
            i += sum(x[1] <= start for x in rest)
            if rest and rest[-1][0] >= end:
                break
        return out

    def give(self, start: int, end: int) -> None:
        i = bisect_right(self.starts, start)
        if i and self.ends[i - 1] == start:
            i -= 1
            start = self.starts[i]
            del self.starts[i], self.ends[i]
        if i < len(self.starts) and self.starts[i] == end:
            end = self.ends[i]
            del self.starts[i], self.ends[i]
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def places_of(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int]]]:
    """First column and column behind each of (text, columns, rows) cells: a row's cells take the first columns that cells of earlier rows leave free."""
    free, due, out = Free(), [], []
    for r, row in enumerate(rows):
        while due and due[0][0] <= r:
            free.give(*heappop(due)[1:])
        at, line, tall = 0, [], []
        for _, wide, high in row:
            at = free.next(at)
            line.append((at, at + wide))
            if high > 1:
                tall.append((at, at + wide, r + high))
            at += wide
        for start, end, until in tall:
            for part in free.take(start, end):
                heappush(due, (until, *part))
        out.append(line)
    return out


def layout(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table of (text, columns, rows) cells. A cell of several columns stands over all of them, and the places it takes
    in later rows stay empty; columns in which no cell begins take no room."""
    placed = [[(a, b, text.split("\n")) for (a, b), (text, _, _) in zip(line, row)] for line, row in zip(places_of(rows), rows) if any(text for text, _, _ in row)]
    order = sorted({a for line in placed for a, _, _ in line})
    starts = {c: i for i, c in enumerate(order)}
    width = [0] * len(order)
    wanted: dict[tuple[int, int], int] = {}  # (last column, first column) of cells over several -> their width
    for line in placed:
        for a, b, text in line:
            i, j = starts[a], bisect_left(order, b) - 1
            longest = max(map(len, text))
            if i == j:
                width[i] = max(width[i], longest)
            else:
                wanted[j, i] = max(wanted.get((j, i), 0), longest)
    left = [0]
    for (j, i), longest in sorted(wanted.items()):  # what stands over several columns widens the last of them
        while len(left) <= j:
            left.append(left[-1] + width[len(left) - 1] + 2)
        width[j] = max(width[j], longest - (left[j] - left[i]))
    while len(left) <= len(width):
        left.append(left[-1] + width[len(left) - 1] + 2)
    out = []
    for line in placed:
        for k in range(max(len(text) for _, _, text in line)):
            parts, at = [], 0
            for a, _, text in line:
                if k < len(text) and text[k]:
                    parts.append(" " * min(left[starts[a]] - at, FARTHEST) + text[k])
                    at = left[starts[a]] + len(text[k])
            out.append("".join(parts).rstrip())
    return out


def render(source: str | None) -> str:
    """The visible text; null and empty sources give an empty text."""
    out = [Writer()]
    pre = 0
    lists: list[list] = []  # [kind, items so far]
    tables: list[list | None] = []  # rows: (part's order, cells); None: too deep, laid out as blocks
    root = parse(source or "")
    stack: list[tuple[Node, Iterator, bool]] = [(root, iter(root.kids), True)]
    while stack:
        node, kids, visible = stack[-1]
        kid = next(kids, None)
        w = out[-1]
        if isinstance(kid, str):
            if not visible:
                continue
            if kid.strip() or node.tag not in ("table", "tr", "tbody", "thead", "tfoot", "ul", "ol"):
                first = node.tag in ("pre", "textarea") and kid is node.kids[0]
                w.text(re.sub(r"\A\r?\n", "", kid) if first else kid, pre > 0)
            continue
        if kid is not None:
            if not kid.shown:
                continue
            tag = kid.tag
            if tag == "br":
                w.end(1, keep=bool(w.parts) or pre > 0 or bool(w.lines and not w.gap))
                continue
            if tag == "hr":
                w.end(2)
                continue
            if tag in VOID:
                continue
            if tag in BLOCK:
                w.end(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            if tag == "pre":
                pre += 1
            elif tag in ("ul", "ol"):
                first_number = number_in(kid, "start") if tag == "ol" else None
                lists.append([tag, 0 if first_number is None else first_number - 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 0]
                said = number_in(kid, "value") if kind[0] == "ol" else None
                kind[1] = kind[1] + 1 if said is None else said
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                w.first = "".join(w.indent[:DEEPEST]) + mark
                w.indent.append(" " * len(mark))
            elif tag == "dd":
                w.indent.append("    ")
            elif tag == "table":
                tables.append([] if len(tables) < DEEPEST else None)
            elif tag == "tr" and tables and tables[-1] is not None:
                tables[-1].append((PART_ORDER.get(node.tag, 1), []))
            elif tag in ("td", "th") and tables:
                if tables[-1] is None:
                    w.end(1)
                else:
                    if not tables[-1]:
                        tables[-1].append((1, []))
                    out.append(Writer())
            if tag == "details" and "open" not in attributes_of(kid.attributes):  # shows its first summary only
                kid.kids = [x for x in kid.kids if isinstance(x, Node) and x.tag == "summary"][:1]
            stack.append((kid, iter(kid.kids), visible if kid.visible is None else kid.visible))
            continue
        stack.pop()
        tag = node.tag
        if tag in ("td", "th") and tables and tables[-1] is not None and len(out) > 1:
            w.end(1)
            out.pop()
            tables[-1][-1][1].append(("\n".join(w.lines).strip("\n"), *spans_of(node)))
            continue
        if tag == "table" and tables:
            rows = sorted(tables.pop() or [], key=lambda row: row[0])
            for line in layout([cells for _, cells in rows]):
                w.end(1)
                w.put(line)
        if tag == "pre":
            pre -= 1
        if tag in BLOCK:
            w.end(2 if tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1) else 1)
        if tag in ("ul", "ol"):
            lists.pop()
        elif tag == "li":
            w.indent.pop()
            w.first = ""
        elif tag == "dd":
            w.indent.pop()
    out[0].end(1)
    return "\n".join(out[0].lines)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = [render(x) for x in column(batch, "html").to_pylist()]
        yield pa.RecordBatch.from_arrays([column(batch, "page_id"), pa.array(texts, pa.string())], ["page_id", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars for each row of pages(page_id, html).

    Null and empty html give an empty text; broken markup is read as browsers do: a tag, quoted value or comment that never
    ends takes the rest. Pages of any length and depth are read whole; lists and tables nested over DEEPEST deep keep their text and are
    indented as at that depth. Null page_ids and repeated rows stay; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    out = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(_render, "page_id long, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op9(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
