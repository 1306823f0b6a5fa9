"""HTML to text, laid out as a page shows it.

A tolerant tree builder adds implied end tags and table parts; visibility rules drop what a page does not show;
the renderer keeps block spacing, list markers, preformatted text and tables with aligned cells.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*'|(?![\"'])))*+)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
# Element kinds of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("head script style template noscript title meta link base datalist iframe noembed noframes object audio video canvas area param rp".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table ul xmp".split())
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 hr listing menu ol p pre table ul fieldset".split())
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "legend"}
TABLE_PARTS = {"table", "caption", "colgroup", "tbody", "thead", "tfoot", "tr", "td", "th"}
LISTS = {"ul", "ol", "menu", "dir"}
TABLE_CONTEXT = {"table", "tbody", "thead", "tfoot", "tr"}
#: What stays in place between table parts; all else is shown before the table.
IN_TABLE = TABLE_PARTS | {"col", "script", "style", "template"}
# SVG and MathML: tags that end them, elements that hold HTML again, elements that are not drawn, elements of text.
BREAKOUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = {"svg": {"foreignobject", "desc", "title"}, "math": {"mi", "mo", "mn", "ms", "mtext"}}
HOLDS_HTML_KEYS = {f"{space} {tag}" for space, tags in HOLDS_HTML.items() for tag in tags - {"desc", "title"}} | {"math annotation-xml"}
INNER = {"td", "th", "caption", "template"} | HOLDS_HTML_KEYS
CELLS = INNER | {"table"}
UNDRAWN = set("title desc metadata defs symbol clippath mask pattern marker filter lineargradient radialgradient script style annotation annotation-xml mphantom".split())
SVG_TEXT = {"text", "tspan", "textpath", "a", "tref"}
MATH_TOKENS = HOLDS_HTML["math"]
#: Spans of cells are cut at the standard's limits; deeper lists and quotes keep their text at the indent of this level.
MAX_COLSPAN, MAX_ROWSPAN, MAX_INDENTS = 1000, 65534, 200
#: Columns of a table that are aligned; cells beyond follow in their row.
MAX_COLUMNS = 1000
#: Aligning tables and indenting may write this many characters for each one of the page, and this many more.
LAYOUT_SHARE, LAYOUT_LEAST = 16, 1 << 16


class TagEnds:
    """Where the tags of a page end, for pages with tags that never do.

    A tag ends at the first > outside of its quoted values, so scans from two places agree from the first value on
    that both open. Ends are remembered by the place of that value: all tags of a page together cost one pass.
    """

    def __init__(self, text: str) -> None:
        self.text, self.known = text, {}
        self.marks = [m.start() for m in re.finditer(r">|=\s*+[\"']", text)]
        self.stops = [m.start() for m in re.finditer(r"[\s/>]", text)]

    def of(self, at: int) -> int:
        """Place of the > that ends a tag whose name begins at `at`; -1 if there is none."""
        text, passed, end = self.text, [], -1
        stop = bisect_left(self.stops, at)
        at = self.stops[stop] if stop < len(self.stops) else len(text)
        while (k := bisect_left(self.marks, at)) < len(self.marks):
            mark = self.marks[k]
            if text[mark] == ">":
                end = mark
                break
            if mark in self.known:
                end = self.known[mark]
                break
            passed.append(mark)
            quote = mark + 1
            while text[quote].isspace():
                quote += 1
            if (close := text.find(text[quote], quote + 1)) < 0:
                break
            at = close + 1
        self.known.update(dict.fromkeys(passed, end))
        return end


def _closes_itself(raw: str) -> bool:
    """Whether a tag's inside ends in a slash that is not the end of an unquoted value."""
    if not raw.endswith("/"):
        return False
    at = max(map(raw.rfind, " \t\n\r\f\v\"'>")) + 1
    return "=" not in raw[at:-1] and not raw[:at].rstrip().endswith("=")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    space: str = ""  # svg or math


class TreeBuilder:
    """Builds the tree of a page; never fails, whatever the markup."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}  # of the open elements by key, so that no rule walks a deep stack

    def feed(self, text: str) -> Node:
        at, end, ends = 0, len(text), None
        last = text.rfind(">")
        plain: list[str] = []  # text up to the next tag

        def flush() -> None:
            if plain:
                self.text(html.unescape("".join(plain)))
                plain.clear()

        while at < end:
            if text[at] == "<" and at + 1 < end:
                if text.startswith("<![CDATA[", at):
                    flush()
                    if self._foreign():
                        stop = text.find("]]>", at)
                        self.text(text[at + 9 : stop if stop >= 0 else end])
                        at = stop + 3 if stop >= 0 else end
                        continue
                named = at + 1 + (text[at + 1] == "/")
                if at > last and not text.startswith("<!--", at) or ends and text[named : named + 1].isalpha() and ends.of(named) < 0:
                    plain.append("<")
                    at += 1
                    continue
            m = _TOKEN.match(text, at)
            at = m.end()
            if m[2]:
                flush()
                tag = m[2].lower()
                if m[1]:
                    self.close(tag)
                elif self.open(tag, m[3]):
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, at)
                    raw = text[at : stop.start() if stop else end]
                    self.text(html.unescape(raw) if tag in ("textarea", "title") else raw)
                    at = stop.start() if stop else end
            elif m[0][0] != "<" or m[0] == "<":
                plain.append(m[0])
                if m[0] == "<" and not ends and text[at : at + 2].lstrip("/")[:1].isalpha():
                    ends = TagEnds(text)  # one tag without an end: look before each further one
        flush()
        return self.root

    def text(self, value: str) -> None:
        if value.strip():
            self._leave_columns()
            self._insert(value)
        else:
            self.stack[-1].children.append(value)

    def _last(self, keys: set[str]) -> int:
        """Place of the innermost open element of these keys; 0 if there is none."""
        return max((p[-1] for k in keys if (p := self.places.get(k))), default=0)

    def _cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[_key(self.stack.pop())].pop()

    def _foreign(self) -> bool:
        top = self.stack[-1]
        if not top.space or top.tag in HOLDS_HTML[top.space]:
            return False
        return top.tag != "annotation-xml" or top.attrs.get("encoding", "").lower() not in ("text/html", "application/xhtml+xml")

    def _between_parts(self) -> bool:
        """Whether the open element is a table or a row, outside of its cells."""
        top = self.stack[-1]
        return top.tag in TABLE_CONTEXT and not top.space and self._last({"table"}) > self._last({"template"})

    def _leave_columns(self) -> None:
        if self.stack[-1].tag == "colgroup" and not self.stack[-1].space:
            self._cut(len(self.stack) - 1)

    def _insert(self, child: Node | str) -> None:
        """Adds to the open element; what may not be between table parts is shown before the table."""
        if self._between_parts():
            self.stack[self._last({"table"}) - 1].children.insert(-1, child)
        else:
            self.stack[-1].children.append(child)

    def _until(self, tags: set[str], barrier: set[str]) -> None:
        """Closes the innermost of `tags`, unless an element of `barrier` is met first."""
        place = self._last(tags)
        if place and place > self._last(barrier - tags):
            self._cut(place)

    def open(self, tag: str, raw: str) -> bool:
        """Adds an element; true if raw text follows."""
        attrs = {}
        if raw and not raw.isspace():
            for a in _ATTRIBUTE.finditer(raw):
                attrs.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        closed = _closes_itself(raw)
        if self._foreign():
            if tag not in BREAKOUT and not (tag == "font" and attrs.keys() & {"color", "face", "size"}):
                node = Node(tag, attrs, space=self.stack[-1].space)
                self.stack[-1].children.append(node)
                if not closed:
                    self._enter(node)
                return False
            self._leave_foreign()
        cells = CELLS
        in_table = bool(self.places.get("table")) and self._last({"table"}) > self._last(INNER)
        if tag == "html" or tag == "body" and self.places.get("body") or in_table and tag in ("body", "head", "form"):
            return False  # a form between table parts holds nothing
        if tag in CLOSES_P:
            self._until({"p"}, cells | {"button", "object"})
        if tag in BLOCK and tag != "head":
            self._until({"head"}, cells)
        if tag == "table" and in_table:
            self._cut(self._last({"table"}))
        elif tag == "li":
            self._until({"li"}, LISTS | cells)
        elif tag in ("dt", "dd"):
            self._until({"dt", "dd"}, {"dl"} | cells)
        elif tag in ("option", "optgroup"):
            self._until({"option"} if tag == "option" else {"optgroup", "option"}, {"select", "datalist"} | cells)
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6") and self.stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._cut(len(self.stack) - 1)
        elif tag in ("caption", "colgroup", "tbody", "thead", "tfoot"):
            self._back_to({"table"})
        elif tag == "tr":
            self._back_to({"tbody", "thead", "tfoot", "table"})
            if self.stack[-1].tag == "table":
                self._push(Node("tbody"))
        elif tag in ("td", "th"):
            self._back_to({"tr", "tbody", "thead", "tfoot", "table"})
            if self.stack[-1].tag == "table":
                self._push(Node("tbody"))
            if self.stack[-1].tag in ("tbody", "thead", "tfoot"):
                self._push(Node("tr"))
        if tag not in ("col", "template"):
            self._leave_columns()
        node = Node(tag, attrs, space=tag if tag in HOLDS_HTML else "")
        if tag in IN_TABLE and tag != "table" or tag == "input" and attrs.get("type", "").lower() == "hidden":
            self.stack[-1].children.append(node)
        else:
            self._insert(node)
        if tag not in VOID and not (closed and node.space):
            self._enter(node)
        return tag in RAW

    def _enter(self, node: Node) -> None:
        self.places.setdefault(_key(node), []).append(len(self.stack))
        self.stack.append(node)

    def _push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        self._enter(node)

    def _leave_foreign(self) -> None:
        while self._foreign():
            self._cut(len(self.stack) - 1)

    def _back_to(self, tags: set[str]) -> None:
        """Leaves what is open inside the innermost table, down to one of `tags`."""
        place = self._last(tags)
        if place and place >= self._last({"table"}) and place > self._last({"template"}):
            self._cut(place + 1)

    def close(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag in ("br", "p"):
            self._leave_foreign()
        if tag == "br" or tag == "p" and not self.places.get("p"):
            self._leave_columns()
            self._insert(Node(tag))
            return
        barrier = set() if tag == "template" else {"template"} if tag == "table" else {"table", "template"} if tag in TABLE_PARTS else {"td", "th", "caption", "table", "template"}
        self._until({tag, f"svg {tag}", f"math {tag}"}, barrier)


def _key(node: Node) -> str:
    return f"{node.space} {node.tag}" if node.space else node.tag


_STYLE = re.compile(r"(display|visibility|white-space|text-align)\s*:\s*([a-z-]+)", re.I)


def _styles(node: Node) -> dict[str, str]:
    return {k.lower(): v.lower() for k, v in _STYLE.findall(node.attrs.get("style", ""))}


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum((not unicodedata.combining(c)) * (1 + (unicodedata.east_asian_width(c) in "WF")) for c in text)


class Page:
    """What a page's layout may still write. Nested tables write inner lines again at every level, and a wide cell pads
    every row: what goes beyond a page's share is told without alignment or indents, with all its text."""

    def __init__(self, length: int, max_indents: int = MAX_INDENTS) -> None:
        self.left, self.max_indents = LAYOUT_SHARE * length + LAYOUT_LEAST, max_indents

    def spend(self, n: int) -> bool:
        if n > self.left:
            return False
        self.left -= n
        return True


def flat(lines: list) -> Iterator[str]:
    """Lines in order; of lists inside, whatever their depth, those that are not blank."""
    stack = [iter(lines)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, list):
                stack.append(iter(x))
                break
            if x or len(stack) == 1:
                yield x
        else:
            stack.pop()


class Flow:
    """Lines of text under construction: collapses white space inside lines and margins between blocks."""

    def __init__(self, page: Page) -> None:
        self.page = page
        self.lines: list[str | list] = []  # a list holds the lines of a cell, as they were
        self.count = self.size = 0  # lines, and their characters, lists' among them
        self.parts: list[str] = []  # of the open line; none is empty
        self.gap = 0
        self.prefix: list[str] = []  # indents of the open blocks; a list marker replaces the last one once
        self.marker = ""

    def add(self, value: str) -> None:
        if value:
            self.parts.append(value)

    def text(self, value: str, pre: bool = False) -> None:
        if pre:
            first, *rest = value.replace("\r\n", "\n").split("\n")
            self.add(first.expandtabs(8))
            for x in rest:
                self.end_line(keep_empty=True)
                self.add(x.expandtabs(8))
            return
        value = _SPACE.sub(" ", value)
        if value[:1] == " " and (not self.parts or self.parts[-1][-1] == " "):
            value = value[1:]
        self.add(value)

    def end_line(self, keep_empty: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ")
        self.parts = []
        if line or keep_empty:
            self._emit(line)

    def _emit(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        indent = "".join(self.prefix[: self.page.max_indents])
        if not self.page.spend(len(indent)):
            indent = " " * len(self.marker)
        if self.marker:
            indent, self.marker = indent[: len(indent) - len(self.marker)] + self.marker, ""
        self.lines.append((indent + line).rstrip(" "))
        self.count += 1
        self.size += len(self.lines[-1])

    def below(self, inner: Flow) -> None:
        """The lines of a cell, but for blank ones, below what is there: as one list where nothing indents them."""
        lines = inner.result()
        if not lines:
            return
        if (self.prefix or self.marker) and self.page.spend(inner.size):
            for line in flat([lines]):
                self._emit(line)
            return
        if self.marker:
            self._emit("")
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append(lines)
        self.count += inner.count
        self.size += inner.size

    def block(self, blank: int) -> None:
        self.end_line()
        self.gap = max(self.gap, blank)

    def result(self) -> list[str | list]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def render(root: Node, page: Page) -> str:
    """Runs the steps below, each a generator of the steps inside it, on a stack of its own: any depth is laid out."""
    flow = Flow(page)
    steps = [_render(root, flow, False, True)]
    while steps:
        inner = next(steps[-1], None)
        if inner is None:
            steps.pop()
        else:
            steps.append(inner)
    return "\n".join(flat(flow.result()))


Steps = Iterator["Steps"]


def _children(node: Node, flow: Flow, pre: bool, shown: bool) -> Steps:
    for child in node.children:
        if isinstance(child, str):
            if shown and child:
                flow.text(child, pre)
        else:
            yield _render(child, flow, pre, shown)


def _drawn(node: Node, style: dict[str, str]) -> bool:
    return node.tag not in UNDRAWN and (style.get("display") or node.attrs.get("display", "")).strip().lower() != "none"


def _svg(node: Node, flow: Flow, shown: bool, inside: bool) -> Steps:
    """Text elements and embedded HTML of a drawing; they are apart from each other."""
    children = node.children
    if node.tag == "switch":
        fits = (c for c in children if isinstance(c, Node) and "requiredextensions" not in c.attrs and ("systemlanguage" not in c.attrs or re.search(r"\ben\b", c.attrs["systemlanguage"])))
        children = [c for c in [next(fits, None)] if c]
    for child in children:
        if isinstance(child, str):
            if inside and shown:
                flow.text(child)
            continue
        if not child.space:
            yield _render(child, flow, False, shown)
            continue
        style = _styles(child) if "style" in child.attrs else {}
        if not _drawn(child, style):
            continue
        seen = style.get("visibility") or child.attrs.get("visibility", "").strip().lower()
        seen = seen == "visible" if seen in ("visible", "hidden", "collapse") else shown
        if child.tag == "foreignobject":
            flow.text(" ")
            yield from _children(child, flow, False, seen)
            flow.text(" ")
        else:
            apart = child.tag == "text"
            if apart:
                flow.text(" ")
            yield _svg(child, flow, seen, apart or inside and child.tag in SVG_TEXT)
            if apart:
                flow.text(" ")


def _math(node: Node, flow: Flow, shown: bool) -> Steps:
    """A formula's symbols in order; the parts of fractions and matrices are apart from each other."""
    first = node.tag == "maction"
    for child in node.children:
        if isinstance(child, str):
            if shown and (child.strip() or node.tag == "mtext"):
                flow.text(child if node.tag == "mtext" else child.strip())
            continue
        if not child.space:
            yield _render(child, flow, False, shown)
            continue
        style = _styles(child) if "style" in child.attrs else {}
        if _drawn(child, style):
            yield _math(child, flow, style["visibility"] == "visible" if "visibility" in style else shown)
            if node.tag in ("mfrac", "mtr", "mtable"):
                flow.text(" ")
        if first:
            break


def _render(node: Node, flow: Flow, pre: bool, shown: bool) -> Steps:
    tag, style = node.tag, _styles(node) if "style" in node.attrs else {}
    if tag in HIDDEN or "hidden" in node.attrs or style.get("display") == "none" or tag == "dialog" and "open" not in node.attrs:
        return
    if "visibility" in style:
        shown = style["visibility"] == "visible"
    if "white-space" in style:
        pre = style["white-space"].startswith("pre")
    if node.space == "svg":
        if _drawn(node, style) and node.attrs.get("visibility", "").lower() not in ("hidden", "collapse"):
            yield _svg(node, flow, shown, False)
    elif node.space == "math":
        if node.attrs.get("display", "").lower() == "block":
            flow.block(0)
        yield _math(node, flow, shown)
        if node.attrs.get("display", "").lower() == "block":
            flow.block(0)
    elif tag == "br":
        flow.end_line(keep_empty=True)
    elif tag == "wbr" or tag == "img":
        return
    elif tag == "hr":
        flow.block(1)
    elif tag == "input":
        kind = node.attrs.get("type", "text").lower()
        if shown and kind not in ("hidden", "checkbox", "radio", "file", "password", "image", "color", "range"):
            flow.text(node.attrs.get("value") or node.attrs.get("placeholder") or "")
    elif tag == "select":
        options = _find(node, "option")
        chosen = [o for o in options if "selected" in o.attrs] or options[:1]
        for o in options if "multiple" in node.attrs else chosen[-1:]:
            yield from _children(o, flow, pre, shown)
            flow.text(" ")
    elif tag == "details" and "open" not in node.attrs:
        flow.block(0)
        for child in node.children:
            if isinstance(child, Node) and child.tag == "summary":
                yield _render(child, flow, pre, shown)
                break
        flow.block(0)
    elif tag == "table":
        flow.block(1)
        yield from _table(node, flow, shown)
        flow.block(1)
    elif tag in LISTS:
        yield from _list(node, flow, pre, shown)
    elif tag == "li":
        yield from _item(node, flow, pre, shown, "- ")
    elif tag == "q":
        flow.text("“" if shown else "")
        yield from _children(node, flow, pre, shown)
        flow.text("”" if shown else "")
    elif tag in BLOCK or style.get("display") in ("block", "flex", "grid", "list-item"):
        blank = 1 if tag in SPACED else 0
        flow.block(blank)
        indent = {"blockquote": "  ", "dd": "    "}.get(tag)
        if indent:
            flow.prefix.append(indent)
        yield from _children(node, flow, pre or tag in ("pre", "listing", "xmp", "plaintext"), shown)
        flow.end_line()
        if indent:
            flow.prefix.pop()
        flow.block(blank)
    else:
        yield from _children(node, flow, pre or tag == "textarea", shown)
        if tag in ("td", "th", "button"):
            flow.text(" ")


def _find(node: Node, tag: str) -> list[Node]:
    out, left = [], [node]
    while left:
        at = left.pop()
        if at.tag == tag and at is not node:
            out.append(at)
        else:
            left += [c for c in reversed(at.children) if isinstance(c, Node)]
    return out


def _whole(value: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return int(m[1]) if m else default


def _item(node: Node, flow: Flow, pre: bool, shown: bool, marker: str) -> Steps:
    flow.block(0)
    flow.prefix.append(" " * len(marker))
    flow.marker = marker if shown else ""
    yield from _children(node, flow, pre, shown)
    flow.end_line()
    if flow.marker:  # an empty item still shows its marker
        flow._emit("")
    flow.prefix.pop()


def _list(node: Node, flow: Flow, pre: bool, shown: bool) -> Steps:
    blank = 0 if flow.prefix else 1
    flow.block(blank)
    items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
    step = -1 if "reversed" in node.attrs else 1
    number = _whole(node.attrs.get("start"), len(items) if step < 0 else 1)
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            number = _whole(child.attrs.get("value"), number)
            if "hidden" in child.attrs or _styles(child).get("display") == "none":
                continue
            yield from _item(child, flow, pre, shown, f"{number}. " if node.tag == "ol" else "- ")
            number += step
        elif isinstance(child, Node):
            flow.prefix.append("  ")
            yield _render(child, flow, pre, shown)
            flow.end_line()
            flow.prefix.pop()
        elif shown:
            flow.text(child, pre)
    flow.block(blank)


def _gather(part: Node, into: list[Node], rows: list[Node], foot: list[Node], flow: Flow, shown: bool) -> Steps:
    """The rows of a table's part; captions go to the flow. No function inside _table(): it would hold all inner lines
    until Python looks for cycles."""
    for child in part.children:
        if not isinstance(child, Node) or child.tag in HIDDEN or "hidden" in child.attrs or _styles(child).get("display") == "none":
            continue
        if child.tag == "tr":
            into.append(child)
        elif child.tag in ("tbody", "thead"):
            yield from _gather(child, rows, rows, foot, flow, shown)
        elif child.tag == "tfoot":
            yield from _gather(child, foot, rows, foot, flow, shown)
        elif child.tag == "caption":
            yield from _children(child, flow, False, shown)
            flow.end_line()


def _table(node: Node, flow: Flow, shown: bool) -> Steps:
    """Cells in columns as wide as their widest line; spans take the columns they cover. See _aligned() and _told()."""
    rows: list[Node] = []
    foot: list[Node] = []
    yield from _gather(node, rows, rows, foot, flow, shown)
    rows += foot
    placed: list[list[Cell]] = []
    busy: np.ndarray | None = None  # of each column, the first row that is free again
    for r, row in enumerate(rows):
        c, own = 0, []
        for cell in row.children:
            if not isinstance(cell, Node) or cell.tag not in ("td", "th") or "hidden" in cell.attrs or _styles(cell).get("display") == "none":
                continue
            if busy is not None and c < MAX_COLUMNS and busy[c] > r:
                free = np.flatnonzero(busy[c:] <= r)
                c = c + int(free[0]) if len(free) else MAX_COLUMNS
            across = min(max(_whole(cell.attrs.get("colspan"), 1), 1), MAX_COLSPAN, MAX_COLUMNS - c)
            down = _whole(cell.attrs.get("rowspan"), 1)
            down = min(down, MAX_ROWSPAN) if down > 0 else len(rows) - r
            inner = Flow(flow.page)
            style = _styles(cell)
            yield from _children(cell, inner, style.get("white-space", "").startswith("pre"), shown and style.get("visibility", "visible") == "visible")
            inner.result()
            right = (style.get("text-align") or cell.attrs.get("align", "")).lower() in ("right", "end")
            own.append(Cell(c, across, inner, right))
            if down > 1:
                busy = np.zeros(MAX_COLUMNS, np.int64) if busy is None else busy
                busy[c : c + across] = np.maximum(busy[c : c + across], r + down)
            c += across
        placed.append(own)
    one_column = all(len(own) <= 1 and not any(cell.column or cell.right for cell in own) for own in placed)
    lines = None if one_column else _aligned(placed, flow.page)
    if lines is None:
        _told(placed, flow)
        return
    for line in lines:
        flow.add(line)
        flow.end_line()


@dataclass
class Cell:
    """column, columns that it covers (0 beyond MAX_COLUMNS), its content, whether it stands at the right."""

    column: int
    across: int
    flow: Flow
    right: bool


def _aligned(placed: list[list[Cell]], page: Page) -> list[str] | None:
    """The lines of a table with its cells in columns; None if the page has no share left for it."""
    if not page.spend(sum(cell.flow.size + cell.flow.count for own in placed for cell in own)):
        return None
    texts = [[list(flat(cell.flow.lines)) for cell in own] for own in placed]
    widths = np.zeros(MAX_COLUMNS, np.int64)
    needs = [(cell.across, cell.column, max(map(_width, lines), default=0)) for own, mine in zip(placed, texts, strict=True) for cell, lines in zip(own, mine, strict=True) if cell.across]
    for across, c, need in sorted(needs, key=lambda n: n[0]):
        have = int(widths[c : c + across].sum()) + 2 * (across - 1) if across > 1 else int(widths[c])
        widths[c + across - 1] += max(0, need - have)
    wide = widths > 0
    starts, sums, columns = ([0, *np.cumsum(x).tolist()] for x in (widths + 2 * wide, widths, wide))
    out, padding = [], 0
    for own, mine in zip(placed, texts, strict=True):
        for i in range(max(map(len, mine), default=0)):
            line, used = [], 0
            for cell, lines in zip(own, mine, strict=True):
                text, end = lines[i] if i < len(lines) else "", cell.column + cell.across
                if not cell.across:
                    begin = used + 2 if used and text else used
                else:
                    begin = starts[cell.column]
                    if cell.right and text:
                        room = sums[end] - sums[cell.column] + 2 * (columns[end] - columns[cell.column + 1])
                        begin += max(0, room - _width(text))
                if text:
                    padding += max(0, begin - used)
                    if padding > page.left:
                        return None
                    line += [" " * (begin - used), text]
                    used = max(used, begin) + _width(text)
            out.append("".join(line))
    page.spend(padding)
    return out


def _told(placed: list[list[Cell]], flow: Flow) -> None:
    """A table without columns: rows of short cells in a line each, other rows cell by cell."""
    for own in placed:
        if len(own) > 1 and all(cell.flow.count <= 1 for cell in own):
            flow.add("  ".join(line for cell in own for line in flat(cell.flow.lines) if line))
            flow.end_line()
        else:
            for cell in own:
                flow.below(cell.flow)


def extract(page: str | None, max_indents: int = MAX_INDENTS) -> str | None:
    """A page's visible text; null stays null. Levels of lists and quotes below `max_indents` are not indented further."""
    return None if page is None else render(TreeBuilder().feed(page), Page(len(page), max_indents))


def visible_text(pages: DataFrame, html_column: str = "html", key: str = "page_id", max_indents: int = MAX_INDENTS) -> DataFrame:
    """Per row: key, text (null for a null page, empty where nothing is shown), n_lines, n_chars.

    Repeated rows stay; other columns are not read. One narrow stage. Layout writes at most LAYOUT_SHARE characters for
    each one of a page, and LAYOUT_LEAST: tables beyond that are told without columns, with all their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [extract(p, max_indents) for p in part.column(1).to_pylist()]
                lines = [t.count("\n") + 1 if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], ["k", "text", "n_lines", "n_chars"])

    rows = pages.select(pages[key].alias("k"), pages[html_column].cast("string").alias("h"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, text string, n_lines long, n_chars long").withColumnRenamed("k", key)
