"""Layout-aware rendering of HTML as text.

A tree builder closes and opens tags as HTML implies them, visibility rules drop what a reader
would not see, and the rest is laid out: blocks on lines of their own, paragraphs, headings, lists
and tables apart from each other, list items with marks and indents, table cells aligned.

Tokenizer, tree builder and renderer take a time that grows with the page, however it is nested or
broken: each character is read once, open elements are found by name, and lines are written once.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm import bpe
from kindred.llm.common import ship

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style template noscript head title meta link iframe object audio video canvas datalist annotation annotation-xml noembed noframes rp defs desc metadata".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td textarea tfoot th thead tr ul caption".split())
_APART = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir fieldset".split())
_LISTS = frozenset(["ul", "ol", "menu", "dir"])
#: Elements whose content is text up to their end tag; of the latter two it may have character references.
_RAW = frozenset(["script", "style", "xmp", "iframe", "noembed", "noframes", "textarea", "title"])
_REFERENCES = frozenset(["textarea", "title"])
#: A start tag on the left ends an open element on the right, up to the scope that follows.
_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption", "colgroup"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
_PARAGRAPH, _HEAD, _BODY = frozenset(["p"]), frozenset(["head"]), frozenset(["body"])
_PARAGRAPH_SCOPE = frozenset(["td", "th", "table", "button", "caption", "html"])
_IN_TABLE, _IN_CELL = frozenset(["table"]), frozenset(["td", "th", "table"])
_ROW_GROUPS = frozenset(["thead", "tbody", "tfoot"])
#: A cell wider than this, or than the cells of its column that aren't, is followed by a line break:
#: the row goes on in the next line, at the next cell's column.
_WIDEST = 60
#: Indents don't grow beyond this; marks of list items do.
_DEEPEST = 80
#: Spans of cells as HTML limits them.
_MOST_COLUMNS, _MOST_ROWS = 1_000, 65_534
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!\s*important\s*)?(?:;|$)", re.IGNORECASE)

_NAME = re.compile(r"[^ \t\n\f/>]+")
_BETWEEN = re.compile(r"[ \t\n\f/]*")
_ATTRIBUTE = re.compile(r"=?[^ \t\n\f/>=]*")
_EQUALS = re.compile(r"[ \t\n\f]*=[ \t\n\f]*")
_BARE = re.compile(r"[^ \t\n\f>]*")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[ \t\n\f/>])", re.IGNORECASE) for t in _RAW}


def _tag(page: str, at: int) -> tuple[str, dict[str, str], int]:
    """Name, attributes and end of the tag whose name is at ``at``; the end is -1 if the page ends within."""
    m = _NAME.match(page, at)
    name, at, attrs = m[0].lower(), m.end(), {}
    while True:
        at = _BETWEEN.match(page, at).end()
        if at >= len(page):
            return name, attrs, -1
        if page[at] == ">":
            return name, attrs, at + 1
        m = _ATTRIBUTE.match(page, at)
        key, at, value = m[0].lower(), m.end(), ""
        if m := _EQUALS.match(page, at):
            at = m.end()
            if page[at : at + 1] in ('"', "'"):
                end = page.find(page[at], at + 1)
                if end < 0:
                    return name, attrs, -1
                value, at = page[at + 1 : end], end + 1
            else:
                m = _BARE.match(page, at)
                value, at = m[0], m.end()
        attrs.setdefault(key, entities.unescape(value) if "&" in value else value)


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """("text", text, None), ("start", tag, attributes) and ("end", tag, None), in order."""
    page = page.replace("\r\n", "\n").replace("\r", "\n")
    at, n = 0, len(page)
    while at < n:
        mark = page.find("<", at)
        mark = n if mark < 0 else mark
        if mark > at:
            yield "text", entities.unescape(page[at:mark]), None
        at = mark
        kind = page[at + 1 : at + 2]
        if at >= n:
            return
        if kind.isascii() and kind.isalpha():
            tag, attrs, at = _tag(page, at + 1)
            if at < 0:
                return
            yield "start", tag, attrs
            if tag == "plaintext":
                yield "text", page[at:], None
                return
            if tag in _RAW:
                m = _RAW_END[tag].search(page, at)
                end = m.start() if m else n
                if end > at:
                    yield "text", entities.unescape(page[at:end]) if tag in _REFERENCES else page[at:end], None
                at = end
        elif kind == "/" and (first := page[at + 2 : at + 3]).isascii() and first.isalpha():
            tag, _, at = _tag(page, at + 2)
            if at < 0:
                return
            yield "end", tag, None
        elif page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):
                at = page.index(">", at) + 1
            else:
                m = _COMMENT_END.search(page, at + 4)
                at = m.end() if m else n
        elif kind in ("!", "?") or kind == "/" and at + 2 < n:
            end = page.find(">", at)
            at = end + 1 if end >= 0 else n
        else:
            yield "text", "<", None
            at += 1


class Node:
    __slots__ = ("tag", "attrs", "children", "nests")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.nests = False  # whether a table has a table within


class TreeBuilder:
    """Builds a tree in which implied tags are explicit."""

    def __init__(self, page: str):
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list, {"html": [0]})  # of open elements, by tag
        self.fresh = False  # a line end that comes first in pre and textarea doesn't count
        for kind, what, attrs in tokens(page):
            if kind == "text":
                self.text(what[1:] if self.fresh and what[0] == "\n" else what)
                self.fresh = False
            elif kind == "start":
                self.start(what, attrs)
                self.fresh = what in ("pre", "textarea", "listing")
            else:
                self.end(what)
                self.fresh = False

    def _last(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close(self, tags: frozenset[str], scope: frozenset[str]) -> None:
        """End the innermost of ``tags``, unless an element of ``scope`` is open within it."""
        at = self._last(tags)
        if at > 0 and at > self._last(scope - tags):
            while len(self.open) > at:
                self._pop()

    def _pop(self) -> None:
        self.places[self.open.pop().tag].pop()

    def _add(self, node: Node, stays: bool) -> None:
        self.open[-1].children.append(node)
        if stays:
            if node.tag == "table" and (outer := self._last(_IN_TABLE)) > 0:
                self.open[outer].nests = True
            self.places[node.tag].append(len(self.open))
            self.open.append(node)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            return
        if tag in _BLOCK and tag not in ("optgroup", "textarea"):
            self._close(_PARAGRAPH, _PARAGRAPH_SCOPE)
        if tag in _BLOCK or tag in _ENDS:
            self._close(_HEAD, _BODY)
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        top = self.open[-1].tag
        if tag in ("td", "th") and top in ("table", *_ROW_GROUPS):
            self._add(Node("tr", {}), True)
        if tag[0] == "h" and tag[1:].isdigit() and top[0] == "h" and top[1:].isdigit():
            self._pop()
        self._add(Node(tag, attrs), tag not in _VOID)

    def end(self, tag: str) -> None:
        if tag == "p" and not self.places.get("p"):
            self._add(Node("p", {}), False)
            return
        if tag == "br":
            self._add(Node("br", {}), False)
            return
        if tag in ("html", "body"):
            return
        if self.open[-1].tag == tag and len(self.open) > 1:
            self._pop()
            return
        self._close(frozenset([tag]), _IN_TABLE if tag in ("tr", "table", *_ROW_GROUPS) else _IN_CELL)

    def text(self, data: str) -> None:
        if data:
            if self.open[-1].tag == "head" and not data.isspace():
                self._pop()
            self.open[-1].children.append(data)


def visible(node: Node) -> bool:
    if node.tag in _UNSEEN or "hidden" in node.attrs:
        return False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False
    return not _STYLE.search(node.attrs.get("style", ""))


class Lines:
    """Lines under construction: spaces and blank lines collapse, indents and marks come first."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.gap = False
        self.start = 0  # of the innermost container
        self.indent = ""
        self.marks: list[str] = []  # of list items without a line so far, in place of the end of the indent
        self.base = ""  # the indent before them

    def write(self, text: str, kept: bool = False) -> None:
        if kept:
            for k, line in enumerate(text.split("\n")):
                if k:
                    self.end(True)
                if line:
                    self.parts.append(line)
            self.space = False
            return
        text = _SPACE.sub(" ", text)
        word = text.strip(" ")
        if word:
            if self.parts and (self.space or text[0] == " "):
                self.parts.append(" ")
            self.parts.append(word)
            self.space = text[-1] == " "
        elif text:
            self.space = True

    def end(self, always: bool = False) -> None:
        if self.parts or always:
            line = "".join(self.parts).rstrip()
            begun = len(self.lines) > self.start
            if line:
                if self.gap and begun:
                    self.lines.append("")
                self.lines.append((self.base + "".join(self.marks) if self.marks else self.indent) + line)
                self.marks = []
                self.gap = False
            elif begun and not self.gap:
                self.lines.append("")
        self.parts, self.space = [], False

    def apart(self) -> None:
        self.end()
        self.gap = True

    def enter(self, mark: str, spaces: int) -> tuple:
        """Begin a container that is indented by ``spaces``, with a mark before its first line."""
        self.end()
        if self.gap and len(self.lines) > self.start:
            self.lines.append("")
        state = self.start, self.indent, len(self.lines), len(self.marks)
        if not self.marks:
            self.base = self.indent
        self.gap, self.start = False, len(self.lines)
        if mark or self.marks:
            self.marks.append(mark or " " * spaces)
        if len(self.indent) < _DEEPEST:
            self.indent += " " * spaces
        return state

    def leave(self, state: tuple) -> None:
        self.end()
        while len(self.lines) > self.start and not self.lines[-1]:
            self.lines.pop()
        self.start, self.indent, n, marks = state
        if len(self.lines) == n:  # nothing came: neither does the mark, nor a blank line before it
            del self.marks[marks:]
            if len(self.lines) > self.start and not self.lines[-1]:
                self.lines.pop()
                self.gap = True
            return
        self.gap = False

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _number(text: str, least: int, most: int, otherwise: int) -> int:
    """A number as HTML reads it: leading digits, within limits."""
    m = re.match(r"[ \t\n\f\r]*([+-]?)([0-9]+)", text)
    if not m:
        return otherwise
    digits = m[2].lstrip("0")[:12] or "0"
    return min(most, max(least, -int(digits) if m[1] == "-" else int(digits)))


class Table:
    """What a table has, by row: cells with their columns; and text that stands outside of them."""

    def __init__(self, node: Node):
        self.rows: list[list[tuple[int, Node]]] = []
        self.loose: list[str | Node] = []
        self.held: dict[int, int] = {}  # columns that a cell above reaches into, and for how many rows yet
        waiting = [iter(node.children)]
        while waiting:
            for child in waiting[-1]:
                if isinstance(child, str):
                    self._loose(child)
                elif visible(child):
                    if child.tag in _ROW_GROUPS or child.tag == "form":
                        self.held = {}
                        waiting.append(iter(child.children))
                        break
                    if child.tag == "tr":
                        self._row(child)
                    elif child.tag not in ("colgroup", "col"):
                        self.loose.append(child)
            else:
                waiting.pop()

    def _loose(self, child: str | Node) -> None:
        if not isinstance(child, str) or not child.isspace():
            self.loose.append(child)

    def _row(self, node: Node) -> None:
        cells, column, new = [], 0, {}
        for cell in node.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                if isinstance(cell, str) or visible(cell):
                    self._loose(cell)
                continue
            if not visible(cell):
                continue
            while column in self.held:
                column += 1
            cells.append((column, cell))
            wide = _number(cell.attrs.get("colspan", ""), 1, _MOST_COLUMNS, 1)
            deep = _number(cell.attrs.get("rowspan", ""), 0, _MOST_ROWS, 1) or _MOST_ROWS
            if deep > 1:
                new |= dict.fromkeys(range(column, column + wide), deep - 1)
            column += wide
        self.held = {k: n - 1 for k, n in self.held.items() if n > 1} | new
        self.rows.append(cells)

    def aligned(self) -> list[str]:
        """A line for each row, and further ones after cells that are wider than their column."""
        rows = [[(k, " ".join(x.strip() for x in render_node(c) if x.strip()), _number(c.attrs.get("colspan", ""), 1, _MOST_COLUMNS, 1)) for k, c in r] for r in self.rows]
        rows = [r for r in rows if any(t for _, t, _ in r)]
        wide: dict[int, int] = {}
        for r in rows:
            for k, text, span in r:
                w = _width(text) if span == 1 else 0
                wide[k] = max(wide.get(k, 0), w if w <= _WIDEST else 0)
        place, at = {}, 0
        for k in sorted(wide):
            place[k] = at
            at += wide[k] + 2
        lines = []
        for r in rows:
            line, width = [], 0
            for k, text, _ in r:
                if not text:
                    continue
                if line and width + 2 > place[k]:
                    lines.append("".join(line))
                    line, width = [], 0
                line += [" " * (place[k] - width), text]
                width = place[k] + _width(text)
            lines.append("".join(line))
        return lines


def _selected(node: Node) -> list[Node]:
    """The options of a select that are seen: all of a list box, else the selected one or the first."""
    options, waiting = [], [iter(node.children)]
    while waiting:
        for child in waiting[-1]:
            if not isinstance(child, str) and visible(child):
                if child.tag == "option":
                    options.append(child)
                else:
                    waiting.append(iter(child.children))
                    break
        else:
            waiting.pop()
    if "multiple" in node.attrs or _number(node.attrs.get("size", ""), 0, 10_000, 1) > 1:
        return options
    return ([o for o in options if "selected" in o.attrs][-1:] or options[:1])


_SHOWN_INPUTS = frozenset(["", "text", "search", "email", "url", "tel", "number", "submit", "button", "reset"])


def render_node(node: Node) -> list[str]:
    """The lines of what is within a node."""
    out = Lines()
    waiting: list[tuple[Iterator, Node, bool, list[int], Callable[[], None] | None]] = []

    def within(at: Node, kept: bool, then: Callable[[], None] | None = None, children: Iterable | None = None) -> None:
        number = [_number(at.attrs.get("start", ""), -999_999_999, 999_999_999, 1)]
        waiting.append((iter(at.children if children is None else children), at, kept, number, then))

    def table(at: Node, kept: bool) -> None:
        found = Table(at)
        out.apart()
        state = out.enter("", 0)

        def then() -> None:
            out.leave(state)
            out.apart()

        def rows() -> None:
            out.end()
            if at.nests or all(len(r) <= 1 for r in found.rows):  # such a table lays out what it holds
                cells = Node("div", {})
                cells.children = [c for r in found.rows for _, c in r]
                within(cells, kept, then)
            else:
                for line in found.aligned():
                    out.parts = [line]
                    out.end()
                then()

        within(at, kept, rows, found.loose)

    def element(child: Node, parent: Node, kept: bool, number: list[int]) -> None:
        tag = child.tag
        if tag == "br":
            out.end(True)
        elif tag == "table":
            table(child, kept)
        elif tag == "select":
            within(child, kept, None, [x for option in _selected(child) for x in (" ", option, " ")])
        elif tag == "text":  # of a drawing
            out.write(" ")
            inside(child, kept, lambda: out.write(" "))
        elif tag == "input":
            if child.attrs.get("type", "").lower() in _SHOWN_INPUTS:
                out.write(f" {child.attrs.get('value', '')} ")
        elif parent.tag in _LISTS:
            mark = ""
            if tag == "li":
                mark = f"{number[0]}. " if parent.tag == "ol" else "- "
                number[0] += 1
            state = out.enter(mark, len(mark) or 2)
            inside(child, kept, lambda: out.leave(state))
        elif tag in ("blockquote", "dd"):
            edge = out.apart if tag == "blockquote" else out.end
            edge()
            state = out.enter("", 2)

            def after() -> None:
                out.leave(state)
                edge()

            within(child, kept, after)
        elif tag in _BLOCK:
            edge = out.apart if tag in _APART else out.end
            edge()
            inside(child, kept or tag in ("pre", "textarea"), edge)
        else:
            inside(child, kept, None)

    def inside(child: Node, kept: bool, then: Callable[[], None] | None) -> None:
        if child.tag == "details" and "open" not in child.attrs:
            within(child, kept, then, [c for c in child.children if not isinstance(c, str) and c.tag == "summary"])
        else:
            within(child, kept, then)

    within(node, node.tag in ("pre", "textarea"))
    while waiting:
        children, parent, kept, number, then = waiting[-1]
        for child in children:
            if isinstance(child, str):
                out.write(child, kept)
            elif visible(child):
                before = len(waiting)
                element(child, parent, kept, number)
                if len(waiting) > before:
                    break
        else:
            waiting.pop()
            if then is not None:
                then()
    return out.done()


def extract(page: str | None) -> str:
    """All visible text of a page, laid out; empty for null."""
    return "\n".join(render_node(TreeBuilder(page).root)) if page else ""


def _pages(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in bpe.blocks(batches, "html", 4_000_000):
        out = [extract(x) for x in block.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([block.column("page_id").combine_chunks().cast(pa.int64()), pa.array(out, pa.string())], ["page_id", "text"])


def render_pages(pages: DataFrame) -> DataFrame:
    """page_id and text of every row of ``pages`` (page_id, html).

    Null and empty pages have an empty text; repeated rows are rendered each for itself; an empty
    table gives no rows; further columns don't matter. Pages are parsed whole, in a time that grows
    with their length. Style sheets aren't evaluated: inline styles, ``hidden`` and the elements'
    own rules say what is visible. Texts of forms that a reader sees are: areas, values of fields
    and buttons, the chosen option.

    Cells stand in columns, spans over columns and rows counted. A table that has a table within,
    or one cell a row, is layout: its cells follow each other as blocks.
    """
    ship(pages.sparkSession)
    return pages.select("page_id", "html").mapInArrow(_pages, "page_id long, text string")
