"""HTML extraction by layout-aware rendering.

Method.  A tokenizer splits a page into tags and text; a tree builder adds what tags imply (a second ``<li>`` closes the
first, a block closes an open ``<p>``, rows and cells close each other, stray end tags are ignored) and follows
visibility: elements that never show (scripts, styles, head matter, templates), the ``hidden`` attribute,
``display:none`` and ``visibility:hidden``, out of which a child may come with ``visibility:visible``.  Drawings and
formulas give their text, a list of options the chosen one, or all where all are on view.  The tree is rendered to all visible text: blocks on lines of
their own with blank lines between paragraphs, ``<br>`` as a line break, list items behind a mark or number and indented
by depth, preformatted text as it stands, and the cells of a table padded to columns, across columns and rows.

Scale.  One pass without a shuffle; a page is the unit, and time and memory are linear in its length (a table's cells are
measured once; what follows an unclosed tag or quote is looked at once).  Nesting deeper than ``DEPTH`` is rendered flat.

Defined results: null stays null; an empty page has an empty text; broken markup never fails: an unclosed tag is text,
an unclosed comment or script runs to the end; an empty table of pages gives an empty table; repeated rows give equal rows; other columns pass through.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

DEPTH = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title noscript template iframe object audio video canvas datalist map desc metadata defs annotation annotation-xml".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure fieldset hr article section".split())
BLOCK = SPACED | frozenset("html body div header footer main nav aside address form li dt dd details summary figcaption center dir menu legend search".split())
CELLS, ROWS, GROUPS = frozenset(("td", "th")), frozenset(("tr",)), frozenset("thead tbody tfoot".split())
#: start tag -> (open elements that it closes, elements beyond which it doesn't look)
CLOSES = (
    {t: (frozenset(("p",)), frozenset("table td th button caption".split())) for t in BLOCK - {"html", "body", "li", "dt", "dd"}}
    | {
        "li": (frozenset(("li", "p")), frozenset("ul ol menu dir table td th".split())),
        "dt": (frozenset(("dt", "dd", "p")), frozenset("dl table td th".split())),
        "dd": (frozenset(("dt", "dd", "p")), frozenset("dl table td th".split())),
        "tr": (frozenset("tr td th caption p".split()), frozenset("table thead tbody tfoot".split())),
        "td": (frozenset("td th p caption".split()), frozenset("tr table".split())),
        "th": (frozenset("td th p caption".split()), frozenset("tr table".split())),
        "option": (frozenset(("option",)), frozenset(("select",))),
        "body": (frozenset(("head",)), frozenset()),
    }
    | {t: (frozenset("thead tbody tfoot tr td th caption p".split()), frozenset(("table",))) for t in GROUPS}
)

#: elements whose content closes nothing outside of them, and what may stand in a head: anything else ends it
CLOSED_IN = UNSEEN - {"head"} | {"svg", "math", "select"}
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())

_TOKEN = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*+)|[!?/])", re.S)
_SPECIAL = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?=;|$)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\s*(?:!\s*important\s*)?(?=;|$)", re.I)
_MAYBE = re.compile(r"hidden|style", re.I)
_NUMBER = re.compile(r"\s*(-?\d{1,9})")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


class Element:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []


def values(attributes: str) -> dict[str, str]:
    """Attributes by name; of a repeated one the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def number_of(element: "Element", name: str) -> int | None:
    if name not in element.attributes.lower():
        return None
    m = _NUMBER.match(values(element.attributes).get(name, ""))
    return int(m[1]) if m else None


def hidden(name: str, attributes: str) -> bool | str:
    """Whether attributes hide the element: ``hidden``, a style, or the type of an input; what only hides it from
    screen readers doesn't count.  ``"ghost"`` and ``"visible"``: its visibility, which children may set anew."""
    if not _MAYBE.search(attributes):
        return False
    held = values(attributes)
    if "hidden" in held or name == "input" and held.get("type", "").strip().lower() == "hidden":
        return True
    style = re.sub(r"/\*.*?\*/", "", held.get("style", ""), flags=re.S)
    if _NONE.search(style):
        return True
    shown = _VISIBILITY.findall(style)
    return False if not shown else "visible" if shown[-1].lower() == "visible" else "ghost"


class Ends:
    """Where tags end: at the first ``>`` outside quotes.  The fate of each quote is worked out once."""

    def __init__(self, page: str):
        self.page, self.fate, self.searched, self.found = page, {}, 0, -2

    def _special(self, at: int) -> int:
        """Place of the next ``>`` or quote, -1 if there is none."""
        if self.searched <= at and (self.found == -1 or at <= self.found):
            return self.found
        m = _SPECIAL.search(self.page, at)
        self.searched, self.found = at, m.start() if m else -1
        return self.found

    def after(self, at: int) -> int:
        """Place behind the tag whose attributes begin at ``at``, -1 if it is never closed."""
        way, x = [], self._special(at)
        while True:
            if x < 0 or x in self.fate:
                end = self.fate.get(x, -1)
                break
            way.append(x)
            if self.page[x] == ">":
                end = x + 1
                break
            close = self.page.find(self.page[x], x + 1)
            if close < 0:
                end = -1
                break
            m = _SPECIAL.search(self.page, close + 1)
            x = m.start() if m else -1
        for x in way:
            self.fate[x] = end
        return end


def tree(page: str) -> Element:
    """The page's visible elements and texts, with implied tags."""
    root = Element("html")
    stack, names, ghosts = [root], ["html"], [False]
    unseen = 0  # depth below the first element that doesn't show
    skipped: dict[str, int] = {}  # elements below DEPTH, whose end tags close nothing
    begin = look = 0
    n, last = len(page), page.rfind(">")
    search, ends = _TOKEN.search, Ends(page)

    def cut(k: int) -> None:
        nonlocal unseen
        del stack[k:], names[k:], ghosts[k:]
        unseen = 0 if k <= unseen else unseen
        skipped.clear()

    def open_place(name: str) -> int:
        k = len(names) - 1
        while k >= 0 and names[k] != name:
            k -= 1
        return k

    while begin < n:
        m = search(page, look)
        while m and m["comment"] is None:
            stop = -1 if m.start() > last else ends.after(m.end()) if m["name"] else page.find(">", m.end()) + 1 or -1
            if stop >= 0:
                break
            # never closed: text; what begins within its name isn't either, but for a comment
            comment = page.find("<!--", m.start() + 1, n if m.start() > last else m.end() + 3)
            m = search(page, comment if comment >= 0 else m.end()) if comment >= 0 or m.start() <= last else None
        end = m.start() if m else n
        if end > begin and names[-1] == "head" and page[begin:end].strip():
            cut(len(stack) - 1)
        if end > begin and not unseen and not ghosts[-1]:
            stack[-1].children.append(html.unescape(page[begin:end]) if "&" in page[begin:end] else page[begin:end])
        if not m:
            break
        name = m["name"]
        begin = look = m.end() if m["comment"] is not None else stop
        if not name:
            continue
        name = name.lower()
        if m["close"]:
            if skipped.get(name):
                skipped[name] -= 1
                continue
            k = open_place(name)
            if unseen:
                if k >= unseen or k >= 0 and name in BLOCK and name != "p":
                    if k:
                        cut(k)
                    else:
                        unseen = 0
            elif k >= 0:
                # an inline end tag doesn't reach out of the block or cell that holds it
                if k and (name in BLOCK or name in CELLS or name in ROWS or name in GROUPS or name == "table" or not any(x in BLOCK or x in CELLS for x in names[k + 1 :])):
                    cut(k)
            elif name == "p":
                stack[-1].children.append(Element("p"))
            elif name == "br":
                stack[-1].children.append(Element("br"))
            continue
        attributes = page[m.end("name") : stop - 1]
        if names[-1] == "head" and name not in IN_HEAD:
            cut(len(stack) - 1)
        if name in CLOSES:
            closed, fence = CLOSES[name]
            k = len(names) - 1
            found = None
            while k > 0 and names[k] not in fence and names[k] not in CLOSED_IN:
                if names[k] in closed:
                    found = k
                elif names[k] in BLOCK and names[k] not in ("div", "p", "address") and name != "body":
                    break
                k -= 1
            if found:
                cut(found)
        if name in VOID or attributes.endswith("/") and ("svg" in names or "math" in names or name == "svg"):
            if not unseen and not (attributes and hidden(name, attributes) is True):
                stack[-1].children.append(Element(name, attributes))
            continue
        hides = name in UNSEEN or bool(attributes) and hidden(name, attributes)
        ghost = ghosts[-1] if hides not in ("ghost", "visible") else hides == "ghost"
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, begin)
            if name not in UNSEEN and not unseen and hides is not True and not ghost:
                inner = Element(name)
                inner.children.append(html.unescape(page[begin : close.start() if close else n]))
                stack[-1].children.append(inner)
            begin = look = close.end() if close else n
            continue
        if name == "html" or name == "body" and "body" in names:
            continue
        element = Element(name, attributes)
        if len(stack) >= DEPTH and (unseen or hides is not True):
            skipped[name] = skipped.get(name, 0) + 1
            continue
        if not unseen and hides is not True:
            stack[-1].children.append(element)
        stack.append(element)
        names.append(name)
        ghosts.append(ghost)
        if hides is True and not unseen:
            unseen = len(stack) - 1
    return root


class Lines:
    """Text under way: words flow into the line, breaks and blank lines are asked for."""

    __slots__ = ("out", "line", "gap", "space", "indent", "mark", "begun")

    def __init__(self, indent: str = ""):
        self.out, self.line, self.gap, self.space, self.indent, self.mark, self.begun = [], [], 0, False, indent, None, False

    def flow(self, text: str) -> None:
        words = text.split()
        if not words:
            self.space = True
            return
        if self.line and (self.space or text[0].isspace()):
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = text[-1].isspace()

    def end(self, gap: int = 0) -> None:
        """End the line; at least ``gap`` blank lines before the next one."""
        if self.line:
            self.add("".join(self.line))
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap)

    def add(self, line: str) -> None:
        if self.out and self.gap:
            self.out.append("")
        self.gap = 0
        lead = self.indent
        if self.mark is not None:
            lead, self.mark = self.indent[: len(self.indent) - len(self.mark)] + self.mark, None
        self.out.append((lead + line).rstrip())


def _render(element: Element, to: Lines, lists: int = 0) -> None:
    number = None
    if element.name == "ol":
        number = number_of(element, "start")
        number = 1 if number is None else number
    for child in element.children:
        if isinstance(child, str):
            to.flow(child)
            continue
        name = child.name
        if name == "br":
            if to.line:
                to.end()
            else:
                to.gap = 1 if to.out else 0
        elif name == "hr":
            to.end(1)
        elif name == "img":
            continue
        elif name == "select":
            shown = _options(child)
            to.flow(" " + " ".join(shown) + " " if shown else " ")
        elif name in ("pre", "textarea", "xmp"):
            to.end(1)
            for line in _plain(child).strip("\n").split("\n"):
                if line.strip():
                    to.add(line.rstrip())
                elif to.out:
                    to.gap = 1
            to.end(1)
        elif name == "table":
            to.end(1)
            for line in _table(child):
                to.add(line)
            to.end(1)
        elif name == "li":
            to.end()
            if number is not None and child.attributes:
                told = number_of(child, "value")
                number = number if told is None else told
            mark = f"{number}. " if number is not None else "- "
            number = None if number is None else number + 1
            to.indent += " " * len(mark)
            to.mark = mark
            _render(child, to, lists)
            to.end()
            to.indent = to.indent[: len(to.indent) - len(mark)]
            to.mark = None
        elif name in ("ul", "ol", "menu", "dir"):
            to.end(0 if lists else 1)
            _render(child, to, lists + 1)
            to.end(0 if lists else 1)
        elif name == "dd":
            to.end()
            to.indent += "    "
            _render(child, to, lists)
            to.end()
            to.indent = to.indent[:-4]
        elif name in BLOCK:
            gap = 1 if name in SPACED else 0
            to.end(gap)
            _render(child, to, lists)
            to.end(gap)
        elif name in CELLS or name in ROWS or name in GROUPS or name == "caption":
            to.end()
            _render(child, to, lists)
            to.end()
        else:
            _render(child, to, lists)


def _plain(element: Element) -> str:
    return "".join("\n" if not isinstance(c, str) and c.name == "br" else c if isinstance(c, str) else _plain(c) for c in element.children)


def _options(select: Element) -> list[str]:
    """The options on view: the chosen one, or the first; all of a list that shows several."""
    options, todo = [], list(reversed(select.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            continue
        if x.name == "option":
            options.append(x)
        else:
            todo += reversed(x.children)
    held = values(select.attributes)
    if "multiple" not in held and (number_of(select, "size") or 1) < 2:
        chosen = [x for x in options if "selected" in values(x.attributes)]
        options = chosen[-1:] or options[:1]
    return [t for t in (_plain(x).strip() for x in options) if t]


def _rows(element: Element):
    for child in element.children:
        if isinstance(child, str):
            if child.strip():
                yield "text", child
        elif child.name == "tr":
            yield "row", child
        elif child.name in GROUPS:
            yield from _rows(child)
        else:
            yield "text", child


def _cell(element) -> list[str]:
    lines = Lines()
    if isinstance(element, str):
        lines.flow(element)
    else:
        _render(element, lines)
    lines.end()
    return lines.out


def _table(table: Element) -> list[str]:
    """Lines with the cells of a column one below the other, two spaces apart; a cell over several rows keeps its columns
    free in the rows below."""
    grid: list = []
    taken: dict[int, int] = {}  # columns that cells from above still hold, and for how many rows
    for kind, row in _rows(table):
        if kind == "text":
            grid.append(_cell(row))
            continue
        cells, k, begun = [], 0, {}
        for child in row.children:
            if isinstance(child, str) and not child.strip():
                continue
            plain = isinstance(child, str) or not child.attributes
            span = 1 if plain else min(50, max(1, number_of(child, "colspan") or 1))
            down = 1 if plain else number_of(child, "rowspan")
            while k in taken:
                k += 1
            cells.append((k, span, _cell(child)))
            if down is not None and (down > 1 or down == 0):
                begun |= {c: (down or 65_535) - 1 for c in range(k, k + span)}
            k += span
        taken = {c: left - 1 for c, left in taken.items() if left > 1} | begun
        grid.append(tuple(cells))
    widths: list[int] = []
    for row in grid:
        if isinstance(row, tuple):
            for k, span, lines in row:
                widths += [0] * (k + span - len(widths))
                if span == 1:
                    widths[k] = max(widths[k], max(map(len, lines), default=0))
    places = [0]
    for w in widths:
        places.append(places[-1] + w + 2)
    out: list[str] = []
    for row in grid:
        if not isinstance(row, tuple):
            out += row
            continue
        for i in range(max((len(lines) for _, _, lines in row), default=0)):
            parts, at = [], 0
            for k, _, lines in row:
                gap = max(places[k] - at, 2 if at else 0)
                text = lines[i] if i < len(lines) else ""
                parts += (" " * gap, text)
                at += gap + len(text)
            out.append("".join(parts).rstrip())
    return out


def rendered(page: str | None) -> str | None:
    """All visible text of a page."""
    if page is None:
        return None
    lines = Lines()
    _render(tree(page), lines)
    lines.end()
    return "\n".join(lines.out).strip("\n")


def extracted(pages: DataFrame, column: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the visible text in place of ``column``; a column that already has the name ``to`` gives way."""
    others = [c for c in pages.columns if c not in (column, to)]
    schema = T.StructType([*[pages.schema[c] for c in others], T.StructField(to, T.StringType())])

    def run(batches):
        for batch in batches:
            texts = pa.array([rendered(t.as_py()) for t in batch.column(len(others))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=schema.names)

    named = [F.col("`" + c.replace("`", "``") + "`") for c in others]
    return map_batches(pages.select(*named, F.col(column).cast("string").alias("__page")), run, schema)
