"""The visible text of a web page, laid out: blocks, lists and aligned table cells.

`events` reads the tags and repairs their nesting: it opens what a tag implies, closes what it ends,
and ignores end tags that match nothing. `render` follows these events with a stack of canvases; a
canvas collects lines, and a table cell has a canvas of its own, so that its columns can be aligned
when the table ends. Nothing is thrown away for being navigation or advertising: all visible text
comes out, in order. Neither step recurses, so nesting may be of any depth.

Not visible: head, scripts, styles, templates, comments, elements with `hidden` or with a style of
`display: none` or `visibility: hidden` (of the latter, parts that are `visible` again come out), dialogs
that are not open, what closed `details` hold besides their summary, hidden inputs; in formulas and drawings (math, svg) annotations,
titles, descriptions, metadata and what is only defined there. Also left out: what stands in for embedded
content (iframe, object, noembed, noframes, noscript), suggestions (datalist), pictures' alternative
texts, default labels of buttons, placeholders, and the values of inputs that show none as text.
Rules of style sheets are not applied. The text of a cell over several rows stands in the first of them.

Defined results: a null page gives null; an empty page, or one without visible text, an empty text;
a tag that the page ends in is dropped. Rows are independent; extra columns stay, except `text`,
which is replaced.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = frozenset(
    "head script style template noscript noembed noframes iframe object datalist title".split()
)
FOREIGN = frozenset(("svg", "math"))
# Inside of these: what is not painted where it stands.
UNPAINTED = frozenset(
    "annotation annotation-xml desc defs metadata symbol clippath mask marker pattern lineargradient"
    " radialgradient".split()
)
WORDLESS_INPUTS = frozenset("checkbox radio password file image color range".split())
IN_HEAD = frozenset("base link meta title style script template noscript".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary"
    " table ul li dt dd".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl pre blockquote table figure hr".split())
OWN_LINE = frozenset(
    "html body address article aside center details dialog div fieldset figcaption footer form"
    " header hgroup legend main nav optgroup option search section summary caption li dt dd".split()
)
LISTS = frozenset("ul ol menu dir".split())
CELLS = frozenset(("td", "th"))
PARTS = frozenset(("thead", "tbody", "tfoot"))

# Opening one of these ends the open elements of its set, up to the nearest of the fence.
IMPLIED_ENDS = {
    "li": (frozenset(("li",)), LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "optgroup", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (CELLS | {"caption"}, frozenset(("tr", "table"))),
    "th": (CELLS | {"caption"}, frozenset(("tr", "table"))),
    "tr": (CELLS | {"tr", "caption"}, frozenset(("table",))),
    "thead": (CELLS | PARTS | {"tr", "caption"}, frozenset(("table",))),
    "tbody": (CELLS | PARTS | {"tr", "caption"}, frozenset(("table",))),
    "tfoot": (CELLS | PARTS | {"tr", "caption"}, frozenset(("table",))),
}
# Elements that no paragraph or stray end tag reaches out of.
FENCES = CELLS | {"table", "caption", "button", "html"}

_MARK = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)(>|\Z)"
    r"|</[^A-Za-z>][^>]*(?:>|\Z)",
    re.S,
)
_START = re.compile(r"</?[A-Za-z]")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")


def attributes(text: str) -> dict[str, str]:
    """The attributes in a tag; the first of a name counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(values[0] or values[1] or values[2]))
    return found


def marks(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", words, ""), ("open", name, rest of the tag) and ("close", name, "")."""
    at, size = 0, len(page)
    foreign = 0
    while at < size:
        less = page.find("<", at)
        if less < 0:
            yield "text", page[at:], ""
            return
        found = _MARK.match(page, less)
        if found is None:  # a plain sign
            following = page.find("<", less + 1)
            end = following if following >= 0 else size
            # A start of a tag that never ends is dropped with all behind it.
            if _START.match(page, less) and page.find(">", less) < 0:
                yield "text", page[at:less], ""
                return
            yield "text", page[at:end], ""
            at = end
            continue
        if less > at:
            yield "text", page[at:less], ""
        at = found.end()
        slash, name, rest, end = found.groups()
        if name is None or end == "":
            continue
        name = name.lower()
        if slash:
            if name in FOREIGN:
                foreign = max(0, foreign - 1)
            yield "close", name, ""
            continue
        yield "open", name, rest
        if rest.endswith("/") and (foreign or name in FOREIGN):
            yield "close", name, ""
            continue
        if name in FOREIGN:
            foreign += 1
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            stop = close.start() if close else size
            yield "text", page[at:stop], ""
            at = stop


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """The marks of a page, well nested."""
    stack: list[str] = []
    open_now: dict[str, int] = {}

    def pop() -> tuple[str, str, str]:
        name = stack.pop()
        open_now[name] -= 1
        return "close", name, ""

    def push(name: str, rest: str) -> tuple[str, str, str]:
        stack.append(name)
        open_now[name] = open_now.get(name, 0) + 1
        return "open", name, rest

    def up_to(names: frozenset, fence: frozenset) -> int | None:
        """How deep the outermost of the names lies inside the fence."""
        if not any(open_now.get(n) for n in names):
            return None
        depth = None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in names:
                depth = i
            elif stack[i] in fence:
                break
        return depth

    def close(names: frozenset, fence: frozenset) -> Iterator[tuple[str, str, str]]:
        depth = up_to(names, fence)
        while depth is not None and len(stack) > depth:
            yield pop()

    for kind, name, rest in marks(page):
        if kind == "text":
            if open_now.get("head") and name.strip() and stack[-1] == "head":
                yield pop()
            yield kind, name, rest
            continue
        if kind == "open":
            if open_now.get("head") and name not in IN_HEAD and stack[-1] == "head":
                yield pop()
            if name in ENDS_PARAGRAPH:
                yield from close(frozenset(("p",)), FENCES)
            if name in IMPLIED_ENDS:
                yield from close(*IMPLIED_ENDS[name])
            if name in CELLS and open_now.get("table") and _nearest(stack, ("table", "tr")) == "table":
                yield push("tr", "")
            if name in VOID:
                yield "open", name, rest
                yield "close", name, ""
            else:
                yield push(name, rest)
        elif name == "br":
            yield "open", "br", ""
            yield "close", "br", ""
        elif not open_now.get(name):
            if name == "p":
                yield "open", "p", ""
                yield "close", "p", ""
        else:
            depth = _last(stack, name)
            # An end tag does not reach out of a table cell, unless it ends something around it.
            inner = next((i for i in range(len(stack) - 1, depth, -1) if stack[i] in CELLS), None)
            if inner is None or name in FENCES or name in PARTS or name in ("tr", "body"):
                while len(stack) > depth:
                    yield pop()
    while stack:
        yield pop()


def _last(stack: list[str], name: str) -> int:
    return next(i for i in range(len(stack) - 1, -1, -1) if stack[i] == name)


def _nearest(stack: list[str], names: tuple[str, ...]) -> str:
    return next(x for x in reversed(stack) if x in names)


class Canvas:
    """Lines of text. `gap` is the least number of line ends before what comes next."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False  # a collapsed blank waits for the next word
        self.gap = 0
        self.indents: list[str] = []
        self.bullet = ""

    def write(self, text: str) -> None:
        """Running text: blanks collapse, also across elements."""
        for i, word in enumerate(_BLANKS.split(text)):
            if i:
                self.space = True
            if word:
                if self.space and self.parts:
                    self.parts.append(" ")
                self.space = False
                self.parts.append(word)

    def write_lines(self, text: str) -> None:
        """Text whose blanks and line ends stay."""
        first, *more = text.replace("\r\n", "\n").split("\n")
        if first:
            self.parts.append(first)
        for line in more:
            self.end_line(always=True)
            if line:
                self.parts.append(line)

    def end_line(self, always: bool = False) -> None:
        """End the line that is being written; `always`: even if nothing is on it."""
        self.space = False
        if not self.parts and not always:
            return
        if self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        indent = "".join(self.indents)
        if self.bullet:
            indent = indent[: len(indent) - len(self.bullet)] + self.bullet
            self.bullet = ""
        self.lines.append((indent + "".join(self.parts)).rstrip() if self.parts else "")
        self.parts = []

    def block(self, gap: int) -> None:
        """A block begins or ends here: 1 for a new line, 2 for an empty line between."""
        self.end_line()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.end_line()
        lines = [x.replace("\xa0", " ").rstrip() for x in self.lines]
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def _width(line: str) -> int:
    """Columns that a line takes: two for a wide sign, none for one that combines."""
    if line.isascii():
        return len(line)
    wide = sum(unicodedata.east_asian_width(c) in "WF" for c in line)
    return len(line) + wide - sum(unicodedata.combining(c) > 0 for c in line)


class Cell:
    """A finished cell: the columns and rows it spans, and its lines."""

    def __init__(self, columns: int, rows: int, lines: list[str]) -> None:
        self.columns, self.rows, self.lines = columns, rows, lines


def places(rows: list[tuple[int, list[Cell]]]) -> list[list[tuple[int, Cell]]]:
    """The first column of every cell: the first that no cell from above reaches into.

    Rows come with the number of their row group, which no cell reaches out of; 0 rows are all of it.
    """
    out, group = [], None
    free: dict[int, tuple[int, int]] = {}  # column: the row it is free in, the end of its cell
    for i, (own, cells) in enumerate(rows):
        if own != group:
            free, group = {}, own
        at, placed = 0, []
        for cell in cells:
            while free.get(at, (0, 0))[0] > i:
                at = free[at][1]
            placed.append((at, cell))
            end = at + cell.columns
            if cell.rows != 1:
                until = i + (cell.rows or len(rows))
                free.update((c, (until, end)) for c in range(at, end))
            at = end
        out.append(placed)
    return out


def align(rows: list[tuple[int, list[Cell]]]) -> list[str]:
    """Rows of cells as text; columns are as wide as their widest cell."""
    placed = places(rows)
    widths: dict[int, int] = {}
    for row in placed:
        for at, cell in row:
            if cell.columns == 1 and cell.lines:
                widths[at] = max(widths.get(at, 0), *map(_width, cell.lines))
    # Empty columns take no room.
    filled = sorted(c for c, w in widths.items() if w)
    starts = list(accumulate((widths[c] + 2 for c in filled), initial=0))
    out = []
    for row in placed:
        for i in range(max((len(cell.lines) for _, cell in row), default=0)):
            line = ""
            for at, cell in row:
                if i < len(cell.lines):
                    line += " " * (starts[bisect_left(filled, at)] - _width(line)) + cell.lines[i]
            out.append(line.rstrip())
    return [x for x in out if x]


class _Table:
    def __init__(self) -> None:
        self.group = 0  # number of the row group
        self.rows: list[tuple[int, list[Cell]]] = []
        self.cells: list[tuple[Canvas, int, int]] = []  # cells that are open


class _Open:
    """An element that is open. `body`: a closed `details`, whose first summary alone is shown."""

    def __init__(self, painted: bool, body: bool) -> None:
        self.painted, self.body, self.summed = painted, body, False


def _number(text: str | None, default: int) -> int:
    found = re.match(r"\s*([+-]?\d{1,6})", text or "")
    return int(found[1]) if found else default


def _unpainted(found: dict[str, str]) -> bool:
    """Whether an attribute of a drawing's element, not its style, hides it."""
    return found.get("display") == "none"


def _painted(found: dict[str, str], drawn: bool, inherited: bool) -> bool:
    """Whether an element's own text is painted, by its visibility or that of what it stands in."""
    asked = found.get("visibility", "") if drawn else ""
    for value in _VISIBILITY.findall(found.get("style", "")):
        asked = value
    asked = asked.lower()
    return inherited if asked in ("", "inherit", "unset") else asked not in ("hidden", "collapse")


def render(page: str) -> str:
    """The visible text of a page."""
    canvases = [Canvas()]
    tables: list[_Table] = []
    lists: list[list] = []  # [ordered, next number]
    foreign = 0  # formulas and drawings that are open
    path = [_Open(True, False)]  # elements that are open and not unseen
    unseen = 0  # elements open since a hidden one, itself included
    pre = 0

    for kind, name, rest in events(page):
        canvas = canvases[-1]
        if unseen:
            unseen += {"open": 1, "close": -1, "text": 0}[kind]
            continue
        above = path[-1]
        if kind == "text":
            if above.body or not above.painted:
                continue
            text = html.unescape(name) if "&" in name else name
            if pre:
                canvas.write_lines(text)
            else:
                canvas.write(text)
            continue
        found = attributes(rest) if rest and not rest.isspace() else {}
        if kind == "open":
            drawn = foreign > 0 or name in FOREIGN
            hidden = (
                name in HIDDEN
                or "hidden" in found
                or _UNSEEN.search(found.get("style", "")) is not None
                or (name == "input" and found.get("type", "").strip().lower() == "hidden")
                or (foreign and name in UNPAINTED)
                or (drawn and _unpainted(found))
                or (name == "dialog" and "open" not in found)
                or (above.body and (name != "summary" or above.summed))
            )
            if hidden:
                unseen = 1
                continue
            above.summed = above.summed or name == "summary"
            painted = _painted(found, drawn, above.painted)
            path.append(_Open(painted, name == "details" and "open" not in found))
            if not painted and name in ("input", "br"):
                continue
            if name == "input":
                if found.get("type", "").strip().lower() not in WORDLESS_INPUTS and found.get("value"):
                    canvas.write(f" {found['value']} ")
            elif name in FOREIGN:
                foreign += 1
            elif foreign and name == "text":
                canvas.block(1)
            elif name == "br":
                canvas.end_line(always=True)
            elif name in CELLS and tables:
                columns = max(1, min(1000, _number(found.get("colspan"), 1)))
                rows = max(0, min(65534, _number(found.get("rowspan"), 1)))
                tables[-1].cells.append((Canvas(), columns, rows))
                if not tables[-1].rows:
                    tables[-1].rows.append((tables[-1].group, []))
                canvases.append(tables[-1].cells[-1][0])
            elif name == "tr" and tables:
                tables[-1].rows.append((tables[-1].group, []))
            elif name in PARTS and tables:
                tables[-1].group += 1
            elif name in SPACED:
                nested = name in LISTS and lists
                canvas.block(1 if nested else 2)
                if name in LISTS:
                    lists.append([name == "ol", _number(found.get("start"), 1)])
                    canvas.indents.append("")
                elif name == "blockquote":
                    canvas.indents.append("  ")
                elif name == "pre":
                    pre += 1
                elif name == "table":
                    tables.append(_Table())
            elif name in OWN_LINE:
                canvas.block(1)
                if name == "li":
                    bullet = "* "
                    if lists and lists[-1][0]:
                        number = _number(found.get("value"), lists[-1][1])
                        bullet, lists[-1][1] = f"{number}. ", number + 1
                    canvas.indents.append(" " * len(bullet))
                    canvas.bullet = bullet
                elif name == "dd":
                    canvas.indents.append("    ")
            continue
        # A closing tag of something visible.
        path.pop()
        if name in FOREIGN:
            foreign -= 1
        elif foreign and name == "text":
            canvas.block(1)
        elif name in CELLS and tables and tables[-1].cells:
            cell, columns, rows = tables[-1].cells.pop()
            if canvases[-1] is cell:
                canvases.pop()
            tables[-1].rows[-1][1].append(Cell(columns, rows, cell.done()))
        elif name == "table" and tables:
            canvas.block(1)
            for line in align(tables.pop().rows):
                canvas.parts.append(line)
                canvas.end_line()
                canvas.gap = 1
            canvas.block(2)
        elif name in SPACED:
            nested = name in LISTS and len(lists) > 1
            canvas.block(1 if nested else 2)
            if name in LISTS and lists:
                lists.pop()
            if name in LISTS or name == "blockquote":
                if canvas.indents:
                    canvas.indents.pop()
            elif name == "pre":
                pre = max(0, pre - 1)
        elif name in OWN_LINE:
            canvas.block(1)
            if name in ("li", "dd") and canvas.indents:
                canvas.indents.pop()
                canvas.bullet = ""
    return "\n".join(canvases[0].done())


def visible_text(page: Column) -> Column:
    """The text of a string column of pages."""

    @F.pandas_udf("string")
    def rendered(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: None if x is None else render(x)).astype(object)

    return rendered.asNondeterministic()(page)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """The pages with `text` in place of the markup."""
    kept = [c for c in pages.columns if c not in ("text", column)]
    return pages.select(*kept, visible_text(F.col(column)).alias("text"))
