"""Visible text of HTML pages, laid out: blocks, lists and tables.

A scanner reads tags and text. The builder keeps the stack of open elements, closes what HTML lets
authors leave open (paragraphs, list items, cells, rows) and ignores end tags without a start. It
knows what a browser would not show: hidden elements, those that the page's own style sheets or a
``style`` hide, what a closed ``details`` holds but its summary, options that are not chosen. Of
style sheets it reads ``display`` and ``visibility`` in rules with simple selectors (a name, id and
classes, without combinators). The renderer follows start and end events. It has no recursion,
and indents and padding are bounded by the page's size, so memory is in proportion to the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the HTML standard.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "head script style title template noscript iframe noembed noframes object audio video canvas "
    "datalist annotation annotation-xml".split())
# Straight inside an svg or its groups only these are drawn or hold what is.
SVG_SHOWN = frozenset("a foreignobject g svg switch text".split())
SVG_GROUPS = frozenset("g svg switch".split())
SHOWN_INPUTS = frozenset("text search url tel email number submit reset button".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre search section summary table ul caption".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
LISTS = frozenset("dir menu ol ul".split())
# An element that starts closes these, up to the elements that bound the search.
CLOSES = {
    "li": ("li", LISTS), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}),
    "tr": ("td th tr caption", {"table"}), "td": ("td th", {"table", "tr"}),
    "th": ("td th", {"table", "tr"}), "option": ("option", {"select"}),
    "thead": ("td th tr thead tbody tfoot caption", {"table"}),
    "tbody": ("td th tr thead tbody tfoot caption", {"table"}),
    "tfoot": ("td th tr thead tbody tfoot caption", {"table"}), "body": ("head", {"html"}),
    "select": ("select option optgroup", frozenset()), "optgroup": ("option optgroup", {"select"}),
}
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "summary"}
P_BOUNDS = frozenset("button caption html object table td th".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)"
    r"(?P<attrs>(?:[^>=]|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# Style sheets of a page; comments and other raw elements are matched to be passed over.
SHEET = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes)\b([^>]*+)(?:>|\Z)"
    r"(.*?)(?:</\1\s*/?>|\Z)", re.S | re.I)
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
DECLARATION = re.compile(r"(?:\A|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
SELECTOR = re.compile(r"(?:\*|([a-z][a-z0-9-]*))?((?:[.#][\w-]+)*)\Z", re.I)
SCREEN = re.compile(r"\s*(?:(?:only\s+)?(?:all|screen))?\s*\Z", re.I)
# White space that HTML collapses; a no-break space is text.
BLANKS = re.compile(r"[ \t\n\r\f]+")
MOST_INDENT = 24  # levels of lists and quotations that are indented further
NARROW = 40  # columns are aligned to this width at least, where padding allows
MOST_PADDING = 8  # an aligned table is at most so many times as long as its text
MOST_SPAN = 1_000  # HTML's limit of colspan; row spans are followed in so many columns


def attributes(raw: str) -> dict[str, str]:
    return {
        m[1].lower(): html.unescape(next((v for v in m.groups()[1:] if v is not None), ""))
        for m in ATTRIBUTE.finditer(raw)
    }


def number_of(attrs: dict[str, str], name: str, default: int) -> int:
    value = attrs.get(name, "").strip()
    digits = value.removeprefix("-")
    return int(value) if digits.isascii() and digits.isdigit() and len(digits) < 10 else default


def declarations(block: str) -> dict[str, tuple[bool, str]]:
    """Property -> (important, value) of ``display`` and ``visibility``."""
    found: dict[str, tuple[bool, str]] = {}
    for m in DECLARATION.finditer(block):
        name, kept = m[1].lower(), found.get(m[1].lower())
        if kept is None or bool(m[3]) >= kept[0]:
            found[name] = (bool(m[3]), m[2].lower())
    return found


class Styles:
    """Rules of a page's style sheets that show or hide."""

    def __init__(self, page: str):
        self.rules: dict[str, list[tuple]] = {}  # by id, class or name of the selector
        self.n = 0
        if "<style" in page or "<STYLE" in page:
            for m in SHEET.finditer(page):
                if (m[1] or "").lower() == "style" and SCREEN.match(attributes(m[2]).get("media", "")):
                    self._read(CSS_COMMENT.sub(" ", m[3]))

    def _read(self, sheet: str) -> None:
        read = [True]  # for each open block, whether its rules are read
        at = 0
        for m in re.finditer(r"[{};]", sheet):
            part, at = sheet[at:m.start()].strip(), m.end()
            if m[0] == "{":
                if part.startswith("@"):
                    media = part[:6].lower() == "@media" and SCREEN.match(part[6:])
                    read.append(read[-1] and bool(media))
                    continue
                if read[-1]:
                    stop = sheet.find("}", at)
                    found = declarations(sheet[at:stop if stop >= 0 else len(sheet)])
                    for selector in part.split(",") if found else ():
                        self._add(selector.strip(), found)
                read.append(False)
            elif m[0] == "}" and len(read) > 1:
                read.pop()

    def _add(self, selector: str, found: dict) -> None:
        m = SELECTOR.match(selector)
        if not selector or m is None:
            return
        name, marks = (m[1] or "").lower(), re.findall(r"[.#][\w-]+", m[2])
        ids = [mark for mark in marks if mark[0] == "#"]
        weight = (len(ids), len(marks) - len(ids), bool(name))
        self.n += 1
        key = marks[0] if marks else name or "*"
        self.rules.setdefault(key, []).append((weight, self.n, name, frozenset(marks), found))

    def of(self, name: str, attrs: dict[str, str]) -> dict[str, str]:
        """Value of each property that is set for an element."""
        best: dict[str, tuple] = {}
        if self.rules:
            marks = {"." + c for c in attrs.get("class", "").split()}
            if attrs.get("id"):
                marks.add("#" + attrs["id"])
            for key in (*marks, name, "*"):
                for weight, order, wanted, needs, found in self.rules.get(key, ()):
                    if wanted in ("", name) and needs <= marks:
                        for prop, (important, value) in found.items():
                            rank = (important, 0, weight, order)
                            if prop not in best or best[prop][0] < rank:
                                best[prop] = (rank, value)
        if "style" in attrs:
            for prop, (important, value) in declarations(attrs["style"]).items():
                rank = (important, 1, (), 0)
                if prop not in best or best[prop][0][:2] < rank[:2]:
                    best[prop] = (rank, value)
        return {prop: value for prop, (_, value) in best.items()}


@dataclass
class Flow:
    """Lines of one block container: the page, or a table cell."""

    lines: list[str] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)  # of the line being filled
    gap: bool = False  # a blank line is due before the next text
    mark: str = ""  # list mark that the next line starts with
    indent: int = 0

    def text(self, text: str) -> None:
        if not self.parts or self.parts[-1].endswith((" ", "\n")):
            text = text.lstrip(" ")
        if text:
            self.parts.append(text)

    def put(self, line: str) -> None:
        """Add a line that is not empty, after what is due before it."""
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = "  " * min(self.indent, MOST_INDENT)
        if self.mark:
            lead = "  " * min(self.indent - 1, MOST_INDENT) + self.mark
            self.mark = ""
        self.lines.append(lead + line)

    def end_line(self, forced: bool = False) -> None:
        line = "".join(self.parts).strip(" ")
        self.parts.clear()
        if line:
            self.put(line)
        elif forced and self.lines and self.lines[-1]:
            self.lines.append("")

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


@dataclass
class Cell:
    column: int
    span: int
    text: str = ""


@dataclass
class Table:
    rows: list[list[Cell]] = field(default_factory=list)
    taken: dict[int, int] = field(default_factory=dict)  # column -> first row free of row spans

    def row(self) -> None:
        self.rows.append([])

    def cell(self, columns: int, rows: int) -> Cell:
        """A new cell in the last row, in the first column that no other covers."""
        if not self.rows:
            self.row()
        at, last = len(self.rows) - 1, self.rows[-1]
        column = last[-1].column + last[-1].span if last else 0
        while self.taken.get(column, 0) > at:
            column += 1
        if rows > 1:
            for covered in range(column, min(column + columns, MOST_SPAN)):
                self.taken[covered] = at + rows
        last.append(Cell(column, columns))
        return last[-1]

    def lines(self, nested: bool) -> list[str]:
        """Rows as lines, each column as wide as its widest cell.

        Where that would make the table too long, wide cells stand over; where that is not enough,
        and in a table within a cell, nothing is aligned.
        """
        rows = [row for row in self.rows if any(cell.text for cell in row)]
        plain = sum(len(cell.text) + 3 for row in rows for cell in row)
        for most in () if nested else (plain, NARROW):
            at = self._offsets(rows, most)
            if sum(at[row[-1].column] + len(row[-1].text) for row in rows) <= MOST_PADDING * plain:
                return [self._line(row, at).rstrip() for row in rows]
        return [" | ".join(cell.text for cell in row).rstrip() for row in rows]

    @staticmethod
    def _offsets(rows: list[list[Cell]], most: int) -> dict[int, int]:
        """Where each column in which a cell begins starts in its line."""
        starts = sorted({cell.column for row in rows for cell in row})
        widest: dict[int, dict[int, int]] = {column: {} for column in starts}
        for row in rows:
            for cell in row:
                after = bisect_left(starts, cell.column + cell.span)
                if after < len(starts) and len(cell.text) <= most:
                    ends = widest[cell.column]
                    ends[starts[after]] = max(ends.get(starts[after], 0), len(cell.text))
        offsets, least, at = {}, dict.fromkeys(starts, 0), 0
        for column in starts:
            offsets[column] = at = max(at, least[column])
            for end, width in widest[column].items():
                least[end] = max(least[end], at + width + 3)
            at += 3
        return offsets

    @staticmethod
    def _line(row: list[Cell], offsets: dict[int, int]) -> str:
        parts, length = [], 0
        for cell in row:
            if cell.column:
                pad = max(0, offsets[cell.column] - 3 - length)
                parts.append(" " * pad + " | ")
                length += pad + 3
            parts.append(cell.text)
            length += len(cell.text)
        return "".join(parts)


class Renderer:
    """Turns start, end and text events into laid-out text."""

    def __init__(self):
        self.flow = Flow()
        self.tables: list[Table] = []
        self.cells: list[tuple[Flow, Cell]] = []  # flow outside the cell
        self.lists: list[int | None] = []  # next number, None for bullets
        self.list_bases: list[int] = []
        self.n_tables = self.n_items = 0
        self.pre = 0

    def text(self, text: str) -> None:
        if self.pre:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self.flow.parts.append(first)
            for line in rest:
                self._pre_line()
                self.flow.parts.append(line)
        else:
            self.flow.text(BLANKS.sub(" ", text))

    def _pre_line(self) -> None:
        flow, line = self.flow, "".join(self.flow.parts).rstrip()
        flow.parts.clear()
        if flow.gap and flow.lines:
            flow.lines.append("")
        flow.gap = False
        if line or flow.lines:
            flow.lines.append("  " * min(flow.indent, MOST_INDENT) + line)

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name == "br":
            self._pre_line() if self.pre else self.flow.end_line(forced=True)
            return
        if name == "hr":
            self.flow.block(True)
            return
        if name == "img" and attrs.get("alt"):
            self.flow.text(BLANKS.sub(" ", attrs["alt"]))
            return
        if name == "input":
            if attrs.get("type", "text").lower() in SHOWN_INPUTS and attrs.get("value"):
                self.flow.text(BLANKS.sub(" ", attrs["value"]))
            return
        if name in ("td", "th") and self.tables:
            columns = min(max(number_of(attrs, "colspan", 1), 1), MOST_SPAN)
            rows = number_of(attrs, "rowspan", 1) or 65_534  # 0: all that follow
            cell = self.tables[-1].cell(columns, rows)
            self.cells.append((self.flow, cell))
            self.flow = Flow()
        elif name == "tr" and self.tables:
            self.tables[-1].row()
        elif name == "table":
            self.flow.block(True)
            self.n_tables += 1
            self.tables.append(Table())
        elif name in LISTS:
            self.flow.block(not self.lists)
            self.lists.append(number_of(attrs, "start", 1) if name == "ol" else None)
            self.flow.indent += 1
        elif name == "li":
            self.flow.block(False)
            self.n_items += 1
            number = self.lists[-1] if self.lists else None
            if number is not None:
                number = number_of(attrs, "value", number)
            self.flow.mark = "- " if number is None else f"{number}. "
            if number is not None:
                self.lists[-1] = number + 1
            if not self.lists:
                self.flow.indent += 1
        elif name in BLOCKS:
            self.flow.block(name in SPACED)
            self.flow.indent += name in ("blockquote", "dd")
            self.pre += name == "pre"
        elif name == "textarea":
            self.flow.end_line()
            self.pre += 1
        elif name == "text":
            self.flow.text(" ")

    def end(self, name: str) -> None:
        if name in ("td", "th"):
            if self.cells:
                text = " ".join(filter(None, map(str.strip, self.flow.done())))
                self.flow, cell = self.cells.pop()
                cell.text = text
        elif name == "table":
            if self.tables:
                table = self.tables.pop()
                self.flow.end_line()
                for line in table.lines(nested=bool(self.cells)):
                    self.flow.put(line)
                self.flow.block(True)
        elif name in LISTS:
            if self.lists:
                self.lists.pop()
                self.flow.end_line()
                self.flow.mark = ""
                self.flow.indent = max(0, self.flow.indent - 1)
                self.flow.gap = self.flow.gap or not self.lists
        elif name == "li":
            self.flow.block(False)
            self.flow.mark = ""
            if not self.lists:
                self.flow.indent = max(0, self.flow.indent - 1)
        elif name in BLOCKS:
            if name == "pre":
                self._pre_line()
                self.pre -= 1
            self.flow.block(name in SPACED)
            self.flow.indent = max(0, self.flow.indent - (name in ("blockquote", "dd")))
        elif name == "tr":
            self.flow.end_line()
        elif name == "textarea":
            self._pre_line()
            self.pre -= 1


AWAITS_SUMMARY, HAS_SUMMARY = 1, 2


@dataclass
class Element:
    name: str
    seen: bool  # whether it makes a box, apart from what is around it
    visible: bool  # whether its own text is shown
    closed: int = 0  # of details that show no more than their first summary


@dataclass
class Choice:
    """The options of a ``select``; without a chosen one the first shows, or all of a list box."""

    box: bool
    options: list[tuple[bool, list[str]]] = field(default_factory=list)

    def shown(self) -> list[str]:
        texts = [(chosen, BLANKS.sub(" ", "".join(parts)).strip()) for chosen, parts in self.options]
        if self.box:
            return [text for _, text in texts]
        chosen = [text for chosen, text in texts if chosen]
        return chosen[-1:] or [text for _, text in texts[:1]]


class Builder:
    """Stack of open elements; sends what is visible to the renderer."""

    def __init__(self, renderer: Renderer, styles: Styles):
        self.out, self.styles = renderer, styles
        self.open: list[Element] = []
        self.counts: dict[str, int] = {}
        self.hidden = 0
        self.choice: Choice | None = None

    def _seen(self, name: str, attrs: dict[str, str], style: dict[str, str]) -> bool:
        """Whether an element makes a box where it stands."""
        if name in HIDDEN or style.get("display") == "none":
            return False
        if ("hidden" in attrs or (name == "dialog" and "open" not in attrs)) and "display" not in style:
            return False
        parent = self.open[-1] if self.open else None
        if parent and parent.closed:
            return name == "summary" and parent.closed == AWAITS_SUMMARY
        return name in SVG_SHOWN or not (parent and self._in_svg(parent.name))

    def _in_svg(self, name: str) -> bool:
        return name in SVG_GROUPS and self.counts.get("svg", 0) > 0

    def _push(self, element: Element) -> None:
        self.open.append(element)
        self.counts[element.name] = self.counts.get(element.name, 0) + 1
        self.hidden += not element.seen

    def _pop(self) -> str:
        element = self.open.pop()
        self.counts[element.name] -= 1
        if not self.hidden:
            if element.name == "select" and self.choice:
                shown, self.choice = self.choice.shown(), None
                if element.visible and shown:
                    self.out.text(" " + " ".join(shown) + " ")
            elif not self.choice:
                self.out.end(element.name)
        self.hidden -= not element.seen
        return element.name

    def _close_implied(self, names, bounds) -> None:
        """Close open elements of these names above the nearest bound."""
        if not any(self.counts.get(n) for n in names):
            return
        lowest = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].name in bounds:
                break
            if self.open[i].name in names:
                lowest = i
        while lowest is not None and len(self.open) > lowest:
            self._pop()

    def start(self, name: str, raw: str) -> None:
        if name in CLOSES_P and self.counts.get("p"):
            self._close_implied(("p",), P_BOUNDS)
        if name in CLOSES:
            names, bounds = CLOSES[name]
            self._close_implied(names.split(), bounds)
        if name in ("td", "th") and self.counts.get("table"):
            rows = next((e.name for e in reversed(self.open) if e.name in ("tr", "table")), "")
            if rows == "table":
                self.start("tr", "")
        if name not in ("head", "title", "meta", "link", "script", "style", "base", "html", "noscript",
                        "template") and self.counts.get("head"):
            self._close_implied(("head",), {"html"})
        attrs = attributes(raw) if raw.strip(" /") else {}
        style = self.styles.of(name, attrs) if attrs or self.styles.rules else {}
        seen = self._seen(name, attrs, style)
        visible = not self.open or self.open[-1].visible
        if style.get("visibility") in ("hidden", "collapse", "visible"):
            visible = style["visibility"] == "visible"
        shows = seen and not self.hidden
        if name in VOID:
            if shows and not self.choice and (visible or name in ("br", "hr")):
                self.out.start(name, attrs)
            return
        closed = 0
        if shows and self.choice:
            if name == "option":
                self.choice.options.append(("selected" in attrs, []))
        elif shows and name == "select":
            self.choice = Choice("multiple" in attrs or number_of(attrs, "size", 1) > 1)
        elif shows:
            self.out.start(name, attrs)
            if name == "details" and "open" not in attrs:
                closed = AWAITS_SUMMARY
            elif self.open and self.open[-1].closed:
                self.open[-1].closed = HAS_SUMMARY
        self._push(Element(name, seen, visible, closed))

    def end(self, name: str) -> None:
        if not self.counts.get(name):
            if name == "p":  # an end tag alone is an empty paragraph
                self.start("p", "")
                self._pop()
            return
        if name not in ("table", "html", "body"):  # only these close what is outside a cell
            for element in reversed(self.open):
                other = element.name
                if other == name:
                    break
                if other in ("table", "td", "th") and name not in ("tr", "tbody", "thead", "tfoot"):
                    return
        while self._pop() != name:
            pass

    def text(self, text: str) -> None:
        if not text or self.hidden:
            return
        parent = self.open[-1] if self.open else None
        if parent and (not parent.visible or parent.closed or self._in_svg(parent.name)):
            return
        text = html.unescape(text) if "&" in text else text
        if not self.choice:
            self.out.text(text)
        elif self.counts.get("option") and self.choice.options:
            self.choice.options[-1][1].append(text)

    def close(self) -> None:
        while self.open:
            self._pop()


def render(page: str | None) -> tuple[str, int, int]:
    """Visible text, number of tables and of list items."""
    renderer = Renderer()
    at, page = 0, page or ""
    builder = Builder(renderer, Styles(page))
    while found := TOKEN.search(page, at):
        builder.text(page[at:found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["end"]:
            builder.end(name)
            continue
        builder.start(name, found["attrs"] or "")
        if name in RAW:
            stop = re.compile(rf"</{name}\s*/?>", re.I).search(page, at)
            raw = page[at:stop.start()] if stop else page[at:]
            builder.text(raw.removeprefix("\n") if name == "textarea" else raw)
            at = stop.end() if stop else len(page)
            builder.end(name)
    builder.text(page[at:])
    builder.close()
    return "\n".join(renderer.flow.done()), renderer.n_tables, renderer.n_items


def extract_text(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """One row per page: id, ``text``, ``n_chars``, ``n_blocks``, ``n_tables``, ``n_items``.

    Null and empty pages give an empty text; null ids stay null; repeated rows are rendered one
    by one; other columns are not read. A page without tags is its own text, blanks collapsed.
    Texts are never cut; only padding and indents have bounds (MOST_PADDING, MOST_INDENT).
    """

    def extract(batches):
        for batch in batches:
            found = [render(page) for page in batch.column(1).to_pylist()]
            texts = [text for text, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([sum(map(bool, t.split("\n"))) for t in texts], pa.int64()),
                 pa.array([n for _, n, _ in found], pa.int64()),
                 pa.array([n for _, _, n in found], pa.int64())],
                names=[id_column, "text", "n_chars", "n_blocks", "n_tables", "n_items"],
            )

    read = pages.select(id_column, html_column)
    kind = read.schema[id_column].dataType.simpleString()
    return read.mapInArrow(
        extract,
        f"`{id_column}` {kind}, text string, n_chars long, n_blocks long, n_tables long, n_items long",
    )
