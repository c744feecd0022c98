"""HTML extraction by layout-aware rendering: implied tags, visibility, block spacing, lists and aligned table cells."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormsift.llm.common import table

#: An attribute: a name, and after = a value, which quotes enclose only where it begins.
_ATTRIBUTE = r"([^\s/>][^\s/>=]*+)(?>\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>]*+)))?+"
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_COMMENT = r"<!---?>|<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
_TOKEN = re.compile(_COMMENT + r"|<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|" + re.sub(r"\((?=\[)", "(?:", _ATTRIBUTE) + r")*+)(?:>|\Z)|[^<]+|<", re.S)
_USED = re.compile(r"hidden|style|span|start|value", re.I)
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
_UNSEEN = frozenset(("head", "script", "style", "title", "template", "noscript", "iframe", "object", "select", "datalist", "noembed", "noframes"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_SPACED = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "pre", "blockquote", "figure", "fieldset"))
_BLOCK = _SPACED | frozenset(("html", "body", "div", "article", "section", "nav", "header", "footer", "main", "aside", "address", "form", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "figcaption", "details", "summary", "hr", "center"))
_CELLS, _GROUPS = ("td", "th"), ("thead", "tbody", "tfoot")
#: What an opening tag closes, and the elements beyond which it does not look.
_IMPLIED = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", *_CELLS), ("table",)), "td": (_CELLS, ("tr", "table")), "th": (_CELLS, ("tr", "table")), "tbody": ((*_GROUPS, "tr", *_CELLS), ("table",)), "thead": (("tbody", "tr", *_CELLS), ("table",)), "tfoot": (("thead", "tbody", "tr", *_CELLS), ("table",)), "option": (("option",), ("select",))}
#: What may stand in head; any other element, and text, ends it.
_IN_HEAD = frozenset(("html", "head", "body", "base", "link", "meta", "title", "noscript", "noframes", "style", "script", "template"))
#: End tags that reach beyond the cell or table they stand in.
_FAR = frozenset(("table", "tr", *_CELLS, *_GROUPS, "body", "html"))
#: Columns that lists and quotes indent at most; what lies deeper stands no further in, so nesting costs no more than its text.
_INDENT = 36
#: Columns and rows that a cell spans at most, as in the standard.
_ACROSS, _DOWN = 1000, 65_534
#: A column is padded to _WIDE characters at most and no cell is moved further in than _LINE; wider text stands whole, and the
#: next cell follows it. Tables within _NESTED others are not laid out: their cells are blocks one below the other, and nothing
#: in them is indented further. So a line costs its own text and at most _NESTED times _LINE blanks, and both output and work
#: grow with the page.
_WIDE, _LINE, _NESTED = 40, 120, 3


#: Stands for a line break in inline text; a page's own NUL becomes U+FFFD, as in the standard.
_BREAK = "\0"


class _Out:
    """Lines laid out so far at one place: the page, or a table cell; and the inline text of the line at hand."""

    __slots__ = ("lines", "inline", "gap", "marks")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False
        self.marks: list[str] = []  # what list items put before their first line

    def flush(self, indent: str, pre: bool) -> None:
        """Ends the line of inline text."""
        if not self.inline:
            return
        text = "".join(self.inline)
        self.inline = []
        if pre:
            found = text.strip("\n").split("\n")
        else:
            found = [x.strip(" ") for x in text.split(_BREAK)]
            while found and not found[-1]:
                found.pop()
        self.add(found, indent)

    def add(self, lines: list[str], indent: str) -> None:
        if not lines:
            return
        if self.lines and self.gap:
            self.lines.append("")
        self.gap = False
        start, first = indent, lines[0]
        if self.marks:
            mark = self.marks[-1]
            self.marks.clear()
            start = indent[: max(0, len(indent) - len(mark))] + mark
        self.lines.append(start + first if first else start.rstrip() if start != indent else first)
        rest = lines[1:]
        self.lines += [indent + x if x else x for x in rest] if indent else rest


class _Box:
    """An open element: its tag, whether its text is seen and laid out as it stands, its indent, and what a list or table holds."""

    __slots__ = ("tag", "seen", "shown", "block", "pre", "indent", "count", "rows", "row", "out", "span")

    def __init__(self, tag: str, shown: bool, seen: bool, block: bool, pre: bool, indent: int):
        self.tag, self.shown, self.seen, self.block, self.pre, self.indent = tag, shown, seen, block, pre, indent
        self.count = 0
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.row: list[tuple[list[str], int, int]] = []
        self.out: _Out | None = None
        self.span = (1, 1)


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table of rows of (lines, columns, rows spanned): cells stand side by side, their lines below each other.

    A column is as wide as the widest line of its cells of one column, up to _WIDE.
    """
    grid: list[dict[int, list[str]]] = [{} for _ in rows]
    wide: dict[int, int] = defaultdict(int)
    until = [0] * _ACROSS  # of a column: the first row that no cell above takes; columns further in stand beyond _LINE anyway
    for at, row in enumerate(rows):
        column = 0
        for lines, across, down in row:
            while column < _ACROSS and until[column] > at:
                column += 1
            grid[at][column] = lines
            if across == 1 and lines:
                wide[column] = max(wide[column], min(_WIDE, max(map(len, lines))))
            if down > 1:
                for c in range(column, min(column + across, _ACROSS)):
                    until[c] = at + down
            column += across
    out: list[str] = []
    start, place = {}, 0
    for c in sorted({c for row in grid for c in row}):
        start[c] = min(place, _LINE)
        place += wide[c] + 2
    for row in grid:
        cells = [(start[c], row[c]) for c in sorted(row) if row[c]]
        height = max((len(lines) for _, lines in cells), default=0)
        for k in range(max(1, height)):
            line = ""
            cells = [x for x in cells if len(x[1]) > k]
            for at, lines in cells:
                if lines[k]:
                    line = line.ljust(at) if len(line) < at or not line else line + "  "
                    line += lines[k]
            out.append(line)
    return out


class _Page:
    """The tree builder: open elements, and for each tag the places where it is open, so every step looks at few of them."""

    def __init__(self) -> None:
        self.stack = [_Box("#root", True, True, True, False, 0)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks = [0]
        self.outs = [_Out()]

    def last(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost open element among these tags, or 0."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def flush(self) -> None:
        box = self.stack[self.blocks[-1]]
        self.outs[-1].flush(" " * box.indent, box.pre)

    def open(self, tag: str, hidden: str, span: tuple[int, int], number: int | None = None) -> None:
        up = self.stack[-1]
        block = tag in _BLOCK
        shown = up.shown and tag not in _UNSEEN and hidden != "none"
        seen = shown and (hidden == "visible" or up.seen and hidden != "hidden")
        holder = self.stack[self.last(("ul", "ol"))] if tag == "li" else up
        deeper = (3 if holder.tag == "ol" else 2) if tag in ("li", "dd", "blockquote") and len(self.places["table"]) <= _NESTED else 0
        box = _Box(tag, shown, seen, block, up.pre or tag == "pre", min(up.indent + deeper, _INDENT) if up.indent < _INDENT else up.indent)
        box.span = span
        if block:
            self.flush()
            if seen and tag in _SPACED and not (tag in ("ul", "ol") and self.places["li"]):
                self.outs[-1].gap = True
            self.blocks.append(len(self.stack))
        if tag == "ol" and number is not None:
            box.count = number - 1
        if tag == "li" and seen:
            holder.count = holder.count + 1 if number is None else number
            self.outs[-1].marks.append(f"{holder.count}. " if holder.tag == "ol" else "- ")
        if tag in _CELLS and self.last(("tr", "table")) and len(self.places["table"]) <= _NESTED:
            box.indent = 0  # within the cell
            box.out = _Out()
            self.outs.append(box.out)
        self.places[tag].append(len(self.stack))
        self.stack.append(box)

    def close(self) -> None:
        """Closes the innermost element and lays out what it held."""
        box = self.stack[-1]
        if box.block:
            self.flush()
            self.blocks.pop()
        self.stack.pop()
        self.places[box.tag].pop()
        if box.out is not None:
            self.outs.pop()
            if box.shown:
                self.stack[self.last(("tr", "table"))].row.append((box.out.lines, *box.span))
            return
        if box.tag in ("tr", "table") and box.row:
            box.rows.append(box.row)
        if box.tag == "tr" and box.rows and self.last(("table",)):
            self.stack[self.last(("table",))].rows += box.rows
        elif box.rows and box.tag in ("tr", "table"):
            self.outs[-1].add(aligned(box.rows), " " * box.indent)
        if box.tag == "li" and box.seen and self.outs[-1].marks:
            self.outs[-1].marks.pop()
        if box.seen and box.tag in _SPACED and not (box.tag in ("ul", "ol") and self.places["li"]):
            self.outs[-1].gap = True

    def close_to(self, k: int) -> None:
        while len(self.stack) > k:
            self.close()

    def end_head(self) -> None:
        if self.stack[-1].tag == "head":
            self.close()
            self.open("body", "", (1, 1))

    def text(self, text: str) -> None:
        if text.strip(" \t\n\r\f"):
            self.end_head()
        if not self.stack[-1].seen:
            return
        text = html.unescape(text).replace(_BREAK, "\ufffd")
        inline = self.outs[-1].inline
        if not self.stack[self.blocks[-1]].pre:
            text = _BLANKS.sub(" ", text)
            if not inline or inline[-1][-1:] in (" ", _BREAK):
                text = text.lstrip(" ")
        if text:
            inline.append(text)

    def end_tag(self, tag: str) -> None:
        k = self.last((tag,))
        if k and (tag in _FAR or k > self.last((*_CELLS, "table"))) and (tag in ("table", "body", "html") or k >= self.last(("table",))):
            self.close_to(k)

    def start_tag(self, tag: str, attributes: str) -> None:
        if tag not in _IN_HEAD:
            self.end_head()
        if tag == "body":
            if self.places["body"]:
                return
            if self.places["head"]:
                self.close_to(self.places["head"][-1])
        if tag in _IMPLIED:
            closes, until = _IMPLIED[tag]
            limit = self.last(until)
            inner = [p for t in closes for p in self.places[t][-1:] if p > limit]
            while inner:
                self.close_to(min(inner))
                inner = [p for t in closes for p in self.places[t][-1:] if p > limit]
        if tag in _BLOCK and self.stack[self.blocks[-1]].tag == "p":
            self.close_to(self.blocks[-1])
        if tag == "br":
            if self.stack[-1].seen:
                self.outs[-1].inline.append("\n" if self.stack[self.blocks[-1]].pre else _BREAK)
        elif tag == "hr":
            self.flush()
            self.outs[-1].gap = True
        elif tag not in _VOID:
            self.open(tag, *_looks(attributes))


def _looks(attributes: str) -> tuple[str, tuple[int, int], int | None]:
    """(none, hidden, visible or nothing; (columns, rows) spanned; number of a list or its item) by an element's attributes; of
    equal names the first counts, of equal properties the last."""
    if not attributes or not _USED.search(attributes):
        return "", (1, 1), None
    values: dict[str, str] = {}
    for m in _ATTRIBUTES.finditer(attributes):
        values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    style = dict(map(str.strip, x.split(":", 1)) for x in html.unescape(values.get("style", "")).lower().split(";") if ":" in x)
    display, visible = style.get("display", ""), style.get("visibility", "")
    how = "none" if "hidden" in values or display.startswith("none") else "hidden" if visible.startswith(("hidden", "collapse")) else "visible" if visible.startswith("visible") else ""
    number = lambda name: int(m[0]) if (m := re.match(r"\s*-?[0-9]{1,9}", values.get(name, ""))) else None
    across, down = number("colspan"), number("rowspan")
    down = 1 if down is None or down < 0 else down or _DOWN  # 0: to the end of the table
    first = number("start") if "start" in values else number("value")
    return how, (min(max(across or 1, 1), _ACROSS), min(down, _DOWN)), first


def render(page: str) -> str:
    """The page's visible text as laid out: blocks on lines of their own, blank lines around paragraphs, headings, lists and
    tables, list marks with indents, table columns aligned (cells of several lines side by side), preformatted text as it is.
    Tags may be missing or unclosed. The result is at most a constant times as long as the page (see _WIDE)."""
    p = _Page()
    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            if len(m[0]) == 1 or m[0][0] != "<":
                p.text(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            p.end_tag(tag)
            continue
        p.start_tag(tag, m[3])
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            text = page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            if p.stack[-1].tag == tag:
                if p.stack[-1].seen:
                    p.outs[-1].inline.append(html.unescape(text) if tag in ("textarea", "title") else text)
                p.close()
    p.close_to(1)
    p.flush()
    return "\n".join(p.outs[0].lines)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars and n_lines of every page's visible text.

    Null and empty pages have an empty text; repeated rows each give a row; an empty table gives none; other columns are
    not read. Style sheets are not applied: an element is hidden by its kind, by the attribute hidden, or by its own style.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [render(x) if x else "" for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64()), pa.array([x.count("\n") + 1 if x else 0 for x in text], pa.int64())], ["page_id", "text", "n_chars", "n_lines"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
