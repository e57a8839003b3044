"""HTML tables as markdown, alone and inside text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Headings told by their numbers, the deepest first.
NUMBERED = ((r"\d{1,2}\.\d{1,2}\.\d{1,2}.*", 3), (r"\d{1,2}\.\d{1,2}.*", 2), (r"\d{1,2}\s[^\./].*", 1))


class Element:
    """A tag with what it holds, texts and elements in order."""

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.parts = tag, attrs or {}, []

    def text(self) -> str:
        return "".join(p if isinstance(p, str) else p.text() for p in self.parts)

    def all(self, *tags: str) -> Iterator[Element]:
        """Elements of these tags at any depth, in order."""
        for p in self.parts:
            if isinstance(p, Element):
                if p.tag in tags:
                    yield p
                yield from p.all(*tags)

    def children(self, tag: str) -> list[Element]:
        return [p for p in self.parts if isinstance(p, Element) and p.tag == tag]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__()
        self.open = [Element("")]

    def handle_starttag(self, tag, attrs):
        new = Element(tag, dict(attrs))
        self.open[-1].parts.append(new)
        if tag not in _VOID:
            self.open.append(new)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].parts.append(Element(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def tree(html: str) -> Element:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.open[0]


def whole_number(value, default: int = 1) -> int:
    try:
        return int(str(value)) if value is not None else default
    except ValueError:
        return default


def grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells (text, columns, rows) spread over what they span, short rows filled up.

    The first row with cells sets the width; cells that don't fit are left out.
    """
    out: list[list[str]] = []
    held: list[tuple[int, str]] = []  # of each column: rows that its cell still covers
    for row in rows:
        if not held:
            held = [(down - 1, text) for text, across, down in row for _ in range(across)]
            out.append([text for _, text in held])
            continue
        cells, line, now = iter(row), [], []
        while len(line) < len(held):
            rest, text = held[len(line)]
            if rest > 0:
                now.append((rest - 1, text))
                line.append(text)
                continue
            text, across, down = next(cells, ("", 1, 1))
            for _ in range(max(0, min(across, len(held) - len(line)))):
                now.append((down - 1, text))
                line.append(text)
            if across < 1:
                break
        held = now + held[len(now) :]
        out.append(line)
    width = max(map(len, out), default=0)
    return [r + [""] * (width - len(r)) for r in out]


def _kind(values: list[str]) -> str:
    """int, float or text: what all non-empty values can be read as."""
    got = "none"
    for v in filter(None, values):
        for kind, read in (("int", int), ("float", float)):
            try:
                if read(v) in (float("inf"), float("-inf")) or v.lower() == "nan":
                    raise ValueError
            except (ValueError, OverflowError):
                continue
            break
        else:
            return "text"
        got = "float" if "float" in (kind, got) else kind
    return got


def pipe_table(names: list[str], rows: list[list[str]]) -> str:
    """A markdown table: numbers to the right, points below each other, columns two wider than their names at least."""
    shown, rules, heads = [], [], []
    for j, name in enumerate(names):
        cells = [r[j] for r in rows]
        kind = _kind(cells)
        if kind == "float":
            cells = [f"{float(c):g}" if c else c for c in cells]
            after = [len(c) - c.rfind(".") - 1 if "." in c else len(c) - c.rfind("e") - 1 if "e" in c else -1 for c in cells]
            cells = [c + " " * (max(after) - a) for c, a in zip(cells, after)]
        right = kind in ("int", "float")
        width = max([len(name) + 2, *map(len, cells)])
        put = str.rjust if right else str.ljust
        heads.append(put(name, width))
        shown.append([put(c, width) for c in cells])
        rules.append("-" * (width + 1) + ":" if right else ":" + "-" * (width + 1))
    line = lambda cs: "| " + " | ".join(cs) + " |"
    return "\n".join([line(heads), "|" + "|".join(rules) + "|", *(line(r) for r in zip(*shown))])


def _element_to_markdown(table: Element) -> str:
    rows = list(table.all("tr"))
    cells = [list(r.all("th", "td")) for r in rows]
    names = [h.text().replace("\n", "") for h in table.all("th")]
    if all(c.tag == "th" for row in cells for c in row):
        level = next((n for p, n in NUMBERED if names and re.match(p, names[0])), 0)
        return "#" * level + " " + " ".join(names) if level else ""
    flat = lambda c: c.text().replace("\n\n", "\n").replace("\n", " ").strip()
    body = grid([[(flat(c), whole_number(c.attrs.get("colspan")), whole_number(c.attrs.get("rowspan"))) for c in row] for row in cells])
    if not body:
        return ""
    if names and len(names) == len(body[0]):
        return pipe_table(names, body[1:]) + "\n\n"
    return pipe_table([str(i) for i in range(len(body[0]))], body) + "\n\n"


def table_to_markdown(html: str | None) -> str:
    """The first table of ``html``.

    A table of header cells alone is a heading if its first cell is numbered, else
    nothing.  Header cells name the columns if there are as many; else columns have
    numbers.  Without a table, or one without rows, the result is empty.
    """
    table = next(tree(html or "").all("table"), None)
    return "" if table is None else _element_to_markdown(table)


def lowest_tables(element: Element) -> list[Element]:
    """Tables that hold no table as a child of their own."""
    inner = element.children("table")
    return [x for t in inner for x in lowest_tables(t)] if inner else [element]


def replace_tables(text: str | None) -> str | None:
    """A text with its tables as markdown.

    A table goes from a line with its start to the line with its end; starts and ends
    inside are counted.  Lines are joined without breaks, as tables bring their own;
    a table that doesn't end is left out.  Null stays null.
    """
    if text is None:
        return None
    out, held, depth, nested = [], [], 0, False
    for line in text.split("\n"):
        if "<table" in line:
            nested = nested or depth > 0
            depth += 1
            held.append(line)
        elif "</table>" in line:
            held.append(line)
            depth -= 1
            if depth == 0:
                html = "\n".join(held)
                out.append("".join(_element_to_markdown(t) + "\n" for t in lowest_tables(tree(html)) if t.tag) if nested else table_to_markdown(html))
                held = []
            else:
                held.append(line)
        elif held:
            held.append(line)
        else:
            out.append(line)
    return "".join(out)


def decoded(content: Column) -> Column:
    """The bytes of a file as text; what is no UTF-8 becomes the replacement mark."""
    return F.decode(content, F.lit("UTF-8"))


def dimensions(table: Column) -> Column:
    """Rows and columns of an array of rows."""
    return F.struct(F.size(table).alias("row_count"), F.coalesce(F.array_max(F.transform(table, lambda r: F.size(r))), F.lit(0)).alias("col_count"))


def _mapped(c: Column, f: Callable[[str | None], str | None]) -> Column:
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(f)

    return run(c)


def html_tables(c: Column) -> Column:
    """table_to_markdown() of a column."""
    return _mapped(c, table_to_markdown)


def clean_html_tables(c: Column) -> Column:
    """replace_tables() of a column."""
    return _mapped(c, replace_tables)
