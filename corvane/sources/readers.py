"""Files of many kinds as texts: a reader for each suffix, on the standard library alone."""

from __future__ import annotations

import csv
import email
import io
import json
import re
import zipfile
from collections.abc import Callable
from email.message import Message
from html.parser import HTMLParser
from xml.etree import ElementTree

from ..operators.tables import pipe_table

#: What a reader gives: texts with their metadata.
Parts = list[tuple[str, dict[str, str]]]
Reader = Callable[[str, bytes], Parts]

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _rows_as_table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    rows = [r + [""] * (width - len(r)) for r in rows]
    return pipe_table(rows[0], rows[1:]) if rows and width else ""


def _cell(cell, p: str, t: str) -> str:
    return " ".join("".join(x.text or "" for x in par.iter(t)) for par in cell.iter(p)).strip()


def docx(path: str, data: bytes) -> Parts:
    """Paragraphs, headings with ``#`` marks, list items with a dash, tables as markdown, in the document's order."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    out = []
    for part in body if body is not None else []:
        if part.tag == f"{_W}tbl":
            out.append(_rows_as_table([[_cell(c, f"{_W}p", f"{_W}t") for c in r.iter(f"{_W}tc")] for r in part.iter(f"{_W}tr")]))
        elif part.tag == f"{_W}p":
            text = "".join((x.text or "") if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in part.iter())
            style = part.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"[Hh]eading\s?([1-6])", style.get(f"{_W}val", "")) if style is not None else None
            item = "- " if part.find(f"{_W}pPr/{_W}numPr") is not None and not level else ""
            out.append(("#" * int(level[1]) + " " if level else item) + text)
    return [("\n\n".join(x for x in out if x.strip()), {"category": "docx"})]


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    return sorted((n for n in z.namelist() if re.fullmatch(pattern, n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


def pptx(path: str, data: bytes) -> Parts:
    """One text for each slide with more than its number: shapes in order, a mark for pictures, table rows with bars."""
    z, out = zipfile.ZipFile(io.BytesIO(data)), []
    for k, name in enumerate(_numbered(z, r"ppt/slides/slide\d+\.xml"), 1):
        lines = []
        for shape in ElementTree.fromstring(z.read(name)).iter():
            if shape.tag == f"{_P}pic":
                lines.append("[Image]")
            elif shape.tag == f"{_A}tbl":
                for row in shape.iter(f"{_A}tr"):
                    cells = [_cell(c, f"{_A}p", f"{_A}t") for c in row.iter(f"{_A}tc")]
                    if any(cells):
                        lines.append(" | ".join(c for c in cells if c))
            elif shape.tag == f"{_P}txBody":
                lines += ["".join(t.text or "" for t in p.iter(f"{_A}t")).strip() for p in shape.iter(f"{_A}p")]
        lines = [x for x in lines if x]
        if lines:
            out.append(("\n".join([f"Slide {k}", *lines]), {"h1": f"Slide {k}", "level": "1", "slide": str(k), "category": "pptx"}))
    return out


def xlsx(path: str, data: bytes) -> Parts:
    """One markdown table for each sheet with cells; the first row names the columns."""
    z, shared, names = zipfile.ZipFile(io.BytesIO(data)), [], {}
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_M}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_M}si")]
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        target = {r.get("Id"): r.get("Target", "").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        names = {target.get(s.get(f"{_R}id")): s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_M}sheet")}
    out = []
    for n in _numbered(z, r"xl/worksheets/sheet\d+\.xml"):
        rows = []
        for row in ElementTree.fromstring(z.read(n)).iter(f"{_M}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{_M}c"):
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                v = c.findtext(f"{_M}v") or "".join(t.text or "" for t in c.iter(f"{_M}t"))
                cells[at - 1 if letters else len(cells)] = shared[int(v)] if c.get("t") == "s" and v else v
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        if any(map(any, rows)):
            sheet = names.get(n.removeprefix("xl/")) or n.rsplit("/", 1)[-1].removesuffix(".xml")
            out.append((_rows_as_table(rows), {"h1": sheet, "h2": "", "h3": "", "level": "1", "category": "excel"}))
    return out


def comma_separated(path: str, data: bytes) -> Parts:
    """Rows without the header, values with commas between."""
    rows = list(csv.reader(io.StringIO(data.decode("utf-8-sig", "replace"))))
    return [("\n".join(", ".join(r) for r in rows[1:]), {"category": "csv"})]


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")
        if tag in ("p", "br", "div", "li", "tr") or re.fullmatch("h[1-6]", tag):
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(html: str) -> str:
    """The text of a page, a line for each block."""
    p = _Text()
    p.feed(html)
    return "\n".join(x.strip() for x in "".join(p.out).split("\n") if x.strip())


def epub(path: str, data: bytes) -> Parts:
    """The chapters, in the order of the book's spine, as one text."""
    z = zipfile.ZipFile(io.BytesIO(data))
    pages = [n for n in z.namelist() if n.endswith((".xhtml", ".html", ".htm"))]
    book = next((n for n in z.namelist() if n.endswith(".opf")), None)
    if book:
        root = ElementTree.fromstring(z.read(book))
        href = {i.get("id"): i.get("href") for i in root.iter() if i.tag.rpartition("}")[2] == "item"}
        base = book.rpartition("/")[0]
        order = [f"{base}/{href.get(i.get('idref'))}".lstrip("/") for i in root.iter() if i.tag.rpartition("}")[2] == "itemref"]
        pages = [n for n in order if n in z.namelist()] or pages
    return [("\n".join(html_text(z.read(n).decode("utf-8", "replace")) for n in pages), {"category": "epub"})]


def _body(message: Message) -> str:
    for part in message.walk():
        if part.get_content_type() in ("text/plain", "text/html") and not part.is_multipart():
            text = (part.get_payload(decode=True) or b"").decode(part.get_content_charset() or "utf-8", "replace")
            return text if part.get_content_type() == "text/plain" else html_text(text)
    return ""


def mbox(path: str, data: bytes) -> Parts:
    """One text for each message; a message begins at a line that starts with "From "."""
    messages = [email.message_from_bytes(part.partition(b"\n")[2]) for part in re.split(rb"(?m)^(?=From )", data) if part.startswith(b"From ")]
    return [("\n".join([*(f"{k}: {m.get(k, '')}" for k in ("Date", "From", "To", "Subject")), f"Content: {_body(m).strip()}"]), {"category": "mbox"}) for m in messages]


def ipynb(path: str, data: bytes) -> Parts:
    """One text for each code or markdown cell that isn't empty."""
    cells = json.loads(data.decode("utf-8")).get("cells", [])
    return [("".join(c.get("source", [])), {"cell": str(k), "cell_type": c.get("cell_type", ""), "category": "ipynb"}) for k, c in enumerate(cells) if "".join(c.get("source", [])).strip()]


#: Readers by suffix.  None: the kind is known, but its format needs software or a trained model that isn't here; give an extractor.
READERS: dict[str, Reader | None] = {
    ".docx": docx, ".pptx": pptx, ".pptm": pptx, ".xlsx": xlsx, ".xlsm": xlsx, ".csv": comma_separated, ".epub": epub, ".mbox": mbox, ".ipynb": ipynb,
    ".pdf": None, ".ppt": None, ".xls": None, ".hwp": None, ".jpg": None, ".jpeg": None, ".png": None, ".mp3": None, ".mp4": None, ".vsd": None, ".vsdx": None,
}
#: Suffixes that are read as plain text and then split as markdown.
MARKDOWN = (".md", ".mmd")


def read(path: str, data: bytes, extractors: dict[str, Reader] | None = None, encoding: str = "utf-8", errors: str = "ignore") -> Parts:
    """The texts of one file: by the extractor for its suffix (in small letters), else by the reader, else as one plain text."""
    suffix = re.search(r"(?<=[^/])(\.[^./]+)?$", path)[0].lower()
    found = (extractors or {}).get(suffix, READERS.get(suffix, False))
    if found is None:
        raise NotImplementedError(f"{suffix} files need an extractor")
    return found(path, data) if found else [(data.decode(encoding, errors), {"category": "Markdown"} if suffix in MARKDOWN else {})]
