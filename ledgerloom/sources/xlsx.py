"""Spreadsheets read as a stream of rows, with the types that styles give to numbers.

A sheet's XML is walked by events and each row is let go once it is handed on; merged ranges, which the format puts behind the rows, are found
first by a scan of the bytes, and a window of the ranges open at a row carries their values down. In memory are the shared strings, the ranges and
the row at hand, whatever the number of rows.

Values are texts, as a reader with types would print them: numbers without exponents and without binary residues (the shortest decimal of the same double),
dates by the cell's number format, in either epoch, as ``2025-03-31 00:00:00``, times as ``12:30:00``, spans of time as ``1 day, 2:00:00``. A boolean is
``True`` or ``False`` in the first row and as a label, 1 or 0 where a figure stands. Error values are their text.
"""

from __future__ import annotations

import datetime
import functools
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from xml.etree import ElementTree

#: Columns that a merged range spreads to beyond the used area at most, and rows that are handed on together.
MERGED_WIDTH, PART = 16, 1000
#: Built-in number formats that show a date or time, and the one that shows a span.
DATE_FORMATS, SPAN_FORMATS = frozenset((*range(14, 23), 45, 47)), frozenset((46,))
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_MERGE = re.compile(rb"<(?:\w+:)?mergeCell\s[^>]*?\bref\s*=\s*[\"']([A-Z]+\d+)(?::([A-Z]+\d+))?[\"']")
_CELL = re.compile(rb"<(?:\w+:)?c\s[^>]*?\br\s*=\s*[\"']([A-Z]{1,3})(\d+)[\"']")
_MERGES = re.compile(rb"<(?:\w+:)?mergeCell\s")
_CHUNK = 1 << 20


@dataclass
class Sheet:
    """A sheet and its rows, which can be walked once. commented: the values of commented cells, known after the walk."""

    number: int
    name: str
    merged: list[tuple[int, int, int, int]]
    comments: list[tuple[str, str, str]]
    rows: Iterator[list[str | None]]
    commented: dict[str, str | None] = field(default_factory=dict)


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


@functools.lru_cache(maxsize=1 << 16)
def place(reference: str) -> tuple[int, int]:
    """Row and column, from 0."""
    letters = reference.rstrip("0123456789")
    return int(reference[len(letters) :]) - 1, column_number(letters)


@functools.lru_cache(maxsize=1 << 12)
def shows_date(code: str) -> tuple[bool, bool]:
    """Whether a number format shows a date or time, and whether a span of time ([h]:mm)."""
    first = re.sub(r'"[^"]*"|\\.|_.|\*.', "", code).split(";")[0]
    span = bool(re.search(r"(?i)\[(?:h+|m+|s+)\]", first))
    return span or bool(re.search(r"(?i)[dmhys]", re.sub(r"\[[^\]]*\]", "", first))), span


def number_text(text: str) -> str:
    """A number as plain decimal digits; what is no number stays."""
    if text.isdecimal():
        return text
    try:
        value = float(text) if re.search(r"[.eE]", text) else int(text)
    except ValueError:
        return text
    if value != value or abs(value) == float("inf"):
        return text
    shown = repr(value)
    return format(Decimal(shown), "f") if "e" in shown else shown


def date_text(text: str, span: bool, mac: bool) -> str:
    """A serial number as date and time, as a time if it is below one day, or as a span; what is no such number stays."""
    try:
        serial = float(text)
        day, part = divmod(serial, 1)
        rest = datetime.timedelta(milliseconds=round(part * 86_400_000))
        if span:
            return str(datetime.timedelta(days=day) + rest)
        if 0 <= serial < 1 and not rest.days:
            return str((datetime.datetime.min + rest).time())
        # The older epoch counts a 29th of February 1900.
        start = datetime.datetime(1904, 1, 1) if mac else datetime.datetime(1899, 12, 31) if 0 < serial < 60 else datetime.datetime(1899, 12, 30)
        return str(start + datetime.timedelta(days=day) + rest)
    except (ValueError, OverflowError):
        return number_text(text)


class Workbook:
    """Sheets of a workbook's bytes, one after the other."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        book = self._tree("xl/workbook.xml")
        properties = book.find(f"{_S}workbookPr")
        self.mac = properties is not None and properties.get("date1904") in ("1", "true")
        links = {r.get("Id"): r.get("Target") for r in self._tree("xl/_rels/workbook.xml.rels")}
        self.paths = []
        for sheet in book.iter(f"{_S}sheet"):
            target = links[sheet.get(f"{_R}id")].lstrip("/")
            self.paths.append((sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
        self.shared = list(self._shared()) if "xl/sharedStrings.xml" in self.names else []
        self.formats = self._formats() if "xl/styles.xml" in self.names else []

    def __enter__(self) -> Workbook:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()

    def _tree(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def _shared(self) -> Iterator[str]:
        if self.zip.getinfo("xl/sharedStrings.xml").file_size < _CHUNK:
            yield from map(_text, self._tree("xl/sharedStrings.xml").iter(f"{_S}si"))
            return
        with self.zip.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == f"{_S}si":
                    yield _text(e)
                    e.clear()

    def _formats(self) -> list[tuple[bool, bool]]:
        """Whether each cell style shows a date, and a span."""
        styles = self._tree("xl/styles.xml")
        own = {int(f.get("numFmtId")): shows_date(f.get("formatCode") or "") for f in styles.iter(f"{_S}numFmt")}
        listed = styles.find(f"{_S}cellXfs")
        numbers = [int(x.get("numFmtId") or 0) for x in (listed if listed is not None else ())]
        return [own.get(n, (n in DATE_FORMATS or n in SPAN_FORMATS, n in SPAN_FORMATS)) for n in numbers]

    def sheet(self, number: int) -> Sheet:
        name, path = self.paths[number]
        merged, width, height = self._extent(path)
        comments = self._comments(path)
        found = Sheet(number, name, merged, comments, iter(()))
        found.rows = self._rows(path, merged, width, height, {ref for ref, *_ in comments}, found.commented)
        return found

    def _extent(self, path: str) -> tuple[list, int, int]:
        """Merged ranges (0-based, inclusive), and the used columns and rows, which only merged ranges need."""
        merged, cells, width, height, kept = [], [], 0, 0, b""
        if self.zip.getinfo(path).file_size < _CHUNK and not _MERGES.search(self.zip.read(path)):
            return merged, width, height
        with self.zip.open(path) as f:
            while chunk := f.read(_CHUNK):
                data = kept + chunk
                cut = data.rfind(b"<") if len(chunk) == _CHUNK else len(data)
                cut = cut if cut > 0 else len(data)
                data, kept = data[:cut], data[cut:]
                merged += [(*place(a.decode()), *place((b or a).decode())) for a, b in _MERGE.findall(data)]
                cells = _CELL.findall(data)
                if cells:
                    height = max(height, int(cells[-1][1]))
                    width = max(width, *(column_number(c.decode()) + 1 for c in {c for c, _ in cells}))
        return merged, width, height

    def _rows(self, path: str, merged: list, width: int, height: int, noted: set[str], commented: dict) -> Iterator[list[str | None]]:
        """Rows in order, the first even if it is empty, else those with a value; short ones as wide as the first."""
        starts = sorted(merged)
        open_ranges: list[tuple[int, int, int, str | None]] = []  # bottom, left, right, value
        at, first, last = 0, 0, -1
        wanted = {place(ref): ref for ref in noted}

        def finished(r: int, cells: dict[int, str]) -> list[str | None]:
            nonlocal at, open_ranges, first
            open_ranges = [x for x in open_ranges if x[0] >= r]
            while at < len(starts) and starts[at][0] <= r:
                top, left, bottom, right = starts[at]
                at += 1
                if top == r and left in cells:
                    open_ranges.append((min(bottom, max(height - 1, top)), left, min(right, max(width - 1, left + MERGED_WIDTH)), cells[left]))
            for _, left, right, value in open_ranges:
                for k in range(left, right + 1):
                    cells[k] = value
            for (row, k), ref in wanted.items() if noted else ():
                if row == r:
                    commented[ref] = cells.get(k)
            if r == 0:
                first = max(cells, default=-1) + 1
            return [cells.get(k) for k in range(max(max(cells, default=-1) + 1, first))]

        for r, cells in self._cells(path):
            for gap in range(last + 1, r):  # rows that only merged ranges fill
                if gap == 0 or any(x[0] >= gap for x in open_ranges):
                    yield finished(gap, {})
            values = finished(r, cells)
            if r == 0 or any(v is not None for v in values):
                yield values
            last = r
        for gap in range(last + 1, max((x[0] for x in open_ranges), default=-1) + 1):
            yield finished(gap, {})

    def _cells(self, path: str) -> Iterator[tuple[int, dict[int, str]]]:
        """Row numbers, from 0, and the values of their cells by column."""
        row = -1
        for e in self._row_elements(path):
            row = int(e.get("r") or row + 2) - 1
            cells, column = {}, -1
            for c in e.iter(f"{_S}c"):
                ref = c.get("r")
                column = place(ref)[1] if ref else column + 1
                value = self._value(c, figure=row > 0 and column > 0)
                if value is not None:
                    cells[column] = value
            yield row, cells

    def _row_elements(self, path: str) -> Iterator[ElementTree.Element]:
        """Row elements in order: of a small sheet's tree, of others by events. A broken sheet gives those before the break."""
        if self.zip.getinfo(path).file_size < _CHUNK:
            try:
                rows = list(self._tree(path).iter(f"{_S}row"))
            except ElementTree.ParseError:
                rows = None
            if rows is not None:
                yield from rows
                return
        holder = None
        with self.zip.open(path) as f:
            for event, e in ElementTree.iterparse(f, ("start", "end")):
                if event == "start":
                    holder = e if e.tag == f"{_S}sheetData" else holder
                elif e.tag == f"{_S}row":
                    yield e
                    e.clear()
                    if holder is not None:
                        holder.clear()

    def _value(self, c, figure: bool) -> str | None:
        kind = c.get("t") or "n"
        if kind == "inlineStr":
            return _text(c)
        v = c.find(f"{_S}v")
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.shared[int(v.text)]
        if kind == "b":
            true = v.text.strip() in ("1", "true")
            return ("1" if true else "0") if figure else str(true)
        if kind == "d":
            return v.text.strip().replace("T", " ").removesuffix("Z")
        if kind != "n":
            return v.text
        style = int(c.get("s") or 0)
        date, span = self.formats[style] if style < len(self.formats) else (False, False)
        return date_text(v.text.strip(), span, self.mac) if date else number_text(v.text.strip())

    def _comments(self, path: str) -> list[tuple[str, str, str]]:
        """Cell, text and author of each comment."""
        folder, _, base = path.rpartition("/")
        rels, out = f"{folder}/_rels/{base}.rels", []
        if rels in self.names:
            for r in self._tree(rels):
                if r.get("Type", "").endswith("/comments"):
                    target = "xl/" + r.get("Target").replace("../", "").removeprefix("/xl/")
                    root = self._tree(target)
                    authors = [a.text or "" for a in root.iter(f"{_S}author")]
                    out += [(c.get("ref"), _text(c), authors[int(c.get("authorId", 0))] if authors else "") for c in root.iter(f"{_S}comment")]
        return out


def _text(node) -> str:
    """The text of a string item: its plain and its formatted runs, not the reading aids of eastern scripts."""
    if len(node) == 1 and node[0].tag == f"{_S}t":
        return node[0].text or ""
    aids = {id(t) for aid in node.iter(f"{_S}rPh") for t in aid.iter(f"{_S}t")}
    return "".join(t.text or "" for t in node.iter(f"{_S}t") if id(t) not in aids)


class Phrases:
    """Which of some phrases a stream of cell texts, joined by blanks, holds."""

    def __init__(self, phrases: list[str]):
        self.open, self.found, self.tail = list(phrases), [], ""
        self.reach = max(map(len, phrases), default=1) - 1

    def see(self, cells: list[str | None]) -> None:
        if not self.open:
            return
        text = self.tail + " ".join(c for c in cells if c is not None).lower() + " "
        hit = [p for p in self.open if p in text]
        self.found += hit
        self.open = [p for p in self.open if p not in hit]
        self.tail = text[-self.reach :]
