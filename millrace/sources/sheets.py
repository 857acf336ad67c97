"""Tables in files (spreadsheets, Word documents, CSV) as batches of rows under named columns."""

from __future__ import annotations

import csv
import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

from millrace.functions.columns import column_names
from millrace.sources.parsers import ARCHIVE_BYTES
from millrace.sources.tables import ROWS_IN_BATCH

Cell = str | int | float | bool | None
# Namespaces of the two formats, and the numbers of built-in formats that show dates or times.
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
# The most rows and columns that a sheet has.
SHEET_ROWS, SHEET_COLUMNS = 1 << 20, 1 << 14
#: The parts of a custom format that are no placeholders: quoted and escaped text, colours and conditions.
NOT_PLACEHOLDERS = re.compile(r'"[^"]*"|\\.|_.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.IGNORECASE)


def archive(data: bytes) -> zipfile.ZipFile:
    """The archive; ValueError if it is too large when unpacked."""
    opened = zipfile.ZipFile(io.BytesIO(data))
    if sum(i.file_size for i in opened.infolist()) > ARCHIVE_BYTES:
        raise ValueError("the archive is too large when unpacked")
    return opened


def elements(z: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag, each dropped from memory once it has been used."""
    with z.open(name) as part:
        events = ElementTree.iterparse(part, ("start", "end"))
        _, root = next(events)
        parents = [root]
        for event, e in events:
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag == tag:
                yield e
                parents[-1].remove(e)


def strings(z: zipfile.ZipFile) -> list[str]:
    """The shared strings; phonetic notes are left out."""
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return [rich_text(e) for e in elements(z, "xl/sharedStrings.xml", f"{SHEET}si")]


def rich_text(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for part in e if part.tag in (f"{SHEET}t", f"{SHEET}r") for t in part.iter(f"{SHEET}t"))


def shows_date(code: str) -> bool:
    """Whether a custom format shows a date or a time; only its part for positive numbers counts."""
    return bool(re.search("[dmyhs]", NOT_PLACEHOLDERS.sub("", code.split(";")[0]), re.IGNORECASE))


def date_styles(z: zipfile.ZipFile) -> set[int]:
    """The styles of cells that hold dates or times."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId", 0)): f.get("formatCode", "") for f in root.iter(f"{SHEET}numFmt")}
    used = (int(x.get("numFmtId", 0)) for x in root.iterfind(f"{SHEET}cellXfs/{SHEET}xf"))
    return {i for i, n in enumerate(used) if (shows_date(custom[n]) if n in custom else n in DATE_FORMATS)}


def moment(days: float, from_1904: bool) -> str:
    """A serial number as ISO time; below one day it is a time alone. 1900 counts a 29 February that wasn't."""
    at = timedelta(milliseconds=round(days * 86_400_000))
    if 0 <= days < 1 and not from_1904:
        return (datetime(1900, 1, 1) + at).time().isoformat()
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31 if days < 60 else 30)
    return (start + at).isoformat()


def number(text: str) -> int | float:
    value = float(text)
    return int(text) if re.fullmatch(r"-?\d+", text) else value


def column_of(place: str) -> int:
    """The column of a place such as AB12, from 0."""
    n = 0
    for c in re.match("[A-Z]*", place)[0]:  # type: ignore[index]
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_cells(z: zipfile.ZipFile, name: str, shared: list[str], dates: set[int], from_1904: bool) -> Iterator[list[Cell]]:
    """Rows from the first to the last with a number, those left out in the file as empty ones; a merged range has its value in its first cell."""
    at = 0
    for row in elements(z, name, f"{SHEET}row"):
        number_of_row = int(row.get("r", at + 1))
        if not at < number_of_row <= SHEET_ROWS:
            raise ValueError(f"row {number_of_row} after row {at}")
        yield from ([] for _ in range(number_of_row - at - 1))
        at = number_of_row
        cells: list[Cell] = []
        for c in row.iterfind(f"{SHEET}c"):
            column = column_of(c.get("r", "")) if c.get("r") else len(cells)
            if not len(cells) <= column < SHEET_COLUMNS:
                raise ValueError(f"a cell at {c.get('r')} after {len(cells)} columns")
            cells += [None] * (column - len(cells))
            kind, text = c.get("t", "n"), c.findtext(f"{SHEET}v")
            inline = c.find(f"{SHEET}is")
            value: Cell = text
            if kind == "inlineStr":
                value = None if inline is None else rich_text(inline)
            elif not text:
                value = None
            elif kind == "s":
                value = shared[int(text)]
            elif kind == "b":
                value = text in ("1", "true")
            elif kind == "n":
                value = moment(float(text), from_1904) if int(c.get("s", 0)) in dates else number(text)
            cells.append(value)
        yield cells


def workbook_tables(data: bytes) -> Iterator[tuple[str, Iterator[list[Cell]]]]:
    """Title and rows of each sheet of an .xlsx file, in order; sheets of charts have none."""
    with archive(data) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared, dates = strings(z), date_styles(z)
        of_1904 = any(p.get("date1904") in ("1", "true") for p in book.iter(f"{SHEET}workbookPr"))
        for sheet in book.iter(f"{SHEET}sheet"):
            link = links[sheet.get(LINK)]
            if link.get("Type", "").endswith("/worksheet"):
                yield sheet.get("name", ""), sheet_cells(z, posixpath.normpath(posixpath.join("/xl", link.get("Target", "")))[1:], shared, dates, of_1904)


def workbook(title: str, names: list[str], rows: str) -> bytes:
    """An .xlsx file with one sheet: a row of names, then rows that are XML already."""
    space = SHEET.strip("{}")
    head = "".join(f'<c t="inlineStr"><is><t>{escape(n)}</t></is></c>' for n in names)
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{LINK[1:-3]}"><sheets><sheet name={quoteattr(title)} sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships><Relationship Id="r1" Type="{LINK[1:-3]}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{space}"><sheetData><row>{head}</row>{rows}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def paragraph_text(p: ElementTree.Element) -> str:
    marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
    return "".join(t.text or "" if t.tag == f"{WORD}t" else marks.get(t.tag, "") for run in p.iter(f"{WORD}r") for t in run)


def word_tables(data: bytes) -> Iterator[tuple[str, Iterator[list[Cell]]]]:
    """Name and rows of each table of a .docx file's body, in order. A cell over several columns or rows stands in each of them; tables within cells are left out."""

    def rows(table: ElementTree.Element) -> Iterator[list[Cell]]:
        above: list[Cell] = []
        for row in table.iterfind(f"{WORD}tr"):
            cells: list[Cell] = []
            for cell in row.iterfind(f"{WORD}tc"):
                span, down = cell.find(f"{WORD}tcPr/{WORD}gridSpan"), cell.find(f"{WORD}tcPr/{WORD}vMerge")
                text: Cell = "\n".join(paragraph_text(p) for p in cell.iterfind(f"{WORD}p"))
                if down is not None and down.get(f"{WORD}val", "continue") == "continue" and len(cells) < len(above):
                    text = above[len(cells)]
                cells += [text] * (1 if span is None else int(span.get(f"{WORD}val", 1)))
            yield cells
            above = cells

    with archive(data) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    for n, table in enumerate([] if body is None else body.iterfind(f"{WORD}tbl"), 1):
        yield f"table-{n}", rows(table)


def csv_table(data: bytes) -> Iterator[tuple[str, Iterator[list[Cell]]]]:
    yield "csv", csv.reader(io.TextIOWrapper(io.BytesIO(data), "utf-8-sig", "replace", newline=""))  # type: ignore[misc]


#: What reads the tables of a file, by extension.
READERS = {"xlsx": workbook_tables, "docx": word_tables, "csv": csv_table}


def batches(extension: str, data: bytes | None) -> Iterator[tuple[str, int, list[str], list[str]]]:
    """table, batch, columns and rows (JSON objects) of a file's tables.

    The first row of a table names the columns. Cells beyond it are dropped, missing ones are null.
    """
    if extension not in READERS:
        raise ValueError(f"no tables in .{extension}")
    if data is None:
        raise ValueError("no content")
    for name, rows in READERS[extension](data):
        first = next(rows, None)
        if first is None:
            continue
        columns = column_names(["" if c is None else str(c) for c in first])
        held, batch = [], 0
        for row in rows:
            held.append(json.dumps(dict(zip(columns, [*row, *[None] * (len(columns) - len(row))], strict=False)), ensure_ascii=False))
            if len(held) == ROWS_IN_BATCH:
                yield name, batch, columns, held
                held, batch = [], batch + 1
        if held:
            yield name, batch, columns, held


def table_batches(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches, errors) of files (path, extension, content).

    A row of batches: path, table, batch, columns, rows. Files with an error have no batches, other files
    are whole: each file is read once for its faults and once for its rows, so that a task holds one batch.
    """
    fields = ["path", "table", "batch", "columns", "rows", "error"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, extension, data in zip(part["path"], part["extension"], part["content"], strict=True):
                try:
                    for _ in batches(extension, data):
                        pass
                except Exception as e:  # noqa: BLE001  any file may be damaged in any way
                    yield pd.DataFrame([(path, None, None, None, None, f"{type(e).__name__}: {e}")], columns=fields)
                    continue
                for batch in batches(extension, data):
                    yield pd.DataFrame([(path, *batch, None)], columns=fields)

    rows = files.select("path", "extension", "content").mapInPandas(run, "path string, table string, batch int, columns array<string>, rows array<string>, error string")
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("path", "error")
