"""Bytes of files to texts and rows: text, CSV, HTML, mail and Word documents."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import column_names

# Tags whose end is a line end in stripped text.
BLOCKS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6")
ARCHIVE_BYTES = 512 << 20


class PageText(HTMLParser):
    """Text nodes of a page; script and style are left out."""

    def __init__(self, lines: bool) -> None:
        super().__init__()
        self.lines, self.parts, self.hidden = lines, [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif not self.lines and tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden and (not self.lines or data.strip()):
            self.parts.append(data.strip() if self.lines else data)


def html_text(html: str) -> str:
    """Each text node on a line of its own, trimmed."""
    page = PageText(True)
    page.feed(html)
    return "\n".join(page.parts)


def html_stripped(html: str) -> str:
    """Running text: line ends after block elements, two blank lines at most in a row become one."""
    page = PageText(False)
    page.feed(html)
    return re.sub(r"\n{3,}", "\n\n", "".join(page.parts)).strip()


def html_text_column(html: Column, stripped: bool = False) -> Column:
    one = html_stripped if stripped else html_text
    return F.pandas_udf(lambda s: s.map(lambda h: None if h is None else one(h)), "string")(html)


def decoded(data: bytes) -> str:
    """UTF-8, else Latin-1."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def csv_text(data: bytes) -> tuple[str, int]:
    """Rows as lines with | between cells, and a number of pages of 50 rows."""
    text = decoded(data)
    try:
        dialect = csv.Sniffer().sniff(text[:4096])
    except csv.Error:
        dialect = csv.excel
    lines = [" | ".join(r) for r in csv.reader(io.StringIO(text), dialect)]
    return "\n".join(lines), max(1, len(lines) // 50)


def csv_rows(data: bytes) -> list[dict[str, str | None]]:
    """Rows by header: short rows are filled with null, cells beyond the header are dropped."""
    lines = list(csv.reader(io.StringIO(decoded(data))))
    if not lines:
        return []
    names = column_names(lines[0])
    return [dict(zip(names, [*r, *[None] * (len(names) - len(r))], strict=False)) for r in lines[1:]]


def mail_text(data: bytes) -> tuple[str, dict[str, str]]:
    """A message's body (plain rather than HTML) and its main headers and attachments' names."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    body = message.get_body(("plain", "html"))
    text = "" if body is None else body.get_content()
    if body is not None and body.get_content_type() == "text/html":
        text = html_text(text)
    heads = {k: str(message[k]) for k in ("from", "to", "subject", "date") if message[k]}
    names = [a.get_filename() or "" for a in message.iter_attachments()]
    return text.strip(), heads | ({"attachments": ", ".join(names)} if names else {})


def word_text(data: bytes) -> str:
    """Paragraphs of a .docx file, a blank line between them; those in tables are left out (see `sheets.word_tables`)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if sum(i.file_size for i in z.infolist()) > ARCHIVE_BYTES:
            raise ValueError("the archive is too large when unpacked")
        root = ElementTree.fromstring(z.read("word/document.xml"))
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    marks = {f"{space}tab": "\t", f"{space}br": "\n", f"{space}cr": "\n"}

    def paragraphs(e: ElementTree.Element) -> Iterator[str]:
        for child in e:
            if child.tag == f"{space}p":
                yield "".join(t.text or "" if t.tag == f"{space}t" else marks.get(t.tag, "") for run in child.iter(f"{space}r") for t in run)
            elif child.tag != f"{space}tbl":
                yield from paragraphs(child)

    return "\n\n".join(p for p in paragraphs(root) if p.strip())


def parse(extension: str, data: bytes) -> tuple[str, int]:
    """Text and number of pages of a file."""
    if extension in ("csv", "tsv"):
        return csv_text(data)
    if extension in ("html", "htm"):
        text = html_text(decoded(data))
    elif extension == "eml":
        text = mail_text(data)[0]
    elif extension == "docx":
        text = word_text(data)
    elif extension in ("txt", "md", "text", "log", "json"):
        text = decoded(data)
    else:
        raise ValueError(f"no parser for .{extension}")
    return text, max(1, len(text) // 3000)


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of files (path, name, extension, size, content): a file that fails leaves the others be."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, name, extension, size, data in zip(*(part[c] for c in ("path", "name", "extension", "size", "content")), strict=True):
                try:
                    text, pages = parse(extension, data)
                    out.append((path, name, extension, size, text, pages, None))
                except Exception as e:  # noqa: BLE001  any file may be damaged in any way
                    out.append((path, name, extension, size, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "name", "extension", "size", "text", "page_count", "error"])

    rows = files.select("path", "name", "extension", "size", "content").mapInPandas(run, "path string, name string, extension string, size long, text string, page_count int, error string")
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("path", "error")


def ocr_lines(tokens: DataFrame) -> DataFrame:
    """Lines of a page from word rows of recognised text (page, block, par, line, word, left, top, width, height, conf, text): the words joined, the box around them and the mean confidence from 0 to 1."""
    words = tokens.where((F.col("level") == 5) & (F.trim("text") != ""))
    sure = F.when(F.col("conf") >= 0, F.col("conf") / 100.0)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ")
    return words.groupBy("page", "block", "par", "line").agg(joined.alias("text"), F.round(F.avg(sure), 4).alias("confidence"), F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"))


def table_headers(cells: DataFrame) -> DataFrame:
    """col and name of a table's columns: header cells (header_level set) over each column joined by ' / ' from top to bottom, repeats numbered."""
    from pyspark.sql import Window as W

    spread = cells.where("header_level is not null").withColumn("col", F.explode(F.sequence("column", F.col("column") + F.col("colspan") - 1)))
    joined = spread.groupBy("col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda c: c["text"]), " / ").alias("base"))
    nth = F.row_number().over(W.partitionBy("base").orderBy("col"))
    return joined.select("col", F.when(nth == 1, F.col("base")).otherwise(F.concat_ws("_", "base", nth)).alias("name"))
