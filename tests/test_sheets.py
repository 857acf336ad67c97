import io
import json
import zipfile

import pytest

from millrace.sources import parsers, sheets

S = sheets.SHEET.strip("{}")
W = sheets.WORD.strip("{}")


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def book(sheet, more="", props=""):
    """A workbook with a chart, a sheet at an absolute path and an empty sheet."""
    kind = sheets.LINK[1:-3]
    return packed({
        "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{kind}">{props}<sheets><sheet name="Chart" sheetId="9" r:id="c"/><sheet name="A &amp; B" sheetId="1" r:id="a"/><sheet name="Empty" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships><Relationship Id="c" Type="{kind}/chartsheet" Target="c.xml"/><Relationship Id="b" Type="{kind}/worksheet" Target="worksheets/s2.xml"/><Relationship Id="a" Type="{kind}/worksheet" Target="/xl/worksheets/s1.xml"/></Relationships>',
        "xl/worksheets/s1.xml": f'<worksheet xmlns="{S}"><sheetData>{sheet}</sheetData></worksheet>',
        "xl/worksheets/s2.xml": f'<worksheet xmlns="{S}"><sheetData/></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>name</t></si><si><r><t>in </t></r><r><t>parts</t></r><rPh><t>no</t></rPh></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{S}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0 &quot;days&quot;[Red]"/><numFmt numFmtId="166" formatCode="[hh]:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/></cellXfs></styleSheet>',
    } | ({"xl/more.xml": more} if more else {}))


CELLS = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>kind</t></is></c><c r="D1" t="s"><v>0</v></c></row>
<row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" s="1"><v>44197.5</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" t="e"><v>#DIV/0!</v></c><c r="E3"><v>9</v></c></row>
<row r="4"><c r="A4" s="2"><v>59</v></c><c r="B4" s="3"><v>1.50</v></c><c r="C4"><v>-7</v></c><c r="D4" s="4"><v>0.25</v></c></row>"""


def test_cells_of_a_workbook():
    got = list(sheets.batches("xlsx", book(CELLS)))
    assert [(t, b, c) for t, b, c, _ in got] == [("A & B", 0, ["name", "column_2", "kind", "name_2"])]
    rows = [list(json.loads(r).values()) for r in got[0][3]]
    # Row 2 isn't in the file; what lies beyond the header is dropped.
    assert rows == [[None] * 4, ["in parts", "2021-01-01T12:00:00", True, "#DIV/0!"], ["1900-02-28T00:00:00", 1.5, -7, "06:00:00"]]
    of_1904 = list(sheets.batches("xlsx", book(CELLS, props='<workbookPr date1904="1"/>')))
    assert json.loads(of_1904[0][3][1])["column_2"] == "2025-01-02T12:00:00"


@pytest.mark.parametrize("row", ['<row r="9999999"/>', '<row r="2"/><row r="2"/>', '<row><c r="ZZZZ1"/></row>', '<row><c r="B1"/><c r="A1"/></row>', '<row><c t="s"><v>7</v></c></row>'])
def test_damaged_sheets(row):
    with pytest.raises((ValueError, IndexError)):
        list(sheets.batches("xlsx", book(row)))


def test_tables_of_a_word_document():
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr>" + "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in text.split("\n")) + "</w:tc>"
    row = lambda *cells: f"<w:tr>{''.join(cells)}</w:tr>"
    wide, down, more = '<w:gridSpan w:val="2"/>', '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    body = "<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl>" + row(cell("k"), cell("v", wide)) + row(cell("a", down), cell("1\n2"), cell("x")) + row(cell("", more), cell("3"), cell("y")) + "</w:tbl><w:tbl/><w:p><w:r><w:t>end</w:t></w:r></w:p>"
    data = packed({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'})
    assert parsers.word_text(data) == "one\ttwo\n\nend"
    assert [(t, b, c, [json.loads(r) for r in rows]) for t, b, c, rows in sheets.batches("docx", data)] == [("table-1", 0, ["k", "v", "v_2"], [{"k": "a", "v": "1\n2", "v_2": "x"}, {"k": "a", "v": "3", "v_2": "y"}])]


def test_batches_of_files_and_errors_apart(spark, monkeypatch):
    lines = "a,b\n" + "".join(f"{i}\n" for i in range(1001))
    late = "".join(f"<row><c><v>{i}</v></c></row>" for i in range(600)) + '<row><c t="s"><v>99</v></c></row>'
    rows = [("1.csv", "csv", lines.encode()), ("2.xlsx", "xlsx", book(CELLS)), ("3.xlsx", "xlsx", b"no zip"), ("4.pdf", "pdf", b""), ("5.csv", "csv", b""), ("6.xlsx", "xlsx", book(late)), ("7.csv", "csv", None)]
    good, bad = sheets.table_batches(spark.createDataFrame(rows, "path string, extension string, content binary"))
    got = sorted((r.path, r.table, r.batch, len(r.rows), json.loads(r.rows[-1])) for r in good.collect())
    assert [g[:4] for g in got] == [("1.csv", "csv", 0, 500), ("1.csv", "csv", 1, 500), ("1.csv", "csv", 2, 1), ("2.xlsx", "A & B", 0, 3)]
    assert got[2][4] == {"a": "1000", "b": None}
    # A file that is damaged late has no batches at all.
    assert sorted(r.path for r in bad.collect()) == ["3.xlsx", "4.pdf", "6.xlsx", "7.csv"]
    monkeypatch.setattr(sheets, "ARCHIVE_BYTES", 10)
    with pytest.raises(ValueError, match="too large"):
        list(sheets.batches("xlsx", book(CELLS)))
