"""Readers, the file stream, and the driver's contract."""

import io
import zipfile

from pyspark.sql import functions as F

import __spark_entry__
from ledgerloom.sources import readers, writers
from ledgerloom.streaming import ingest

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def workbook() -> bytes:
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>2025</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row>'
    return packed({
        "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="Table 1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {NS}><si><t>Balance Sheet</t></si><si><r><t>To</t></r><r><t>tal</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {NS}><sheetData>{cells}</sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>',
        "xl/worksheets/_rels/sheet1.xml.rels": '<Relationships><Relationship Id="x" Type="http://x/comments" Target="../comments1.xml"/></Relationships>',
        "xl/comments1.xml": f'<comments {NS}><authors><author>Me</author></authors><commentList><comment ref="B2" authorId="0"><text><t>why</t></text></comment></commentList></comments>',
    })


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = packed({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Note 7: Cash</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})


def folder(tmp_path):
    for name, content in (("a.xlsx", workbook()), ("b.docx", DOCX), ("c.zip", packed({"in/x.pdf": "pdf", "y.txt": "no"})), ("bad.xlsx", b"broken"), ("bad.zip", b"broken"), ("d.pdf", b"%PDF"), ("e.png", b"img"), ("f.txt", b"text")):
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def test_readers(spark, tmp_path):
    found = readers.files(spark, folder(tmp_path))
    assert {r.doc_id.rsplit("/", 1)[1]: r.kind for r in found.collect()} == {"a.xlsx": "xlsx", "b.docx": "docx", "c.zip": "zip", "bad.xlsx": "xlsx", "bad.zip": "zip", "d.pdf": "pdf", "e.png": "image", "f.txt": None}
    sheets = {r.doc_id.rsplit("/", 1)[1]: r for r in readers.sheets(found).collect()}
    good = sheets["a.xlsx"]
    assert (good.sheet_type, good.headers, good.rows) == ("balance_sheet", ["Balance Sheet", "Balance Sheet", "2025"], [["Total", "7", None]])
    assert [tuple(c) for c in good.comments] == [("B2", "why", "Me")] and sheets["bad.xlsx"].error
    word = readers.word_documents(found).first()
    assert "Note 7: Cash" in word.raw_text and word.tables == [[["A", "1"]]]
    assert [(r.name, bytes(r.content)) for r in readers.archived(found).collect()] == [("in/x.pdf", b"pdf")]
    pdf = readers.pdf_pages(found, lambda content: [(1, content.decode(), [], False)]).first()
    assert (pdf.raw_text, pdf.error) == ("%PDF", None)
    assert readers.image_pages(found, lambda content: ["one", "two"]).first().raw_text == "one\ntwo"


def test_recognised_text(spark):
    pages = spark.createDataFrame([("a", "short", True, "a longer recognised text"), ("b", "short", False, "a longer recognised text"), ("c", "x" * 40, True, "y" * 80)], "doc_id string, raw_text string, has_images boolean, ocr_text string")
    assert [(r.doc_id, r.ocr) for r in readers.prefer_recognised(pages).orderBy("doc_id").collect()] == [("a", True), ("b", False), ("c", False)]


def test_word_reports(spark):
    one = lambda **c: spark.createDataFrame([("d", *c.values())], "doc_id string, " + ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in c.items()))
    parts = {
        "summary": one(rating_ord=0, rating="High", count=1, areas="A & B"), "observations": one(number=1, area="A", observation="<seen>", notes="Note 1", rating="High", citation="", recommendation="do"),
        "movements": one(row=1, line_item="Cash", current="1", prior="2", change="-50.0%"), "ratios": one(ratio_ord=0, name="Current Ratio", current="1.50", prior="-"),
    }
    made = writers.word_reports(parts, one(number=1, step="Go on")).first()
    text, tables = readers.read_docx(bytes(made.content))
    assert "1. Go on" in text and tables[0][1] == ["High", "1", "A & B"] and tables[1][1][2] == "<seen>" and len(tables) == 4


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    folder(tmp_path / "in")
    stream = ingest.file_stream(spark, str(tmp_path / "in"), per_trigger=3)
    query = ingest.ingest(stream, lambda batch: batch.select("doc_id", "kind", F.length("content").alias("n")), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_driver_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 60
