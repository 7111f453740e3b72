"""Workbooks with types and PDF files page by page."""

import os
import resource
import time
import uuid
import zipfile
from io import BytesIO

import pytest
from pyspark import TaskContext

from ledgerloom.plans.analysis import Analysis, analyze_files
from ledgerloom.sources import pdf, readers, xlsx

from .test_sources import NS, packed

STYLES = f"""<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="dd\\-mmm\\-yyyy"/><numFmt numFmtId="165" formatCode="[Red]0.0&quot; days&quot;"/><numFmt numFmtId="166" formatCode="[h]:mm:ss"/><numFmt numFmtId="167" formatCode="[$-409]mmm\\ yy;@"/></numFmts>
<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="9"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/><xf numFmtId="167"/><xf numFmtId="20"/></cellXfs></styleSheet>"""


def book(*sheets, styles=STYLES, shared="", properties="", more=()):
    """Bytes of a workbook of sheets (sheetData's inside, what follows it)."""
    listed = "".join(f'<sheet name="S{i}" sheetId="{i}" r:id="r{i}"/>' for i in range(1, len(sheets) + 1))
    parts = {
        "xl/workbook.xml": f"<workbook {NS}>{properties}<sheets>{listed}</sheets></workbook>", "xl/styles.xml": styles, "xl/sharedStrings.xml": f"<sst {NS}>{shared}</sst>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>",
    }
    parts |= {f"xl/worksheets/sheet{i}.xml": s if s.startswith("!") else f"<worksheet {NS}><sheetData>{s}</sheetData></worksheet>" for i, s in enumerate(sheets, 1)}
    return packed(parts | dict(more))


def values(row, **options):
    return readers.read_xlsx(book(f'<row r="1"><c r="A1"><v>0</v></c></row><row r="2"><c r="A2" t="inlineStr"><is><t>x</t></is></c>{row}</row>', **options))[0]["rows"][1][1:]


@pytest.mark.parametrize(
    ("cell", "text"),
    [
        ('<c r="B2"><v>7</v></c>', "7"), ('<c r="B2"><v>-12.5</v></c>', "-12.5"), ('<c r="B2" s="2"><v>7.0000000000000007E-2</v></c>', "0.07"), ('<c r="B2"><v>-1.4551915228366852E-11</v></c>', "-0.000000000014551915228366852"),
        ('<c r="B2"><v>1.0E+5</v></c>', "100000.0"), ('<c r="B2"><v>0.1</v></c>', "0.1"), ('<c r="B2"><v>2.9999999999999999E-1</v></c>', "0.3"),
        ('<c r="B2" s="1"><v>45747</v></c>', "2025-03-31 00:00:00"), ('<c r="B2" s="3"><v>45747.75</v></c>', "2025-03-31 18:00:00"), ('<c r="B2" s="6"><v>45747</v></c>', "2025-03-31 00:00:00"), ('<c r="B2" s="1"><v>1</v></c>', "1900-01-01 00:00:00"),
        ('<c r="B2" s="1"><v>61</v></c>', "1900-03-01 00:00:00"), ('<c r="B2" s="7"><v>0.5</v></c>', "12:00:00"), ('<c r="B2" s="5"><v>1.25</v></c>', "1 day, 6:00:00"), ('<c r="B2" s="4"><v>30</v></c>', "30"), ('<c r="B2" s="1"><v>1E+99</v></c>', "1" + "0" * 99),
        ('<c r="B2" t="b"><v>1</v></c>', "1"), ('<c r="B2" t="b"><v>0</v></c>', "0"), ('<c r="B2" t="e"><v>#DIV/0!</v></c>', "#DIV/0!"), ('<c r="B2" t="str"><f>A1</f><v>got</v></c>', "got"), ('<c r="B2" t="d"><v>2025-03-31T10:00:00</v></c>', "2025-03-31 10:00:00"),
        ('<c r="B2" t="s"><v>0</v></c>', "東京 one"), ('<c r="B2" s="99"><v>5</v></c>', "5"), ("<c><v>4</v></c>", "4"),
    ],
)
def test_cell_types(cell, text):
    shared = "<si><r><t>東京</t></r><rPh sb='0' eb='2'><t>トウキョウ</t></rPh><r><t> one</t></r></si>"
    assert values(cell, shared=shared) == [text]


def test_older_epoch_and_headers():
    assert values('<c r="B2" s="1"><v>0</v></c><c r="C2" s="1"><v>43921</v></c>', properties='<workbookPr date1904="1"/>') == ["00:00:00", "2024-04-01 00:00:00"]
    head = '<row r="1"><c r="A1" t="b"><v>1</v></c><c r="B1" s="1"><v>45747</v></c></row><row r="2"><c r="A2" t="b"><v>0</v></c></row>'
    assert readers.read_xlsx(book(head))[0]["rows"] == [["True", "2025-03-31 00:00:00"], ["False", None]]


def test_formats_that_show_dates():
    shown = {"General": (False, False), "0.00E+00": (False, False), "[Red]#,##0": (False, False), '0" days"': (False, False), "d/m/yy h:mm": (True, False), "[hh]:mm": (True, True), "[$-F800]dddd": (True, False), "@": (False, False), "0.0\\d": (False, False), '_("$"* 0_)': (False, False), "#,##0;dd": (False, False)}
    assert {code: xlsx.shows_date(code) for code in shown} == shown


def test_merged_ranges_comments_and_rows_without_numbers():
    rows = '<row><c t="inlineStr"><is><t>Head</t></is></c></row><row r="3"><c r="B3"><v>2</v></c></row><row r="6"><c r="A6"><v>9</v></c></row>'
    sheet = f'!<worksheet {NS}><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="B3:C5"/><mergeCell ref="A1:B1"/></mergeCells></worksheet>'
    more = [
        ("xl/worksheets/_rels/sheet1.xml.rels", '<Relationships><Relationship Id="x" Type="http://x/comments" Target="../comments1.xml"/></Relationships>'),
        ("xl/comments1.xml", f'<comments {NS}><authors><author>Me</author></authors><commentList><comment ref="C4" authorId="0"><text><t>why</t></text></comment><comment ref="Z9" authorId="0"><text><t>none</t></text></comment></commentList></comments>'),
    ]
    made = zipfile.ZipFile(BytesIO(book(sheet, more=more)))
    content = packed({n: made.read(n).decode().removeprefix("!") for n in made.namelist()})
    (found,) = readers.read_xlsx(content)
    assert found["rows"] == [["Head", "Head"], [None, "2", "2"], [None, "2", "2"], [None, "2", "2"], ["9", None]]
    assert found["comments"] == [("C4", "why", "Me"), ("Z9", "none", "Me")] and found["commented"] == {"C4": "2"}


def test_a_million_rows_in_bounded_memory(spark, tmp_path):
    n = 1_000_000
    out = BytesIO()
    shell = book("")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        old = zipfile.ZipFile(BytesIO(shell))
        for name in old.namelist():
            if "sheet1" not in name:
                z.writestr(name, old.read(name))
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f"<worksheet {NS}><sheetData>".encode())
            for at in range(0, n, 10_000):
                f.write("".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(at + 1, at + 10_001)).encode())
            f.write(b'</sheetData><mergeCells><mergeCell ref="C1:C2"/></mergeCells></worksheet>')
    content = out.getvalue()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    parts, seen, widest = 0, 0, 0
    for part in readers._sheet_parts(content):
        if part[1] is not None:
            parts, seen, widest = parts + 1, seen + len(part[4]), max(widest, len(part[4]))
            assert part[4][0] == [str(part[2] + 2)]
    assert (parts, seen, widest) == (n // xlsx.PART, n - 1, xlsx.PART)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000  # KB


def test_sheet_types_across_cells_and_parts(spark, tmp_path):
    row = lambda i, t: f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>{t}</t></is></c></row>'
    far = "".join(row(i, "line") for i in range(1, 2500)) + row(2500, "Revenue from") + row(2501, "Operations") + "".join(row(i, "line") for i in range(2502, 3100))
    bad = f"!<worksheet {NS}><sheetData>" + row(1, "a") + row(2, "b") + "<row"
    made = zipfile.ZipFile(BytesIO(book(far, bad, row(1, "Balance Sheet") + row(2, "Cash"))))
    (tmp_path / "a.xlsx").write_bytes(packed({n: made.read(n).decode().removeprefix("!") for n in made.namelist()}))
    files = readers.files(spark, str(tmp_path))
    got = {r.sheet_ord: r for r in readers.sheets(files).where("error is null").collect()}
    assert [got[i].sheet_type for i in (0, 1, 2)] == ["pnl", "unknown", "balance_sheet"]
    assert len(got[0].rows) == 3098 and got[0].rows[2498] == ["Revenue from"] and got[1].rows == [["b"]] and got[2].rows == [["Cash"]]
    (failed,) = readers.sheets(files).where("error is not null").collect()
    assert failed.error.startswith("sheet S2: ParseError")
    parts = readers.sheets_of(readers.sheet_parts(files)).where("sheet_ord = 0").orderBy("row_from").collect()
    assert [(p.row_from, len(p.rows), p.sheet_type) for p in parts] == [(0, 1000, "pnl"), (1000, 1000, "pnl"), (2000, 1000, "pnl"), (3000, 98, "pnl")]


class Page:
    """Writes a mark for each reading of text, tables or picture."""

    def __init__(self, marks, number, text, images=(), fails=None):
        self.marks, self.number, self.text, self.images, self.fails = marks, number, text, list(images), fails

    def _mark(self, what):
        place = TaskContext.get().partitionId() if TaskContext.get() else -1
        open(f"{self.marks}/{self.number}-{what}-{place}-{uuid.uuid4().hex}", "w").close()
        if self.fails == what:
            raise ValueError("cannot be read")

    def extract_text(self, **_):
        self._mark("text")
        return self.text

    def extract_tables(self, settings):
        self._mark("tables")
        return [[["Head", "2025"], [f"Line {self.number}", "1"]]]

    def to_image(self, resolution):
        self._mark("picture")
        time.sleep(0.05)
        return type("Picture", (), {"original": f"seen {self.number}"})()


class Pdf:
    def __init__(self, pages):
        self.pages = pages

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def opener(marks, n, typed=True, fails=()):
    text = "typed text of some length, longer than fifty characters, on page" if typed else ""
    return lambda content: Pdf([Page(marks, i, text and f"{text} {i}", [] if typed else [1], dict(fails).get(i)) for i in range(1, n + 1)])


def marks_of(folder):
    return [tuple(name.split("-")[:3]) for name in os.listdir(folder)]


@pytest.mark.parametrize("typed", [True, False])
def test_one_file_is_read_by_all_tasks_and_each_page_once(spark, tmp_path, typed):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    (tmp_path / "marks").mkdir()
    reader = readers.plumber(lambda picture: [picture], opener(str(tmp_path / "marks"), 64, typed))
    got = sorted((r.page_num, r.raw_text, r.ocr, len(r.tables), r.error) for r in readers.pdf_pages(readers.files(spark, str(tmp_path / "in")), reader).collect())
    assert [x[0] for x in got] == list(range(1, 65)) and all(x[2:] == ((False, 1, None) if typed else (True, 0, None)) for x in got)
    marks = marks_of(tmp_path / "marks")
    text, seen = ([n for n, what, _ in marks if what == w] for w in ("text", "tables" if typed else "picture"))
    assert sorted(map(int, seen)) == list(range(1, 65))
    assert sorted(map(int, text)) == (list(range(1, 65)) if typed else [1, 2, 3, 4, 5])  # a scanned file's kind is told by its first pages
    assert len({place for *_, place in marks}) >= 5  # ranges went to several tasks


def test_pages_and_tables_that_fail_cost_no_other_page(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    (tmp_path / "in" / "b.zip").write_bytes(packed({"c.pdf": "x"}))
    (tmp_path / "marks").mkdir()
    reader = readers.plumber(None, opener(str(tmp_path / "marks"), 20, fails=[(2, "text"), (3, "tables"), (9, "text"), (11, "tables")]))
    read = readers.documents(readers.files(spark, str(tmp_path / "in")), reader)
    assert sorted(r.page_num for r in read.pages.collect()) == [i for i in range(1, 21) if i not in (2, 9)]
    errors = sorted(r.error for r in read.errors.collect())
    assert errors == ["Unsupported file type: .zip", *(f"page {x}: ValueError: cannot be read" for x in ("11, tables", "2", "3, tables", "9"))]


def test_an_analysis_reads_each_page_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    (tmp_path / "marks").mkdir()
    out = analyze_files(readers.files(spark, str(tmp_path / "in")), readers.plumber(None, opener(str(tmp_path / "marks"), 7)))
    assert out["pages"].count() == 7 and out["errors"].count() == 0 and isinstance(out, Analysis)
    assert sorted(marks_of(tmp_path / "marks")) and len(marks_of(tmp_path / "marks")) == 14
    out.release()


def test_a_recogniser_is_built_once_a_worker():
    built = []
    engine = pdf.PerWorker("test engine", lambda: built.append(1) or (lambda picture: [picture]))
    assert [engine("a"), engine("b")] == [["a"], ["b"]] and built == [1]
