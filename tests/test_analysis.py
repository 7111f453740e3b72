"""A filing from its files to its report, with a reader, an encoder and a generator that stand in for the real ones."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import mapping, narrate, notes, pages as pages_ops, records, retrieval, rules, tables as tables_ops
from ledgerloom.plans.analysis import analyze_files
from ledgerloom.sources import readers

from .test_operators import filing
from .test_sources import NS, packed


class Page:
    def __init__(self, text="", lines=(), by_text=(), images=(), seen=""):
        self.text, self.lines, self.by_text, self.images, self.seen = text, list(lines), list(by_text), list(images), seen

    def extract_text(self, **_):
        return self.text

    def extract_tables(self, settings):
        return self.lines if settings["vertical_strategy"] == "lines" else self.by_text

    def to_image(self, resolution):
        return type("Picture", (), {"original": self.seen})()


class Pdf:
    def __init__(self, *pages):
        self.pages = pages

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


FACE = [["Particulars", "Note", "2025", "2024"], ["Cash and cash equivalents", "7f", "500", "1,000"], ["", "", "", ""], ["Inventories", "5", "2,000", "1,900"], ["Particulars", "Note", "2025", "2024"]]
MORE = [["Particulars", "Note", "2025", "2024"], ["Total assets", "", "50,000", "45,000"], ["profit for the period", "", "3,000", "2,800"]]
NOTES = "Notes to the Financial Statements\nNote 7 (f) : Cash\nUnpaid dividend 12. Refer Note No. 14 for terms. More.\nNote 14: Borrowings\nas per Note 7 the balance"
LONG = " The year was one of change for the company, as told below, at length."
FILES = {
    "a.pdf": Pdf(Page("ACME WIDGETS INDIA LIMITED\nfor the year ended 31 März 2025" + LONG), Page("Balance sheet" + LONG, [FACE]), Page("Balance sheet, continued" + LONG, [MORE]), Page(NOTES, [], [[["Maturity", "2025"], ["Loan", "7"]]]), Page("x", images=[1], seen="read from the picture of a page")),
    "s.pdf": Pdf(Page(images=[1], seen="Seen page one"), Page(images=[1], seen="Seen page two")),
    "t.pdf": Pdf(*(Page("\n".join(f"Line item {x} {i}a 1,{i}00 2,345" for x in "abcdef") + "\n" + LONG * 2) for i in (1, 2, 3))),
}


def opened(content):
    return FILES[content.decode()]


def recognise(picture):
    return [picture] if isinstance(picture, str) else ["photographed", "page"]


def test_pages_of_typed_and_scanned_files(spark, tmp_path):
    for name in FILES:
        (tmp_path / name).write_bytes(name.encode())
    for name in ("p.png", "u.txt", "none"):
        (tmp_path / name).write_bytes(b"x")
    files = readers.files(spark, str(tmp_path))
    read = readers.documents(files, readers.plumber(recognise, opened), recognise)
    short = F.element_at(F.split("doc_id", "/"), -1)
    pages = {(r.f, r.page_num): (r.raw_text, r.ocr) for r in read.pages.withColumn("f", short).collect()}
    assert pages["a.pdf", 5] == ("read from the picture of a page", True) and not pages["a.pdf", 1][1]
    assert pages["s.pdf", 2] == ("Seen page two", True) and pages["p.png", 1] == ("photographed\npage", True)
    tables = {(r.f, r.page_num): (r.headers, r.rows) for r in read.tables.withColumn("f", short).collect()}
    assert tables["a.pdf", 2] == (FACE[0], [FACE[1], FACE[3], *MORE[1:]])  # cleaned, and joined over the page
    assert tables["a.pdf", 4] == (["Maturity", "2025"], [["Loan", "7"]])
    assert tables["t.pdf", 1][0] == ["Particulars", "Note", "Current", "Prior"] and len(tables["t.pdf", 1][1]) == 12 and ("t.pdf", 2) not in tables  # rebuilt from lines
    errors = {r.f: r.error for r in read.errors.withColumn("f", short).collect()}
    assert errors == {"u.txt": "Unsupported file type: .txt", "none": "Unsupported file type: "}
    broken = readers.documents(files.where("kind = 'pdf'"), lambda content: 1 / 0).errors.collect()
    assert len(broken) == 3 and all("ZeroDivisionError" in r.error for r in broken)
    assert readers.documents(files.where("kind = 'image'")).errors.first().error.endswith("no recogniser for images was given")


def encode(texts):
    """Letter counts, so that like texts are near."""
    return np.array([[1e-3 + t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float)


def generate(system, message, most):
    if most == narrate.ADDENDUM:
        return '"The note gives no reason."' if "Cash and cash equivalents declined" in message else "NONE"
    return "no json"


def standards(spark):
    pages = spark.createDataFrame([("Ind AS 7 - Cash Flows.pdf", 1, "cash flow from operations profit reconciliation working capital"), ("Ind AS 1 - Presentation.pdf", 4, "going concern liquidity cash flow assessment"), ("SA 520.pdf", 2, "zzz")], "source_filename string, page_number int, text string")
    return retrieval.build_index(pages, None, lambda chunks: mapping.encoded(chunks, "text", encode))


def test_files_to_report(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"a.pdf")
    cells = "".join(f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>{t}</t></is></c><c r="B{i}"><v>{v}</v></c><c r="C{i}"><v>{w}</v></c></row>' for i, (t, v, w) in enumerate([("Line", 2025, 2024), *((f"Note line {k}", 1, 1) for k in range(70)), ("Profit before tax", 4000, 3700), ("Total income", 5, 6)], 1))
    (tmp_path / "a.xlsx").write_bytes(packed({
        "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="Table 1" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {NS}><sheetData>{cells}</sheetData></worksheet>",
    }))
    out = analyze_files(readers.files(spark, str(tmp_path)), readers.plumber(recognise, opened), recognise, encode=encode, index=standards(spark), generate=generate)
    assert out["sheets"].first().sheet_type == "pnl"  # told by the last of 73 rows
    (who,) = out["identity"].collect()
    assert (who.company, who.period) == ("ACME WIDGETS INDIA LIMITED", "31 März 2025")
    edges = [(e.src, e.dst, e.context) for e in out["references"].collect()]
    assert edges == [("7f", "14", "Refer Note No.")]  # a sentence ends at the full stop of "No."
    items = {r.raw_label: (r.canonical_key, r.current_value, r.note_ref) for r in out["line_items"].collect()}
    assert items["Cash and cash equivalents"] == ("cash_equivalents", 500, "7f") and items["Total assets"][0] == "total_assets" and items["Profit before tax"][:2] == ("pbt", 4000)
    flags = [r.flag_id for r in out["flags"].orderBy("rule_ord", "key_ord").collect()]
    assert flags[0] == "CASH_DECLINE" and "UNPAID_DIVIDEND" in flags
    noted = {r.flag_id: r.note_text for r in out["flag_notes"].collect()}
    assert noted["CASH_DECLINE"].startswith("=== Note 7(f) ===") and "(referenced by Note 7f)" in noted["CASH_DECLINE"]
    seen = out["observations"].orderBy("number").collect()
    assert seen[0].observation.endswith("material to the company's total assets. The note gives no reason.")
    assert seen[0].citation.split(" / ")[0] == "Ind AS 1" and set(seen[0].citation.split(" / ")) <= {"Ind AS 1", "Ind AS 7", "SA 520"}
    (told,) = out["reports"].collect()
    assert told.company == "ACME WIDGETS INDIA LIMITED" and told.high >= 1 and told.total == len(seen)
    assert out["next_steps"].count() >= 2 and out["errors"].count() == 0
    out.release()


def test_generated_observations(spark):
    from ledgerloom.operators import analytics

    flags = rules.flags(analytics.movements(analytics.best_items(filing(spark))))
    flags = flags.withColumns({"sources": F.array(F.lit("Ind AS 7 - x.pdf")), "passages": F.array(F.lit("see 5.1"))})
    answer = lambda **c: json.dumps({"area": "Cash", "observation": "Cash fell from 1,000 to 500.", "risk_rating": "Low", "standard_reference": "Ind AS 7 para 5.1", "recommendation": "Ask."} | c)

    def good(system, message, most):
        if "CASH_DECLINE" in message:
            return f"Here you are:\n```json\n{answer()}\n```" if "no valid JSON" in message else "nothing yet"
        if "CFO_PAT" in message:
            return answer(standard_reference="Ind AS 99 para 1.2")
        if "MSE" in message:
            raise RuntimeError("no memory")
        return "never json" if "RECEIVABLES" in message else answer(area=1)

    told = {r.flag_id: r for r in narrate.observations(flags, None, good, templates=False, instances=2).collect()}
    assert set(told) == {"CASH_DECLINE", "CFO_PAT_DIVERGENCE"}  # the others gave no valid answer
    assert told["CASH_DECLINE"].rating == "High" and told["CASH_DECLINE"].citation == "Ind AS 7 para 5.1" and told["CASH_DECLINE"].area == "Cash"
    assert told["CFO_PAT_DIVERGENCE"].citation == "Ind AS 7"  # a standard that was not retrieved does not hold
    plain = narrate.observations(flags).count()
    assert narrate.observations(flags, None, good).count() == plain  # templates stand without an answer
    doubt = {r.flag_id: r.doubtful for r in narrate.generated(narrate.templated(flags).withColumn("note_text", F.lit("")), good, templates=False).collect()}
    assert doubt == {"CASH_DECLINE": False, "CFO_PAT_DIVERGENCE": False}


@pytest.mark.parametrize("text", ["", "{", "[1]", '{"area": "a"}', "prose only"])
def test_answers_that_do_not_hold(text):
    assert narrate.parsed_answer(text) is None


def test_embedding_step_and_log(spark, tmp_path):
    labels = spark.createDataFrame([("trade and other recievable net of them",), ("qqqq",), ("Total",), ("cash",)], "raw_label string")
    found = {r.raw_label: (r.canonical_key, r.method) for r in mapping.map_labels(labels, mapping.embedding_step(spark, encode, 0.5)).collect()}
    assert found["trade and other recievable net of them"][1] == "embedding" and found["qqqq"] == (None, "unknown")
    rows = spark.createDataFrame([("d", 0, i, "pnl", x, 1.0, 2.0, None) for i, x in enumerate(["Trade receivables", "weird label", "total", "Profit before tax"])], "doc_id string, page_num int, row_ord int, sheet_type string, label string, current double, prior double, note_ref string")
    items = mapping.map_items(rows, ["doc_id", "page_num"])
    assert {r.raw_label: r.canonical_key for r in items.collect()} == {"Trade receivables": None, "weird label": None, "total": None, "Profit before tax": "pbt"}
    mapping.write_unmapped(items, str(tmp_path / "log"))
    mapping.write_unmapped(items, str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["weird label"] * 2  # what a statement refused is not logged
    assert [r.raw_label for r in mapping.unmapped_labels(items).collect()] == ["weird label"]


def test_best_variant_equals_all_comparisons():
    import random

    from ledgerloom.functions.similarity import weighted_ratio
    from ledgerloom.functions.vocabulary import chart

    variants = [(key, v) for _, key, vs in chart() for v in vs]
    rng = random.Random(1)
    for _ in range(60):
        base = rng.choice(variants)[1]
        label = "".join(c for c in base if rng.random() > 0.15) + rng.choice(["", " of the company and its subsidiaries", "x"])
        scores = [weighted_ratio(label, v) for _, v in variants]
        best = max(range(len(variants)), key=lambda i: (scores[i], -i))
        assert mapping._best_variant(label, variants) == (variants[best][0], scores[best]), label


def test_retrieval_in_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    queries, passages = spark.createDataFrame(rows, "query int, embedding array<double>"), spark.createDataFrame(rows, "chunk_index int, embedding array<double>")
    key = lambda df: sorted(map(tuple, df.select("query", "rank", "chunk_index").collect()))
    assert key(retrieval.nearest(queries, passages, block=7)) == key(retrieval.nearest(queries, passages))
    candidates = spark.createDataFrame([(f"c{i}", i, v) for i, v in rows], "candidate string, ord int, embedding array<double>")
    assert sorted(map(tuple, retrieval.best_by_cosine(queries, candidates, 0.0, block=7).collect())) == sorted(map(tuple, retrieval.best_by_cosine(queries, candidates, 0.0).collect()))
    assert retrieval.nearest(queries.limit(0), passages).count() == 0


def test_index_grows_by_new_files(spark):
    page = lambda f, t: spark.createDataFrame([(f, 1, t)], "source_filename string, page_number int, text string")
    enc = lambda chunks: mapping.encoded(chunks, "text", encode)
    first = retrieval.build_index(page("a.pdf", " ".join(["word"] * 700)), None, enc)
    both = retrieval.build_index(page("a.pdf", "other").unionByName(page("b.pdf", "new text")), first, enc)
    assert sorted((r.source_filename, r.chunk_index, len(r.embedding)) for r in both.collect()) == [("a.pdf", 0, 26), ("a.pdf", 1, 26), ("a.pdf", 2, 26), ("b.pdf", 0, 26)]


def test_white_space_of_any_script(spark):
    one = lambda t, f: spark.createDataFrame([(t,)], "x string").select(f(F.col("x")).alias("y")).first().y
    from ledgerloom.functions import text as X

    assert one("see Note No. 7f", X.note_reference) == "7f"
    assert one("year ended 31 03 2025", X.period) == "31 03 2025" and one("period ended 31 März 2025", X.period) == "31 März 2025"
    assert one("6 6,152.58", X.recover_split_digit) == 66152.58 and one(" (1,234) ", X.parse_indian_number) == -1234
    assert one("audit trail was not enabled", rules.audit_trail_excerpt) == "audit trail was not enabled"
    assert one("Cash Flow Statement 31 March 2025 and 31 March 2024", rules.cash_flow_years) == ["2025", "2024"]
    assert one("Emphasis of Matter is here", rules.emphasis).paragraph_type == "Emphasis of Matter"
    assert one("restricted cash 1,234 lakh", rules.restricted_balance) == 1234


def plain_sentence(text, at):
    import re

    cursor = 0
    for s in re.split(r"(?<=[.!?])\s+", text):
        if cursor <= at <= cursor + len(s):
            return s.strip()
        cursor += len(s) + 1
    return text[max(0, at - 80) : at + 80].strip()


def test_sentences_around_references():
    text = "First one.  Refer note no. 5 here!   Then, as per note 6,  it goes on? (see note 7) " + "End.    " * 6 + "(refer note 8)"
    got = notes.find_references(text)
    assert [(k, ref) for k, _, ref, _ in got] == [(0, "5"), (1, "7"), (2, "6"), (3, "8")]
    for (k, n, ref, context), m in zip(got, [m for style in notes._REFERENCES for m in style.finditer(text)], strict=True):
        assert context == plain_sentence(text, m.start())


def test_offsets_on_pages(spark):
    pages = spark.createDataFrame([("d", 1, "abc"), ("d", 2, ""), ("d", 4, "xy"), ("e", 1, "q")], "doc_id string, page_num int, raw_text string")
    offsets = spark.createDataFrame([("d", i, i) for i in range(12)] + [("e", 0, 99)], "doc_id string, k int, off int")
    got = {(r.doc_id, r.k): r.page for r in pages_ops.offsets_to_pages(offsets, pages_ops.page_offsets(pages), ["k"], "off", "page").collect()}
    assert got == {("d", 0): 1, ("d", 1): 1, ("d", 2): 1, ("d", 3): 1, ("d", 4): 2, **{("d", i): 4 for i in range(5, 12)}, ("e", 0): 1}


def test_wide_rows_read_like_narrow_ones(spark):
    narrow = ["Cash", "7", "x (3)", "12", "-", "5"]
    wide = narrow + [None] * 6
    headers = ["P", "Note", "a", "b", "c", "d"]
    t = spark.createDataFrame([("n", headers, [narrow]), ("w", headers + ["e"] * 6, [wide]), ("late", ["P", *"abcdefghij"], [["Cash", *[""] * 8, "1", "2"]])], "doc_id string, headers array<string>, rows array<array<string>>")
    got = {r.doc_id: (r.label, r.current, r.prior, r.note_ref) for r in tables_ops.read_rows(t).collect()}
    assert got == {"n": ("Cash", 12, 5, "7"), "w": ("Cash", 12, 5, "7"), "late": ("Cash", 1, 2, None)}


def test_records_in_one_pass(spark):
    found = spark.createDataFrame([("d", 1, "1", "Contingent liabilities", ""), ("d", 2, "2", "CSR", ""), ("d", 3, "3", "Other", ""), ("e", 1, "1", "x", "")], "doc_id string, note_ord int, note_id string, title string, raw_text string")
    csr = (["P", "Amount"], [["Amount required to be spent", "50"], ["Amount unspent", "20"]])
    claims = (["P", "2025", "2024"], [["GST demand", "10", "8"], ["Total", "10", "8"]])
    tables = spark.createDataFrame([("d", "1", 1, 0, *csr), ("d", "1", 1, 1, *claims), ("d", "2", 2, 0, *csr), ("d", "3", 3, 0, *claims), ("e", "1", 1, 0, *csr)], "doc_id string, note_id string, page_num int, table_ord int, headers array<string>, rows array<array<string>>")
    got = {r.doc_id: r for r in records.all_records(found, tables).collect()}
    assert got["d"].csr_details.amount_unspent == 20 and got["d"].contingent_liabilities.total == 10 and got["d"].msmed_disclosure is None
    assert got["e"].csr_details.obligation == 50 and got["e"].contingent_liabilities is None
    for name in ("csr_details", "contingent_liabilities"):
        assert {r.doc_id: r[name] for r in records.first_record(name, found, tables).collect()} == {d: r[name] for d, r in got.items() if r[name] is not None}


def test_sparse_sheets_stay_small():
    sheet = lambda cells, merged="": packed({
        "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {NS}><sheetData>{cells}</sheetData><mergeCells>{merged}</mergeCells></worksheet>",
    })
    far = '<row r="1"><c r="A1"><v>1</v></c></row><row r="3"><c r="B3"><v>2</v></c></row><row r="1048576"><c r="XFD1048576"><v>9</v></c></row>'
    rows = readers.read_xlsx(sheet(far))[0]["rows"]
    assert len(rows) == 3 and rows[0][0] == "1" and rows[1][1] == "2" and rows[2][-1] == "9"
    whole = '<mergeCell ref="A1:A1048576"/><mergeCell ref="B1:XFD1"/>'
    rows = readers.read_xlsx(sheet('<row r="1"><c r="A1"><v>1</v></c><c r="B1"><v>2</v></c></row><row r="4"><c r="B4"><v>3</v></c></row>', whole))[0]["rows"]
    assert [r[0] for r in rows] == ["1", "1", "1", "1"] and rows[0][1:3] == ["2", "2"] and rows[3][1] == "3" and len(rows[0]) < 30


def test_archive_members_come_one_by_one():
    found = readers.unzip(packed({"b.pdf": "2", "a.pdf": "1", "c.txt": "x"}))
    assert next(found) == ("a.pdf", b"1") and list(found) == [("b.pdf", b"2")] and list(readers.unzip(b"broken")) == []
