"""Operators on golden filings."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import analytics, mapping, narrate, notes, pages as pages_ops, records, report, rules, tables as tables_ops
from ledgerloom.plans.analysis import analyze

FILING = [
    ("cash_equivalents", 500, 1000), ("trade_receivables", 6000, 4000), ("inventories", 2000, 1900), ("total_current_assets", 15000, 13000), ("total_assets", 50000, 45000), ("share_capital", 2000, 2000),
    ("total_equity", 25000, 24000), ("borrowings_current", 1000, 1000), ("trade_payables_mse", 700, 400), ("total_current_liabilities", 10000, 9000), ("borrowings_non_current", 4000, None),
    ("revenue_from_operations", 40000, 38000), ("finance_costs", 500, 400), ("pbt", 4000, 3700), ("pat", 3000, 2800), ("cfo", 1500, 2900),
]
ITEM = "doc_id string, item_idx long, raw_label string, canonical_key string, current_value double, prior_value double, confidence double, method string, note_ref string"


def filing(spark, changes=None, doc="d"):
    rows = [(doc, i, k, k, *(changes or {}).get(k, (c, p)), 1.0, "exact", None) for i, (k, c, p) in enumerate(FILING)]
    return spark.createDataFrame([(a, b, c, d, e if e is None else float(e), f if f is None else float(f), g, h, n) for a, b, c, d, e, f, g, h, n in rows], ITEM)


def flags_of(spark, changes=None):
    moves = analytics.movements(analytics.best_items(filing(spark, changes)))
    return [(r.flag_id, r.severity) for r in rules.flags(moves).orderBy("rule_ord", "key_ord").collect()]


def test_ratios(spark):
    got = {r.ratio: (r.current, r.prior) for r in analytics.ratios(analytics.best_items(filing(spark))).collect()}
    wanted = {"current_ratio": (1.5, 1.444444), "quick_ratio": (1.3, 1.233333), "debt_equity": (0.2, 0.041667), "interest_coverage": (9, 10.25), "debtor_days": (54.75, 38.421053), "creditor_days": (None, None), "net_profit_margin": (7.5, 7.368421), "roce": (11.25, 11.388889), "cfo_to_pat": (0.5, 1.035714)}
    assert {k: tuple(x and round(x, 6) for x in v) for k, v in got.items()} == wanted


def test_flags_in_order(spark):
    assert flags_of(spark) == [("CASH_DECLINE", "High"), ("CFO_PAT_DIVERGENCE", "High"), ("FIRST_OCCURRENCE_BORROWINGS_NON_CURRENT", "High"), ("RECEIVABLES_REVENUE_MISMATCH", "Medium"), ("MSE_PAYABLES_INCREASE", "Medium"), ("MATERIAL_MOVEMENT_FINANCE_COSTS", "Low")]


def test_flag_bounds(spark):
    ids = lambda c: {x for x, _ in flags_of(spark, c)}
    assert "CASH_DECLINE" not in ids({"cash_equivalents": (600, 1000)})
    assert "CFO_PAT_DIVERGENCE" not in ids({"cfo": (1800, 2900)})
    finance = lambda c: dict(flags_of(spark, c)).get("MATERIAL_MOVEMENT_FINANCE_COSTS")
    assert [finance({"finance_costs": (x, 400)}) for x in (480, 600, 720)] == ["Low", "Medium", "High"]
    assert "FIRST_OCCURRENCE_TOTAL_ASSETS" in ids({"total_assets": (50000, None)})
    assert not {x for x in ids({"total_assets": (0, 45000)}) if x.startswith(("FIRST", "MATERIAL"))}


def test_best_item_ties(spark):
    rows = [("d", 0, "a", "X", 10.0, None, 1.0, "exact", None), ("d", 1, "a", "X", 20.0, 15.0, 0.93, "fuzzy", None), ("d", 2, "a", "X", 30.0, 25.0, 0.6, "structural", None), ("d", 3, "a", "X", None, 40.0, 1.0, "exact", None), ("d", 4, "a", "X", 50.0, 45.0, 0.93, "fuzzy", None)]
    assert analytics.best_items(spark.createDataFrame(rows, ITEM)).first().item_idx == 1


def test_observations(spark):
    moves = analytics.movements(analytics.best_items(filing(spark)))
    seen = narrate.observations(rules.flags(moves)).orderBy("number").collect()
    assert seen[0].observation.startswith("Cash and cash equivalents declined by 50.00% from ₹1,000 lakh to ₹500 lakh") and seen[0].notes == "Notes 7(f), 14(a), 14(d)"
    assert all(r.observation and r.recommendation for r in seen) and [r.rating for r in seen] == sorted((r.rating for r in seen), key=narrate.RATING_RANK.get)
    assert seen[2].observation.startswith("Borrowings Non Current appears for the first time this year at ₹4,000 lakh, representing 8.00% of total assets")
    steps = [r.step for r in report.next_steps(report.summary(narrate.observations(rules.flags(moves)))).orderBy("number").collect()]
    assert len(steps) == 3 and steps[0].startswith("Prioritize closing the 3 High-risk item(s)")
    evidence = json.loads(seen[0].evidence)
    assert evidence["pct_change"] == -50 and evidence["current"] == 500


def test_other_documents_change_nothing(spark):
    one = analytics.movements(analytics.best_items(filing(spark)))
    both = analytics.movements(analytics.best_items(filing(spark).unionByName(filing(spark, {"cash_equivalents": (1, 2)}, "e")).orderBy(F.rand(1))))
    key = lambda df: sorted(map(str, df.where("doc_id = 'd'").drop("key_ord").collect()))
    assert key(one) == key(both)


TEXT = "Notes to the Financial Statements\nNote 7 (f) : Cash\nUnpaid dividend 12. Refer Note No. 14 for terms.\nNote 14: Borrowings\nas per Note 7 the balance\n2.14 Cash and Cash Equivalents"


def test_notes(spark):
    pages = spark.createDataFrame([("d", 1, TEXT)], "doc_id string, page_num int, raw_text string")
    found = notes.notes(pages).orderBy("note_ord").collect()
    assert [n.note_id for n in found] == ["7f", "14", "2.14"]
    assert [n.raw_text.startswith("\n") for n in found] == [True, True, False]
    assert [(e.src, e.dst) for e in notes.references(notes.notes(pages)).collect()] == [("7f", "14")]
    assert not notes.find_headers("26,726.37 and 31.03.2025\nas per Note 34 it is") and notes.find_headers("1.2. Use of Estimates")[0][2] == "1.2"


def test_note_that_opens_a_page_reaches_back(spark):
    pages = spark.createDataFrame([("d", 1, "Balance sheet"), ("d", 2, "Note 7: Cash")], "doc_id string, page_num int, raw_text string")
    tables = spark.createDataFrame([("d", p, 0, ["a"], [[str(p)]]) for p in (1, 2)], "doc_id string, page_num int, table_ord int, headers array<string>, rows array<array<string>>")
    found = notes.notes(pages)
    assert [(n.page_start, n.page_end) for n in found.collect()] == [(1, 2)]
    assert notes.note_tables(found, tables).count() == 2 and pages_ops.uncovered_pages(pages, found).count() == 0


def test_resolved_notes(spark):
    rows = [("d", 1, "Note 1: A\nrefer note no. 2 and refer note no. 3\nNote 2: B\nrefer note no. 3\nNote 3: C\nrefer note no. 4\nNote 4: D\nend")]
    found = notes.notes(spark.createDataFrame(rows, "doc_id string, page_num int, raw_text string"))
    got = {r.note_id: r.resolved for r in notes.resolved_texts(found, notes.references(found)).collect()}
    heads = [line for line in got["1"].split("\n") if line.startswith("===")]
    assert heads == ["=== Note 1 ===", "=== Note 2 (referenced by Note 1) ===", "=== Note 3 (referenced by Note 2) ==="]


@pytest.mark.parametrize(
    ("name", "headers", "rows", "wanted"),
    [
        ("contingent_liabilities", ["Particulars", "2023-24", "Addition", "2024-25"], [["Income tax demand", "100", "50", "150"], ["GST demand", "10", "0", "10"], ["Total", "110", "50", "160"]], {"income_tax": 150, "gst": 10, "total": 160, "total_prior": 110, "others": None}),
        ("contingent_liabilities", ["P", "2025"], [["Sundry", "5"]], None),
        ("csr_details", ["Particulars", "Amount"], [["Amount required to be spent", "50"], ["Amount spent", "30"], ["Amount unspent", "20"]], {"obligation": 50, "amount_spent": None, "amount_unspent": 20}),
        ("msmed_disclosure", ["Particulars", "2025", "2024"], [["Principal", "70", "40"], ["Interest accrued", "2", "1"], ["Further interest", "1", "0"]], {"principal_unpaid": 70, "interest_unpaid": None, "interest_accrued_unpaid": 2, "interest_further_due": 1}),
        ("actuarial_assumptions", ["Assumption", "2025", "2024"], [["Discount rate", "6.8%", "7.2%"]], {"discount_rate_current": 6.8, "discount_rate_prior": 7.2}),
        ("actuarial_assumptions", ["Assumption", "2025", "2024"], [["Discount rate", "14400", "7.2%"]], {"discount_rate_current": None, "discount_rate_prior": 7.2}),
    ],
)
def test_records(spark, name, headers, rows, wanted):
    tables = spark.createDataFrame([("d", headers, rows)], "doc_id string, headers array<string>, rows array<array<string>>")
    got = records.read_record(name, tables).first()[name]
    if wanted is None:
        assert got is None
    else:
        wanted = wanted | ({"amount_spent": 30} if "amount_spent" in wanted else {})
        assert {k: got[k] for k in wanted} == wanted


CWIP = (["Project", "Less than 1 year", "1-2 years", "2-3 years", "More than 3 years", "Total"], [["Plant A", "5", "0", "0", "40", "45"], ["Total", "5", "0", "0", "40", "45"]])


def test_work_in_progress_ageing(spark):
    tables = spark.createDataFrame([("d", *CWIP)], "doc_id string, headers array<string>, rows array<array<string>>")
    read = lambda compat: [tuple(p) for p in records.read_record("cwip_ageing", tables, compat).first().cwip_ageing.projects]
    assert read(False) == [("Plant A", "less_than_1_year", 5), ("Plant A", "more_than_3_years", 40)]
    assert read(True) == [("Plant A", "more_than_3_years", 5)]


def test_consistency_texts(spark):
    texts = ["the audit trail has not been tampered with", "audit trail (edit log) was operated except for the period April", "related party L12345MH1999PLC123456 x", "L12345MH1999PLC123456 and " + "y" * 400 + " u12345mh1999plc654321"]
    facts = spark.createDataFrame(list(enumerate(texts)), "doc_id int, full_text string")
    assert [(r.doc_id, r.flag_id) for r in rules.consistency_flags(facts).orderBy("doc_id").collect()] == [(1, "AUDIT_TRAIL_LAPSE"), (3, "MULTI_ENTITY_DOCUMENT")]


def test_table_rows(spark):
    tables = spark.createDataFrame([("d", ["Particulars", "Note No.", "2025", "2024"], [["Right of use", "5", "100", "90"], ["Cash (3)", None, "6 6,152.58", "-"], ["ab", "1", "2", "3"], ["12", "1", "2", "3"]])], "doc_id string, headers array<string>, rows array<array<string>>")
    assert [(r.label, r.current, r.prior, r.note_ref) for r in tables_ops.read_rows(tables).orderBy("row_ord").collect()] == [("Right of use", 100, 90, "5"), ("Cash (3)", 66152.58, None, "3")]


def test_clean_tables(spark):
    t = spark.createDataFrame([([[" A ", "B"], ["", None], ["A", "B"], ["x\ny", "1"]],)], "rows array<array<string>>")
    assert t.select(tables_ops.clean_pdf_rows(F.col("rows")).alias("r")).first().r == [["A", "B"], ["x y", "1"]]
    assert t.select(tables_ops.clean_docx_rows(F.col("rows")).alias("r")).first().r == [["A", "B"], ["x\ny", "1"]]


def test_mapping(spark):
    labels = spark.createDataFrame([("Total outstanding dues of creditors other than micro enterprises",), ("Dues to micro enterprises payable",), ("Cash & Cash Equivalents",), ("Trade recievables",), ("Total",), ("zzz",), ("Property, plant and equipment 2a 7.96 15,602",)], "raw_label string")
    got = {r.raw_label: (r.canonical_key, r.method) for r in mapping.map_labels(labels).collect()}
    assert list(got.values()).count((None, "unknown")) == 2
    assert got["Cash & Cash Equivalents"] == ("cash_equivalents", "exact") and got["Trade recievables"] == ("trade_receivables", "fuzzy")
    assert got["Dues to micro enterprises payable"] == ("trade_payables_mse", "exact") and got["Total outstanding dues of creditors other than micro enterprises"] == ("trade_payables_others", "exact")
    assert got["Property, plant and equipment 2a 7.96 15,602"] == ("ppe_net", "exact")


def test_whole_analysis(spark):
    pages = spark.createDataFrame([("d", 1, "Balance sheet"), ("d", 2, TEXT), ("e", 1, "nothing here")], "doc_id string, page_num int, raw_text string")
    rows = [["cash and cash equivalents", "500", "1000"], ["Total assets", "50,000", "45,000"], ["profit for the period", "3000", "2800"], ["net cash from operating activities", "1500", "2900"]]
    tables = spark.createDataFrame([("d", 1, 0, ["Particulars", "2025", "2024"], rows)], "doc_id string, page_num int, table_ord int, headers array<string>, rows array<array<string>>")
    out = analyze(pages, tables)
    assert [(r.doc_id, r.flag_id) for r in out["flags"].orderBy("rule_ord").collect()] == [("d", "CASH_DECLINE"), ("d", "CFO_PAT_DIVERGENCE"), ("d", "UNPAID_DIVIDEND")]
    assert [r.rating for r in out["observations"].orderBy("number").collect()] == ["High", "High", "Low"]
    out.release()
