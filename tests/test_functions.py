"""Scalar functions against golden cases and a plain Python specification."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import similarity, vocabulary
from ledgerloom.functions import text as X


def apply(spark, f, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_numbers(spark):
    cases = {
        "1,76,020": 176020, "(1,234.5)": -1234.5, "₹ 1,00,000": 100000, "(-5)": -5, "Rs. 12": 12, "-": None, "NIL": None, "N/A": None, "5,000 5,000 - 536": None, "5,000 5,000 - - - - 536": None,
        "12%": 12, "FY24": 24, "31.03.2025": None, "5-3": None, "": None, "1-2": None, "—": None, ".": None, " 7 ": 7, "1d": 1, "nan": None, "INR 4": 4,
    }
    assert apply(spark, X.parse_indian_number, list(cases)) == list(cases.values())
    assert apply(spark, X.parse_indian_number, [None]) == [None]
    assert apply(spark, X.format_indian_number, [176020.0, 999.0, 2.5, 3.5, -0.4, -1234567.0, None], "double") == ["1,76,020", "999", "2", "4", "-0", "-12,34,567", None]
    assert apply(spark, lambda x: X.format_indian_number(x, 2), [1234567.125, 0.125], "double") == ["12,34,567.12", "0.12"]
    assert apply(spark, X.percent, [0.125, 2.675, -3.0], "double") == ["0.12", "2.67", "-3.00"]
    assert apply(spark, X.rate_cell, ["6.8%", "14400", "x"]) == [6.8, None, None]
    assert apply(spark, X.recover_split_digit, ["6 6,152.58", "6 (123)", "66", None]) == [66152.58, 6123.0, None, None]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("0123456789,.-()₹ RsINR%FYa\t", max_size=9), min_size=30, max_size=30))
def test_numbers_by_specification(spark, values):
    def plain(s):
        s = s.strip()
        if s in ("", *X.NIL):
            return None
        for mark in X.CURRENCY:
            s = s.replace(mark, "")
        s = s.strip()
        wrapped = len(s) > 1 and s[0] == "(" and s[-1] == ")"
        s = s[1:-1].strip() if wrapped else s
        minus = s.startswith("-")
        s = s.removeprefix("-").replace(",", "").strip()
        if re.search(r"\s", s):
            return None
        s = re.sub(r"[^\d.\-]", "", s)
        if not re.fullmatch(r"-?\d*\.?\d*", s) or not re.search(r"\d", s):
            return None
        return -abs(float(s)) if wrapped or minus else float(s)

    assert apply(spark, X.parse_indian_number, values) == [plain(v) for v in values]


def test_labels_and_references(spark):
    assert apply(spark, X.clean_label, ["Property, Plant and Equipment 2a 7.96 15,602", " Trade  Receivables (net) [x]:", "Total", None]) == ["property, plant and equipment", "trade receivables", "total", ""]
    assert apply(spark, X.note_reference, ["see Note No. 7f", "Cash (14a)", "Cash", "Note 5 text"]) == ["7f", "14a", None, "5"]
    assert apply(spark, X.period, ["for the year ended 31 March 2025", "March 31, 2025"]) == ["31 March 2025", None]
    assert apply(spark, X.company_name, ["Annual report\nACME WIDGETS INDIA LIMITED\nSOME OTHER TRADING LTD OF\nx", "nothing"]) == ["ACME WIDGETS INDIA LIMITED", None]
    assert apply(spark, X.standard_name, ["Ind AS 116 - Leases.pdf", "Guidance_note.pdf", "SA 570.pdf"]) == ["Ind AS 116", "Guidance", "SA 570"]
    assert apply(spark, X.normalize_ref, ["6 (a)", "6[A]"]) == ["6a", "6a"]
    assert apply(spark, X.format_note_refs, [["7f", "14a"], ["27"], []], "array<string>") == ["Notes 7(f), 14(a)", "Note 27", ""]
    assert apply(spark, X.fix_reversed, ["sulpruS\n&\nytiuqE", "Total assets"]) == ["Surplus\n&\nEquity", "Total assets"]


def test_lines(spark):
    got = apply(spark, X.parse_text_line, ["Total assets 6 6,152.58", "Inventories 5 1,234 5,678", "Cash 12", "Reserves and surplus 1,000 -", "ab 1,000"])
    assert [g and tuple(g) for g in got] == [("Total assets", None, "66,152.58", None), ("Inventories", "5", "1,234", "5,678"), None, ("Reserves and surplus", None, "1,000", "-"), None]
    assert apply(spark, X.is_value_token, ["1,234", "12", "123", "nil", "-", "(5)", "x"]) == [True, False, True, True, True, True, False]


def test_sheets_and_columns(spark):
    rows = spark.createDataFrame([("Table 1", "Cash flow from operating ... profit before tax"), ("P&L", ""), ("x", "Balance Sheet"), ("y", "z")], "n string, c string")
    assert [r.t for r in rows.select(X.sheet_type(F.col("n"), F.col("c")).alias("t")).collect()] == ["cash_flow", "pnl", "balance_sheet", "unknown"]
    got = apply(spark, X.year_columns, [["P", "2023-24", "Addition", "2024-25"], ["P", "2024", "Amount"], ["2020", "2020", "2019"]], "array<string>")
    assert [g and tuple(g) for g in got] == [(3, 1), None, (0, 2)]


def test_vocabulary():
    chart = vocabulary.chart()
    assert (len(chart), sum(len(v) for *_, v in chart)) == (70, 121)
    assert len({x for *_, v in chart for x in v}) == 121
    assert vocabulary.DISPLAY["roa_net"] == "Right-Of-Use Asset"
    assert [sum(s == t for s, *_ in chart) for t in ("balance_sheet", "pnl", "cash_flow")] == [41, 23, 6]


def test_similarity():
    assert similarity.ratio("abc", "abc") == 100 and similarity.ratio("", "") == 100
    assert similarity.ratio("ab", "ba") == 50
    assert similarity.partial_ratio("less than 1 year", "1-2 years") == pytest.approx(80)
    assert similarity.token_sort_ratio("fuzzy was a bear", "was a bear fuzzy") == 100
    assert similarity.weighted_ratio("total assets", "total assets") == 100
    partial_only = similarity.weighted_ratio("cash", "cash and cash equivalents at the end")
    assert partial_only <= 90  # paths over partial matches are capped


@settings(max_examples=60, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert similarity.common_subsequence(a, b) == table[-1][-1]
