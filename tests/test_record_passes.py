"""Records read their headers, labels and plain figures once."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import records


@pytest.mark.parametrize("name", ["trade_receivables_ageing", "trade_payables_ageing"])
def test_headers_are_searched_once_a_table(spark, name):
    """The column of totals was searched anew for each row and each use of the rows."""
    headers = ["Particulars", "Not due", "1-2 years", "Total"]
    grids = [[["Micro", "1", "2", "3"], ["Others", "x", "(4)", "5"], ["Total", "6", "", "-"], ["Net", "", "", "7"]], [["Less allowance", "1", "2", None], ["", "", "", "8"], [None, "1.5", "2", "9"]], [], None]
    t = spark.createDataFrame([(i, h, g) for i, (h, g) in enumerate([(headers, g) for g in grids] + [(headers[:3], grids[0])])], "doc_id int, headers array<string>, rows array<array<string>>")
    read = records.read_record(name, t)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position(") <= 2  # one search, which names its place twice
    got = {r.doc_id: r[name] and r[name].asDict() for r in read.collect()}
    shown = {i: None if f is None else tuple(f[k] for k in ("one_to_two_years", *(("total_gross", "allowance_doubtful", "net_total") if "rec" in name else ("total_mse", "total_others", "total")))) for i, f in got.items()}
    if "rec" in name:
        assert shown == {0: (-4.0, None, None, 7.0), 1: (2.0, 9.0, None, None), 2: None, 3: None, 4: (-4.0, None, None, None)}
    else:
        assert shown == {0: (-4.0, 3.0, 5.0, None), 1: (2.0, None, None, None), 2: None, 3: None, 4: (-4.0, None, None, None)}


def test_contingent_rows_are_classed_once(spark):
    t = spark.createDataFrame([(["Particulars", "2024", "2025"], [["GST demand", "1", "2"], ["Claims", "3", "4"], ["Guarantee", "x", "0"], ["Total", "5", "6"]])], "headers array<string>, rows array<array<string>>")
    read = records.read_record("contingent_liabilities", t)
    assert read.select("contingent_liabilities.*").collect() == [(None, None, 2.0, 4.0, 6.0, 5.0)]


def test_plain_figures_are_read_as_others_are(spark):
    cells = ["0", "007", "12.50", "1.", ".5", "12\n", " 12", "1,2", "9" * 400, "३४", "1e5", "-3", "(3)", "", None]
    got = spark.createDataFrame([([c for c in cells],)], "c array<string>").select(F.transform("c", X.parse_in_lambda).alias("a"), F.transform("c", X.parse_indian_number).alias("b")).first()
    assert got.a == got.b
