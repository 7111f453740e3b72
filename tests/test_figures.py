import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import tables as tables_ops


def test_cells_are_read_as_the_column_functions_read_them(spark):
    from ledgerloom.functions.figures import figures

    figure = ["0", "12", "1,76,020", "12.50", "1.", ".5", "1.2.3", "12a", "६", "३४.५", "6 152.58", "6 (123)", "66 77", "123 4", "9" * 400, "1e5", "5-", "", ".", "\ue0007", "4\x1c5", "7\u20038"]
    cells = [a + f + b for f in figure for a in ("", "(", "₹ ", "Rs. ", "-", "--", "( -", "\xa0", "INR", "–", "FY", "\x1f") for b in ("", ")", "%", " ", " )", "\n", ".1", " lakh")] + [None, "x", "()", "(\n1)"]
    cell = F.regexp_replace(X.strip(F.when(F.col("c").rlike(X.DIGIT), F.col("c"))), X.SPLIT_DIGIT, "$1$2")
    want = [r.v for r in spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", X.parse_indian_number(cell).alias("v")).orderBy("i").collect()]
    assert list(zip(cells, map(repr, figures(pa.array(cells, pa.string())).to_pylist()), strict=True)) == list(zip(cells, map(repr, want), strict=True))


def test_tables_are_read_in_one_pass(spark):
    """Wide and narrow rows were read in two branches, each of which unfolded all tables."""
    wide = ["Cash", "3", "(7f)", "x", "y", "z", "1", "2"]
    rows = [["Revenue", "7", "1", "6 100.5"], wide, None, [], [None, "1"], ["12", "1"], ["Costs (12a)", "", None, "(5)"]]
    t = spark.createDataFrame([(1, ["", "Note No.", "2025", "2024"], rows), (2, None, [["Total", "1", "2"]]), (3, ["a"], None)], "doc_id int, headers array<string>, rows array<array<string>>")
    read = tables_ops.read_rows(t)
    assert read._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
    got = sorted((r.doc_id, r.row_ord, r.label, r.current, r.prior, r.note_ref) for r in read.collect())
    assert got == [(1, 0, "Revenue", 1.0, 6100.5, "7"), (1, 1, "Cash", -7.0, 1.0, "3"), (1, 6, "Costs (12a)", -5.0, None, "12a"), (2, 0, "Total", 1.0, 2.0, None)]
