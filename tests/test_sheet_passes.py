"""Workbooks are read once, whatever is asked of their sheets."""

from ledgerloom.plans import file_queries
from ledgerloom.sources import readers


def test_sheets_take_one_pass(spark):
    parts = readers.sheet_parts(file_queries._workbooks(spark, "/root/testdata/sf0.001"))
    plan = readers.sheets_of(parts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join" not in plan  # the workbooks are made, and read


def test_a_row_that_does_not_fit_is_an_error_of_its_file(spark):
    files = spark.createDataFrame([(str(i), "image", bytes([i])) for i in range(3)], "doc_id string, kind string, content binary")
    found = readers.image_pages(files, lambda c: [] if c[0] != 1 else ["\ud800"])
    assert {r.doc_id: r.error is None for r in found.collect()} == {"0": True, "1": False, "2": True}
