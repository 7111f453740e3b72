from pyspark.sql import functions as F

from ledgerloom.operators import tables as tables_ops


def test_each_line_is_turned_once(spark):
    """The cleaned grid stood several times in the expression, once a mention, and each row was met with the whole of it."""
    grid = [["Item", None], ["", " "], ["sulpruS\nlatot", "12"], [" Item ", ""], ["x", "1"]]
    t = spark.createDataFrame([(grid,), ([],), (None,), ([[None]],)], "rows array<array<string>>")
    cleaned = t.select(tables_ops.clean_pdf_rows(F.col("rows")).alias("r"))
    assert [r.r for r in cleaned.collect()] == [[["Item", ""], ["Surplus total", "12"], ["x", "1"]], [], None, []]
    assert cleaned._jdf.queryExecution().optimizedPlan().expressions().mkString(" ").count("reverse(") == 1
