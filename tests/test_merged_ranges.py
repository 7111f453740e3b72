from ledgerloom.operators import tables as tables_ops


def test_ranges_meet_cells_without_unfolding_to_them(spark):
    """Ranges unfolded to cells and were aggregated there: the memory of one task grew with their areas."""
    cells = [(1, 0, r, c, f"{r}.{c}") for r in range(20) for c in range(3)] + [(1, 1, 0, 0, "other sheet"), (2, 0, 0, 0, None), (2, 0, 0, 1, "x"), (None, 0, 0, 0, "y"), (1, 0, 5, 0, "twice")]
    ranges = [(1, 0, 6, 17, 1, 1), (1, 0, 7, 9, 0, 1), (1, 0, 0, 0, 2, 0), (2, 0, 0, 0, 0, 1), (3, 0, 0, 9, 0, 9)]
    c = spark.createDataFrame(cells, "doc_id bigint, sheet_ord int, row_ord int, col_ord int, value string")
    r = spark.createDataFrame(ranges, "doc_id bigint, sheet_ord int, min_row int, max_row int, min_col int, max_col int")
    filled = tables_ops.fill_merged(c, r)

    def expected(doc, sheet, row, col, value):
        top = [next(v for *at, v in cells if at == [doc, sheet, a, e]) for d, s, a, b, e, f in ranges if (d, s) == (doc, sheet) and a <= row <= b and min(e, f) <= col <= max(e, f)]
        return max((t for t in top if t is not None), default=value)

    assert filled.columns == c.columns
    assert sorted(map(tuple, filled.collect()), key=str) == sorted(((*x[:4], expected(*x)) for x in cells), key=str)
    assert filled._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
