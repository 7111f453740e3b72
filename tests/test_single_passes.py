"""Steps that evaluate their input once, and the cases of choosing tables."""

from ledgerloom.operators import notes, tables
from ledgerloom.plans import filing_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_parsed_once_and_pages_are_rebuilt_once(spark):
    rebuilt = filing_queries._rebuilt(spark, SF)
    there = spark.createDataFrame([(1, 1, 0, ["a"], [["x"]])], "doc_id bigint, page_num int, table_ord int, headers array<string>, rows array<array<string>>")
    for found in (rebuilt, tables.choose_tables(there, rebuilt)):
        assert plan(found).count("split(raw_text") + plan(found).count("split(array_join") == 1


def test_chosen_tables_of_each_case(spark):
    schema = "doc_id bigint, page_num int, table_ord int, headers array<string>, rows array<array<string>>"
    full, half, none = [["a", "1"]], [["a", "1"], ["", "2"], ["", "3"]], [["", "1"]]
    there = [(1, 1, 0, ["t"], full), (2, 1, 0, ["t"], half), (2, 1, 1, ["t"], none), (3, 1, 0, ["t"], none), (3, 1, 1, ["t"], full), (5, 1, 0, ["t"], None), (None, 1, 0, ["t"], none), (7, 1, 0, ["t"], none)]
    new = [(1, 1, ["n"], full), (2, 1, ["n"], full), (3, 1, ["n"], full), (4, 1, ["n"], none), (5, 1, ["n"], none), (None, 1, ["n"], full), (7, 1, ["n"], none)]
    got = tables.choose_tables(spark.createDataFrame(there, schema), spark.createDataFrame(new, "doc_id bigint, page_num int, headers array<string>, rows array<array<string>>"))
    found = sorted(((r.doc_id or 0), r.headers[0], r.table_ord) for r in got.collect())
    assert [f for f in found if f[0] != 5] == [(0, "n", 0), (0, "t", 0), (1, "t", 0), (2, "n", 0), (3, "t", 0), (3, "t", 1), (4, "n", 0), (7, "t", 0)]


def test_walks_broadcast_no_edges(spark):
    edges = spark.createDataFrame([(1, "1", "2", 1)], "doc_id bigint, src string, dst string, edge_ord int")
    roots = spark.createDataFrame([(1, "1")], "doc_id bigint, root string")
    step = notes.walks(roots, edges)._jdf.queryExecution().optimizedPlan().toString()
    assert step.count("rightHint=(strategy=merge)") >= 2
