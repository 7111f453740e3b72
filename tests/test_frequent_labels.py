"""Rows of a label that stands in most rows are not dealt to one task."""

from ledgerloom.operators import mapping


def test_rows_of_one_label_meet_its_key_in_parts(spark):
    rows = [(d, 1, 0, r, None, "Inventories" if r else "Odd words", 1.0, None, None) for d in range(50) for r in range(4)] + [(None, 1, 0, 0, None, "Total Assets", 1.0, None, None), (7, 1, 0, 9, None, None, 1.0, None, None)]
    schema = "doc_id bigint, page_num int, table_ord int, row_ord int, sheet_type string, label string, current double, prior double, note_ref string"
    table = ["doc_id", "page_num", "table_ord"]
    held = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = mapping.map_items(spark.createDataFrame(rows, schema), table)
        names = dict(found.dtypes)
        joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin [raw_label" in x]
        got = found.collect()
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    assert any("__part" in x for x in joins) and "__part" not in names
    assert sorted((r.doc_id, r.row_ord, r.item_idx, r.canonical_key) for r in got if r.doc_id is not None) == [(d, r, r, "inventories" if r else None) for d in range(50) for r in range(4)]
    assert [(r.item_idx, r.canonical_key) for r in got if r.doc_id is None] == [(0, "total_assets")]
