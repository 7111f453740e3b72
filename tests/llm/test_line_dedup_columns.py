import re

from ledgerloom.llm import line_dedup


def test_texts_do_not_come_back_beside_what_is_kept(spark):
    docs = spark.createDataFrame([(i, "x" * 50 + f"\n{i}") for i in range(6)], "doc_id long, text string")
    for bound in (0, line_dedup.MAX_BROADCAST_KEYS):
        found = line_dedup.dedup_lines(docs, max_broadcast_keys=bound)
        made = next(x for x in found._jdf.queryExecution().analyzed().toString().splitlines() if "MapInArrow" in x)
        assert re.findall(r"(\w+)#", made[made.index("[") : made.index("]")]) == ["doc_id", "kept_text", "n_lines", "n_dropped"]
        assert sorted(tuple(r) for r in found.collect()) == [*((i, str(i), 2, 1) for i in range(5)), (5, "x" * 50 + "\n5", 2, 0)]
