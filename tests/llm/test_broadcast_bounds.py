"""Beyond the bounds of what is broadcast, results are the same."""

from collections import Counter

from ledgerloom.llm import decontaminate, license_scan, ngram_join

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(repr(r) for r in df.collect())


def test_results_do_not_depend_on_the_bounds(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    block = decontaminate.NODE_BYTES * 26 * 2000
    runs = {
        "ids": lambda: ngram_join.keep_one(docs),
        "hits": lambda: decontaminate.decontaminate(docs, bench, block_bytes=block),
        "kept": lambda: decontaminate.drop_contaminated(docs, bench, block_bytes=block),
        "grams": lambda: license_scan.scan(docs),
    }
    within = {name: rows(run()) for name, run in runs.items()}
    assert rows(decontaminate.decontaminate(docs, bench)) == within["hits"] and sum(within["kept"].values()) < docs.count()
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_IDS", 0)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_HITS", 0)
    monkeypatch.setattr(license_scan, "MAX_BROADCAST_GRAMS", 0)
    for name, run in runs.items():
        assert rows(run()) == within[name], name
