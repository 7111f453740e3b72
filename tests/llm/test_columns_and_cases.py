"""Clashing names, sessions and growth: what every operator that passes rows on has to take."""

import sys
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from ledgerloom.llm import byte_bpe, decontaminate, embedding_dedup, line_dedup, ngram_join, store, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Names that the operators use inside, in several cases.
CLASHES = (
    "kept_text N_LINES n_dropped lost_keys row_key row node bucket component size weight payload bands spans hits hit_key names nameless lost_id copied_text gone class_id n_links "
    "html y id key keeper segment twice ids decoded n_tokens first mask marks check anchor content __lost __kept __salt grade toxic severity"
).split()


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(i).cast("string") for i, c in enumerate(CLASHES)})
    line = "This very line stands in more than five of the documents."
    rows = [(i, f"{line}\nown words of {i} " + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(9000, 9010)]
    return docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_pass_clashing_columns(spark, odd, stage):
    plain = stage[1](spark, odd.select("doc_id", "text"), SF)
    got = stage[1](spark, odd, SF)
    assert got.columns == odd.columns
    assert Counter(tuple(r) for r in got.select("doc_id", "text").collect()) == Counter(tuple(r) for r in plain.collect())
    marks = got.where("doc_id < 9000").select(*CLASHES).distinct().collect()
    assert [tuple(r) for r in marks] == [tuple(str(i) for i in range(len(CLASHES)))]


def test_other_pass_through_functions(spark, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontaminate.drop_contaminated(odd, bench)
    many = decontaminate.drop_contaminated(odd, bench, block_bytes=decontaminate.NODE_BYTES * 26 * 2000)
    assert many.columns == odd.columns and sorted(r.doc_id for r in many.select("doc_id").collect()) == sorted(r.doc_id for r in one.select("doc_id").collect())
    for bound in (0, line_dedup.MAX_BROADCAST_KEYS):
        kept = line_dedup.with_kept_lines(odd, max_broadcast_keys=bound)
        assert kept.columns == [*odd.columns, "kept_text_", "n_lines_", "n_dropped_"] and kept.where("n_dropped_ > 0").count() >= 9
    back = byte_bpe.decode(byte_bpe.encode(odd, RANKS).withColumn("decoded", F.lit(1)), RANKS)
    assert back.columns == ["doc_id", "n_tokens", "ids", "decoded", "decoded_"]
    assert corpus_pipeline.encode(spark, odd, SF).count() == odd.count()
    assert toxicity.score(odd, None).count() == odd.count() and ngram_join.near_duplicates(odd).count() == odd.count()


def test_scratch_needs_a_shared_folder(spark):
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        store.shared_dir(Session())
    assert store.fresh(["Hits", "hits_"], "hits") == "hits__"


def test_entry_without_a_library(monkeypatch):
    whole = set(__spark_entry__.queries())
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    for name in [m for m in sys.modules if m.startswith("ledgerloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    import ledgerloom

    monkeypatch.delattr(ledgerloom, "llm", raising=False)
    left = set(__spark_entry__.queries())
    assert left < whole and len(left) > 60 and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in left)


def test_equal_rows_take_linear_time(spark):
    words = " ".join(f"w{i}" for i in range(400))
    took = {}
    for n in (100, 1000, 5000):
        docs = spark.createDataFrame([(7, words)] * n, "doc_id long, text string")
        began = time.time()
        assert substring_dedup.remove_repeats(docs).where("n_removed = 400").count() == n
        took[n] = time.time() - began
    print(took)
    assert took[5000] < 5 * took[1000] + 5


def test_larger_benchmarks_go_in_blocks(spark):
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 5000, n))
    items = [(i, text(300)) for i in range(60)] + [(None, text(40)), (None, text(41)), (99, None)]
    docs = [(i, text(50) + " " + " ".join(items[i][1].split()[20:40]) + " " + text(30)) for i in range(40)] + [(100, text(60) + " " + items[60][1] + " " + items[61][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    limit = decontaminate.NODE_BYTES * 26 * 3000
    blocks = decontaminate.Blocks(b, "item_id", "text", limit)
    assert blocks.count == 6
    sizes = []
    for k in range(blocks.count):
        sizes.append(decontaminate.Automaton(blocks.fetch(k)).machine.get_stats()["nodes_count"] * decontaminate.NODE_BYTES)
    assert max(sizes) < 1.5 * limit
    rows = lambda **o: Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids), tuple(map(tuple, r.spans))) for r in decontaminate.decontaminate(d, b, **o).collect())
    whole = rows()
    assert rows(block_bytes=limit) == whole and len(whole) == 41
    (last,) = [r for r in whole if r[0] == 100]
    assert last[2:5] == (81, 1, ())  # two items without an id count as one, without a name


def test_ordered_labels_are_taken_as_they_are(spark):
    rng = np.random.default_rng(2)
    mild, severe = ["rude", "silly", "lousy"], ["vile", "hateful", "awful"]
    plain = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(600):
        y = i % 3
        words = list(rng.choice(plain, 30)) + [list(), list(rng.choice(mild, 2)), list(rng.choice(severe, 2))][y]
        rows.append((i, " ".join(words), y))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, 3 * y if y else y) for i, _, y in rows] + [(600, None), (None, 1), (0, -1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: (r.grade, r.severity) for r in toxicity.score(docs, model).collect()}
    assert sum(got[i][0] == y for i, _, y in rows) > 580 and all(0 <= s <= 2 for _, s in got.values())
    binary = toxicity.fit(docs, labels.where("toxic <> 6"), split=False)
    assert len(binary.thresholds) == 1
    with pytest.raises(ValueError):
        toxicity.fit(docs, spark.createDataFrame([(i, i) for i in range(12)], "doc_id long, toxic int"))


def test_ordinal_fit_finds_the_thresholds():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 3))
    s = x @ np.array([1.0, -2.0, 0.5]) + rng.logistic(size=4000)
    y = np.searchsorted([-1.0, 0.5, 2.0], s)
    w, t = toxicity.fit_ordinal(x, y, np.ones(len(y)))
    assert np.abs(w - [1.0, -2.0, 0.5]).max() < 0.2 and np.abs(t - [-1.0, 0.5, 2.0]).max() < 0.2


@pytest.mark.parametrize("mean", [0.0, 0.5, 0.75])
@pytest.mark.parametrize("size", [8, 16, 64, 768])
def test_tables_find_pairs_at_any_number_of_dimensions(size, mean):
    rng = np.random.default_rng(31)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    shared = unit(rng.standard_normal(size))
    spread = lambda n: unit(mean**0.5 * shared + (1 - mean) ** 0.5 * unit(rng.standard_normal((n, size))))
    sample, x = spread(3000), spread(2000)
    noise = rng.standard_normal(x.shape)
    y = 0.905 * x + (1 - 0.905**2) ** 0.5 * unit(noise - (noise * x).sum(axis=1, keepdims=True) * x)
    rotation = embedding_dedup.Rotation(sample)
    flips = embedding_dedup.flipped(rotation, embedding_dedup.threshold_pairs(sample, 0.9))
    for n in (20_000, 100_000_000):
        masks = embedding_dedup.table_masks(n, rotation.bits, flips)
        found = embedding_dedup.recall_of(masks, embedding_dedup.radius_of(flips), rotation.codes(x) ^ rotation.codes(y))
        print(f"size {size} mean {mean} n {n}: width {int(np.bitwise_count(masks[0]))} tables {len(masks)} recall {found:.4f}")
        assert found >= 0.98
