"""Substring, line, n-gram and embedding deduplication against brute force on small fixtures."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import embedding_dedup, line_dedup, ngram_join, pairing, substring_dedup


def words_of(text):
    return (text or "").encode().split()


def brute_removal(texts, length=35):
    found = defaultdict(list)
    for d, t in enumerate(texts):
        w = words_of(t)
        for i in range(len(w) - length + 1):
            found[tuple(w[i : i + length])].append((d, i))
    gone = defaultdict(set)
    for places in found.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + length))
    return [(len(words_of(t)), len(gone[d]), b" ".join(w for i, w in enumerate(words_of(t)) if i not in gone[d]).decode()) for d, t in enumerate(texts)]


def passages(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common, other = text(60), text(50)
    texts = [text(80) + "\t" + common + "\n" + text(40) for _ in range(6)] + [other + " " + text(20), text(10) + " " + other, text(200)]
    return texts + [texts[0], "a b " * 60, "x " * 100, " ".join(["only"] * 35), "", None, text(34), other[:-1] + "é", "ß ß " * 40]


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 2])
def test_substring_removal_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    texts = passages(1)
    docs = spark.createDataFrame([(i % 15, t, "kept", 7) for i, t in enumerate(texts)], "doc_id long, text string, kept_text string, first int")
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == Counter((i % 15, *x) for i, x in enumerate(brute_removal(texts)))


def test_substring_spans_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "z " + "q " * 36)], "doc_id long, text string")
    row = substring_dedup.remove_repeats(docs).first()
    assert (row.n_words, row.n_removed, row.kept_text, [tuple(s) for s in row.removed]) == (37, 36, "z", [(1, 37)])
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_automaton_counts_windows():
    rng = random.Random(4)
    sequences = [[rng.randint(0, 3) for _ in range(rng.randint(3, 40))] for _ in range(12)]
    automaton = substring_dedup.SuffixAutomaton()
    for s in sequences:
        automaton.add(s, 1)
    automaton.finish()
    seen = Counter(tuple(s[i : i + 5]) for s in sequences for i in range(len(s) - 4))
    for s in sequences:
        mask = automaton.repeated(s, 5)
        assert [mask >> i & 1 for i in range(len(s) - 4)] == [int(seen[tuple(s[i : i + 5])] > 1) for i in range(len(s) - 4)]


LINE = "This line is longer than forty code points, surely it is."


def line_docs(spark):
    short, accents = "short line", "é" * 40
    rows = [(i, f"{LINE if i % 2 else '  ' + LINE.upper() + ' '}\nown {i}\n{short}\n{accents}\n\n" + "z" * 45) for i in range(6)]
    rows += [(6, None), (7, ""), (8, LINE + "\n" + LINE), (None, LINE), (9, "é" * 39 + "\n" + "rare line that only four documents hold, not five")]
    return spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, n_lines string, key int"), rows


@pytest.mark.parametrize("bound", [line_dedup.MAX_BROADCAST_KEYS, 0])
def test_line_dedup_equals_brute_force(spark, bound):
    docs, rows = line_docs(spark)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    lost = lambda line, i: len(holders[key(line)] - {None}) >= 5 and max(holders[key(line)] - {None}) != i
    wanted = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not lost(x, i)]
        wanted[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = Counter(tuple(r) for r in line_dedup.dedup_lines(docs, max_broadcast_keys=bound).collect())
    assert got == wanted
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_full_filters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MIN_CELLS", 4096)
    monkeypatch.setattr(line_dedup, "MAX_CELLS", 4096)
    pair = line_dedup.Pair(64)
    h = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    pair.add(h)
    pair.add(h[:100])
    cell, bits = line_dedup._places(h[:100], 64)
    assert (pair.twice[cell] & bits == bits).all()


def brute_classes(texts):
    import regex

    sets = []
    for t in texts:
        w = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    n = len(texts)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in range(n)]
    classes = list(range(n))
    for _ in range(n):
        classes = [min([classes[i], *(classes[j] for j in links[i])]) for i in range(n)]
    return classes, [len(x) for x in links]


def near_texts(seed):
    rng = random.Random(seed)
    base = [[f"v{rng.randint(0, 3000)}" for _ in range(120)] for _ in range(6)]
    texts = []
    for b in base:
        for edits in (0, 0, 1, 2, 3, 6):
            w = list(b)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
            texts.append(" ".join(w))
    return [*texts, "One two", "one TWO!", "one", "", None, "...", "a b c d e", "a b c d e f", "é ü ß x y z", "É ü ß x y z"]


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts(2)
    docs = spark.createDataFrame([(i, t, i, "b") for i, t in enumerate(texts)], "doc_id long, text string, node long, bucket string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()}
    classes, links = brute_classes(texts)
    assert got == {i: (classes[i], links[i]) for i in range(len(texts))}
    kept = sorted(r.doc_id for r in ngram_join.keep_one(docs).collect())
    assert kept == sorted(i for i in range(len(texts)) if classes[i] == i)
    assert ngram_join.keep_one(docs).columns == docs.columns
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_BLOCK", 2)
    monkeypatch.setattr(ngram_join, "COMPONENT_BLOCK", 2)
    texts = near_texts(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes, links = brute_classes(texts)
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs).collect()} == {i: (classes[i], links[i]) for i in range(len(texts))}


def test_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(5, "p q r s t u v w"), (5, "p q r s t u v w"), (5, "entirely other words than the ones above are"), (3, "p q r s t u v w")], "doc_id long, text string")
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect())
    assert got == Counter({(5, 3, 2): 2, (5, 5, 0): 1, (3, 3, 2): 1})
    assert sorted(r.doc_id for r in ngram_join.keep_one(docs).collect()) == [3, 5, 5]  # an id stays while any of its texts does


def test_rows_without_id_are_judged(spark):
    long = [f"w{i}" for i in range(100)]
    near, other = " ".join(long[:-1] + ["new"]), [f"o{i}" for i in range(100)]
    rows = [(1, " ".join(long)), (None, " ".join(long)), (None, near), (None, " ".join(other)), (None, " ".join(other).upper()), (None, " ".join(other[:-1])), (None, "..."), (2, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect())
    assert got == Counter({(1, 1, 2): 1, (None, 1, 2): 2, (None, None, 2): 3, (None, None, 0): 1, (2, 2, 0): 1})
    kept = [tuple(r) for r in ngram_join.keep_one(docs).collect()]
    assert len(kept) == 4 and {rows[0], rows[6], rows[7]} < set(kept)
    assert sum(r in rows[3:6] for r in kept) == 1


def test_pruning_spares_pairs_at_the_threshold():
    floors = ngram_join.fewest_matches(0.8, 1e-6)
    assert all(m < 0.8 * n for n, m in floors.items()) and floors[128] > 60
    rng, similar = np.random.default_rng(5), ngram_join.pruner(0.8, 1e-6)
    base = rng.integers(0, 60000, (1, 128)).astype(np.uint16)
    near, far = np.repeat(base, 300, 0), np.repeat(base, 300, 0)
    near[rng.random(near.shape) > 0.8] += 1
    far[rng.random(far.shape) > 0.3] += 1
    both = np.concatenate((base, near, far))
    kept = similar(both, 0, np.arange(1, 601))
    assert (kept <= 300).sum() == 300 and (kept > 300).sum() == 0


def test_components_of_a_path(spark):
    from ledgerloom.llm.store import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "u long, v long")
    got = {r.node: r.component for r in pairing.components(edges, Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 64))
    v = np.concatenate([centres, centres + 0.1 * rng.standard_normal((40, 64)), centres[:20] + 0.3 * rng.standard_normal((20, 64)), rng.standard_normal((300, 64))]).astype(np.float32)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(900, v[0].tolist(), 1), (901, None, 1), (902, [0.0] * 64, 1), (903, [float("nan")] * 64, 1), (904, [None] * 64, 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [], 1), (None, v[1].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    close = (unit.astype(float) @ unit.T.astype(float)) >= 0.9
    np.fill_diagonal(close, False)
    extra = np.zeros(len(v), int)
    for copy in (0, 1):  # 900 copies 0, the null id copies 1
        extra[close[copy]] += 1
        extra[copy] += 1
    found, true = sum(got[i][0] for i in range(len(v))), int(close.sum() + extra.sum())
    assert true >= found >= 0.9 * true
    assert all(got[i][0] <= close[i].sum() + extra[i] for i in range(len(v)))
    assert got[900][1] == got[0][1] == 0 and got[0][2] and not got[900][2]
    assert [got[i] for i in (901, 902, 903, 904, 907)] == [(0, i, True) for i in (901, 902, 903, 904, 907)]
    assert got[905] == (1, 905, True) and got[906] == (1, 905, False)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_rotation_balances_and_keeps_near_vectors_near():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 64))
    rotation = embedding_dedup.Rotation(x)
    codes, near = rotation.codes(x), rotation.codes(x + 0.2 * rng.standard_normal(x.shape))
    bits = (codes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    assert abs(bits.mean(axis=0) - 0.5).max() < 0.1
    assert np.bitwise_count(codes ^ near).mean() < 8


@pytest.mark.parametrize("mean", [0.0, 0.4, 0.6])
@pytest.mark.parametrize("width", [None, 10, 14])
def test_tables_find_pairs_at_the_threshold(mean, width):
    rng = np.random.default_rng(21)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    shared = unit(rng.standard_normal(64))
    spread = lambda n: unit(mean**0.5 * shared + (1 - mean) ** 0.5 * unit(rng.standard_normal((n, 64))))
    sample, x = spread(5000), spread(3000)
    noise = rng.standard_normal(x.shape)
    y = 0.903 * x + (1 - 0.903**2) ** 0.5 * unit(noise - (noise * x).sum(axis=1, keepdims=True) * x)
    rotation = embedding_dedup.Rotation(sample)
    flips = embedding_dedup.flipped(rotation, embedding_dedup.threshold_pairs(sample, 0.9))
    masks = embedding_dedup.table_masks(1 << 20, 64, flips) if width is None else embedding_dedup.masks_of(width, 64, flips, 5000)
    found = embedding_dedup.recall_of(masks, embedding_dedup.radius_of(flips), rotation.codes(x) ^ rotation.codes(y))
    print(f"mean {mean} width {int(np.bitwise_count(masks[0]))} tables {len(masks)} recall {found:.4f}")
    assert found >= 0.99


def test_embeddings_with_a_shared_direction_are_found(spark):
    rng = np.random.default_rng(22)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(0.6**0.5 * unit(rng.standard_normal(64)) + 0.4**0.5 * unit(rng.standard_normal((2000, 64))))
    noise = rng.standard_normal(x.shape)
    y = 0.903 * x + (1 - 0.903**2) ** 0.5 * unit(noise - (noise * x).sum(axis=1, keepdims=True) * x)
    v = np.concatenate([x, y])
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(v)], "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(df).agg({"n_links": "sum"}).first()[0]
    true = int((v @ v.T >= 0.9).sum()) - len(v)
    print(f"links {got} of {true}")
    assert true >= got >= 0.99 * true
