"""The language model: gradients, a plain scorer, counts by definition, a distribution that sums to one, and what training gains."""

import math
import zlib
from collections import Counter

import numpy as np
import regex

from ledgerloom.llm import gated_network as g
from ledgerloom.llm import language_model as lm

SF = "/root/testdata/sf0.01"


def words_of(text):
    return regex.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def is_held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def plain_counts(rows):
    c, ends = Counter(), 0
    for i, t in rows:
        if not is_held_out(i):
            c.update(words_of(t))
            ends += 1
    return c, ends


def plain_base(text, c, ends):
    n, v = c.total() + ends, len(c) + (ends > 0)
    known = [c[w] for w in words_of(text)] + [ends]
    return len(known), sum(k > 0 for k in known), n, sum(math.log10((k + 1) / (n + v + 1)) for k in known)


def plain_network(net, words):
    """Natural logarithm of the probability of one text's numbers, word by word, all outcomes written out."""
    h, total, before = np.zeros(net.state), 0.0, net.start
    s = net.state
    sig = lambda x: 1 / (1 + np.exp(-x))
    for w in words:
        x, a = net.inputs[before].astype(float), h @ net.recur.astype(float)
        r, z = sig(x[:s] + a[:s]), sig(x[s : 2 * s] + a[s : 2 * s])
        h = (1 - z) * np.tanh(x[2 * s :] + r * a[2 * s :]) + z * h
        kinds = np.exp(h @ net.to_class.astype(float) + net.class_bias)
        k = w // g.CLASS if w < net.words else net.classes
        total += math.log(kinds[k] / kinds.sum())
        if w < net.words:
            own = np.exp(net.to_word[k].astype(float) @ h + net.word_bias[k])
            total += math.log(own[w % g.CLASS] / own.sum())
        before = w
    return total


def some_network(words, seed=0, size=8):
    net = g.Network.begun(np.arange(words, 0, -1), 50, size)
    rng = np.random.default_rng(seed)
    net.to_class, net.to_word = (rng.normal(0, 0.5, net.shapes[n]).astype(np.float32) for n in ("to_class", "to_word"))
    return net


def test_gradients_by_differences(monkeypatch):
    net = some_network(150, size=5)
    rng = np.random.default_rng(1)
    given, words = rng.integers(0, net.start + 1, (6, 4)), rng.integers(0, 150 + g.BUCKETS, (6, 4))
    real = rng.random((6, 4)) < 0.8
    for name in net.NAMES:  # in doubles
        setattr(net, name, getattr(net, name).astype(np.float64))
    state = rng.normal(0, 0.5, (4, 5))
    _, found, _ = net.gradients(given, words, real, state)
    dense = {n: np.zeros(net.shapes[n]) for n in net.NAMES}
    for name in ("recur", "to_class", "class_bias"):
        dense[name] += found[name]
    dense["inputs"][found["inputs"][0]] += found["inputs"][1]
    for name in ("to_word", "word_bias"):
        for c, x in found[name].items():
            dense[name][c] += x
    for name in net.NAMES:
        flat = getattr(net, name).reshape(-1)
        at = np.argsort(-np.abs(dense[name].ravel()))[:6]
        for k in [*at, *rng.integers(0, flat.size, 4)]:
            held, step = flat[k], 1e-5
            flat[k] = held + step
            up = net.gradients(given, words, real, state)[0]
            flat[k] = held - step
            down = net.gradients(given, words, real, state)[0]
            flat[k] = held
            assert abs((up - down) / (2 * step) - dense[name].ravel()[k]) < 1e-6, name


def test_texts_side_by_side_equal_one_by_one():
    net = some_network(300)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 300 + g.BUCKETS, n) for n in (1, 2, 700, 33, 32, 31, 1, 64, 65, *rng.integers(1, 90, 40))]
    limits = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    wanted = [plain_network(net, t) for t in texts]
    for lanes in (1, 7, 256):
        assert np.allclose(g.text_scores(net, np.concatenate(texts), limits, lanes), wanted, rtol=1e-5)


def test_packing_and_places_of_no_word():
    net = some_network(70)
    again = g.Network(70, 8).unpack(net.packed())
    assert all((getattr(again, n) == getattr(net, n)).all() for n in net.NAMES)
    states = np.random.default_rng(3).normal(0, 1, (1, 8)).astype(np.float32)
    p = np.exp(net.log_probabilities(np.repeat(states, 71, axis=0), np.arange(71)))  # 70 words, and the class of all others
    assert abs(p.sum() - 1) < 1e-5


def rows_of(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    long = "q" * 100
    rows += [(90_001, None), (90_002, ""), (None, "Words without an Id"), (None, None), (90_003, " \t\n "), (90_004, f"{long} {long} x"), (90_004, f"{long} {long} x"), (90_005, "zzunheard " * 30_000), (-3, "ÀÉ ÀÉ mixed\x0bKept")]
    return rows


def scored(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row long, FAR string")
    got = lm.score(frame, **options)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return got.collect()


def test_base_by_definition_and_gain_on_held_out(spark):
    rows = rows_of(spark)
    c, ends = plain_counts(rows)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    wanted = sorted(((i, is_held_out(i), *plain_base(t, c, ends)) for i, t in rows), key=key)
    for shipped in (lm.SHIPPED, 300):  # nearly all counts in memory, or nearly all by the join
        got = scored(spark, rows, shipped=shipped, network_words=250)
        mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
        assert [x[:5] for x in mine] == [x[:5] for x in wanted]
        assert np.allclose([x[5] for x in mine], [x[5] for x in wanted], rtol=1e-9)
    got = scored(spark, rows)
    apart = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in apart) / sum(r.n_tokens for r in apart)
    print(f"held out: {gain:.3f} (log10 a token) over the counts, {sum(r.score > r.base_score for r in apart)} of {len(apart)} documents")
    assert gain > 0.02


def test_untrained_model_by_definition(spark):
    rows = [r for r in rows_of(spark)[-200:]]
    c, ends = plain_counts(rows)
    top = sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:99]
    rest, rest_words = c.total() - sum(n for _, n in top), len(c) - len(top)
    got = scored(spark, rows, network_words=99, shipped=150, rounds=0)
    own, known = dict(top), 100 + c.total() + ends + 1  # one more for each output of the network, and one for the class of all others
    other = math.log10((rest + 1) / known) - math.log10(rest + rest_words + 1)
    by_words = lambda t: sum(math.log10((own[w] + 1) / known) if w in own else other + math.log10(c[w] + 1) for w in words_of(t)) + math.log10((ends + 1) / known)
    ordered = lambda pairs: sorted(pairs, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    mine, wanted = ordered((r.doc_id, r.score) for r in got), ordered((i, by_words(t)) for i, t in rows)
    assert [i for i, _ in mine] == [i for i, _ in wanted] and np.allclose([x for _, x in mine], [x for _, x in wanted], rtol=1e-5)


def test_nothing_to_learn_from(spark):
    assert scored(spark, []) == []
    lone = next(i for i in range(100) if is_held_out(i))
    (row,) = scored(spark, [(lone, "some words")])
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
    assert math.isfinite(row.score)
