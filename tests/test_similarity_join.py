"""The array form of the similarity against the plain one, pair by pair."""

import random
import time

import numpy as np
import pytest

from ledgerloom.functions import similarity as one, similarity_join as many
from ledgerloom.functions.vocabulary import chart
from ledgerloom.operators import mapping, records

VARIANTS = [v for _, _, vs in chart() for v in vs]


def labels(n, seed):
    rng = random.Random(seed)
    words = sorted({w for v in VARIANTS for w in v.split()})
    out = ["", " ", "a", "x" * 200, "नकद और नकद", "cash  and   cash", "zzz qqq", "of the", "total total total", "💰 cash", *VARIANTS[:10]]
    while len(out) < n:
        kind = rng.randrange(5)
        base = rng.choice(VARIANTS)
        if kind == 0:
            base = "".join(c for c in base if rng.random() > 0.2)
        elif kind == 1:
            base = " ".join(rng.sample(base.split(), len(base.split()))) + rng.choice(["", " net", " of the company and its many subsidiaries and associates"])
        elif kind == 2:
            base = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))
        elif kind == 3:
            base = "".join(rng.choice("abcdefghij klmnoprst-") for _ in range(rng.randrange(1, 90)))
        out.append(base)
    return out


def test_scores_equal_pair_by_pair():
    found = labels(260, 3)
    fixed = many.Variants(VARIANTS)
    plain, tokens = fixed.labels(found)
    rng = np.random.default_rng(5)
    i, j = rng.integers(0, len(found), 6000), rng.integers(0, len(VARIANTS), 6000)
    got = fixed.scores(plain, tokens, i, j)
    wanted = [one.weighted_ratio(found[a], VARIANTS[b]) for a, b in zip(i, j, strict=True)]
    wrong = [(found[a], VARIANTS[b], g, w) for a, b, g, w in zip(i, j, got, wanted, strict=True) if g != w]
    assert not wrong, wrong[:5]
    assert (fixed.bounds(plain, tokens)[i, j] >= wanted).all()


def test_best_equals_all_pairs():
    found = labels(150, 9)
    at, score = many.Variants(VARIANTS).best(found)
    for label, k, s in zip(found, at, score, strict=True):
        scores = [one.weighted_ratio(label, v) for v in VARIANTS]
        best = max(range(len(VARIANTS)), key=lambda x: (scores[x], -x))
        assert (k, s) == (best, scores[best]), label


@pytest.mark.parametrize("length", [63, 64, 65, 128, 150])
def test_lanes_carry(length):
    rng = random.Random(length)
    text = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    fixed, found = [text(length), text(length // 2), text(1)], [text(n) for n in (1, 40, length, 2 * length)]
    letters = many.Letters(fixed)
    a, b = letters.rows(found), letters.rows(fixed)
    i, j = np.repeat(np.arange(4), 3), np.tile(np.arange(3), 4)
    assert many.ratios(a, i, b, j).tolist() == [one.ratio(found[x], fixed[y]) for x, y in zip(i, j, strict=True)]
    assert many.partial_ratios(a, i, b, j).tolist() == [one.partial_ratio(found[x], fixed[y]) for x, y in zip(i, j, strict=True)]


def plain_buckets(headers, buckets):
    out = {}
    for bucket, names in buckets.items():
        scored = [(max(one.partial_ratio(h.lower(), n) for n in names), -i) for i, h in enumerate(headers) if h]
        best = max(scored, default=(0.0, 0))
        if best[0] > records.BUCKET_SCORE:
            out[bucket] = -best[1]
    return out


def plain_buckets_in_turn(headers, buckets):
    owner = {}
    for bucket, names in buckets.items():
        at = next((i for i, h in enumerate(headers) if h and any(one.partial_ratio(h.lower(), n) > records.BUCKET_SCORE for n in names)), None)
        if at is not None:
            owner[at] = bucket
    return {bucket: at for at, bucket in owner.items()}


def header_rows(n):
    rng = random.Random(7)
    spelt = ["Particulars", "Not due", "Less than 6 months", "0 - 6 Months", "6 months - 1 year", "1-2 years", "1 - 2 Years", "2-3 yrs", "More than 3 years", ">3 Years", "Total", "", None, "Amount", "less than 1 year", "Outstanding for 6-12 months from due date", "y"]
    return [[rng.choice(spelt) for _ in range(rng.randrange(0, 9))] for _ in range(n)] + [None]


@pytest.mark.parametrize("buckets", [records.AGEING, records.CWIP_AGEING])
@pytest.mark.parametrize("compat", [False, True])
def test_columns_of_generated_headers(spark, buckets, compat):
    rows = header_rows(120)
    tables = spark.createDataFrame([(i, h) for i, h in enumerate(rows)], "k int, headers array<string>")
    got = {r.k: r.cols for r in records.with_buckets(tables, buckets, compat).collect()}
    plain = plain_buckets_in_turn if compat else plain_buckets
    assert got == {i: plain(h or [], buckets) for i, h in enumerate(rows) if h is not None}
    assert sum(map(len, got.values())) > 100


def test_pairs_are_not_compared_one_by_one():
    found = [f"{x} {k}" for k, x in enumerate(labels(3000, 11))]
    fixed = many.Variants(VARIANTS)
    fixed.best(found[:50])
    began = time.perf_counter()
    fixed.best(found)
    many_took = (time.perf_counter() - began) / len(found)
    pairs = [(key, v) for _, key, vs in chart() for v in vs]
    began = time.perf_counter()
    for label in found[:60]:
        mapping._best_variant(label, pairs)
    one_took = (time.perf_counter() - began) / 60
    print(f"{many_took * 1e6:.0f} against {one_took * 1e6:.0f} microseconds a label")
    assert many_took < one_took / 3
