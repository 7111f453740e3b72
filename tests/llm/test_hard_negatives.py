"""Hard negatives against all pairs: clusters, copies, ties, several lengths, odd rows; and what the intervals prune."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hard_negatives as h


def brute(rows, positives=5, negatives=3):
    """Rows (id, label, vector) by definition: a Counter of the result's rows."""
    used = []
    for number, (i, label, v) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(math.floor(256 * x)) >= h.LIMIT for x in v):
            continue
        used.append((number, i, label, [math.floor(256 * x) for x in v]))
    out = Counter()
    for number, i, label, v in used:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other == label) for n, j, other, w in used if n != number and len(w) == len(v))
        for under, j, _ in [x for x in scored if x[2]][:positives]:
            fit = [(-s, k) for s, k, alike in scored if not alike and 50 * -under <= 100 * -s <= 95 * -under]
            for rank, (score, k) in enumerate(fit[:negatives], 1):
                out[i, j, rank, k, -under, score] += 1
    return out


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<double>, leaf int, windows string")
    got = h.mine(frame, F.col("vec_id") % 50 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in got.collect())


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d)) * 2
    return [(i, int(rng.integers(3)), (centres[rng.integers(6)] + 0.5 * rng.standard_normal(d)).tolist()) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"sample": 64, "block_bytes": 2000}], ids=["one block", "many blocks"])
def test_equals_all_pairs(spark, options):
    rows = clustered(600, 5, 1)
    grid = np.random.default_rng(2).integers(-1, 2, (150, 3)).astype(float)  # many ties
    rows += [(1000 + i, i % 2, v.tolist()) for i, v in enumerate(grid)]
    rows += [(3000 + i, 1, [1.0, 1.0, 1.0, 1.0]) for i in range(120)] + [(4000 + 3 * i, 2, [0.8, 0.7, 0.9, 0.6]) for i in range(60)] + [(3050, 1, [1.0, 1.0, 1.0, 1.0])] * 3
    rows += [(50, 1, None), (None, 1, [1.0, 1.0]), (100, None, [1.0, 1.0]), (150, 1, [1.0, None]), (200, 1, [float("nan"), 1.0]), (250, 1, [float("inf"), 1.0]), (300, 1, [1e300, 1.0]), (350, 1, []), (351, 1, []), (352, 2, []), (400, 1, [0.0, 0.0]), (401, 1, [0.0, 0.0]), (402, 2, [0.0, 0.0])]
    rows += [(5000, 1, [2.0**17] * 600), (5001, 1, [2.0**17 - 1] * 600), (5002, 2, [2.0**16] * 600), (5003, 2, [-(2.0**16)] * 600)]
    wanted = brute(rows)
    assert mined(spark, rows, **options) == wanted and len(wanted) > 200


def test_tables_with_nothing_to_find(spark):
    one = [(50, 1, [1.0, 2.0])]
    for rows in ([], one, [(1, 1, [1.0]), (2, 2, [1.0])], one * 3, [*one, (51, 2, [0.5, 1.0])]):
        assert mined(spark, rows) == brute(rows) == Counter()


def test_intervals_hold_and_prune_clusters():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 16)) * 40
    draw = lambda n: np.rint(centres[rng.integers(8, size=n)] * 8 + rng.standard_normal((n, 16)) * 10)
    a, b = draw(400), draw(4000)
    anchors, rows = h.Tree(a, 16), h.Tree(b, 16)
    for tree, v in ((anchors, a), (rows, b)):
        for limits, means, radii in zip(tree.limits, tree.means, tree.radii, strict=True):
            for k, (low, high) in enumerate(zip(limits[:-1], limits[1:], strict=True)):
                assert np.linalg.norm(v[tree.order[low:high]] - means[k], axis=1).max() <= radii[k] + 1e-9
    scores = a @ b.T
    least = np.sort(scores, axis=1)[:, -5]
    i, j = h.traverse(anchors, rows, least[anchors.order], np.full(400, np.inf))
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(kept) == len(i)
    of = [np.repeat(np.arange(len(t.radii[-1])), np.diff(t.limits[-1]))[np.argsort(t.order)] for t in (anchors, rows)]
    for q, r in zip(*np.nonzero(scores >= least[:, None]), strict=True):
        assert (of[0][q], of[1][r]) in kept
    share = len(kept) / (len(anchors.radii[-1]) * len(rows.radii[-1]))
    print(f"{share:.2%} of leaf pairs scored")
    assert share < 0.3


def test_products_beyond_doubles_are_exact():
    a = np.array([[(1 << 26) - 1, 1, -(1 << 26) + 1]])
    b = np.array([[(1 << 26) - 1, 3, 5], [7, 11, 13]])
    assert h.products(a, b).tolist() == [[sum(x * y for x, y in zip(a[0].tolist(), r, strict=True)) for r in b.tolist()]]
