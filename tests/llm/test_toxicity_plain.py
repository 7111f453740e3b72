"""The ordinal model against plain loops: likelihood and its maximum, and scores of the whole table."""

import math

import numpy as np
import regex

from ledgerloom.llm import toxicity

SF = "/root/testdata/sf0.01"


def plain_loss(x, y, weight, w, thresholds, decay=1e-5):
    """Mean negative log likelihood, a row at a time, with the penalty."""
    total = 0.0
    for row, grade, own in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        s = sum(a * b for a, b in zip(row, w, strict=True))
        reach = [1.0, *(1 / (1 + math.exp(t - s)) for t in thresholds), 0.0]
        total -= own * math.log(reach[grade] - reach[grade + 1])
    return total / sum(weight.tolist()) + decay / 2 * sum(a * a for a in w)


def test_fit_is_the_maximum_of_the_plain_likelihood():
    rng = np.random.default_rng(12)
    x = rng.standard_normal((300, 4))
    y = np.searchsorted([-0.7, 0.6, 1.9], x @ np.array([0.8, -1.2, 0.3, 0.0]) + rng.logistic(size=300))
    weight = rng.random(300) + 0.5
    w, thresholds = toxicity.fit_ordinal(x, y, weight)
    assert list(thresholds) == sorted(thresholds)
    best = plain_loss(x, y, weight, w.tolist(), thresholds.tolist())
    step = 1e-4
    for k in range(len(w) + len(thresholds)):
        for sign in (-1, 1):
            p = np.concatenate((w, thresholds))
            p[k] += sign * step
            slope = (plain_loss(x, y, weight, p[: len(w)].tolist(), p[len(w) :].tolist()) - best) / step
            assert abs(slope) < 2e-3, k  # flat in every direction
    for _ in range(20):
        p = np.concatenate((w, thresholds)) + 0.1 * rng.standard_normal(len(w) + len(thresholds))
        assert plain_loss(x, y, weight, p[: len(w)].tolist(), sorted(p[len(w) :].tolist())) > best


def plain_score(model, text):
    """Expected severity, grade and probability, feature by feature and word by word."""
    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    if not text:
        return 0.0, 0, 0.0
    s = model.length_weight * math.log1p(len(words))
    for name, i in model.index.items():
        n = sum(w == name[1:] if name[0] == "=" else w.startswith(name[1:]) and len(w) > len(name) - 1 for w in words)
        s += model.weights[i] * math.log1p(n)
    reach = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
    return sum(reach), sum(p >= 0.5 for p in reach), reach[0]


def test_scores_of_the_whole_table(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    for split in (True, False):
        model = toxicity.fit(docs, labels, split=split)
        rows = docs.select("doc_id", "text").collect()
        got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
        assert len(got) == len(rows)
        for i, text in rows:
            severity, grade, p = plain_score(model, text)
            assert abs(got[i].severity - severity) < 1e-9 and abs(got[i].p_toxic - p) < 1e-9, i
            assert got[i].grade == grade or min(abs(x - 0.5) for x in (p, severity - p)) < 1e-9
