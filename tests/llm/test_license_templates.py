"""Labels and score of the license scan against a plain alignment of every template with every text."""

import random

import regex

from ledgerloom.llm import license_scan

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_notices(text, notices, k=license_scan.NOTICE_GRAM):
    """Labels and best cover: for each template, runs of diagonals with common grams at most SLACK apart."""
    words, labels, best = words_of(text), set(), 0.0
    for template, label in notices.items():
        t = words_of(template)
        n = min(k, len(t))
        hits = sorted((i - j, i, j) for i in range(len(words) - n + 1) for j in range(len(t) - n + 1) if words[i : i + n] == t[j : j + n])
        runs = []
        for hit in hits:
            if runs and hit[0] - runs[-1][-1][0] <= license_scan.SLACK:
                runs[-1].append(hit)
            else:
                runs.append([hit])
        for run in runs:
            cover = len({j for _, _, j in run}) / (len(t) - n + 1)
            if cover >= license_scan.COVER and max(i for _, i, _ in run) + n - min(i for _, i, _ in run) <= license_scan.STRETCH * len(t):
                labels.add(label)
                best = max(best, cover)
    return labels, best


def test_labels_and_score_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["nothing here", "", None, "gnu general public license", "x " * 400]
    for notice in license_scan.NOTICES:
        w = notice.split()
        texts += [notice, "before it " + notice + " after", " ".join(w[: len(w) // 2]), " ".join(x for x in w if rng.random() > 0.05), " ".join(y for x in w for y in ([x, "word"] if rng.random() < 0.05 else [x]))]
        texts += [" ".join(w[: int(len(w) * 0.55)] + ["filler"] * len(w) + w[int(len(w) * 0.55) :]), notice + " " + notice]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (set(r.labels) - set(r.base_labels), r.n_base, r.score) for r in license_scan.scan(docs).collect()}
    for i, text in enumerate(texts):
        labels, best = brute_notices(text, license_scan.NOTICES)
        assert got[i][0] == labels, (i, text)
        assert abs(got[i][2] - (1.0 if got[i][1] else best)) < 1e-9


def test_templates_of_one_label_do_not_add_up(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta zz four five six"), (2, "alone mit here"), (3, "two words"), (4, "alpha beta gamma delta epsilon " * 2)], "doc_id long, text string")
    notices = {"alpha beta gamma delta epsilon zeta": "own", "one two three four five six": "own", "two words": "pair"}
    got = {r.doc_id: (r.labels, r.n_base, r.score) for r in license_scan.scan(docs, phrases={"mit": "mit"}, notices=notices).collect()}
    assert got[1] == ([], 0, 0.0)  # two of four grams of the first template, one of the second
    assert got[4][0] == ["own"] and abs(got[4][2] - 3 / 4) < 1e-9  # a gram that stands twice counts once
    assert got[2] == (["mit"], 1, 1.0) and got[3] == (["pair"], 0, 1.0)
