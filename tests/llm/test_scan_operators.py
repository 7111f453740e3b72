"""Toxicity, extraction, licences, decontamination and the pipeline."""

import hashlib
import random
from collections import Counter

import pytest
import regex

import corpus_pipeline
from ledgerloom.llm import decontaminate, html_extract, license_scan, toxicity

SF = "/root/testdata/sf0.01"
WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_on_held_out_labels(spark, tables):
    big = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 2 = 0"))
    scored = toxicity.score(docs, model).withColumnRenamed("toxic", "found").join(labels.where("doc_id % 2 = 1"), "doc_id")
    n = Counter((r.found, r.toxic) for r in scored.select("found", "toxic").collect())
    assert n[True, 1] / (n[True, 1] + n[False, 1]) > 0.9 and n[True, 0] / (n[True, 0] + n[False, 0]) < 0.02
    assert model.thresholds[0] < model.thresholds[1]
    rows = scored.selectExpr("min(severity) lo", "max(severity) hi", "max(grade) g").first()
    assert 0 <= rows.lo < 0.1 and 1.5 < rows.hi <= 2 and rows.g == 2


def test_toxicity_edges(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, 1, None), (10**9, 1, 1)], labels.schema)))
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (3, "you idiot moron, worthless scum and trash", 0.5)], "doc_id long, text string, severity double")
    got = [(r.doc_id, r.grade, r.toxic) for r in toxicity.score(odd, model).orderBy("doc_id").collect()]
    assert got[:3] == [(1, 0, False), (2, 0, False), (2, 0, False)] and got[3][2]
    assert toxicity.keep_clean(odd, model).columns == odd.columns and toxicity.keep_clean(odd, model).count() == 3
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert toxicity.score(odd, None).where("toxic or severity > 0").count() == 0
    assert toxicity.score(odd.limit(0), model).count() == 0


ARTICLE = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><article><h1>Head&amp;line</h1><p>One&nbsp;two\n three<br><p>Next <b>bold</b> text<div class="comments"><p>Nice!</p></div><form><input value="x">Name</form></article><aside>Side</aside><footer>&copy; F</footer></body></html>'


def test_extraction(spark):
    bare = lambda i: f"<html><body><div>Welcome to our site</div><div class='x'><p>Story number {i} is here.</p></div></body></html>"
    rows = [(1, "https://a.example/1", ARTICLE), (1, "https://a.example/1", ARTICLE), (2, None, None), (3, "x", ""), (4, "https://b.example", "plain <unclosed"), (5, "https://c.example", "<p>a<p>b&lt;c")]
    rows += [(100 + i, f"https://site.example/{i}", bare(i)) for i in range(30)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    for bound in (html_extract.MAX_BROADCAST_NODES, 0):
        got = Counter((r.page_id, r.url, r.text) for r in html_extract.extract(pages, max_broadcast_nodes=bound).collect())
        main = "Head&line\n\nOne two three\n\nNext bold text"
        assert got[1, "https://a.example/1", main] == 2
        assert got[2, None, ""] == got[3, "x", ""] == 1
        assert got[5, "https://c.example", "a\n\nb<c"] == 1
        # The site's common block goes for its low entropy, each page's own stays.
        assert all(got[100 + i, f"https://site.example/{i}", f"Story number {i} is here."] == 1 for i in range(30))
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_extraction_keeps_articles_of_copied_pages(spark):
    pages = spark.createDataFrame([(i, "https://m.example/x", ARTICLE) for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in html_extract.extract(pages).collect()} == {"Head&line\n\nOne two three\n\nNext bold text"}


def plain(i):
    return f"<html><body><div>Welcome to our site</div><div><p>Story number {i} is here.</p><p>It goes on for {i} lines.</p></div></body></html>"


@pytest.mark.parametrize("copies, others", [(4, 0), (30, 0), (20, 20), (45, 5)])
def test_extraction_of_copied_pages_without_article(spark, copies, others):
    pages = spark.createDataFrame([(i, "https://p.example/x", plain(0)) for i in range(copies)] + [(100 + i, "https://p.example/y", plain(1 + i)) for i in range(others)], "page_id long, url string, html string")
    for bound in (html_extract.MAX_BROADCAST_NODES, 0):
        got = {r.page_id: r.text for r in html_extract.extract(pages, max_broadcast_nodes=bound).collect()}
        story = lambda i: f"Story number {i} is here.\n\nIt goes on for {i} lines."
        head = "" if others else "Welcome to our site\n\n"
        assert got == {i: head + story(0) for i in range(copies)} | {100 + i: story(1 + i) for i in range(others)}


def test_extraction_leaves_no_page_empty(spark):
    pages = spark.createDataFrame([(i, "https://e.example/", "<html><body><div>All read this</div>" + f"<p>and {i}</p>" * (i > 0) + "</body></html>") for i in range(9)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == {0: "All read this"} | {i: f"and {i}" for i in range(1, 9)}


STORY = "A story of some length, which is what the page is for."


@pytest.mark.parametrize(
    "body",
    [
        f'<body class="has-sidebar"><p>{STORY}</p></body>',
        f'<body class="has-sidebar" role="dialog"><article>{STORY}</article></body>',
        f'<body><div id="page" class="no-comments"><article><p>{STORY}</p></article><div class="comments">{STORY * 3}</div></div></body>',
        f'<body><article class="post related-tag"><p>{STORY}</p><div class="share">Tell it</div></article></body>',
        f'<body><article class="post related-tag"><p>{STORY}</p></article><div class="ad">{STORY * 2}</div></body>',
        f'<body><p class="ad">Buy</p><div class="share-enabled content"><p>{STORY}</p></div></body>',
        f'<body><article><h1></h1><div class="share-enabled content">{STORY}</div></article></body>',
        f'<body><form id="aspnetForm"><input name="x"><div>{STORY}</div><label>Name</label></form><footer>F</footer></body>',
        f'<body><form id="aspnetForm" class="login-page"><main>{STORY}</main><div class="login">Log in</div></form></body>',
        f'<body><main>{STORY}</main><div class="comments"><article class="comment">{STORY * 2}</article></div></body>',
    ],
)
def test_noise_words_of_wrappers_are_no_verdict(body):
    assert html_extract.main_text(html_extract.Page(f"<html class='no-overlay'>{body}</html>"), lambda path: None) == STORY


def test_extraction_under_a_noise_word(spark):
    page = lambda i: f'<html><body class="has-sidebar"><div class="menu">{"Go there. " * 20}</div><div class="share-enabled"><p>Story number {i} is here.</p></div></body></html>'
    pages = spark.createDataFrame([(i, "https://w.example/x", page(i)) for i in range(12)], "page_id long, url string, html string")
    for bound in (html_extract.MAX_BROADCAST_NODES, 0):
        assert {r.page_id: r.text for r in html_extract.extract(pages, max_broadcast_nodes=bound).collect()} == {i: f"Story number {i} is here." for i in range(12)}


def test_entropy_judges_inside_and_beside_articles(spark):
    page = lambda i: f"<html><body><div class='x'>Welcome to our site</div><div class='y'>Summary of story {i}</div><article><div class='z'>Read our terms</div><h1>Story {i}</h1><p>It goes on for {i} lines.</p></article></body></html>"
    pages = spark.createDataFrame([(i, "https://r.example/x", page(i)) for i in range(20)] + [(100, "https://q.example/x", page(100))], "page_id long, url string, html string")
    body = lambda i: f"Story {i}\n\nIt goes on for {i} lines."
    for bound in (html_extract.MAX_BROADCAST_NODES, 0):
        got = {r.page_id: r.text for r in html_extract.extract(pages, max_broadcast_nodes=bound).collect()}
        assert [got[i] for i in range(20)] == [f"Summary of story {i}\n\n{body(i)}" for i in range(20)]
        assert got[100] == "Read our terms\n\n" + body(100)  # one page of a host has no statistics


def brute_base(text):
    words, places, labels = words_of(text), [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def test_licences_equal_brute_force(spark, tables):
    odd = [(-1, None), (-2, ""), (-3, "MIT  License, mit-license; CC BY CC BY Apache License"), (-3, "GNU General Public License"), (-4, "gnu general public x license mit"), (None, "cc by")]
    rows = [(r.doc_id, r.text) for r in tables[0].collect()] + odd
    docs = spark.createDataFrame([(i, t, 1, "m") for i, t in rows], "doc_id long, text string, row int, label string")
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels)) for r in license_scan.scan(docs).collect())
    assert got == Counter((i, *brute_base(t)[:4], tuple(brute_base(t)[4])) for i, t in rows)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_licence_notices_by_neighbouring_diagonals(spark):
    whole = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [(1, "intro words " + whole), (2, whole.replace("free of", "free, as ever, of")), (3, "to any person obtaining a copy of this"), (4, whole.replace(" ", " filler words here and more "))]
    got = {r.doc_id: (r.labels, r.score, r.spans) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][0] == ["mit-text"] and got[1][1] == 1.0 and (got[1][2][0].start, got[1][2][0].end) == (2, 22)
    assert got[2][0] == ["mit-text"] and 0.6 <= got[2][1] < 1
    assert got[3][0] == [] and got[4][0] == [] and got[3][1] == 0.0


def brute_contamination(text, items):
    words, hit, found = words_of(text), set(), set()
    for item_id, item in items:
        w = words_of(item)
        k = min(13, len(w))
        for window in {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else ():
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) == window:
                    hit.update(range(i, i + k))
                    found.add(str(item_id))
    return len(words), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 60])
def test_decontamination_equals_brute_force(spark, block):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice("alpha beta gamma Delta é ß x1".split()) for _ in range(n))
    items = [(1, text(20)), (10, text(15)), (2, "short item"), (3, None), (4, "!!"), (5, "short item"), (None, text(14))]
    texts = [items[0][1].upper().replace("É", "é") + " " + text(30), text(100) + ", " + items[1][1].replace(" ", " -- "), "A Short, item.", text(50) + " short item " + text(60), None, "", "...", text(13)]
    docs = spark.createDataFrame([(i % 7, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, item_ids string, n_hit int")
    bench = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids), r.contaminated) for r in decontaminate.decontaminate(docs, bench, block_bytes=block).collect())
    wanted = Counter((i % 7, *(tuple(x) if isinstance(x, list) else x for x in brute_contamination(t, items))) for i, t in enumerate(texts))
    assert got == wanted
    kept = decontaminate.drop_contaminated(docs, bench, block_bytes=block)
    assert kept.columns == docs.columns and kept.count() == sum(not brute_contamination(t, items)[-1] for t in texts)
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_spans_point_into_the_original(spark):
    docs = spark.createDataFrame([(1, "Ééé, a Short -- ITEM!")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "short item")], "item_id long, text string")
    (span,) = decontaminate.decontaminate(docs, bench).first().spans
    assert "Ééé, a Short -- ITEM!"[span.start : span.end] == "Short -- ITEM"


def test_pipeline_equals_brute_force(spark):
    """Stage by stage: each stage's output is held against plain Python over its own input."""
    import base64
    from collections import defaultdict

    import public_tokenizers
    import tiktoken

    from .test_dedup_operators import brute_classes

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = (before, docs.collect())
        if name != "byte_bpe":
            assert docs.columns == names
    before, after = seen["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert [r for r in before if r.doc_id in kept] == after
    assert sum(labels.get(r.doc_id) == 0 and r.doc_id not in kept for r in before) <= 1
    before, after = seen["line_dedup"]
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for r in before:
        for line in r.text.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(r.doc_id)
    wanted = {r.doc_id: "\n".join(x for x in r.text.split("\n") if len(holders[key(x)]) < 5 or max(holders[key(x)]) == r.doc_id) for r in before}
    assert {r.doc_id: r.text for r in after} == wanted and all(r.n_chars == len(r.text) for r in after if r.text != {b.doc_id: b.text for b in before}[r.doc_id])
    before, after = seen["near_duplicates"]
    before = sorted(before, key=lambda r: r.doc_id)
    classes, _ = brute_classes([r.text for r in before])
    assert sorted(r.doc_id for r in after) == [r.doc_id for i, r in enumerate(before) if classes[i] == i]
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {}
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if not _fast_contamination(r.text, items, grams))
    before, after = seen["byte_bpe"]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        ids = encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def _fast_contamination(text, items, grams):
    if not grams:
        for _, item in items:
            w = words_of(item)
            k = min(13, len(w))
            for i in range(len(w) - k + 1 if k else 0):
                grams.setdefault(k, set()).add(tuple(w[i : i + k]))
    words, hit = words_of(text), set()
    for k, known in grams.items():
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in known:
                hit.update(range(i, i + k))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_pipeline_takes_odd_rows(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "words in a text without an id", None, None, 3), (3, "same text here, five words", "en", "s", 1), (4, "same text here, five words", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_tokens > 0) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [x for x in got if x[0] == "3"] == [("3", True)] and not [x for x in got if x[0] == "4"]
    assert {x[0] for x in got} == {"1", "2", "3", "None"}
