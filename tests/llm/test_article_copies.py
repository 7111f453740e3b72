"""Articles published several times on a host: their paragraphs stay, and so do those of the host's other pages."""

import random
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import html_extract as h

from .test_style_tree import PLANTED, SF, expected


def page(title, paragraphs):
    return f"<html><body><div><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div></body></html>"


STORY = [f"Paragraph {k} of the story tells something of its own, in some words more." for k in "abcd"]


def texts(spark, pages, **options):
    return {r.page_id: r.text for r in h.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), **options).collect()}


@pytest.mark.parametrize("bound", [h.MAX_BROADCAST_NODES, 0])
@pytest.mark.parametrize(("editions", "others"), [(4, 0), (30, 2), (9, 1), (20, 1)])
def test_editions_of_one_text_keep_it(spark, editions, others, bound):
    rows = [(f"Edition {i}", STORY) for i in range(editions)] + [(f"Other {i}", [f"Own {i} {k}" for k in range(4)]) for i in range(others)]
    pages = [(i, "https://e.example/x", page(*r)) for i, r in enumerate(rows)]
    assert texts(spark, pages, max_broadcast_nodes=bound) == {i: "\n\n".join([t, *ps]) for i, (t, ps) in enumerate(rows)}


def brute_repeated(rows):
    """Block keys by definition, from (url, html)."""
    shown, blocks_of = defaultdict(set), {}
    for url, source in rows:
        p, host = h.Page(source), h.host_of(url)
        number = (host, tuple(t for e, t in p.blocks if not e.noise))
        blocks_of[number] = {h.block_key(host, e.key, t) for e, t in p.blocks if not e.noise}
        for b in blocks_of[number]:
            shown[b].add(number)
    article = {}
    for number, blocks in blocks_of.items():
        votes = Counter(frozenset(shown[b]) for b in blocks)
        alone = votes.pop(frozenset([number]), 0)
        if alone and alone >= max(votes.values(), default=0):
            article[number] = {number}
        elif votes:
            most = max(votes.values())
            largest = max(len(s) for s, n in votes.items() if n == most)
            article[number] = {s for s, n in votes.items() if n == most and len(s) == largest}
    return shown, article


def test_repeated_blocks_equal_brute_force(spark):
    rng = random.Random(8)
    pages = []
    for i in range(120):
        story = STORY if i % 4 == 0 else [f"Text {i} {k}" for k in range(rng.randrange(1, 5))]
        pages.append((i, f"https://s{i % 2}.example/{i}", page(f"Title {i}", [*story, "All rights reserved by us."][: rng.randrange(2, 7)])))
    pages += pages[:10] + [(None, None, None), (900, "", "")]
    own = spark.createDataFrame(pages, "page_id long, url string, html string")
    got, spread = ({r.block for r in h.repeated_blocks(own, h.Scratch(spark), max_broadcast=bound).collect()} for bound in (h.MAX_BROADCAST_NODES, 0))
    assert got == spread
    shown, article = brute_repeated([p[1:] for p in pages])
    assert all(len(a) == 1 for a in article.values())  # no tie between sets of one size, which only their sums would settle
    wanted = {b for b, numbers in shown.items() if len({next(iter(article[n])) for n in numbers}) >= h.MIN_PAGES}
    assert got == wanted and wanted


def test_near_copies_and_boilerplate_on_the_whole_of_pages(spark):
    """Every tenth page of the table is published thrice, with a changed date line; a sentence of the host is planted beside and inside each article."""
    given = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows, wanted, judged = [], {}, set()
    sizes = Counter(h.host_of(u) for _, u, _ in given)
    for i, url, source in given:
        for copy in range(3 if i % 10 == 0 else 1):
            dated = source.replace("<article>", f"<article><p>Seen on day {copy}.</p>") if i % 10 == 0 else source
            plant = PLANTED.format(host=h.host_of(url))
            number = 10 * i + copy
            rows.append((number, url, dated.replace("<article>", "<article>" + plant).replace("</body>", plant + "</body>")))
            wanted[number] = expected(dated)
            if sizes[h.host_of(url)] >= h.MIN_PAGES:
                judged.add(number)
    got = texts(spark, rows)
    wrong = [i for i in judged if got[i] != wanted[i]]
    print(f"{len(judged) - len(wrong)} of {len(judged)} pages whole and free of what was planted")
    assert len(judged) > 0.9 * len(rows) and not wrong
