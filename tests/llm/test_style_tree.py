"""The style tree: importance against a plain computation, planted boilerplate on the whole of pages, odd and deep pages."""

import math
import random
import resource
import time
from collections import Counter, defaultdict

import pytest
import regex

from ledgerloom.llm import html_extract as h

SF = "/root/testdata/sf0.1"


def brute_importance(rows):
    """(host, key) to importance, from pages (url, html): counts over the distinct texts of a host, entropies by definition."""
    pages = {}
    for url, source in rows:
        page = h.Page(source)
        pages[h.host_of(url), tuple(text for e, text in page.blocks if not e.noise)] = page
    seen = defaultdict(lambda: (Counter(), Counter()))
    for (host, _), page in pages.items():
        looks, reads = defaultdict(list), defaultdict(list)
        for e in page.elements:
            if e.tag in h.BLOCK and not e.noise:
                looks[e.key].append(tuple(e.children))
        for e, text in page.blocks:
            if not e.noise:
                reads[e.key].append(text)
        for kind, found in ((0, looks), (1, reads)):
            for key, values in found.items():
                seen[host, key][kind][tuple(values)] += 1

    def entropy(counts):
        n = sum(counts.values())
        return -sum(c / n * math.log(c / n) for c in counts.values()) / math.log(n)

    out = {}
    for node, (looks, reads) in seen.items():
        if sum(reads.values()) >= h.MIN_PAGES:
            look = entropy(looks) if sum(looks.values()) >= h.MIN_PAGES else 1.0
            out[node] = (1 - h.PRESENTATION) * entropy(reads) + h.PRESENTATION * look
    return out


PARTS = ["<div class='x'>Welcome</div>", "<p>Same for all</p>", "<p>Own {i}</p>", "<ul><li>{i}</li><li>b</li></ul>", "<article><h1>Story {i}</h1><p>Text {i}</p></article>", "<nav>Go {i}</nav>", "<div><p>Kind {k}</p></div>"]


def made_pages(n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parts = [p for p in PARTS if rng.random() < 0.8]
        rows.append((i, f"https://s{i % 3}.example/{i}", "<html><body>" + "".join(parts).format(i=i, k=i % 5) + "</body></html>"))
    return rows + rows[: n // 4]


def test_importance_equals_brute_force(spark):
    rows = made_pages(60)
    own = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.node: r.importance for r in h.importance(own).collect()}
    wanted = {h.node_key(*node): value for node, value in brute_importance([r[1:] for r in rows]).items()}
    assert got.keys() == wanted.keys() and len(got) > 10
    assert all(abs(got[k] - wanted[k]) < 1e-9 for k in got)


ARTICLE = regex.compile(r"<article>(.*?)</article>", regex.S)
PLANTED = "<div class='q'>You read the pages of {host}, kept by its readers for its readers.</div>"


def expected(source):
    """Text of the given pages' articles, read by patterns: blocks open at h1, p and end there; b and br are no blocks."""
    import html as entities

    inner = ARTICLE.search(source)[1].replace("<br>", " ")
    blocks = (" ".join(entities.unescape(regex.sub(r"</?b>", "", x)).split()) for x in regex.split(r"</?(?:h1|p)>", inner))
    return "\n\n".join(x for x in blocks if x)


def test_planted_boilerplate_on_the_whole_of_pages(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    plain = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(plain).collect()}
    wanted = {i: expected(source) for i, _, source in pages}
    assert got == wanted
    plant = lambda u, source: source.replace("<article>", "<article>" + PLANTED.format(host=h.host_of(u))).replace("</body>", PLANTED.format(host=h.host_of(u)) + "</body>")
    sown = [(i, u, plant(u, source)) for i, u, source in pages]
    texts = Counter((h.host_of(u), t) for (_, u, _), t in zip(pages, wanted.values(), strict=True))
    sizes = Counter(host for host, _ in texts)
    found = {r.page_id: r.text for r in h.extract(spark.createDataFrame(sown, "page_id long, url string, html string")).collect()}
    judged = [i for i, u, _ in pages if sizes[h.host_of(u)] >= h.MIN_PAGES]
    right = sum(found[i] == wanted[i] for i in judged)
    print(f"{right} of {len(judged)} pages free of planted boilerplate and otherwise whole")
    assert len(judged) > 0.95 * len(pages) and right == len(judged)
    # Without the tree the boilerplate stays.
    assert all("kept by its readers" in h.main_text(h.Page(source), lambda key: None) for _, _, source in sown[:200])


def test_branches_of_boilerplate_go_as_a_whole(spark):
    page = lambda i: f"<html><body><div class='legal'><p>{'All rights are reserved by the makers of this site. ' * 8}</p><h6>Printed as sheet {i}</h6></div><div><p>Story {i} begins.</p><p>It ends after {i} lines, as all do.</p></div></body></html>"
    pages = spark.createDataFrame([(i, "https://z.example/x", page(i)) for i in range(20)], "page_id long, url string, html string")
    for bound in (h.MAX_BROADCAST_NODES, 0):
        assert {r.page_id: r.text for r in h.extract(pages, max_broadcast_nodes=bound).collect()} == {i: f"Story {i} begins.\n\nIt ends after {i} lines, as all do." for i in range(20)}


def text_of(source):
    return h.main_text(h.Page(source), lambda key: None)


@pytest.mark.parametrize("tags", [("div", ""), ("b", ""), ("div", ' class="ad"'), ("ul><li", ""), ("p", "")])
def test_deep_pages_in_bounded_memory_and_time(tags):
    tag, attributes = tags
    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    page = h.Page(f"<{tag}{attributes}>x" * 100_000 + "</span>" * 1000 + "y")
    h.main_text(page, lambda key: 0.5)
    assert time.time() - began < 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
    closed = "<div>" * 2000 + "deep" + "</div>" * 2000
    assert text_of(f"<body>{closed}<article>After</article><footer>Foot</footer></body>") == "After"
    assert text_of(f"<body>{closed}<p>After</p><footer>Foot</footer></body>") == "deep\n\nAfter"


def test_nested_teasers_and_no_sidebar():
    story = "A story of some length, which is what the page is for."
    assert text_of(f'<body class="single no-sidebar"><article><p>{story}</p></article></body>') == story
    assert text_of(f'<div id="content-with-sidebar"><main><p>{story}</p></main></div>') == story
    assert text_of(f'<body><article><p>{story}</p><aside><article><p>Teaser</p></article></aside></article></body>') == story
