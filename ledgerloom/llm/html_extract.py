"""Main text of web pages by a site style tree.

Pages of one host are merged into one style tree. Its nodes are the elements of the pages: pages share a node if their elements have
the same name (tag, classes, id) under the same parent node. A node has the presentations (sequences of child elements) and the
contents (own texts) that the host's pages show there; the entropy of each, as a share of the greatest that so many pages can have,
makes its importance. A node that looks and reads the same everywhere is of low importance.

What an element is for is a prior, a weight on the importance: an article triples it (inside one only what repeats nearly everywhere
goes, below LEAST_INSIDE), elements that are navigation, footers, scripts and the like by their tag or role have weight 0. Forms, and
elements that only a word of their class or id names, are doubtful: they go, unless they hold an article, or TEXT_SHARE of the text
that importance leaves of the page (of the article, if there is one).

A block's own text decides whether the statistics speak of it at all: sibling blocks of equal name share a node, so a node may be low because some of its
texts repeat, while others stand on one page alone. A block whose text is not repeated counts as important, whatever its node. Repeated means shown by MIN_PAGES
articles of the host, not pages: pages are taken for copies of one article if they share more blocks with one another than each has for itself
(``page_groups``), so an article published under several titles or dates keeps its paragraphs, and so do the other pages of its host. An article of so few
paragraphs that each copy has as many blocks of its own is not told from boilerplate.

From each page go the branches of low importance: repeated blocks whose weighted importance is below LEAST, and outside articles whole branches
whose text has a mean importance below LEAST_BRANCH, with the odd line in them that differs. What is left are the page's text blocks. A page never
loses all its blocks to the statistics.

Statistics are counts per (host, node, fingerprint) and per (host, node, block's text) over the distinct pages of a host (pages of the same text count once, else
copies would look like boilerplate), aggregated before the shuffle and spread over all pages, so a host with a third of all
pages is no hot spot; only the nodes' importance and the keys of repeated blocks travel back to the pages.

Defined cases: null or empty html gives an empty text of 0 characters; a null url, or one without a host, belongs to the host
''; nodes seen on fewer than MIN_PAGES distinct pages of a host have no statistics and
count as important, but beside an article only if the article is the lesser part of the text; elements nested deeper than DEPTH count as
parts of the one there, as in browsers, so the work on a very long page is in proportion to its length and its elements take some
300 bytes each; repeated rows are extracted row by row; a null page_id is carried along; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import column, groups, texts_of
from .decontaminate import Shipped
from .pairing import spread_join
from .store import Scratch, prepare

#: Pages that a node's statistics need, weight of presentation in importance, least importance of what stays.
MIN_PAGES, PRESENTATION, LEAST = 4, 0.1, 0.6
#: Least importance of what stays inside an article, and least mean importance of a branch outside.
LEAST_INSIDE, LEAST_BRANCH = 0.2, 0.2
#: Elements in one another that are told apart.
DEPTH = 512
#: Share of a page's text with which a doubtful element is no noise.
TEXT_SHARE = 0.5
#: Nodes, and repeated blocks, that may be broadcast (12 and 8 bytes each; about 150 in the driver while they are sorted).
MAX_BROADCAST_NODES = 1 << 20

#: HTML's void elements, elements whose content is no markup, and elements that stand as blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements, roles and words of class or id that mark what is not the article.
NOISE_TAGS = frozenset("nav footer aside script style noscript template iframe button select textarea svg canvas menu dialog object head header title option label input".split())
DOUBTFUL_TAGS, ROOTS = frozenset(("form",)), frozenset(("html", "body"))
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement banner sponsor sponsored promo cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup sidebar widget menu nav navbar navigation breadcrumb breadcrumbs topbar masthead footer comments comment reply replies respond disqus share sharing social related recommended toolbar login search pagination pager skip copyright".split())
CONTENT_TAGS = frozenset(("article", "main"))
#: An open element that a new one closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = regex.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>", regex.S)
_ATTRIBUTE = regex.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", regex.I)
_WORDS = regex.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_DIGITS = regex.compile(r"\d+")


class Element:
    """A node on one page. key: of its node in the style tree; noise: by tag or role, its own or an ancestor's; doubt: the innermost
    doubtful element (by a word of its own) among itself and its ancestors; holds: an article is in it."""

    __slots__ = ("tag", "name", "key", "parent", "noise", "doubt", "above", "content", "holds", "children")

    def __init__(self, tag: str, name: str, parent: Element | None, noise: bool, doubtful: bool, content: bool):
        self.tag, self.name, self.parent, self.noise, self.content, self.holds, self.children = tag, name, parent, noise, content, False, []
        self.key = xxhash.xxh3_64_intdigest(f"{parent.key}>{name}".encode()) if parent else 0
        self.above = parent.doubt if parent else None
        self.doubt = self if doubtful else self.above

    def doubted(self) -> bool:
        """Whether it is in a doubtful element that no article clears."""
        d = self.doubt
        while d is not None and d.holds:
            d = d.above
        return d is not None


def _opened(tag: str, attributes: str, parent: Element) -> Element:
    names, roles = [], []
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        (roles if kind.lower() == "role" else names).append(value)
    words = {w.lower() for n in names for w in _WORDS.findall(n)}
    roles = {r.lower() for r in roles}
    root = tag in ROOTS
    noise = parent.noise or (tag in NOISE_TAGS and not (tag == "header" and parent.content)) or (not root and bool(NOISE_ROLES - DOUBTFUL_TAGS & roles))
    doubtful = not root and (tag in DOUBTFUL_TAGS or bool(words & NOISE_WORDS) or bool(DOUBTFUL_TAGS & roles))
    article = tag in CONTENT_TAGS or "main" in roles
    # An article's own words tell nothing ("tag-related"), but comments and teasers are articles inside of such elements.
    doubtful = doubtful and not (article and not parent.content and not parent.doubted())
    content = not noise and (parent.content or (article and not doubtful))
    own = ".".join([tag, *sorted(_DIGITS.sub("0", x) for n in names for x in n.split())])
    element = Element(tag, own, parent, noise, doubtful, content)
    if content and not parent.content:
        above = parent
        while above is not None and not above.holds:
            above.holds, above = True, above.parent
    return element


class Page:
    """Blocks of a page, (element, text) in page order, and its elements, parents first."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[Element, str]] = []
        self.elements: list[Element] = []
        self.buffer: list[str] = []
        self.stack = [Element("", "", None, False, False, False)]
        self.open: Counter = Counter()
        self.deeper: list[str] = []
        self._parse(source or "")

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join(entities.unescape("".join(self.buffer)).split())
            self.buffer = []
            if text:
                top = next(e for e in reversed(self.stack) if e.tag in BLOCK or e.noise or e.doubt is e or not e.tag)
                self.blocks.append((top, text))

    def _parse(self, source: str) -> None:
        at = 0
        while True:
            m = _TOKEN.search(source, at)
            if m is None:
                self.buffer.append(source[at:])
                break
            if m.start() > at:
                self.buffer.append(source[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._close(tag)
                else:
                    at = self._open(tag, m[3], source, at)
        self._flush()

    def _open(self, tag: str, attributes: str, source: str, at: int) -> int:
        """Position after the start tag, or after the end tag of an element without markup."""
        if tag in RAW:
            end = regex.compile(rf"</{tag}\b[^>]*>", regex.I).search(source, at)
            return end.end() if end else len(source)
        if tag in VOID:
            self.buffer.append(" ")
            if tag == "hr":
                self._flush()
            return at
        if tag in BLOCK or tag in NOISE_TAGS:
            self._flush()
        if self.deeper or len(self.stack) > DEPTH:
            self.deeper.append(tag)
            return at
        if tag in BLOCK:
            self._end({"p"}, BLOCK - {"p"})
        if tag in CLOSES:
            self._end(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        element = _opened(tag, attributes, self.stack[-1])
        if not attributes.endswith("/") or tag in BLOCK:
            self.stack.append(element)
            self.open[tag] += 1
        self.elements.append(element)
        if tag in BLOCK:
            parent = next(e for e in reversed(self.stack[:-1]) if e.tag in BLOCK or not e.tag)
            parent.children.append(element.name)
        return at

    def _close(self, tag: str) -> None:
        if tag in BLOCK or (tag in NOISE_TAGS and (self.open[tag] or self.deeper)):
            self._flush()
        if self.deeper:  # a tag that is not among the last few is taken for a stray one
            for i in range(len(self.deeper) - 1, max(-1, len(self.deeper) - 1 - DEPTH), -1):
                if self.deeper[i] == tag:
                    del self.deeper[i:]
                    return
            if len(self.deeper) > DEPTH:
                return
            self.deeper.clear()
        if self.open[tag]:
            self._end({tag}, set())

    def _end(self, wanted: set[str], stop: set[str]) -> None:
        """Closes the innermost wanted element, and what is open in it."""
        if not any(self.open[t] for t in wanted):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in wanted:
                self.open.subtract(e.tag for e in self.stack[i:])
                del self.stack[i:]
                return
            if self.stack[i].tag in stop:
                return


def host_of(url: str | None) -> str:
    m = regex.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def node_key(host: str, key: int) -> int:
    """The node of the host's style tree."""
    return xxhash.xxh3_64_intdigest(f"{host}\0{key}".encode()) - (1 << 63)


def block_key(host: str, key: int, text: str) -> int:
    """A text at a node of the host's style tree."""
    return xxhash.xxh3_64_intdigest(f"{host}\0{key}\0{text}".encode()) - (1 << 63)


def _low_branches(page: Page, heard: list[tuple[Element, str, float | None]]) -> set[Element]:
    """Elements outside articles, with all that is in them, of whose text nearly all repeats on the host's pages."""
    size: dict[Element, list[float]] = {}
    for e, text, weight in heard:
        sums = size.setdefault(e, [0.0, 0.0])
        sums[0] += len(text)
        sums[1] += len(text) * (1.0 if weight is None else weight)
    for e in reversed(page.elements):
        if e in size and e.parent is not None:
            above = size.setdefault(e.parent, [0.0, 0.0])
            above[0] += size[e][0]
            above[1] += size[e][1]
    low: set[Element] = set()
    for e in page.elements:
        mean_is_low = e in size and size[e][1] < LEAST_BRANCH * size[e][0] and e.tag not in ROOTS
        if e.parent in low or (mean_is_low and not e.holds and not e.content):
            low.add(e)
    return low


def main_text(page: Page, weight, repeated=lambda key, text: True) -> str:
    """weight(key): the importance that the site's statistics give the node, None if they have none; repeated(key, text): whether a text repeats there."""
    weighed = lambda w, key, text: w if w is None or repeated(key, text) else max(w, 1.0)
    heard = [(e, text, weighed(weight(e.key), e.key, text)) for e, text in page.blocks if not e.noise]
    low = _low_branches(page, heard) if any(w is not None for *_, w in heard) else ()
    stays = lambda e, w: e not in low and (w is None or w >= (LEAST_INSIDE if e.content else LEAST))
    kept = [b for b in heard if stays(b[0], b[2])] or heard
    inside = [b for b in kept if b[0].content]
    # Beside an article that is free of doubt, doubtful elements are what they are called; else the share of the text decides.
    pool = inside if any(not e.doubted() for e, *_ in inside) else kept
    doubtful = [e for e in page.elements if e.doubt is e]
    held: Counter = Counter()
    for e, text, _ in pool:
        held[e.doubt] += len(text)
    for d in reversed(doubtful):
        held[d.above] += held[d]
    enough = TEXT_SHARE * sum(len(text) for _, text, _ in pool)
    clear = {None: True}
    for d in doubtful:
        clear[d] = clear[d.above] and (d.holds or held[d] >= enough)
    quiet = [b for b in kept if clear[b[0].doubt]] or kept
    # Beside an article only what statistics find important stays, unless the article is the lesser part of the text.
    share = sum(len(text) for e, text, _ in quiet if e.content)
    lesser = share < TEXT_SHARE * sum(len(text) for _, text, _ in quiet)
    return "\n\n".join(text for e, text, w in quiet if e.content or w is not None or not share or lesser)


def fingerprints(page: Page) -> dict[int, dict[int, int]]:
    """For LOOKS (presentation) and READS (content): the fingerprint of each node of the page that is not noise."""
    looks: dict[int, list] = {}
    reads: dict[int, list] = {}
    for e in page.elements:
        if e.tag in BLOCK and not e.noise:
            looks.setdefault(e.key, []).append(",".join(e.children))
    for e, text in page.blocks:
        if not e.noise:
            reads.setdefault(e.key, []).append(text)
    return {kind: {key: xxhash.xxh3_64_intdigest("\n".join(values).encode()) - (1 << 63) for key, values in found.items()} for kind, found in ((LOOKS, looks), (READS, reads))}


def page_groups(blocks: DataFrame, shared: DataFrame) -> DataFrame:
    """page, article of the pages that share blocks: copies of one article have the same one.

    blocks: distinct (page, block); shared: those that several pages show, with the set of these pages (its size and sum). A page belongs to the set that most of
    its shared blocks stand for, the set of more pages if several are as many, but to itself alone if as many blocks are its own.
    """
    votes = shared.groupBy("page", "shown").agg(F.count("block").alias("n"))
    best = votes.groupBy("page").agg(F.max(F.struct("n", "shown")).alias("most"), F.sum("n").alias("shared"))
    alone = F.struct(F.lit(1).cast("long").alias("pages"), F.col("page").cast("decimal(38,0)").alias("sum"))
    own = blocks.groupBy("page").agg(F.count("block").alias("n"))
    return best.join(own, "page").select("page", F.when(F.col("most.n") > F.col("n") - F.col("shared"), F.col("most.shown")).otherwise(alone).alias("article"))


def repeated_blocks(own: DataFrame, scratch: Scratch, merged: DataFrame | None = None, max_broadcast: int = MAX_BROADCAST_NODES) -> DataFrame:
    """block keys of the texts that MIN_PAGES articles or more show at a node of their host."""
    blocks = (merge(own) if merged is None else merged).where(F.col("kind") == BLOCKS).select("page", F.col("node").alias("block"))
    sets = blocks.groupBy("block").agg(F.count("page").alias("pages"), F.sum(F.col("page").cast("decimal(20,0)")).cast("decimal(38,0)").alias("sum")).where("pages > 1")
    sets = scratch.write(sets.select("block", F.struct("pages", "sum").alias("shown")))
    met = blocks.join(F.broadcast(sets), "block") if sets.count() <= max_broadcast // 4 else spread_join(blocks, sets, "block", F.col("page")).where(F.col("shown").isNotNull())
    shared = scratch.write(met.select("page", "block", "shown"))
    often = shared.where(F.col("shown.pages") >= MIN_PAGES).join(page_groups(blocks, shared), "page").select("block", "article").distinct()
    return often.groupBy("block").agg(F.count("article").alias("n")).where(F.col("n") >= MIN_PAGES).select("block")


#: Kinds of what pages show: presentations and contents of nodes, and texts at nodes.
LOOKS, READS, BLOCKS = 0, 1, 2


def merge(own: DataFrame) -> DataFrame:
    """node (for BLOCKS, the block's key), kind, page and print (a fingerprint of what the page shows there) of each distinct page, once."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "html"):
            nodes, kinds, prints, numbers = [], [], [], []
            for url, source in zip(texts_of(batch, "url"), texts_of(batch, "html"), strict=True):
                page, host = Page(source), host_of(url)
                number = xxhash.xxh3_64_intdigest("\0".join([host, *(text for e, text in page.blocks if not e.noise)]).encode()) - (1 << 63)
                found = fingerprints(page)
                for kind, own_prints in found.items():
                    nodes += [node_key(host, key) for key in own_prints]
                    kinds += [kind] * len(own_prints)
                    prints += own_prints.values()
                blocks = {block_key(host, e.key, text) for e, text in page.blocks if not e.noise}
                nodes += blocks
                kinds += [BLOCKS] * len(blocks)
                prints += [0] * len(blocks)
                numbers += [number] * (len(nodes) - len(numbers))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(kinds, pa.int32()), pa.array(prints, pa.int64()), pa.array(numbers, pa.int64())], ["node", "kind", "print", "page"])

    return own.mapInArrow(show, "node long, kind int, print long, page long").groupBy("node", "kind", "page").agg(F.min("print").alias("print"))


def importance(own: DataFrame, merged: DataFrame | None = None) -> DataFrame:
    """node, pages, importance: entropies of content and presentation, each over its greatest value. merged: what ``merge`` gives, where it is kept."""
    c = F.col("count").cast("double")
    share = lambda n, s: 1 - s / (n * F.log(n))  # entropy / log(n)
    pick = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))
    counts = (merge(own) if merged is None else merged).where(F.col("kind") != BLOCKS).groupBy("node", "kind", "print").count()
    sums = counts.groupBy("node").agg(pick(0, c).alias("looks"), pick(0, c * F.log(c)).alias("looks_log"), pick(1, c).alias("pages"), pick(1, c * F.log(c)).alias("pages_log"))
    kept = sums.where(F.col("pages") >= MIN_PAGES)
    looks = F.when(F.col("looks") >= MIN_PAGES, share(F.col("looks"), F.col("looks_log"))).otherwise(F.lit(1.0))
    return kept.select("node", "pages", ((1 - PRESENTATION) * share(F.col("pages"), F.col("pages_log")) + PRESENTATION * looks).alias("importance"))


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", max_broadcast_nodes: int = MAX_BROADCAST_NODES) -> DataFrame:
    """Per page: page_id, url, text."""
    spark = pages.sparkSession
    prepare(spark)
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    scratch = Scratch(spark)
    merged = scratch.write(merge(own))
    known = scratch.write(importance(own, merged).select("node", "importance"))
    often = scratch.write(repeated_blocks(own, scratch, merged, max_broadcast_nodes))
    schema = T.StructType([own.schema["page_id"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
    if known.count() + often.count() <= max_broadcast_nodes:
        table = np.array(sorted((r.node, r.importance) for r in known.toLocalIterator()), [("node", np.int64), ("importance", np.float32)])
        shipped = Shipped(spark.sparkContext.broadcast((table, np.sort(np.array([r.block for r in often.toLocalIterator()], np.int64)))))

        def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes, values, blocks = np.ascontiguousarray(shipped.value[0]["node"]), shipped.value[0]["importance"], shipped.value[1]

            def weight(host: str, node: int) -> float | None:
                key = node_key(host, node)
                at = int(np.searchsorted(nodes, key))
                return float(values[at]) if at < len(nodes) and int(nodes[at]) == key else None

            def repeated(host: str, node: int, text: str) -> bool:
                key = block_key(host, node, text)
                at = int(np.searchsorted(blocks, key))
                return at < len(blocks) and int(blocks[at]) == key

            for batch in groups(batches, "html"):
                rows = zip(texts_of(batch, "url"), texts_of(batch, "html"), strict=True)
                texts = [main_text(Page(source), lambda node, host=host_of(u): weight(host, node), lambda node, text, host=host_of(u): repeated(host, node, text)) for u, source in rows]
                yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

        return own.mapInArrow(prune, schema)

    # Too many to broadcast: each page's nodes and blocks meet them in a join keyed by the node or block, spread over all pages by a salt.
    numbered = scratch.write(own.withColumn("row", F.monotonically_increasing_id()))

    def heard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "html"):
            rows, nodes = [], []
            for row, u, source in zip(texts_of(batch, "row"), texts_of(batch, "url"), texts_of(batch, "html"), strict=True):
                host = host_of(u)
                heard = [(e.key, text) for e, text in Page(source).blocks if not e.noise]
                own_nodes = {node_key(host, key) for key, _ in heard} | {block_key(host, key, text) for key, text in heard}
                nodes += own_nodes
                rows += [row] * len(own_nodes)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(nodes, pa.int64())], ["row", "node"])

    salts = 16
    salted = numbered.mapInArrow(heard_nodes, "row long, node long").withColumn("salt", F.pmod("row", F.lit(salts)))
    both = known.unionByName(often.select(F.col("block").alias("node"), F.lit(None).cast("double").alias("importance")))
    spread = both.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    found = salted.join(spread, ["node", "salt"]).groupBy("row").agg(F.collect_set(F.struct("node", "importance")).alias("weights"))

    def prune_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "html"):
            rows = zip(texts_of(batch, "url"), texts_of(batch, "html"), texts_of(batch, "weights"), strict=True)
            texts = []
            for u, source, weights in rows:
                host, found, blocks = host_of(u), {x["node"]: float(np.float32(x["importance"])) for x in weights or () if x["importance"] is not None}, {x["node"] for x in weights or () if x["importance"] is None}
                texts.append(main_text(Page(source), lambda node, h=host, f=found: f.get(node_key(h, node)), lambda node, text, h=host, b=blocks: block_key(h, node, text) in b))
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return numbered.join(found, "row", "left").mapInArrow(prune_joined, schema)
