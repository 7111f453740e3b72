"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

Texts are normalised (A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``); every window of 13 item words is a pattern, an
item of fewer words is one pattern. The automaton reads words, numbered by the benchmark's vocabulary, as two letters each (a node's edges are
searched one by one, so an alphabet of the vocabulary's square root keeps steps short), which keeps it several times smaller than one
of characters. Each document is scanned once and the matches are mapped back to character
offsets of the original text. No shuffle: benchmark patterns travel to the documents, never the other way.

An automaton is bounded by BLOCK_BYTES, reckoned from its nodes before it is built. A larger benchmark is dealt in blocks of
segments that overlap by a window; the driver holds one block at a time, each block's scan writes only what it hit, and the hits meet the documents
at the end.

Defined cases: a null or empty document has no words and is clean; a very long one is scanned whole, alone in its worker; a null item, or
one without words, has no windows; items with a null id count as one item that has no name in item_ids; repeated documents
are judged row by row; repeated items with different ids all count; an empty benchmark leaves every
document clean; other columns, whatever their names, are not read by ``decontaminate`` and pass through ``drop_contaminated`` untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import FOLD, column, groups, texts_of
from .store import Scratch, fresh, prepare

WINDOW = 13
#: Memory of one block's automaton in a worker, and of one of its nodes (32 bytes, and its share of the values); letters of a word.
BLOCK_BYTES, NODE_BYTES, LETTERS = 256 << 20, 40, 2
#: Windows of a segment at least.
SEGMENT = 1024
#: Texts with hits that may be broadcast, where there are several blocks.
MAX_BROADCAST_HITS = 1 << 16
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_JAVA_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normal_words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().translate(FOLD).split()


def windows(items: Iterable[tuple], size: int = WINDOW) -> Iterator[tuple[tuple, object]]:
    """Windows (tuples of words) of (id, words) items, with the item's id."""
    for item_id, words in items:
        span = min(size, len(words))
        for i in range(len(words) - span + 1 if span else 0):
            yield tuple(words[i : i + span]), item_id


class Automaton:
    """Patterns of word numbers, written as two letters each; items: (id, words)."""

    def __init__(self, items: list[tuple[object, list[bytes]]]):
        self.numbers: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.numbers.setdefault(w, len(self.numbers) + 1)
        self.base = max(2, math.isqrt(len(self.numbers)) + 1)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, item_id in windows(items):
            key = self._letters(window)
            had = self.machine.get(key, None)
            if had is None:
                self.machine.add_word(key, (len(window), {item_id: None}))
            else:
                had[1][item_id] = None
        self.empty = not self.numbers
        if not self.empty:
            self.machine.make_automaton()

    def _letters(self, words: Sequence[bytes]) -> tuple[int, ...]:
        """First letters are 1 to base + 1, second ones greater; a word that no item has is two zeros."""
        number = self.numbers.get
        n = np.array([number(w, 0) for w in words], np.int64)
        pairs = np.stack((n // self.base + 1, n % self.base + self.base + 2), axis=1)
        pairs[n == 0] = 0
        return tuple(pairs.ravel().tolist())

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list]:
        """Number of words, hit word intervals (merged, end exclusive), ids of the items found."""
        words = normal_words(text)
        if self.empty or not words:
            return len(words), [], []
        ids, spans = {}, []
        for end, (n, items) in self.machine.iter(self._letters(words)):
            last = end // LETTERS + 1
            spans.append((last - n, last))
            ids.update(items)
        return len(words), merged(spans), list(ids)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word intervals as character offsets of the untouched text."""
    at = [m.span() for m in _WORD.finditer(text)] if spans else []
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


_built: dict[int, Automaton] = {}


def automaton(shipped) -> Automaton:
    """One automaton per worker process and broadcast."""
    if shipped.id not in _built:
        _built.clear()
        _built[shipped.id] = Automaton(shipped.value)
    return _built[shipped.id]


class Shipped:
    """A broadcast value that keeps its number in the worker."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state

    @property
    def value(self):
        return self.broadcast.value


class Blocks:
    """The benchmark dealt in blocks whose automata take about ``limit`` bytes each; a block is fetched when it is asked for."""

    def __init__(self, benchmark: DataFrame, item_id: str, item_text: str, limit: int):
        words = F.regexp_extract_all(F.translate(F.coalesce(F.col(item_text), F.lit("")), _UPPER, _UPPER.lower()), F.lit(_JAVA_WORD), F.lit(0))
        items = benchmark.select(F.col(item_id).alias("id"), words.alias("words")).where(F.size("words") > 0)
        most = max(SEGMENT, limit // NODE_BYTES // LETTERS // WINDOW // 8)
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)), F.lit(most))
        cut = items.select("id", "words", F.explode(starts).alias("at"))
        self.segments = cut.select("id", F.slice("words", F.col("at") + 1, F.lit(most + WINDOW - 1)).alias("words"))
        span = F.least(F.size("words"), F.lit(WINDOW))
        sums = self.segments.agg(F.sum((F.size("words") - span + 1).cast("long") * span).alias("nodes"), F.count("words").alias("n")).first()
        self.count = max(1, min(sums.n, -(-(sums.nodes or 0) * LETTERS * NODE_BYTES // limit)))

    def fetch(self, k: int) -> list[tuple[object, list[bytes]]]:
        part = self.segments.where(F.pmod(F.xxhash64("id", "words"), F.lit(self.count)) == k) if self.count > 1 else self.segments
        return [(r.id, [w.encode() for w in r.words]) for r in part.toLocalIterator()]


SCHEMA = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("contaminated", T.BooleanType()),
]
_WORD_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
_HITS = "array<struct<a: long, b: long>>"


def _key(text: Column) -> Column:
    """Tells texts apart by two hashes; equal texts are hit equally."""
    return F.struct(F.xxhash64(text).alias("hash"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("check"))


def _block_hits(texts: DataFrame, shipped: Shipped) -> DataFrame:
    """key, spans (of words), items (their names) and nameless of each text that a block hits. texts: text, key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "text"):
            got = [automaton(shipped).scan(t) for t in texts_of(batch, "text")]
            at = [i for i, (_, spans, _) in enumerate(got) if spans]
            spans = [[{"a": a, "b": b} for a, b in got[i][1]] for i in at]
            names = [[str(x) for x in got[i][2] if x is not None] for i in at]
            arrays = [column(batch, "key").take(pa.array(at, pa.int64())), pa.array(spans, _WORD_SPANS), pa.array(names, pa.list_(pa.string())), pa.array([None in got[i][2] for i in at], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "spans", "names", "nameless"])

    return texts.mapInArrow(scan, f"key struct<hash: long, check: long>, spans {_HITS}, names array<string>, nameless boolean")


def _all_hits(texts: DataFrame, blocks: Blocks, scratch: Scratch) -> DataFrame:
    """One row a text that any block hits, with what all blocks hit in it."""
    spark, parts = texts.sparkSession, []
    for k in range(blocks.count):
        broadcast = spark.sparkContext.broadcast(blocks.fetch(k))
        parts.append(scratch.write(_block_hits(texts, Shipped(broadcast)).dropDuplicates(["key"])))
        broadcast.destroy()
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    return scratch.write(found.groupBy("key").agg(flat("spans"), flat("names"), F.bool_or("nameless").alias("nameless")))


def _with_hits(docs: DataFrame, text: str, blocks: Blocks, name: str) -> DataFrame:
    """The documents with what all blocks hit in a struct column ``name`` (null: nothing)."""
    scratch = Scratch(docs.sparkSession)
    key = fresh(docs.columns, "hit_key", name)
    hits = _all_hits(docs.select(F.col(text).alias("text"), _key(F.col(text)).alias("key")), blocks, scratch)
    few = hits.count() <= MAX_BROADCAST_HITS
    hits = hits.select(F.col("key").alias(key), F.struct("spans", "names", "nameless").alias(name))
    return docs.withColumn(key, _key(F.col(text))).join(F.broadcast(hits) if few else hits, key, "left").drop(key)


def _found(texts: list[str | None], machine: Automaton | None, hits: list[dict | None] | None) -> Iterator[tuple[int, list, list[str], bool]]:
    """Number of words, hit intervals, names of items and whether a nameless one is among them, from a scan or from the blocks' hits."""
    if machine is not None:
        for t in texts:
            n, spans, ids = machine.scan(t)
            yield n, spans, sorted({str(x) for x in ids if x is not None}), None in ids
        return
    for t, hit in zip(texts, hits, strict=True):
        n = len(normal_words(t))
        if hit is None:
            yield n, [], [], False
        else:
            yield n, merged([(x["a"], x["b"]) for x in hit["spans"]]), sorted(set(hit["names"])), hit["nameless"]


def _bad(n: int, spans: list[tuple[int, int]], share: int) -> bool:
    hit = sum(b - a for a, b in spans)
    return hit > 0 and share * hit >= n


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids, spans (character offsets), contaminated.

    A document is contaminated if n_hit > 0 and share * n_hit >= n_words.
    """
    spark = docs.sparkSession
    prepare(spark)
    blocks = Blocks(benchmark, item_id, item_text, block_bytes)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    one = Shipped(spark.sparkContext.broadcast(blocks.fetch(0))) if blocks.count == 1 else None
    own = own if one else _with_hits(own, "text", blocks, "hits")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "text"):
            texts = texts_of(batch, "text")
            rows = list(_found(texts, automaton(one) if one else None, None if one else texts_of(batch, "hits")))
            places = [[{"start": a, "end": b} for a, b in original_spans(t or "", spans)] for t, (_, spans, _, _) in zip(texts, rows, strict=True)]
            arrays = [
                column(batch, "doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([sum(b - a for a, b in r[1]) for r in rows], pa.int64()),
                pa.array([len(r[2]) + r[3] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string())),
                pa.array(places, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([_bad(r[0], r[1], share) for r in rows], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f.name for f in SCHEMA)])

    return own.mapInArrow(finish, T.StructType([T.StructField("doc_id", own.schema["doc_id"].dataType), *SCHEMA]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that are not contaminated."""
    spark = docs.sparkSession
    prepare(spark)
    blocks = Blocks(benchmark, item_id, item_text, block_bytes)
    one = Shipped(spark.sparkContext.broadcast(blocks.fetch(0))) if blocks.count == 1 else None
    name = fresh(docs.columns, "hits")
    rows = docs if one else _with_hits(docs, text, blocks, name)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, text):
            found = _found(texts_of(batch, text), automaton(one) if one else None, None if one else texts_of(batch, name))
            good = pa.array([not _bad(n, spans, share) for n, spans, _, _ in found], pa.bool_())
            yield batch.filter(good) if one else batch.filter(good).drop_columns([name])

    return rows.mapInArrow(keep, docs.schema)
