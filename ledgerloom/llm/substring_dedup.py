"""Substring deduplication with suffix automata of reference shards.

Words are ``[^\\x20\\x09-\\x0D]+``. A window of LENGTH consecutive words is repeated if its words also start anywhere else.

1. Every window is owned by its anchor, the first least hash among its ANCHOR-word grams. Equal windows have equal anchors, so
   only anchors that occur twice matter. Consecutive windows of one anchor's place form a context; contexts are counted by content with
   partial aggregation, so copies collapse.
2. The contexts of such an anchor are its reference, each with its number of occurrences. Shards of references become suffix automata
   with occurrence counts, and the shard's contexts are streamed through for matching statistics: a window is repeated if the
   state of its LENGTH words has occurred twice. That holds for exact copies (one context that occurs often) as for others.
3. Repeated windows go back to their documents, whose maximal covered spans are removed.

The corpus is its own reference and grows, so shards are not broadcast to all documents: by their anchors, contexts go to the one
shard that can match them. Anchors with more than HOT contexts (a passage that a large share of all documents embeds) would make
unbounded shards; their windows are counted by hash with partial aggregation instead.

Defined cases: a null text, or one without words, gives 0 words and an empty text; repeated rows repeat each other (their marks are
kept once, however many rows there are); rows that share a doc_id are told apart by their text; a very long text is one group of its
own in a worker and is judged whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bitmap
from .bytescan import SPACED, Words, column, gram_starts, grams, groups, mix, range_hashes, texts_of
from .decontaminate import Shipped
from .pairing import sorted_groups
from .store import Scratch, prepare

LENGTH, ANCHOR = 35, 8
#: Windows of a context at most (bits of a mask), contexts of an anchor that go to one shard, words of a shard.
MOST, HOT, SHARD_WORDS = 60, 1024, 20_000


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the first least value of each w consecutive values."""
    at, size = np.arange(len(x)), 1
    while size < w:
        step = min(size, w - size)
        left, right = at[:-step], at[step:]
        at = np.where(x[left] <= x[right], left, right)
        size += step
    return at


class Contexts:
    """Contexts of texts: text number, first window (word number in the text), windows, anchor and content hash."""

    def __init__(self, texts: list[str | None], length: int):
        words = Words(texts, SPACED)
        self.hashes = words.hashes()
        starts = gram_starts(words.bounds, length)
        k = min(ANCHOR, length)
        n = len(self.hashes)
        if not len(starts):
            self.text = self.first = self.windows = self.at = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.int64)
            return
        all_grams = grams(self.hashes, np.arange(n - k + 1), k)
        owner = _sliding_least(all_grams, length - k + 1)[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1] + 1) | (owner[1:] != owner[:-1])
        runs = np.flatnonzero(new)
        new[(np.arange(len(starts)) - np.repeat(runs, np.diff(np.append(runs, len(starts))))) % MOST == 0] = True
        runs = np.flatnonzero(new)
        self.at, self.windows = starts[runs], np.diff(np.append(runs, len(starts)))
        self.text = np.searchsorted(words.bounds, self.at, side="right") - 1
        self.first = self.at - words.bounds[self.text]
        self.anchor = all_grams[owner[runs]].view(np.int64)
        ends = self.at + self.windows + length - 1
        self.content = mix(range_hashes(self.hashes, self.at, ends) + self.windows.astype(np.uint64)).view(np.int64)

    def letters(self, i: int, length: int) -> np.ndarray:
        """64-bit word codes of a context."""
        return self.hashes[self.at[i] : self.at[i] + self.windows[i] + length - 1]


class SuffixAutomaton:
    """Suffix automaton of several sequences, with the number of occurrences of each state's strings."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of state q for the strings that p reaches by c."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, letters: list[int], weight: int) -> None:
        state = 0
        for c in letters:
            state = self._extend(state, c)
            self.count[state] += weight

    def finish(self) -> None:
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def repeated(self, letters: list[int], length: int) -> int:
        """Streams a sequence; bit i is set if its ``length`` letters from i on occurred twice."""
        state = matched = mask = 0
        for i, c in enumerate(letters):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                matched += 1
            if matched >= length:
                while self.length[self.link[state]] >= length:
                    state = self.link[state]
                matched = min(matched, self.length[state])
                if self.count[state] >= 2:
                    mask |= 1 << (i - length + 1)
        return mask


def _row_columns(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("check", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def repeated_windows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, scratch: Scratch | None = None) -> DataFrame:
    """row, check, first, mask: bit i of mask says that the window at word first + i is repeated. Written."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = scratch or Scratch(spark)
    keyed = _row_columns(docs, doc_id, text)
    ship = lambda value: Shipped(spark.sparkContext.broadcast(value))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "text"):
            values, counts = np.unique(Contexts(texts_of(batch, "text"), length).anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], ["anchor", "n"])

    twice = scratch.write(keyed.select("text").mapInArrow(anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("anchor"))
    seen = ship(bitmap.build(twice, bitmap.cells_for(twice.count())))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "text"):
            c = Contexts(texts_of(batch, "text"), length)
            hit = np.flatnonzero(bitmap.holds(seen.value, c.anchor))
            at = pa.array(c.text[hit])
            yield pa.RecordBatch.from_arrays([column(batch, "row").take(at), column(batch, "check").take(at), *(pa.array(x[hit]) for x in (c.anchor, c.content, c.first, c.windows))], ["row", "check", "anchor", "content", "first", "windows"])

    found = scratch.write(keyed.mapInArrow(occurrences, "row long, check long, anchor long, content long, first long, windows long"))
    counted = scratch.write(found.groupBy("anchor", "content").agg(F.count("row").alias("n")))
    kinds = counted.groupBy("anchor").agg(F.count("content").alias("kinds"), F.sum("n").alias("places")).where(F.col("places") > 1).select("anchor", "kinds")
    shared = scratch.write(counted.join(kinds, "anchor"))
    wanted = ship(bitmap.build(shared.select("content"), bitmap.cells_for(shared.count())))

    def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in groups(batches, "text"):
            c = Contexts(texts_of(batch, "text"), length)
            hit = [i for i in np.flatnonzero(bitmap.holds(wanted.value, c.content)) if int(c.content[i]) not in sent]
            if len(sent) > 500_000:
                sent = set()
            sent.update(c.content[hit].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c.content[hit]), pa.array([c.letters(i, length).tobytes() for i in hit], pa.binary())], ["content", "letters"])

    spelled = keyed.select("text").mapInArrow(letters, "content long, letters binary").dropDuplicates(["content"])
    references = scratch.write(shared.join(spelled, "content"))
    masks = _shard_masks(references.where(F.col("kinds") <= HOT), length).unionByName(_hot_masks(references.where(F.col("kinds") > HOT), length))
    known = scratch.write(masks.where(F.col("mask") != 0))
    return scratch.write(found.join(known, ["anchor", "content"]).select("row", "check", "first", "mask"))


def _shard_masks(references: DataFrame, length: int) -> DataFrame:
    """anchor, content, mask from the automata of shards: whole anchors, gathered up to SHARD_WORDS words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, list[int]]] = []
        words = 0
        for g in sorted_groups(batches, ["anchor"]):
            held += zip(column(g, "anchor").to_pylist(), column(g, "content").to_pylist(), column(g, "n").to_pylist(), (np.frombuffer(x, np.uint64).tolist() for x in column(g, "letters").to_pylist()), strict=True)
            words += sum(len(x[3]) for x in held[-g.num_rows :])
            if words >= SHARD_WORDS:
                yield _matched(held, length)
                held, words = [], 0
        yield _matched(held, length)

    dealt = references.select("anchor", "content", "n", "letters").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "anchor long, content long, mask long")


def _matched(shard: list[tuple[int, int, int, list[int]]], length: int) -> pa.RecordBatch:
    automaton = SuffixAutomaton()
    for *_, n, letters in shard:
        automaton.add(letters, n)
    automaton.finish()
    masks = [automaton.repeated(letters, length) for *_, letters in shard]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in shard], pa.int64()), pa.array([x[1] for x in shard], pa.int64()), pa.array(masks, pa.int64())], ["anchor", "content", "mask"])


def _windows(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of each window of the contexts of a batch."""
    rows, places, windows = [], [], []
    for row, packed in enumerate(column(batch, "letters").to_pylist()):
        codes = np.frombuffer(packed, np.uint64)
        starts = np.arange(len(codes) - length + 1)
        windows.append(range_hashes(mix(codes + np.uint64(1)), starts, starts + length).view(np.int64))
        places.append(starts)
        rows.append(np.full(len(starts), row))
    return np.concatenate(rows), np.concatenate(places), np.concatenate(windows)


def _hot_masks(references: DataFrame, length: int) -> DataFrame:
    """anchor, content, mask of the contexts of hot anchors, from counts of their windows, summed where they are made."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, _, windows = _windows(batch, length)
                values, number = np.unique(windows, return_inverse=True)
                sums = np.zeros(len(values), np.int64)
                np.add.at(sums, number, np.asarray(column(batch, "n"))[rows])
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(sums)], ["window", "n"])

    some = references.select("anchor", "content", "n", "letters")
    twice = some.mapInArrow(count, "window long, n long").groupBy("window").agg(F.sum("n").alias("total")).where(F.col("total") > 1).select("window")
    written = Scratch(references.sparkSession).write(twice)
    seen = Shipped(references.sparkSession.sparkContext.broadcast(bitmap.build(written, bitmap.cells_for(written.count()))))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, places, windows = _windows(batch, length)
                hit = bitmap.holds(seen.value, windows)
                at = pa.array(rows[hit])
                yield pa.RecordBatch.from_arrays([column(batch, "anchor").take(at), column(batch, "content").take(at), pa.array(places[hit]), pa.array(windows[hit])], ["anchor", "content", "place", "window"])

    found = some.mapInArrow(find, "anchor long, content long, place long, window long").join(written, "window")
    return found.groupBy("anchor", "content").agg(F.bit_or(F.expr("shiftleft(1L, cast(place as int))")).alias("mask"))


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space), removed (spans of word numbers)."""
    found = repeated_windows(docs, doc_id=doc_id, text=text, length=length)
    # Sets: equal rows have equal marks, and each map task sends a mark once.
    marks = found.groupBy("row", "check").agg(F.collect_set(F.struct("first", "mask")).alias("marks"))
    rows = _row_columns(docs, doc_id, text).join(marks, ["row", "check"], "left").select("doc_id", "text", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "text"):
            n, gone, kept, spans = [], [], [], []
            for t, m in zip(texts_of(batch, "text"), texts_of(batch, "marks"), strict=True):
                words = (t or "").encode().split()  # splits at just the bytes that no word holds
                covered = covered_words(len(words), m or [], length)
                n.append(len(words))
                gone.append(int(covered.sum()))
                kept.append(b" ".join(words if not gone[-1] else [w for w, c in zip(words, covered.tolist(), strict=True) if not c]).decode())
                edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return rows.mapInArrow(cut, T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", span)]))


def covered_words(n: int, marks: list[dict], length: int) -> np.ndarray:
    """Which of n words a repeated window covers."""
    steps = np.zeros(n + 1, np.int64)
    for m in marks:
        first, mask = m["first"], m["mask"]
        while mask:
            low = mask & -mask
            i = first + low.bit_length() - 1
            steps[i] += 1
            steps[min(n, i + length)] -= 1
            mask ^= low
    return np.cumsum(steps[:n]) > 0
