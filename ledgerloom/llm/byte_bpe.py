"""Byte-level BPE encoding and decoding by corpus-level merge replay.

1. The distinct words of all texts that are more than one token are counted, with partial aggregation.
2. The most frequent of them, MAX_SHIPPED at most (all, where they are no more), are dealt over tasks and laid side by side as
   bytes. An inverted index leads from a merge's rank to the positions of its token pair; ranks are replayed in order, each at all its
   positions in all words at once, and only the neighbours of a merged position are looked at again. A word's merges depend on
   that word alone, so an index over a task's share of the words merges as one over the whole corpus would.
3. Their ids travel to the texts, which are put together from their words' ids. Rarer words, and words longer than LONG bytes, go
   through an index of the same kind over the slice where they are met: their ids are as many as the words of the corpus and
   would not fit a broadcast, and a shuffle of words would cost more than replaying them.

Words are told apart by 64-bit hashes within one slice of about 1 MB and by their bytes beyond it.

Defined cases: a null text counts as empty (no ids, no bytes); no special tokens; a very long text is a slice of its own and encoded whole;
rows are independent, so repeated rows, null ids, empty tables and other columns change nothing; invalid ids raise an error when decoded.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import column, groups, texts_of
from .decontaminate import Shipped
from .pretokens import Pretokens
from .store import Scratch, fresh, prepare

#: Ids of distinct words that a worker keeps; beyond it starts anew.
MAX_IDS = 1_500_000
#: Words that may travel to the texts, most bytes of a word of the table, words of one index, and words a task counts before it passes them on.
MAX_SHIPPED, LONG, INDEXED, HELD = 1 << 18, 64, 20_000, 100_000


class Ranks:
    """Ranks of a tiktoken file, and the rank that each pair of tokens merges to."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = rank
        size = max(self.ranks.values()) + 1
        by_rank = [b""] * size
        for token, rank in self.ranks.items():
            by_rank[rank] = token
        self.lengths = np.array([len(t) for t in by_rank], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.pool = np.frombuffer(b"".join(by_rank), np.uint8)
        self.byte_rank = np.array([self.ranks[bytes((b,))] for b in range(256)], np.int64)
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def indexed(self, token: np.ndarray) -> dict[int, list[int]]:
        """From a rank to the positions whose pair of neighbours merges to it, in order; negative tokens are borders."""
        at = np.flatnonzero((token[:-1] >= 0) & (token[1:] >= 0))
        keys = token[at] << 20 | token[at + 1]
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = self.pair_keys[found] == keys
        at, ranks = at[hit], self.pair_ranks[found[hit]]
        if not len(at):
            return {}
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        firsts = np.flatnonzero(np.diff(ranks, prepend=-1))
        listed, ends = at.tolist(), np.append(firsts[1:], len(at)).tolist()
        return {r: listed[a:b] for r, a, b in zip(ranks[firsts].tolist(), firsts.tolist(), ends, strict=True)}


def replay(words: list[bytes], table: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and the number of ids of each."""
    pairs, sizes = table.pairs, np.array([len(w) for w in words], np.int64)
    begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    laid = np.full(1 + int((sizes + 1).sum()), -1, np.int64)  # a border before each word, and one at the end
    laid[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(words)), sizes) + 1] = table.byte_rank[np.frombuffer(b"".join(words), np.uint8)]
    index, token, n = table.indexed(laid), laid.tolist(), len(laid)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = list(index)
    heapq.heapify(heap)
    merged, redo = pairs.get, set()

    def seen(new: int, at: int) -> None:
        """A pair that a merge has made: its position goes to its rank's list."""
        if new < rank:  # it should have come before this rank's later positions
            redo.add(at)
        if new in index:
            index[new].append(at)
        else:
            index[new] = [at]
            heapq.heappush(heap, new)

    while heap:
        rank = heapq.heappop(heap)
        high = rank << 20
        for p in sorted(index.pop(rank)):
            a, q = token[p], after[p]
            if a < 0 or q >= n:
                continue
            b = token[q]
            if b < 0 or merged(a << 20 | b) != rank:
                continue
            token[p], token[q] = rank, -2
            r = after[p] = after[q]
            before[r] = p
            left, c = before[p], token[r]
            if (a := token[left]) >= 0 and (new := merged(a << 20 | rank)) is not None:
                seen(new, left)
            if c >= 0 and (new := merged(high | c)) is not None:
                seen(new, p)
    kept = np.array(token, np.int64)
    if redo:
        for k in {int(np.searchsorted(begins, at, side="right")) - 1 for at in redo}:
            ids = _one_by_one([int(table.byte_rank[b]) for b in words[k]], pairs)
            kept[begins[k] : begins[k] + sizes[k]] = ids + [-2] * (int(sizes[k]) - len(ids))
    live = kept >= 0
    return kept[live].astype(np.uint32), np.add.reduceat(np.append(live, False).astype(np.int64), begins) if len(words) else np.zeros(0, np.int64)


def _one_by_one(parts: list[int], pairs: dict[int, int]) -> list[int]:
    """A single word, always the lowest and then leftmost rank: for words whose merges do not come in rank order."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, p) for p in range(n - 1) if (rank := pairs.get(parts[p] << 20 | parts[p + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, p = heapq.heappop(heap)
        q = after[p]
        if parts[p] < 0 or q >= n or pairs.get(parts[p] << 20 | parts[q]) != rank:
            continue  # one of the two has merged meanwhile
        parts[p], parts[q] = rank, -1
        r = after[p] = after[q]
        if r < n:
            before[r] = p
        for left, right in ((before[p], p), (p, r)):
            if left >= 0 and right < n:
                new = pairs.get(parts[left] << 20 | parts[right])
                if new is not None:
                    heapq.heappush(heap, (new, left))
    return [t for t in parts if t >= 0]


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """pool[start : start + length] for each pair, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    return pool[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]


class Codec:
    """Encodes texts; given: words whose ids are known beforehand, as (bytes, their lengths, ids, their numbers)."""

    def __init__(self, path: str, given: tuple[bytes, np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.table, self.given = Ranks(path), given
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, np.uint32), 0
        if self.given:
            pool, sizes, ids, numbers = self.given
            ends = np.cumsum(sizes)
            self._store([pool[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], ids, numbers)

    def _store(self, words: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> None:
        at = len(self.known)
        for name, need in (("starts", at + len(words)), ("lengths", at + len(words)), ("ids", self.used + len(flat))):
            had = getattr(self, name)
            if need > len(had):
                setattr(self, name, np.concatenate((had, np.zeros(max(need - len(had), len(had)), had.dtype))))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[at : at + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[at : at + len(words)] = lengths
        self.used += len(flat)
        self.known.update(zip(words, range(at, at + len(words)), strict=True))

    def _learn(self, words: list[bytes]) -> None:
        whole = [self.table.ranks.get(w, -1) for w in words]
        easy = [(w, r) for w, r in zip(words, whole, strict=True) if r >= 0]
        self._store([w for w, _ in easy], np.array([r for _, r in easy], np.uint32), np.ones(len(easy), np.int64))
        hard = [w for w, r in zip(words, whole, strict=True) if r < 0]
        self._store(hard, *replay(hard, self.table))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words = Pretokens(texts)
        _, first, numbers = words.distinct()
        if self.used > MAX_IDS + (len(self.given[2]) if self.given else 0):
            self._forget()
        listed = words.words(first)
        new = [w for w in listed if w not in self.known]
        if new:
            self._learn(new)
        slots = np.array([self.known[w] for w in listed], np.int64)[numbers]
        lengths = self.lengths[slots]
        ids = _gather(self.ids, self.starts[slots], lengths).astype("<u4")
        cuts = np.concatenate(([0], np.cumsum(lengths)))[words.bounds]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def hard_words(self, texts: list[str]) -> dict[bytes, int]:
        """Count of each word of the texts that is more than one token, and no longer than LONG."""
        words = Pretokens(texts)
        _, first, numbers = words.distinct()
        listed, counts, ranks = words.words(first), np.bincount(numbers, minlength=len(first)).tolist(), self.table.ranks
        return {w: n for w, n in zip(listed, counts, strict=True) if len(w) <= LONG and w not in ranks}

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return _gather(self.table.pool, self.table.offsets[ids], self.table.lengths[ids]).tobytes()

    def decoded(self, ids: np.ndarray) -> bytes | None:
        """None where an id is no token's."""
        lengths = self.table.lengths
        return self.decode(ids) if not len(ids) or (int(ids.max()) < len(lengths) and lengths[ids.astype(np.int64)].all()) else None


_codecs: dict[str, tuple[int | None, Codec]] = {}


def codec(path: str, shipped: Shipped | None = None) -> Codec:
    """One codec per worker process, tokenizer and broadcast table of words."""
    wanted = shipped.id if shipped else None
    held = _codecs.get(path)
    if held is None or (shipped and held[0] != wanted):
        held = _codecs[path] = wanted, Codec(path, shipped.value if shipped else None)
    return held[1]


def corpus_words(texts: DataFrame, ranks: str) -> DataFrame:
    """word, n of the distinct words of all texts (one column, text) that are more than one token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in groups(batches, "text"):
            for word, n in codec(ranks).hard_words([t or "" for t in texts_of(batch, "text")]).items():
                seen[word] = seen.get(word, 0) + n
            if len(seen) > HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                seen = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def replayed(words: DataFrame, ranks: str) -> DataFrame:
    """word, n and ids (packed) of distinct words, by one index over up to INDEXED words at a time."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        flat, sizes = replay(column(batch, "word").to_pylist(), codec(ranks).table)
        packed, ends = flat.astype("<u4").tobytes(), np.cumsum(sizes * 4)
        ids = [packed[a:b] for a, b in zip((ends - sizes * 4).tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([column(batch, "word"), column(batch, "n"), pa.array(ids, pa.binary())], ["word", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= INDEXED:
                yield flush(held)
                held, rows = [], 0
        if held:
            yield flush(held)

    return words.mapInArrow(run, "word binary, n long, ids binary")


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words (word, n) from a frequency on that ``most`` words at most reach; no sort, whatever their number."""
    steps = F.floor(F.log2("n") * 8)
    found = words.groupBy(steps.alias("step")).count().orderBy(F.desc("step")).collect()  # some 8 rows for each power of two
    total, least = 0, None
    for r in found:
        total += r["count"]
        if total > most:
            break
        least = r.step
    return words.where(steps >= least) if least is not None else words.limit(0)


def shipped_words(texts: DataFrame, ranks: str, most: int = MAX_SHIPPED) -> Shipped:
    """The corpus's most frequent words with their ids as a broadcast."""
    spark = texts.sparkSession
    counted = Scratch(spark).write(corpus_words(texts, ranks))
    found = replayed(frequent(counted, most), ranks).select("word", "ids").toArrow()  # at most ``most`` words of LONG bytes
    words, ids = found.column("word").to_pylist(), found.column("ids").to_pylist()
    value = b"".join(words), np.array([len(w) for w in words], np.int64), np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
    return Shipped(spark.sparkContext.broadcast(value))


def round_trip(docs: DataFrame, ranks: str, *, doc_id: str = "doc_id", text: str = "text", most: int = MAX_SHIPPED) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (packed little-endian unsigned 32-bit) and decoded (the ids' bytes)."""
    prepare(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shipped = shipped_words(own.select("text"), ranks, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "text"):
            own_codec = codec(ranks, shipped)
            ids = own_codec.encode([t or "" for t in texts_of(batch, "text")])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([own_codec.decode(x) for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return own.mapInArrow(run, T.StructType([T.StructField("doc_id", own.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())]))


def encode(docs: DataFrame, ranks: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids."""
    return round_trip(docs, ranks, doc_id=doc_id, text=text).select("doc_id", "n_tokens", "ids")


def decode(encoded: DataFrame, ranks: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the bytes of their packed ids added as ``out`` (underscores added until the name is free). Null ids, ids that the
    vocabulary does not have and bytes that are no whole ids give null."""
    out = fresh(encoded.columns, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if x is None or len(x) % 4 else codec(ranks).decoded(np.frombuffer(x, "<u4")) for x in texts_of(batch, ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, out])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())]))
