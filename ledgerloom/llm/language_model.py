"""Scoring of documents by a gated recurrent language model trained on the corpus.

Words and their counts in the training documents are gathered from all of them: distinct words are counted in each task and summed by word.
The most frequent words (NETWORK_WORDS) have an output of their own in the network (``gated_network``); a word beyond them has the probability
of the network's class of all others, times its share in that class with one added to each count, so the model is a distribution
over the V + 1 outcomes of the base (all known words, and one for any unknown).

Training takes all words of all training documents, each once: texts are cut into pieces (PIECE words), dealt by hash to ROUNDS rounds, and those of a round to
shards of SHARD pieces. In each round every shard goes on from the shared parameters, by truncated backpropagation over windows of a piece, and the shards'
parameters are averaged by their words, summed in the tasks before the shuffle. The driver holds one set of parameters (2 MB).

A document is scored whole, the state carried across its windows to its end. Counts of the SHIPPED most frequent words travel to the documents; of the
others each document sends its distinct ones to meet the counts in a join, so no vocabulary is held whole anywhere.

Within a task words are told apart by 64-bit hashes of their bytes; across tasks by the bytes themselves (words over LONG bytes by their SHA-256).

Defined cases: a null or empty text is its end alone; a null id is hashed as an empty one; repeated rows are counted, and scored, row by row; a very
long text is scored whole; an empty table gives an empty result, and where no document is for training N and V are 0 and every word is unknown; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import LOWERED, Words, column, groups, mix, texts_of
from .decontaminate import Shipped
from .gated_network import BUCKETS, RATE, Learner, Network, text_scores
from .pairing import sorted_groups
from .store import Scratch, prepare

#: Remainders of crc32 of the id: documents with this one are held out.
FOLDS, HELD_OUT = 7, 2
#: Frequent words with an output of their own, and those whose counts are broadcast (some 3 MB).
NETWORK_WORDS, SHIPPED = 4095, 131_072
#: Bytes beyond which a word's key is a digest, which no word's UTF-8 equals as its first byte is none.
LONG, DIGEST = 64, b"\xff"
#: Words of a piece; pieces of a shard; rounds that the pieces are dealt to; chunks that parameters are averaged in.
PIECE, SHARD, ROUNDS, CHUNKS = 256, 8192, 3, 32
#: Bytes of text that are scored side by side.
SCORE_BYTES = 4 << 20


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order of their first places, each place's number among them, and the first places."""
    coded = pa.array(hashes, pa.uint64()).dictionary_encode()
    of = coded.indices.to_numpy().astype(np.int64)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(of), prepend=-1))
    return coded.dictionary.to_numpy(), of, first


class Distinct:
    """The distinct words of a group of texts, or of those at some places: hash and number of each, and for each word in order ``of``, its distinct word."""

    def __init__(self, words: Words, at: np.ndarray | None = None, hashes: np.ndarray | None = None):
        hashes, starts, ends = words.hashes() if hashes is None else hashes, words.starts, words.ends
        if at is not None:
            hashes, starts, ends = hashes[at], starts[at], ends[at]
        self.hashes, self.of, first = numbered(hashes)
        self.counts = np.bincount(self.of, minlength=len(first))
        self.buffer, self.starts, self.ends = words.bytes, starts[first], ends[first]
        self.long = np.flatnonzero(self.ends - self.starts > LONG)

    def keys(self, at: np.ndarray) -> list[bytes]:
        own = [self.buffer[s:e] for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]
        return [DIGEST + hashlib.sha256(w).digest() if len(w) > LONG else w for w in own]


def word_counts(texts: DataFrame) -> DataFrame:
    """key, c of the words of the texts (text), their ends not included."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "text"):
            d = Distinct(Words(texts_of(batch, "text"), LOWERED))
            yield pa.RecordBatch.from_arrays([pa.array(d.keys(np.arange(len(d.hashes))), pa.binary()), pa.array(d.counts, pa.int64())], ["key", "c"])

    return texts.mapInArrow(tally, "key binary, c long").groupBy("key").agg(F.sum("c").alias("c"))


class Lexicon:
    """Counts of the most frequent words, by hash, in order of rank; ``n`` training tokens and ``v`` distinct ones, ends included; ``rest`` and
    ``rest_words``: tokens and distinct words beyond the network's."""

    def __init__(self, top: list[tuple[bytes, int]], texts: int, tokens: int, words: int, network_words: int):
        short = [(k, c, r) for r, (k, c) in enumerate(top) if k[:1] != DIGEST]
        spelt = Words([b"\n".join(k for k, *_ in short).decode()], LOWERED)
        hashes = spelt.hashes()
        assert len(hashes) == len(short)
        order = np.argsort(hashes)
        self.hashes, self.ranks = hashes[order], np.array([r for *_, r in short], np.int64)[order]
        self.long = {k: r for r, (k, _) in enumerate(top) if k[:1] == DIGEST}
        self.counts = np.array([c for _, c in top], np.int64)
        self.texts, self.n, self.v = texts, tokens + texts, words + (texts > 0)
        self.own = min(network_words, len(top))
        self.rest, self.rest_words = tokens - int(self.counts[: self.own].sum()), words - self.own

    def ranked(self, words: Words, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, Distinct]:
        """Of the words at some places, or all: rank (-1 where the count is not here), the network's number, and the places
        without a rank among them with their distinct words."""
        every = words.hashes()
        hashes, of, _ = numbered(every if places is None else every[places])
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        rank = (np.where(self.hashes[at] == hashes, self.ranks[at], -1) if len(self.hashes) else np.full(len(hashes), -1))[of]
        apart = np.flatnonzero(rank < 0)
        d = Distinct(words, apart if places is None else places[apart], every)
        if len(d.long):
            found = np.full(len(d.hashes), -1)
            found[d.long] = [self.long.get(k, -1) for k in d.keys(d.long)]
            rank[apart] = found[d.of]
        numbers = np.where((rank >= 0) & (rank < self.own), rank + 1, self.own + 1 + (hashes % np.uint64(BUCKETS)).astype(np.int64)[of])
        return rank, numbers, apart, d


def with_ends(numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all texts, each with its end (0), and the limits of the texts."""
    limits = bounds + np.arange(len(bounds))
    out = np.zeros(int(limits[-1]), np.int64)
    out[np.arange(len(numbers)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = numbers
    return out, limits


def lexicon(docs: DataFrame, counts: DataFrame, network_words: int, shipped: int) -> Lexicon:
    """docs: training texts; counts: their words'."""
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("key").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "key").limit(shipped).toArrow()
    pairs = list(zip(top.column("key").to_pylist(), top.column("c").to_pylist(), strict=True))
    return Lexicon(pairs, docs.count(), totals.n, totals.v, network_words)


def pieces(docs: DataFrame, lexicon: Shipped, piece: int) -> DataFrame:
    """seed, ids of all pieces of the texts: the input before the piece (-1 at a text's start), then its words' numbers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        for batch in groups(batches, "text"):
            words = Words(texts_of(batch, "text"), LOWERED)
            _, numbers, *_ = lex.ranked(words)
            numbers, seeds, found = numbers.astype(np.int32), [], []
            for doc, low, high in zip(texts_of(batch, "id"), words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
                own = mix(np.arange((high - low) // piece + 1, dtype=np.uint64) + (np.uint64(zlib.crc32((doc or "").encode())) << np.uint64(32)))
                seeds += (own >> np.uint64(1)).tolist()
                text = np.concatenate(([-1], numbers[low:high], [0])).astype(np.int32)  # the end counts as one more word
                found += [text[at : at + piece + 1] for at in range(0, high - low + 1, piece)]
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["seed", "ids"])

    return docs.mapInArrow(cut, "seed long, ids array<int>")


def train(found: DataFrame, net: Network, rounds: int, shard: int, rate: float = RATE) -> Network:
    """The network after training over all pieces (seed, ids), each in one of the rounds."""
    n = found.count()
    if not n:
        return net
    spark = found.sparkSession
    shards = -(-n // (shard * max(rounds, 1)))
    dealt = found.withColumns({"round": F.pmod(F.col("seed"), F.lit(max(rounds, 1))), "shard": F.pmod(F.xxhash64("seed"), F.lit(shards))})
    for r in range(rounds):
        begun = Shipped(spark.sparkContext.broadcast(net))

        def learn(batches: Iterator[pa.RecordBatch], begun=begun, rate=rate / 2**r) -> Iterator[pa.RecordBatch]:
            total, weight = None, 0
            for g in sorted_groups(batches, ["shard"]):
                shared = begun.value
                own = Network(shared.words, shared.state).unpack(shared.packed())
                ids = column(g, "ids")
                flat, at = np.asarray(ids.flatten()).astype(np.int64), np.concatenate(([0], np.cumsum(np.asarray(ids.value_lengths()))))
                flat = np.where(flat < 0, own.start, flat)
                _, words = Learner(own, rate).learn([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
                part = own.packed().astype(np.float64) * words
                total, weight = (part if total is None else total + part), weight + words
            if weight:
                yield _chunked(total, weight)

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                for k, values, weight in zip(*(column(batch, c).to_pylist() for c in ("chunk", "total", "weight")), strict=True):
                    sums = held.setdefault(k, [0.0, 0])
                    sums[0], sums[1] = sums[0] + np.frombuffer(values), sums[1] + weight
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([s.tobytes() for s, _ in held.values()], pa.binary()), pa.array([w for _, w in held.values()], pa.int64())], ["chunk", "total", "weight"])

        schema = "chunk int, total binary, weight long"
        sums = dealt.where(F.col("round") == r).select("seed", "ids", "shard").repartition("shard").sortWithinPartitions("shard", "seed", "ids").mapInArrow(learn, schema)
        met = sorted(sums.repartition("chunk").mapInArrow(merge, schema).collect(), key=lambda x: x.chunk)  # CHUNKS rows, one set of parameters
        if met:  # a round of a few pieces may have none
            net = Network(net.words, net.state).unpack(np.concatenate([np.frombuffer(x.total) / x.weight for x in met]))
        begun.broadcast.unpersist()
    return net


def _chunked(total: np.ndarray, weight: int) -> pa.RecordBatch:
    parts = np.array_split(total, CHUNKS)
    return pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([weight] * CHUNKS, pa.int64())], ["chunk", "total", "weight"])


def score(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", network_words: int = NETWORK_WORDS, shipped: int = SHIPPED, piece: int = PIECE, shard: int = SHARD, rounds: int = ROUNDS, score_bytes: int = SCORE_BYTES
) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text by counts and by the model)."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    learnt = own.where(~held_out(F.col("doc_id"))).select("id", "text")
    counts = scratch.write(word_counts(learnt.select("text")))
    lex = lexicon(learnt, counts, network_words, shipped)
    words = Shipped(spark.sparkContext.broadcast(lex))
    net = Network.begun(np.concatenate(([lex.texts], lex.counts[: lex.own])), lex.rest)
    net = train(scratch.write(pieces(learnt, words, piece)), net, rounds, shard)
    model = Shipped(spark.sparkContext.broadcast(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, net = words.value, model.value
        logs = np.log10(lex.counts + 1.0)
        end = math.log10(lex.texts + 1)
        for batch in groups(_gathered(batches, score_bytes), "text", score_bytes):
            spelt = Words(texts_of(batch, "text"), LOWERED)
            rank, numbers, apart, d = lex.ranked(spelt)
            ids, limits = with_ends(numbers, spelt.bounds)
            n = batch.num_rows
            by_net = text_scores(net, ids, limits) / math.log(10)
            of = np.repeat(np.arange(n), np.diff(spelt.bounds))
            known, log = rank >= 0, np.where(rank >= 0, logs[np.maximum(rank, 0)], 0.0) if len(logs) else np.zeros(len(rank))
            beyond = (rank < 0) | (rank >= lex.own)
            # Distinct words of each text whose counts are elsewhere.
            far_of, word_of = (x[rank[apart] < 0] for x in (of[apart], d.of))
            pairs, times = np.unique(far_of * np.int64(len(d.hashes)) + word_of, return_counts=True)
            text_of, word = np.divmod(pairs, max(len(d.hashes), 1))
            far = pa.StructArray.from_arrays([pa.array(d.keys(word), pa.binary()), pa.array(times, pa.int64())], ["key", "n"])
            far = pa.ListArray.from_arrays(pa.array(np.searchsorted(text_of, np.arange(n + 1)).astype(np.int32)), far)
            sums = lambda x, of=of, n=n: np.bincount(of, x, n)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "row"), column(batch, "doc_id"), pa.array(np.diff(limits)), pa.array((sums(known) + (lex.texts > 0)).astype(np.int64)), pa.array(sums(log) + end), pa.array(by_net + sums(np.where(beyond, log, 0.0))), pa.array(sums(beyond).astype(np.int64)), far],
                ["row", "doc_id", "n_tokens", "known", "base", "model", "beyond", "far"],
            )

    schema = T.StructType([T.StructField("row", T.LongType()), own.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_tokens", "known")), *(T.StructField(c, T.DoubleType()) for c in ("base", "model")), T.StructField("beyond", T.LongType())])
    schema = schema.add("far", T.ArrayType(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType())])))
    scored = scratch.write(own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema))
    met = scored.select("row", F.inline("far")).join(counts, "key", "left").groupBy("row")
    met = met.agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("far_known"), F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("far_log"))
    joined = scored.drop("far").join(met, "row", "left")
    far_log = F.coalesce("far_log", F.lit(0.0))
    base = F.col("base") + far_log - F.col("n_tokens") * math.log10(lex.n + lex.v + 1)
    whole = F.col("model") + far_log - F.col("beyond") * math.log10(lex.rest + lex.rest_words + 1)
    return joined.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"), F.lit(lex.n).cast("long").alias("train_tokens"), base.alias("base_score"), whole.alias("score")
    )


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``limit`` bytes, so that long texts run beside others."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
