"""N-gram Jaccard join with Bayesian candidate pruning.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; shingles are five consecutive words (all
words, where there are fewer), and texts are linked if the Jaccard similarity of their shingle sets is 0.8 or more.

1. Texts with equal shingle sets form a class, counted with partial aggregation; one member stands for it.
2. Classes meet in MinHash bands (32 of 4 values: a pair at 0.8 is missed with probability 5e-8).
3. In a bucket MinHash values are compared 16 by 16; a pair is dropped as soon as the posterior probability of reaching the
   threshold, with a uniform prior, falls below the tolerance (1e-6).
4. What is left is verified exactly on whole shingle sets, block against block, inside the candidates' components.

Defined cases: a null text, or one without words, links with nothing and is a class of its own; repeated rows are copies (each
counts the others as links); rows with a null doc_id are linked and dropped like others, but name a class only (by null) where it has
no id; rows that share a doc_id but not a text are told apart by their content; an empty table gives
an empty result; a very long text is shingled whole, alone in its worker; other columns are not read by ``near_duplicates`` and pass
through ``keep_one`` untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pairing
from .bytescan import ALNUM, Words, column, gram_starts, grams, groups, mix, texts_of
from .store import Scratch, fresh, prepare

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, STEP = 32, 4, 16
HASHES = BANDS * ROWS
#: Members of one block of a bucket, and of a component.
BUCKET_BLOCK, COMPONENT_BLOCK = 2048, 512
#: Ids of dropped documents that may be broadcast to the texts.
MAX_BROADCAST_IDS = 1 << 20

_random = np.random.default_rng(5_1337)
_FACTORS = _random.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _random.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; none for a text without words."""
    words = Words(texts, ALNUM)
    hashes = words.hashes()
    starts = gram_starts(words.bounds, k)
    made = grams(hashes, starts, k)
    cuts = np.searchsorted(starts, words.bounds)
    out = []
    for a, b, c, d in zip(words.bounds[:-1], words.bounds[1:], cuts[:-1], cuts[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(made[c:d]))
        elif b > a:
            out.append(grams(hashes, np.array([a]), int(b - a)))
        else:
            out.append(made[:0])
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        least = np.minimum(least, (low[at : at + 512, None] * _FACTORS + _SHIFTS).min(axis=0))
    return least


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for c in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, c])
    return key


def fewest_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared values: the fewest matches with P(similarity >= threshold) >= tolerance.

    The posterior under a uniform prior is Beta(m + 1, n - m + 1), whose upper tail is P(Binomial(n + 1, threshold) <= m).
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def pruner(threshold: float, tolerance: float) -> pairing.Similar:
    floors = fewest_matches(threshold, tolerance)

    def similar(signatures: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
        matches = np.zeros(len(others), np.int64)
        for n, floor in floors.items():
            part = slice(n - STEP, n)
            matches += (signatures[others, part] == signatures[i, part]).sum(axis=1)
            keep = matches >= floor
            others, matches = others[keep], matches[keep]
            if not len(others):
                break
        return others

    return similar


def verifier(threshold: float) -> pairing.Linked:
    scale = 1000
    share = round(threshold * scale)

    def linked(payloads: list[bytes]) -> np.ndarray:
        sets = [np.frombuffer(p, np.uint64) for p in payloads]
        n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
        values, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(counts > 1) - 1  # shingles of one text alone are in no intersection
        keep = counts[number] > 1
        row, col = np.repeat(np.arange(n), sizes)[keep], shared[number[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        common = np.zeros((n, n), np.float64)
        width = 4096
        for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            a, b = np.searchsorted(col, (at, at + width))
            dense = np.zeros((n, width), np.float32)
            dense[row[a:b], col[a:b] - at] = 1
            common += dense @ dense.T
        union = sizes[:, None] + sizes[None, :] - common
        return (common * scale >= share * union) & (common > 0)

    return linked


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE, scratch: Scratch | None = None) -> DataFrame:
    """Per document: doc_id, class_id (smallest doc_id reachable by links), n_links (other documents linked directly).

    A document without words has class_id = doc_id and no links.
    """
    return _judged(docs, doc_id, text, threshold, tolerance, scratch or Scratch(docs.sparkSession))[0]


def _node(s: np.ndarray) -> int | None:
    """The class of a text, by its shingles."""
    return int(mix(np.array([mix(s).sum() ^ np.uint64(len(s))]))[0].view(np.int64)) if len(s) else None


def _with_nodes(texts: DataFrame) -> DataFrame:
    """text, node of rows of one column, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "text"):
            yield pa.RecordBatch.from_arrays([column(batch, "text"), pa.array([_node(s) for s in shingle_sets(texts_of(batch, "text"))], pa.int64())], ["text", "node"])

    return texts.mapInArrow(run, "text string, node long")


def _judged(docs: DataFrame, doc_id: str, text: str, threshold: float, tolerance: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """near_duplicates' rows; per class of equal shingle sets node, class_id, n_links and head (the smallest node it reaches)."""
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "text"):
            nodes, signatures, keys = [], [], []
            for s in shingle_sets(texts_of(batch, "text")):
                least = minhash(s)
                nodes.append(_node(s))
                signatures.append(least.astype(np.uint16).tobytes())
                keys.append(band_keys(least).view(np.int64))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "payload", "bands"])

    kind = own.schema["doc_id"].dataType
    signed = scratch.write(own.mapInArrow(sign, T.StructType([T.StructField("doc_id", kind), T.StructField("node", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])))
    worded = signed.where(F.col("node").isNotNull())
    classes = scratch.write(worded.groupBy("node").agg(F.count("node").alias("weight"), F.min("doc_id").alias("first")))
    first = classes.select("node", F.col("first").alias("doc_id"))
    nameless = first.where(F.col("doc_id").isNull()).select("node")
    headed = worded.join(first, ["node", "doc_id"], "left_semi").unionByName(worded.where(F.col("doc_id").isNull()).join(nameless, "node", "left_semi"))
    heads = scratch.write(headed.dropDuplicates(["node"]))
    rows = pairing.met_members(heads.select("node", F.explode("bands").alias("bucket")), heads.select("node", "payload"))
    edges = pairing.bucket_edges(rows, pruner(threshold, tolerance), "uint16", BUCKET_BLOCK)

    def with_shingles(members: DataFrame) -> DataFrame:
        texts = own.join(members.join(first, "node"), "doc_id").select("node", "component", "size", "weight", "text")
        unnamed = _with_nodes(own.where(F.col("doc_id").isNull()).select("text")).dropDuplicates(["node"])
        texts = texts.unionByName(unnamed.join(members.join(nameless, "node", "left_semi"), "node").select("node", "component", "size", "weight", "text"))

        def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in groups(batches, "text"):
                sets = shingle_sets(texts_of(batch, "text"))
                right = [len(s) and _node(s) == node for s, node in zip(sets, texts_of(batch, "node"), strict=True)]
                made = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "component", "size", "weight", "payload"])
                yield made.filter(pa.array([bool(x) for x in right], pa.bool_()))

        return texts.mapInArrow(shingle, "node long, component long, size long, weight long, payload binary").dropDuplicates(["node"]) if _ids_repeat(own) else texts.mapInArrow(shingle, "node long, component long, size long, weight long, payload binary")

    links, parts = pairing.linked_nodes(classes, edges, with_shingles, verifier(threshold), COMPONENT_BLOCK, scratch)
    known = classes.join(links, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = known.groupBy("component").agg(F.min("first").alias("class_id"), F.min("node").alias("head"))
    per_class = scratch.write(known.join(smallest, "component").select("node", "class_id", "head", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    joined = pairing.spread_join(signed.select("doc_id", "node"), per_class.drop("head"), "node", F.col("doc_id"))
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), per_class


def _ids_repeat(own: DataFrame) -> bool:
    """Whether some id stands for more than one row; decides if texts fetched by id need to be told apart."""
    return not own.groupBy("doc_id").count().where("count > 1").isEmpty()


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns: the one of smallest doc_id of each class, and all documents without words.

    Rows equal in id and text are one document and stay once, with words or without. Of a class without any id the row of smallest node
    and text stays. An id stays, with all its other texts, while any of its texts does.
    """
    scratch = Scratch(docs.sparkSession)
    found, per_class = _judged(docs, doc_id, text, threshold, TOLERANCE, scratch)
    gone = found.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("class_id")).alias("gone"))
    name, copy = fresh(docs.columns, "lost_id"), fresh(docs.columns, "copied_text")
    lost = scratch.write(gone.where("gone").select(F.col("doc_id").alias(name)))
    # Few enough ids travel to the texts; else the texts are shuffled to meet them.
    few = lost.count() <= MAX_BROADCAST_IDS
    rows = docs.join(F.broadcast(lost) if few else lost, docs[doc_id] == F.col(name), "left_anti")
    rows = rows.dropDuplicates([doc_id, text]) if _ids_repeat(docs.select(F.col(doc_id).alias("doc_id"))) else rows
    if docs.where(F.col(doc_id).isNull()).isEmpty():
        return rows
    unnamed = _with_nodes(docs.where(F.col(doc_id).isNull()).select(F.col(text).alias("text")).distinct()).where(F.col("node").isNotNull())
    stays = unnamed.join(per_class.where(F.col("class_id").isNull() & (F.col("node") == F.col("head"))), "node").groupBy("node").agg(F.min("text").alias("stays"))
    copies = unnamed.join(stays, unnamed["text"] == F.col("stays"), "left_anti").select(F.col("text").alias(copy))
    left = rows.where(F.col(doc_id).isNull()).join(scratch.write(copies), F.col(text) == F.col(copy), "left_anti")
    return rows.where(F.col(doc_id).isNotNull()).unionByName(left)
