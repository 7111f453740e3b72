"""Line deduplication with two Bloom filters, one of hashes seen once and one of hashes seen twice.

1. Each task hashes the keys of its documents' lines (a key counts once a document) into a filter of hashes seen and,
   where all bits were set before, into a filter of hashes seen twice. Filters of several tasks merge segment by segment:
   a bit set in two "once" filters is set in "twice", so no repeat is ever missed.
2. Only lines whose hash the "twice" filter knows are shuffled, as 128-bit digests, to count their documents exactly and
   to choose the document that keeps the line. Filters that fill up let more lines through, never fewer.
3. The digests to drop are broadcast if a count shows that they fit, else joined.

The filters' size follows the input up to a fixed bound, and so does what the driver broadcasts.

Key of a line: stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Defined cases: a null or empty text is one
empty line; rows that share a doc_id count as one document; a row with a null doc_id is no document (it does not count, and it
loses lines that other documents repeat); of ties (the largest doc_id in several rows) all rows keep the line; a very long text is split
whole, alone in its worker; an empty table gives an empty result; other columns are not read by
``dedup_lines`` and pass through ``with_kept_lines`` whatever their names, which for its own three have to be free.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import column, groups, texts_of
from .decontaminate import Shipped
from .store import Scratch, fresh, prepare

#: Bounds of a filter in 64-bit cells: 128 KB to 32 MB.
MIN_CELLS, MAX_CELLS = 1 << 14, 1 << 22
#: Cells are merged in segments of 32 KB.
SEGMENT = 1 << 12
#: Digests to drop that may be broadcast (about 180 bytes each in a worker).
MAX_BROADCAST_KEYS = 1 << 18
#: Bytes of text that are split into lines, and handed back, at once.
STRIP_BYTES = 2 << 20
_STRIP = b" \t\n\x0b\x0c\r"


def keys_of(lines: list[bytes], min_chars: int) -> Iterator[tuple[int, bytes]]:
    """Line number and key of each line whose key is long enough. bytes.lower touches A-Z only."""
    for i, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(_STRIP).lower()
            if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars:
                yield i, key


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def _hashes(texts: list[str | None], min_chars: int) -> np.ndarray:
    out: list[int] = []
    for t in texts:
        out += {xxhash.xxh3_64_intdigest(k) for _, k in keys_of(_lines(t), min_chars)}
    return np.array(out, np.uint64)


def _places(h: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each hash and its three bits there."""
    one = np.uint64(1)
    bits = one << (h & np.uint64(63)) | one << (h >> np.uint64(6) & np.uint64(63)) | one << (h >> np.uint64(12) & np.uint64(63))
    return (h >> np.uint64(20) & np.uint64(cells - 1)).astype(np.int64), bits


class Pair:
    """The filters of hashes seen once and twice."""

    def __init__(self, cells: int):
        self.cells, self.once, self.twice = cells, np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)

    def add(self, hashes: np.ndarray) -> None:
        values, counts = np.unique(hashes, return_counts=True)
        cell, bits = _places(values, self.cells)
        again = (self.once[cell] & bits == bits) | (counts > 1)
        np.bitwise_or.at(self.twice, cell[again], bits[again])
        np.bitwise_or.at(self.once, cell, bits)

    def segments(self) -> Iterator[tuple[int, bytes, bytes]]:
        for k in range(-(-self.cells // SEGMENT)):
            part = slice(k * SEGMENT, (k + 1) * SEGMENT)
            if self.once[part].any():
                yield k, zlib.compress(self.once[part].tobytes(), 1), zlib.compress(self.twice[part].tobytes(), 1)


def twice_filter(docs: DataFrame, text: str, min_chars: int, cells: int) -> np.ndarray:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(cells)
        for batch in groups(batches, text, 4 << 20):
            pair.add(_hashes(texts_of(batch, text), min_chars))
        for k, once, twice in pair.segments():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([once], pa.binary()), pa.array([twice], pa.binary())], ["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, *packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                once, twice = (np.frombuffer(zlib.decompress(x), np.uint64) for x in packed)
                if k in held:
                    had = held[k]
                    held[k] = [had[0] | once, had[1] | twice | (had[0] & once)]
                else:
                    held[k] = [once, twice]
        for k, (_, twice) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["segment", "twice"])

    parts = docs.select(text).mapInArrow(build, "segment int, once binary, twice binary")
    rows = parts.repartition("segment").mapInArrow(merge, "segment int, twice binary").toLocalIterator()
    out = np.zeros(cells, np.uint64)
    for r in rows:  # at most MAX_CELLS * 8 bytes in all
        part = np.frombuffer(bytes(r.twice), np.uint64)
        out[r.segment * SEGMENT : r.segment * SEGMENT + len(part)] = part
    return out


def _suspects(docs: DataFrame, shipped: Shipped, min_chars: int) -> DataFrame:
    """key (128-bit digest) and doc_id of each line, once a document, whose hash may be a repeat."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(shipped.value, np.uint64)
        for batch in groups(batches, "text", STRIP_BYTES):
            keys, rows = [], []
            for row, t in enumerate(texts_of(batch, "text")):
                own = {k for _, k in keys_of(_lines(t), min_chars)}
                keys += own
                rows += [row] * len(own)
            h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
            cell, bits = _places(h, len(twice))
            hit = np.flatnonzero(twice[cell] & bits == bits)
            digests = pa.array([xxhash.xxh3_128_digest(keys[i]) for i in hit], pa.binary())
            yield pa.RecordBatch.from_arrays([digests, column(batch, "doc_id").take(pa.array(np.array(rows, np.int64)[hit], pa.int64()))], ["key", "doc_id"])

    return docs.mapInArrow(find, T.StructType([T.StructField("key", T.BinaryType()), docs.schema["doc_id"]]))


def repeated_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """Written table of key (128-bit digest) and keeper (largest doc_id) of lines found in at least ``min_docs`` documents."""
    spark = docs.sparkSession
    prepare(spark)
    scratch = scratch or Scratch(spark)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(MAX_CELLS, max(MIN_CELLS, 1 << int(size // 400).bit_length()))
    shipped = Shipped(spark.sparkContext.broadcast(twice_filter(own, "text", min_chars, cells).tobytes()))
    counted = _suspects(own, shipped, min_chars).groupBy("key").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    return scratch.write(counted.where(F.col("n") >= min_docs).select("key", "keeper"))


def _kept(text: str | None, own_id, drop, min_chars: int) -> tuple[str, int, int]:
    """Kept text, number of lines, number dropped. drop(digest, id): whether that document loses the line."""
    lines = _lines(text)
    gone = {i for i, k in keys_of(lines, min_chars) if drop(xxhash.xxh3_128_digest(k), own_id)}
    kept = b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else b"\n".join(lines)
    return kept.decode(), len(lines), len(gone)


def free_names(docs: DataFrame, names: tuple[str, str, str]) -> tuple[str, str, str]:
    """The names under which with_kept_lines gives its results beside the documents' own columns."""
    a = fresh(docs.columns, names[0])
    b = fresh(docs.columns, names[1], a)
    return a, b, fresh(docs.columns, names[2], a, b)


def with_kept_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, names: tuple[str, str, str] = ("kept_text", "n_lines", "n_dropped"), max_broadcast_keys: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """The documents with the text that is left, the number of lines and the number dropped, under ``names``.

    A name that the documents have already, in whatever case, gets underscores until it is free (store.fresh, in turn).
    """
    return _stripped(docs, doc_id, text, min_chars, min_docs, free_names(docs, names), max_broadcast_keys, [])


def _stripped(docs: DataFrame, doc_id: str, text: str, min_chars: int, min_docs: int, names: tuple[str, str, str], max_broadcast_keys: int, without: list[str]) -> DataFrame:
    """with_kept_lines, the documents' columns ``without`` left out before rows come back from the workers."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    table = repeated_lines(docs, doc_id=doc_id, text=text, min_chars=min_chars, min_docs=min_docs, scratch=scratch)
    fields = [T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.LongType(), T.LongType()), strict=True)]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in without), *fields])
    if table.count() <= max_broadcast_keys:
        shipped = Shipped(spark.sparkContext.broadcast({bytes(r.key): r.keeper for r in table.toLocalIterator()}))

        def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keepers, missing = shipped.value, object()
            for batch in groups(batches, text, STRIP_BYTES):
                ids = texts_of(batch, doc_id)
                yield _appended(batch.drop_columns(without), [_kept(t, i, lambda k, own: keepers.get(k, missing) not in (missing, own), min_chars) for t, i in zip(texts_of(batch, text), ids, strict=True)], names)

        return docs.mapInArrow(strip, schema)

    # Too many digests to broadcast: each row's own digests meet them in a join, and come back to the row by a key of its content.
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    lost = _digests(own, min_chars).join(table, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("row").agg(F.collect_set("key").alias("keys"))
    mark, row = fresh(docs.columns, "lost_keys", *names), fresh(docs.columns, "row_key", *names)
    rows = docs.withColumn(row, F.xxhash64(F.col(doc_id), F.col(text))).join(lost.withColumnsRenamed({"row": row, "keys": mark}), row, "left").drop(row)

    def strip_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, text, STRIP_BYTES):
            sets = [set(x or ()) for x in texts_of(batch, mark)]
            done = [_kept(t, None, lambda k, _, gone=gone: k in gone, min_chars) for t, gone in zip(texts_of(batch, text), sets, strict=True)]
            yield _appended(batch.drop_columns([mark, *without]), done, names)

    return rows.mapInArrow(strip_joined, schema)


def _digests(own: DataFrame, min_chars: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "text"):
            found = [(xxhash.xxh3_128_digest(k), i) for i, t in enumerate(texts_of(batch, "text")) for k in {k for _, k in keys_of(_lines(t), min_chars)}]
            at = pa.array([i for _, i in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), column(batch, "doc_id").take(at), column(batch, "row").take(at)], ["key", "doc_id", "row"])

    keyed = own.withColumn("row", F.xxhash64("doc_id", "text"))
    return keyed.mapInArrow(find, T.StructType([T.StructField("key", T.BinaryType()), own.schema["doc_id"], T.StructField("row", T.LongType())]))


def _appended(batch: pa.RecordBatch, done: list[tuple[str, int, int]], names: tuple[str, str, str]) -> pa.RecordBatch:
    extra = [pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5, max_broadcast_keys: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """Per document: doc_id, kept_text, n_lines (before dropping), n_dropped."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return _stripped(own, "doc_id", "text", min_chars, min_docs, ("kept_text", "n_lines", "n_dropped"), max_broadcast_keys, ["text"])
