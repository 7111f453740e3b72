"""Nearest passages of a standards corpus, and its incremental index.

Queries are few (one per rule), passages many: the queries' vectors travel to the passages, whose batches meet them in one matrix product, and of each query
only what can be among its k best leaves the task; Spark's group limit merges that before the shuffle, so passages times queries are never exchanged and no
pair of them is a row. More queries than MAX_QUERIES go in parts of about that size, each part against all passages; likewise candidates. Within a task the queries
that travelled are met block by block, so small blocks cost no reading of the passages anew.
Rows without a vector, with a null in it, or of another length than the other side's, are near nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pages import chunk_index

#: Queries, or candidates, of one block, which is broadcast.
MAX_QUERIES = 10_000
#: Products of a batch that are held at once.
CELLS = 1 << 22


def in_blocks(rows: DataFrame, by: str, block: int) -> list[DataFrame]:
    """The rows in parts of about ``block`` at most, by hash of a column that tells them apart."""
    n = -(-rows.count() // block)
    # Twice as many parts as would do, where there are several: hashing spreads unevenly.
    return [rows] if n <= 1 else [rows.where(F.pmod(F.xxhash64(by), F.lit(2 * n)) == k) for k in range(2 * n)]


def usable(embedding: str = "embedding") -> Column:
    return F.coalesce(F.forall(embedding, lambda x: x.isNotNull()), F.lit(False))


class Fixed:
    """The side that travels: its columns without the vector, and its vectors by length."""

    def __init__(self, rows: DataFrame):
        table = rows.where(usable()).toArrow().combine_chunks()
        self.columns = table.drop_columns(["embedding"])
        vectors = table.column("embedding").combine_chunks()
        sizes = np.asarray(vectors.value_lengths()) if len(vectors) else np.zeros(0, np.int64)
        self.places = {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}
        self.vectors = {d: matrix(vectors.take(pa.array(at)), d) for d, at in self.places.items()}


def matrix(vectors: pa.Array, d: int) -> np.ndarray:
    return np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), d)


def met(rows: DataFrame, fixed: DataFrame, choose: Callable[[], Callable], value: str, block: int = MAX_QUERIES) -> DataFrame:
    """Rows (without their embedding) beside rows of the fixed side, and the exact value of each pair that ``choose`` keeps.

    choose: makes, for each task and block of the fixed side, a function of its places and vectors and a batch's vectors that gives the kept pairs (batch row, place
    in the block) and values.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(Fixed(fixed))
    keys = [c for c in rows.columns if c != "embedding"]
    fields = [f for f in fixed.schema.fields if f.name != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side, kept = shipped.value, {}
        step = max(1, CELLS // max(1, min(block, sum(map(len, side.places.values())))))
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                vectors = batch.column(batch.schema.get_field_index("embedding"))
                sizes = np.asarray(vectors.value_lengths())
                for d in np.unique(sizes).tolist():
                    if d not in side.places:
                        continue
                    at = np.flatnonzero(sizes == d)
                    own, places, found = matrix(vectors.take(pa.array(at)), d), side.places[d], []
                    for low in range(0, len(places), block):
                        part = slice(low, low + block)
                        x, y, values = kept.setdefault((d, low), choose())(places[part], side.vectors[d][part], own)
                        if len(x):
                            found.append((x, y + low, values))
                    if not found:
                        continue
                    x, y, values = map(np.concatenate, zip(*found, strict=True))
                    left, right = batch.take(pa.array(at[x])), side.columns.take(pa.array(places[y])).combine_chunks()
                    mine = [left.column(left.schema.get_field_index(c)) for c in keys]
                    other = [right.column(f.name).combine_chunks() for f in fields]
                    yield pa.RecordBatch.from_arrays([*mine, *other, pa.array(values, pa.float64())], [*keys, *(f.name for f in fields), value])

    schema = T.StructType([*(rows.schema[c] for c in keys), *fields, T.StructField(value, T.DoubleType())])
    return rows.where(usable()).mapInArrow(run, schema)


def nearest(queries: DataFrame, passages: DataFrame, k: int = 3, tie: str = "chunk_index", digits: int = 5, block: int = MAX_QUERIES) -> DataFrame:
    """query, rank, score (1 - squared distance) and the passage's columns; equal rounded distances go by ``tie``."""
    found = [_nearest(part, passages, k, tie, digits, block) for part in in_blocks(queries.select("query", "embedding"), "query", MAX_QUERIES)]
    return functools.reduce(DataFrame.unionByName, found)


def _nearest(queries: DataFrame, passages: DataFrame, k: int, tie: str, digits: int, block: int) -> DataFrame:
    slack = 2 * 10.0**-digits  # distances that may round alike

    def choose() -> Callable:
        kth: dict[int, np.ndarray] = {}  # by length: the k-th smallest distance of each query in the task so far
        smallest: dict[int, np.ndarray] = {}

        def kept(places: np.ndarray, own: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            d = x.shape[1]
            by_product = (x * x).sum(axis=1)[:, None] + (own * own).sum(axis=1)[None, :] - 2 * (x @ own.T)
            held = np.vstack([smallest.get(d, np.zeros((0, len(own)))), by_product])
            smallest[d] = np.partition(held, k - 1, axis=0)[:k] if len(held) > k else held
            kth[d] = smallest[d].max(axis=0) if len(held) >= k else np.full(len(own), np.inf)
            room = slack + 1e-9 * (1 + np.abs(kth[d]))
            i, j = np.nonzero(by_product <= (kth[d] + np.where(np.isfinite(kth[d]), room, 0))[None, :])
            return i, j, np.concatenate([np.zeros(0), *(((x[i[at : at + 4096]] - own[j[at : at + 4096]]) ** 2).sum(axis=1) for at in range(0, len(i), 4096))])

        return kept

    scored = met(passages, queries, choose, "distance", block).withColumn("distance", F.round("distance", digits))
    near = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", tie))).where(F.col("rank") <= k)
    return near.withColumn("score", F.lit(1.0) - F.col("distance")).drop("distance")


def best_by_cosine(queries: DataFrame, candidates: DataFrame, threshold: float, block: int = MAX_QUERIES) -> DataFrame:
    """The candidate of greatest cosine (unit vectors) of each query, if above the threshold; the first of equals."""

    def choose() -> Callable:
        def kept(places: np.ndarray, own: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            products = x @ own.T
            i, j = np.nonzero(products >= np.maximum(products.max(axis=1), threshold)[:, None] - 2e-6)  # what may round alike
            return i, j, products[i, j]

        return kept

    parts = in_blocks(candidates.select("candidate", "ord", "embedding"), "ord", block)
    scored = functools.reduce(DataFrame.unionByName, [met(queries.select("query", "embedding"), part, choose, "cosine") for part in parts]).withColumn("cosine", F.round("cosine", 6))
    best = scored.groupBy("query").agg(F.max_by(F.struct("candidate", "cosine"), F.struct(F.col("cosine"), -F.col("ord"))).alias("b"))
    return best.select("query", "b.*").where(F.col("cosine") > threshold)


def not_indexed(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files of which the index has no chunk yet, by content, or by name where the index has no content hash."""
    key = "content_hash" if "content_hash" in index.columns and "content_hash" in files.columns else "source_filename"
    return files.join(index.select(key).distinct(), key, "left_anti")


def upsert(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """The index with new chunks; a chunk of the same file and number replaces the old one."""
    both = index.withColumn("__new", F.lit(0)).unionByName(chunks.withColumn("__new", F.lit(1)))
    latest = F.max_by(F.struct(*[c for c in index.columns if c not in ("source_filename", "chunk_index")]), "__new")
    return both.groupBy("source_filename", "chunk_index").agg(latest.alias("c")).select("source_filename", "chunk_index", "c.*").select(*index.columns)


def build_index(pages: DataFrame, index: DataFrame | None, encoded: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index with the chunks of the pages' files (source_filename, page_number, text) that it does not have yet.

    encoded: adds the embedding of a text column ``text``, see mapping.encoded. Columns: source_filename, page_number, chunk_index, text, embedding.
    """
    new = pages
    if index is not None:
        files = not_indexed(pages.select("source_filename").distinct(), index)
        new = pages.join(files, "source_filename", "left_semi")
    made = encoded(chunk_index(new))
    return made if index is None else upsert(index, made.select(*index.columns))
