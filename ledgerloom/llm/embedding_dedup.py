"""Embedding near-duplicates by iterative quantisation.

A rotation of the centred principal axes is learned on a bounded sample (SAMPLE vectors, by hash) so that signs of rotated
vectors make balanced binary codes; every vector is coded. Codes meet in multi-index Hamming tables (substrings of the
code); within a bucket, codes at most a radius apart are candidates, reranked by half precision copies of the vectors so that
unrelated vectors do not chain; what is left is reranked with the original vectors, cosine in double precision, block
against block inside the candidates' components.

Bits flip more often between centred codes than the cosine says, and tables share bits, so nothing is derived from the angle:
pairs at the threshold are made from the sample and coded, and tables are added until they find AIM of them, together and with
the radius. The substrings' length is the cheapest for the number of vectors: long ones make small buckets, but take more tables.
A pair at the threshold is found with probability RECALL or more at any number of vectors;
nearer pairs are found far more surely.

Defined cases: a vector that is null, empty, zero, or has null or non-finite components links with nothing and is its own
component; very large and very small vectors are scaled by a power of two before they are squared, which changes no cosine; vectors of different lengths never link; equal vectors are linked, repeated rows included; a null id is carried along
but is no component's name while others have one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pairing
from .bytescan import column, mix
from .decontaminate import Shipped
from .store import Scratch, prepare

THRESHOLD, RECALL = 0.9, 0.99
#: Bound of the sample that the rotation is learned on; bits of a code; learning rounds.
SAMPLE, BITS, ROUNDS = 20_000, 64, 50
BUCKET_BLOCK, COMPONENT_BLOCK = 2048, 1024
#: Share of the measured pairs that the tables must find, so that RECALL holds beyond the sample, and share that the radius may lose.
AIM, WITHIN = 0.995, 0.001
#: Measured pairs of each kind, width of the band of the sample's own pairs, and how many of those are enough to count.
PAIRS, BAND, ENOUGH = 4000, 0.02, 200
#: What a row of a table costs to shuffle and take up, in comparisons of two codes; most tables.
ROW_COST, MAX_TABLES = 2000, 1024
#: Members of a bucket below which no fewer are wanted for parallel work, and the bits that always make enough buckets.
BUCKET, SPREAD = 512, 8
#: More than half precision can move the cosine of unit vectors.
SLACK = 0.01


class Rotation:
    """Centre, projection and rotation from vectors to codes."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.centre = unit.mean(axis=0)
        centred = unit - self.centre
        self.bits = min(bits, unit.shape[1])
        _, axes = np.linalg.eigh(centred.T @ centred)
        project = axes[:, ::-1][:, : self.bits]
        values = centred @ project
        rotation, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((self.bits, self.bits)))
        for _ in range(rounds):
            signs = np.where(values @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ values)
            rotation = (left @ right).T
        self.matrix = project @ rotation

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        bits = (unit - self.centre) @ self.matrix >= 0
        return bits @ (np.uint64(1) << np.arange(self.bits, dtype=np.uint64))


def threshold_pairs(sample: np.ndarray, threshold: float, pairs: int = PAIRS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors in pairs at the threshold, of several kinds: sample vectors moved by isotropic noise, moved towards other
    sample vectors, and the sample's own pairs just above the threshold, where it has enough of them."""
    random = np.random.default_rng(13)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    x = unit[random.integers(0, len(unit), pairs)]
    kinds = []
    for noise in (random.standard_normal(x.shape), unit[random.integers(0, len(unit), pairs)]):
        noise = noise - (noise * x).sum(axis=1, keepdims=True) * x
        norms = np.linalg.norm(noise, axis=1, keepdims=True)
        some = norms[:, 0] > 1e-9
        if some.any():
            kinds.append((x[some], threshold * x[some] + math.sqrt(max(0.0, 1 - threshold**2)) * noise[some] / norms[some]))
    narrow, own, other = unit.astype(np.float32), [], []
    for at in range(0, min(pairs, len(unit)), 500):
        cosines = narrow[at : min(at + 500, pairs)] @ narrow.T
        i, j = np.nonzero((cosines >= threshold) & (cosines < threshold + BAND))
        later = i + at < j
        own.append(i[later][:pairs] + at)
        other.append(j[later][:pairs])
    i, j = np.concatenate(own), np.concatenate(other)
    if len(i) >= ENOUGH:
        kinds.append((unit[i[:pairs]], unit[j[:pairs]]))
    return kinds


def flipped(rotation: Rotation, kinds: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Per kind of pairs: the code bits in which each pair differs."""
    return [rotation.codes(x) ^ rotation.codes(y) for x, y in kinds]


def radius_of(flips: list[np.ndarray]) -> int:
    """Bits that all but WITHIN of the pairs of each kind differ in at most."""
    return max((int(np.quantile(np.bitwise_count(f), 1 - WITHIN, method="higher")) for f in flips), default=0)


def recall_of(masks: np.ndarray, radius: int, flips: np.ndarray) -> float:
    """Share of pairs that meet in some table, within the radius."""
    met = np.zeros(len(flips), bool)
    for m in masks:
        met |= flips & m == 0
    return float((met & (np.bitwise_count(flips) <= radius)).mean())


def masks_of(width: int, bits: int, flips: list[np.ndarray], most: int) -> np.ndarray | None:
    """The code bits that each table of this width indexes: as many as find AIM of the pairs of each kind, or None beyond ``most``."""
    random, masks = np.random.default_rng(11), []
    radius = radius_of(flips)
    near = [np.bitwise_count(f) <= radius for f in flips]
    met = [np.zeros(len(f), bool) for f in flips]
    while len(masks) < most:
        order = random.permutation(bits)
        for at in range(0, bits - width + 1, max(width, 1)):
            masks.append(np.uint64(sum(1 << int(b) for b in order[at : at + width])))
            met = [m | (f & masks[-1] == 0) for m, f in zip(met, flips, strict=True)]
            if all((m & n).mean() >= AIM for m, n in zip(met, near, strict=True)):
                return np.array(masks, np.uint64)
            if len(masks) == most:
                break
    return None


def table_masks(n: int, bits: int, flips: list[np.ndarray]) -> np.ndarray:
    """Tables of the width that costs least for n vectors: a row a table and vector, and the comparisons in its bucket.

    Buckets are many enough to be dealt over tasks, up to SPREAD bits; only where no tables of such width do, they are fewer.
    """
    lowest = min(bits, SPREAD, max(0, math.ceil(math.log2(max(n, 2) / BUCKET))))
    while (best := masks_of(lowest, bits, flips, MAX_TABLES)) is None:
        lowest -= 1
    least = math.inf
    for width in range(lowest, min(bits, math.ceil(math.log2(max(n, 2)))) + 1):
        masks = masks_of(width, bits, flips, MAX_TABLES)
        if masks is None:
            break
        bucket = n / 2**width
        cost = len(masks) * (ROW_COST + bucket * (0.5 if bucket <= BUCKET_BLOCK else 1))
        if cost < least:
            best, least = masks, cost
    return best


def packed(codes: np.ndarray, unit: np.ndarray) -> list[bytes]:
    """A bucket member's payload: its code, then its unit vector in half precision."""
    return [c.tobytes() + v.tobytes() for c, v in zip(codes, unit.astype(np.float16), strict=True)]


def near_codes(radius: int, threshold: float) -> pairing.Similar:
    """Members at most ``radius`` bits away whose half precision vectors come within SLACK of the threshold."""

    def similar(payloads: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
        codes = np.ascontiguousarray(payloads[others, :8]).view(np.uint64)[:, 0]
        others = others[np.bitwise_count(codes ^ np.ascontiguousarray(payloads[i, :8]).view(np.uint64)[0]) <= radius]
        if not len(others):
            return others
        vectors = np.ascontiguousarray(payloads[others, 8:]).view(np.float16).astype(np.float32)
        own = np.ascontiguousarray(payloads[i, 8:]).view(np.float16).astype(np.float32)
        return others[vectors @ own >= threshold - SLACK]

    return similar


def cosine_at_least(threshold: float) -> pairing.Linked:
    def linked(payloads: list[bytes]) -> np.ndarray:
        v = np.frombuffer(b"".join(payloads), np.float64).reshape(len(payloads), -1)
        norms = np.sqrt((v * v).sum(axis=1))
        return (v @ v.T) / (norms[:, None] * norms[None, :]) >= threshold

    return linked


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors with largest components from a half to one: times a power of two, so no digit is lost and no square over- or underflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    flat = np.asarray(column(batch, name).flatten(), np.float64)
    return scaled(flat.reshape(batch.num_rows, -1))


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Per vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept."""
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.exists("v", lambda x: x != 0)
    node = F.when(finite, F.xxhash64(F.size("v"), "v"))
    keyed = scratch.write(own.withColumn("node", node).withColumn("v", F.when(F.col("node").isNotNull(), F.col("v"))))
    classes = scratch.write(keyed.where(F.col("node").isNotNull()).groupBy("node").agg(F.count("node").alias("weight"), F.min("vec_id").alias("first"), F.any_value("v").alias("v")))
    links, edges = [], []
    for row in classes.groupBy(F.size("v").alias("d")).count().collect():  # the lengths of vectors, commonly one
        edges.append(_candidates(classes.where(F.size("v") == row.d).select("node", "v"), row["count"], threshold, sample, scratch))
    if not edges:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = edges[0]
    for more in edges[1:]:
        found = found.unionByName(more)

    def with_vectors(members: DataFrame) -> DataFrame:
        rows = members.join(classes.select("node", "v"), "node").select("node", "component", "size", "weight", "v")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([scaled(np.array([x], np.float64)).tobytes() for x in column(batch, "v").to_pylist()], pa.binary())], ["node", "component", "size", "weight", "payload"])

        return rows.mapInArrow(pack, "node long, component long, size long, weight long, payload binary")

    links, parts = pairing.linked_nodes(classes, found, with_vectors, cosine_at_least(threshold), COMPONENT_BLOCK, scratch)
    known = classes.select("node", "weight", "first").join(links, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    per_class = scratch.write(known.join(smallest, "component").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    joined = pairing.spread_join(keyed.select("vec_id", "node"), per_class, "node", F.col("vec_id"))
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _least(classes: DataFrame, n: int, sample: int) -> DataFrame:
    """The ``sample`` rows of smallest node. Nodes are hashes, so a range of them that holds twice as many is known beforehand: the task that
    orders them does not get a whole sample from each task."""
    last = min(2**63 - 1, -(2**63) + 2**65 * sample // max(n, 1))
    within = classes.where(F.col("node") <= F.lit(last))
    return (within if last < 2**63 - 1 and within.count() >= sample else classes).orderBy("node").limit(sample)


def _candidates(classes: DataFrame, n: int, threshold: float, sample: int, scratch: Scratch) -> DataFrame:
    """u, v edges between codes that are near in some table; classes: node and v, all of one length."""
    spark = classes.sparkSession
    chosen = _least(classes, n, sample).select("v").toArrow().column("v").combine_chunks()
    learned = scaled(np.asarray(chosen.flatten(), np.float64).reshape(len(chosen), -1))
    rotation = Rotation(learned)
    flips = flipped(rotation, threshold_pairs(learned, threshold))
    masks, radius = table_masks(n, rotation.bits, flips), radius_of(flips)
    shipped = Shipped(spark.sparkContext.broadcast(rotation))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch, "v")
            codes, unit = shipped.value.codes(vectors), vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            keys = [mix((codes & m) * np.uint64(2) + np.uint64(1) ^ mix(np.array([t + 1], np.uint64))).view(np.int64) for t, m in enumerate(masks)]
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(packed(codes, unit), pa.binary()), pa.array(np.stack(keys, axis=1).tolist(), pa.list_(pa.int64()))], ["node", "payload", "keys"])

    coded = scratch.write(classes.mapInArrow(code, "node long, payload binary, keys array<long>"))
    rows = pairing.met_members(coded.select("node", F.explode("keys").alias("bucket")), coded.select("node", "payload"))
    return scratch.write(pairing.bucket_edges(rows, near_codes(radius, threshold), "uint8", BUCKET_BLOCK))
