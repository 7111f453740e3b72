"""Machinery of the similarity joins: candidate buckets, blocks of bounded size, exact links, connected components.

No step emits the pairs of a group. A bucket gives spanning edges between its similar members; a component is compared in
blocks whose tasks return one row a member, its linked weight and its smallest partner. Groups larger than a block are
split into pairs of blocks, so every pair meets in one task and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import column
from .store import Scratch


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The runs of equal keys of sorted batches, each as one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(column(batch, k)) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = first != last
        cuts = np.flatnonzero(change)
        if len(cuts) and cuts[0] == 0:
            if held:
                yield _joined(held)
                held = []
            cuts = cuts[1:]
        at = 0
        for cut in cuts:
            yield _joined([*held, batch.slice(at, cut - at)])
            held, at = [], cut
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in columns)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def in_blocks(rows: DataFrame, group: str, size: str, item: str, block: int) -> DataFrame:
    """rows with block (the item's), low and high (the pair of blocks it is sent to); groups up to ``block`` items are one block."""
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(item), n.cast("long")).cast("int")
    other = F.explode(F.when(n <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1)))
    spread = rows.withColumn("block", F.when(n <= 1, F.lit(0)).otherwise(own)).withColumn("other", other)
    dealt = spread.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", size)
    return dealt.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high")


def met_members(members: DataFrame, payloads: DataFrame) -> DataFrame:
    """bucket, size, node and payload of the members (node, bucket) of buckets of two or more.

    The members are unfolded rows, whose number a plan does not see: their size is that of the folded table, so a join left to the planner
    would broadcast all of them.
    """
    met = members.groupBy("bucket").agg(F.count("node").alias("size")).where(F.col("size") > 1)
    return members.join(met.hint("merge"), "bucket").join(payloads.hint("merge"), "node")


Similar = Callable[[np.ndarray, int, np.ndarray], np.ndarray]


def spanning(payloads: np.ndarray, similar: Similar) -> list[tuple[int, int]]:
    """Edges that connect whatever ``similar`` pairs connect; pairs that are connected already are not compared."""
    n = len(payloads)
    labels, edges = np.arange(n), []
    for i in range(n - 1):
        others = np.flatnonzero(labels[i + 1 :] != labels[i]) + i + 1
        if not len(others):
            if i == 0 or (labels == labels[0]).all():
                break
            continue
        for j in similar(payloads, i, others):
            if labels[j] != labels[i]:
                edges.append((i, int(j)))
                labels[labels == labels[j]] = labels[i]
    return edges


def bucket_edges(rows: DataFrame, similar: Similar, dtype: str, block: int) -> DataFrame:
    """u, v edges between similar members of buckets. rows: bucket, size (its members), node, payload (a vector's bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for g in sorted_groups(batches, ["bucket", "low", "high"]):
            if g.num_rows < 2:
                continue
            nodes = np.asarray(column(g, "node"))
            payloads = np.frombuffer(b"".join(column(g, "payload").to_pylist()), dtype).reshape(g.num_rows, -1)
            for i, j in spanning(payloads, similar):
                u.append(max(nodes[i], nodes[j]))
                v.append(min(nodes[i], nodes[j]))
            if len(u) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return in_blocks(rows, "bucket", "size", "node", block).mapInArrow(run, "u long, v long").where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) of all nodes with edges, by alternating large and small stars."""
    now = scratch.write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct())
    # Done once no root has an edge of its own: then every edge leads from a node to its component's smallest.
    while not now.select("u").join(now.select(F.col("v").alias("u")), "u", "left_semi").isEmpty() or not now.groupBy("u").count().where("count > 1").isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        later = scratch.write(small.unionByName(root.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct())
        scratch.drop(now)
        now = later
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


Linked = Callable[[list[bytes]], np.ndarray]


def block_links(rows: DataFrame, linked: Linked, block: int) -> DataFrame:
    """node, partner (smallest node of its part of the block), weight linked. rows: component, size, node, weight, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, ["component", "low", "high"]):
            if g.num_rows < 2:
                continue
            links = linked(column(g, "payload").to_pylist())
            np.fill_diagonal(links, False)
            if pc.not_equal(column(g, "low"), column(g, "high"))[0].as_py():
                own = np.asarray(column(g, "block"))
                links &= own[:, None] != own[None, :]
            some = np.flatnonzero(links.any(axis=1))
            if not len(some):
                continue
            links = links[np.ix_(some, some)]
            nodes, weight = np.asarray(column(g, "node"))[some], np.asarray(column(g, "weight"))[some]
            label = nodes.copy()
            while True:
                least = np.minimum(label, np.where(links, label[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (least == label).all():
                    break
                label = least
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label), pa.array(links @ weight)], ["node", "partner", "weight"])

    return in_blocks(rows, "component", "size", "node", block).mapInArrow(run, "node long, partner long, weight long")


def linked_nodes(nodes: DataFrame, edges: DataFrame, payload: Callable[[DataFrame], DataFrame], linked: Linked, block: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (node, component) of the nodes that are linked.

    nodes: node, weight; edges: u, v candidates; payload: adds the exact representation to the members of components.
    """
    candidates = scratch.write(components(edges, scratch))
    sizes = candidates.groupBy("component").agg(F.count("node").alias("size"))
    members = payload(candidates.join(sizes, "component").join(nodes.select("node", "weight"), "node"))
    found = scratch.write(block_links(members, linked, block))
    links = found.groupBy("node").agg(F.sum("weight").alias("links"))
    return links, components(found.select(F.col("node").alias("u"), F.col("partner").alias("v")), scratch)


def spread_join(rows: DataFrame, classes: DataFrame, key: str, spread_by: Column, salts: int = 16) -> DataFrame:
    """rows left-joined to one row a class, with each class's rows dealt over ``salts`` tasks.

    Never a broadcast: plans take the copies for one row a class, a sixteenth of what the driver would hold.
    """
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = classes.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies.hint("merge"), [key, "__salt"], "left").drop("__salt")
