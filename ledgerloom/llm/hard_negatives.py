"""Hard negatives by dual-tree search: exact integer inner products, most node pairs never scored where vectors cluster.

An anchor's positives are the rows of its label with the highest scores; its negatives for a positive are the highest-scoring rows of
other labels whose score lies in a window below the positive's. Both are one search: the k best rows of a window of scores.

Candidates hang in a tree: its upper part, learned on a bounded sample (SAMPLE rows), deals every row to a leaf; a leaf is kept as
blocks of bounded size, and each block is a tree of its own in the task that reads it. Anchors are a tree a batch. A pair of nodes, each a ball about its
mean, gives an interval of inner products; a pair whose interval lies outside the windows of all its anchors is left, for all of them at once. What reaches
the leaves is scored exactly. A first pass over a block of each anchor's own leaf gives the score that the k-th best has at least; it
narrows the windows of the second pass, which is complete by itself.

Scores are integers, so ties are exact: they go by id. Of equal vectors of one label only the rows of smallest id can be chosen, so the others are
left out before the search, and equal anchors are searched once: groups of copies cost no more than single rows.

Defined cases: rows take no part whose id, label or vector is null, or that hold a null or non-finite component, or one of 2**26 or more after scaling (so
that every score fits a long); vectors of different lengths never meet; empty vectors score 0 with one another. Rows that repeat an id
are rows of their own: an anchor's row is no positive of itself, another row of its id may be. A table without anchors, positives or rows
in the windows, and an empty one, give an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import column
from .decontaminate import Shipped
from .pairing import sorted_groups
from .store import Scratch, prepare

#: Rows that the upper tree is learned on, most of its leaves, rows of a leaf of the trees in tasks, anchors of a batch.
SAMPLE, LEAVES, LEAF, BATCH = 16_384, 512, 64, 1024
#: Bytes (of eight a component) of a block of candidates, and of the anchors that meet a block in one task.
BLOCK_BYTES = 8 << 20
#: Components at and beyond which rows take no part.
LIMIT = 1 << 26


class Tree:
    """A balanced tree of balls over rows of a matrix: ``order`` of the rows, and for each level the limits, means and radii of its nodes."""

    def __init__(self, v: np.ndarray, leaf: int = LEAF, most: int = 1 << 30):
        n = len(v)
        depth = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
        depth = min(depth, int(math.log2(most)), int(math.log2(max(n, 1)))) if v.shape[1] else 0
        self.order, self.splits = np.arange(n), []
        limits = [np.array([0, n])]
        for _ in range(depth):
            cuts, level = [0], []
            for low, high in zip(limits[-1][:-1], limits[-1][1:], strict=True):
                own, middle = self.order[low:high], (low + high) // 2
                spread = v[own].var(axis=0)
                wide = int(spread.argmax())
                self.order[low:high] = own[np.argpartition(v[own, wide], middle - low)]
                level.append((wide, float(v[self.order[middle], wide])))
                cuts += [middle, high]
            self.splits.append((np.array([w for w, _ in level]), np.array([x for _, x in level])))
            limits.append(np.array(cuts))
        self.limits, self.means, self.radii = limits, [], []
        rows = v[self.order]
        for at in limits:
            mean = np.add.reduceat(rows, at[:-1], axis=0) / np.diff(at)[:, None]
            far = ((rows - np.repeat(mean, np.diff(at), axis=0)) ** 2).sum(axis=1)
            self.means.append(mean)
            self.radii.append(np.sqrt(np.maximum.reduceat(far, at[:-1])))

    @property
    def depth(self) -> int:
        return len(self.limits) - 1

    def route(self, v: np.ndarray) -> np.ndarray:
        """The leaf that each row of another matrix belongs to."""
        at = np.zeros(len(v), np.int64)
        for wide, value in self.splits:
            at = 2 * at + (v[np.arange(len(v)), wide[at]] >= value[at])
        return at

    def widen(self, radii: np.ndarray) -> None:
        """Balls that hold all rows dealt to the leaves: ``radii`` about the leaves' means; a leaf without rows has a negative one."""
        self.radii[-1] = radii
        for level in range(self.depth - 1, -1, -1):
            reach = np.sqrt(((self.means[level + 1] - np.repeat(self.means[level], 2, axis=0)) ** 2).sum(axis=1)) + self.radii[level + 1]
            self.radii[level] = np.where(self.radii[level + 1] < 0, -1.0, reach).reshape(-1, 2).max(axis=1)


def traverse(anchors: Tree, rows: Tree, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves whose interval of inner products meets [least, most] of some anchor there (both in the anchors' tree's order)."""
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for step in range(max(anchors.depth, rows.depth) + 1):
        a, b = min(step, anchors.depth), min(step, rows.depth)
        if step:
            if a == step:
                i, j = np.concatenate((2 * i, 2 * i + 1)), np.concatenate((j, j))
            if b == step:
                i, j = np.concatenate((i, i)), np.concatenate((2 * j, 2 * j + 1))
        at = anchors.limits[a][:-1]
        low, high = np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
        x, y, rx, ry = anchors.means[a], rows.means[b], anchors.radii[a], rows.radii[b]
        middle = np.einsum("nd,nd->n", x[i], y[j])
        nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
        reach = nx[i] * ry[j] + ny[j] * rx[i] + rx[i] * ry[j]
        reach += 1 + 1e-9 * (reach + nx[i] * ny[j])  # floating point
        stays = (ry[j] >= 0) & (middle + reach >= low[i]) & (middle - reach <= high[i])
        i, j = i[stays], j[stays]
    return i, j


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where all sums fit their 53 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


Found = tuple[list[int], list[int], list[int], list[int]]


def best_of_block(queries: dict, rows: dict, k: int, same: bool) -> Found:
    """Query, window, score and id of the k best rows of the block in each query's windows.

    queries: id, label, v, and windows as ``of`` (the query's number), ``name``, ``low`` and ``high``; rows: id, label, v.
    """
    tree = Tree(rows["v"].astype(np.float64))
    ids, labels, vectors = (rows[c][tree.order] for c in ("id", "label", "v"))
    n = len(queries["id"])
    out: Found = ([], [], [], [])
    for begin in range(0, n, BATCH):
        own = slice(begin, min(begin + BATCH, n))
        first, last = np.searchsorted(queries["of"], (own.start, own.stop))
        of = queries["of"][first:last] - begin
        if not len(of):
            continue
        low, high, name = (queries[c][first:last] for c in ("low", "high", "name"))
        least, most = np.full(own.stop - own.start, np.inf), np.full(own.stop - own.start, -np.inf)
        np.minimum.at(least, of, low.astype(np.float64))
        np.maximum.at(most, of, high.astype(np.float64))
        anchors = Tree(queries["v"][own].astype(np.float64))
        i, j = traverse(anchors, tree, least[anchors.order], most[anchors.order])
        windows: list[list[int]] = [[] for _ in range(own.stop - own.start)]
        for w, q in enumerate(of):
            windows[q].append(w)
        for leaf in np.unique(i):
            members = anchors.order[anchors.limits[-1][leaf] : anchors.limits[-1][leaf + 1]]
            met = np.concatenate([np.arange(tree.limits[-1][x], tree.limits[-1][x + 1]) for x in np.sort(j[i == leaf])])
            scores = products(queries["v"][own][members], vectors[met])
            alike = queries["label"][own][members][:, None] == labels[met][None, :]
            fits = alike if same else ~alike
            for m, q in enumerate(members):
                for w in windows[q]:
                    at = np.flatnonzero(fits[m] & (scores[m] >= low[w]) & (scores[m] <= high[w]))
                    if len(at) > k:
                        edge = np.partition(scores[m][at], len(at) - k)[len(at) - k]
                        at = at[scores[m][at] >= edge]
                    at = at[np.lexsort((ids[met[at]], -scores[m][at]))[:k]]
                    out[0].extend([int(queries["id"][begin + q])] * len(at))
                    out[1].extend([int(name[w])] * len(at))
                    out[2].extend(scores[m][at].tolist())
                    out[3].extend(ids[met[at]].tolist())
    return out


def _matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    return np.asarray(column(batch, name).flatten(), np.int64).reshape(batch.num_rows, d)


class Index:
    """Candidates dealt to leaves and blocks: ``rows`` (d, leaf, sub, id, label, v), ``trees`` by length, ``blocks`` by (length, leaf)."""

    def __init__(self, rows: DataFrame, scratch: Scratch, sample: int, block_bytes: int):
        spark = rows.sparkSession
        self.scratch, self.block_bytes = scratch, block_bytes
        total = rows.agg(F.count("id").alias("n"), F.sum(F.size("v")).alias("c")).first()
        drawn: dict[int, list] = {}
        for v in rows.select("v").orderBy(F.xxhash64("v", "id")).limit(sample).toArrow().column("v"):
            x = np.asarray(v.values, np.float64)
            drawn.setdefault(len(x), []).append(x)
        most = max(1, min(LEAVES, (total.c or 0) * 8 // block_bytes))
        self.trees = {d: Tree(np.array(v).reshape(len(v), d), 1, max(1, most * len(v) // max(1, min(total.n, sample)))) for d, v in drawn.items()}
        trees = Shipped(spark.sparkContext.broadcast(self.trees))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = np.asarray(column(batch, "d"))
                for d in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == d))
                    v, tree = _matrix(part, "v", int(d)).astype(np.float64), trees.value.get(int(d))
                    leaf = tree.route(v) if tree else np.zeros(len(v), np.int64)
                    far = ((v - tree.means[-1][leaf]) ** 2).sum(axis=1) if tree else (v * v).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf, pa.int64()), pa.array(np.sqrt(far))], [*part.schema.names, "leaf", "far"])

        self._deal = lambda frame: frame.withColumn("d", F.size("v")).mapInArrow(deal, "id long, label long, v array<int>, d int, leaf long, far double")
        dealt = scratch.write(self._deal(rows.select("id", "label", "v")))
        found = dealt.groupBy("d", "leaf").agg(F.count("id").alias("n"), F.max("far").alias("far"))
        # A row for each length and leaf; the lengths beyond the sample's have one leaf each and no tree.
        sizes = found.withColumn("subs", F.ceil(F.col("n") * F.greatest(F.col("d"), F.lit(1)) * 8 / block_bytes).cast("int"))
        self.sizes = scratch.write(sizes)
        radii = {d: np.full(len(tree.radii[-1]), -1.0) for d, tree in self.trees.items()}
        for r in self.sizes.where(F.col("d").isin(list(self.trees))).toLocalIterator():  # the leaves of the sample's trees
            radii[r.d][r.leaf] = r.far * (1 + 1e-9)
        for d, tree in self.trees.items():
            tree.widen(radii[d])
        self.wide = Shipped(spark.sparkContext.broadcast(self.trees))
        numbered = dealt.join(F.broadcast(self.sizes.select("d", "leaf", "subs")) if self.sizes.count() <= 10 * LEAVES else self.sizes.select("d", "leaf", "subs"), ["d", "leaf"])
        self.rows = numbered.select("d", "leaf", F.pmod(F.xxhash64("id", "v"), "subs").cast("int").alias("sub"), "id", "label", "v")

    def home(self, queries: DataFrame) -> DataFrame:
        """queries (id, label, v, windows) with the leaf each belongs to, and its first block."""
        dealt = self._deal(queries.select("id", "label", "v")).select("id", "d", "leaf")
        return queries.join(dealt, "id").withColumn("sub", F.lit(0))

    def reached(self, queries: DataFrame) -> DataFrame:
        """queries (id, label, v, windows) with every block that may hold rows of their windows."""
        trees = self.wide

        def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = np.asarray(column(batch, "d"))
                for d in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == d))
                    ids, v, tree = np.asarray(column(part, "id")), _matrix(part, "v", int(d)).astype(np.float64), trees.value.get(int(d))
                    if tree is None:
                        who, leaf = np.arange(len(v)), np.zeros(len(v), np.int64)
                    else:
                        anchors = Tree(v)
                        least, most = (np.asarray(column(part, c)).astype(np.float64)[anchors.order] for c in ("least", "most"))
                        i, leaf = traverse(anchors, tree, least, most)
                        size = np.diff(anchors.limits[-1])[i]
                        who = anchors.order[np.repeat(anchors.limits[-1][i] - np.cumsum(size) + size, size) + np.arange(size.sum())] if len(i) else i
                        leaf = np.repeat(leaf, size)
                    for at in range(0, len(who), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[who[at : at + (1 << 16)]]), pa.array(np.full(len(who[at : at + (1 << 16)]), d, np.int32)), pa.array(leaf[at : at + (1 << 16)])], ["id", "d", "leaf"])

        bounds = queries.select("id", "v", F.size("v").alias("d"), F.array_min("windows.low").alias("least"), F.array_max("windows.high").alias("most"))
        met = bounds.mapInArrow(climb, "id long, d int, leaf long")
        subs = F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")
        return queries.join(met.join(self.sizes, ["d", "leaf"]).select("id", "d", "leaf", subs), "id")

    def best(self, queries: DataFrame, k: int, same: bool, parts: int, seeds: bool = False) -> DataFrame:
        """id, name, score, row of the k best rows of each window, over the blocks that the queries come with."""
        part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        none = F.lit(None).cast("array<struct<name:long,low:long,high:long>>")
        rows = self.rows.where("sub = 0") if seeds else self.rows
        rows = rows.select("d", "leaf", "sub", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), "id", "label", "v", none.alias("windows"))
        both = rows.unionByName(queries.select("d", "leaf", "sub", part.alias("part"), F.lit(1).alias("kind"), "id", "label", "v", "windows"))
        keys = ["d", "leaf", "sub", "part"]

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g in sorted_groups(batches, keys):
                kind = np.asarray(column(g, "kind"))
                split = int(np.searchsorted(kind, 1))
                if split in (0, len(kind)):
                    continue
                d = int(column(g, "d")[0].as_py())
                sides = [{"id": np.asarray(column(s, "id")), "label": np.asarray(column(s, "label")), "v": _matrix(s, "v", d)} for s in (g.slice(0, split), g.slice(split))]
                windows = column(g.slice(split), "windows")
                flat = windows.flatten()
                sides[1] |= {"of": np.repeat(np.arange(len(windows)), np.asarray(windows.value_lengths())), **{c: np.asarray(flat.field(c)) for c in ("name", "low", "high")}}
                found = best_of_block(sides[1], sides[0], k, same)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["id", "name", "score", "row"])

        dealt = both.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(meet, "id long, name long, score long, row long")
        order = Window.partitionBy("id", "name").orderBy(F.desc("score"), "row")
        return dealt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """id, name, score, row, rank of the k best rows in each window of each query."""
        size = queries.agg(F.sum(F.size("v")).alias("c")).first().c or 0
        parts = max(1, math.ceil(size * 8 / self.block_bytes))
        seeds = self.best(self.home(queries), k, same, parts, seeds=True).groupBy("id", "name").agg(F.count("row").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
        opened = queries.select("id", F.inline("windows")).join(seeds, ["id", "name"], "left")
        narrowed = opened.groupBy("id").agg(F.collect_list(F.struct("name", F.greatest("low", "kth").alias("low"), "high")).alias("windows"))
        known = self.scratch.write(queries.drop("windows").join(narrowed, "id"))
        return self.scratch.write(self.best(self.reached(known), k, same, parts))


def mine(vectors: DataFrame, anchor: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the hard negatives of each anchor and positive.

    anchor: a condition on the columns. Components count as floor(scale * x). A negative's score is low to high hundredths of the positive's.
    """
    spark = vectors.sparkSession
    prepare(spark)
    scratch = Scratch(spark)
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    usable = F.coalesce(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(F.floor(c * scale)) < LIMIT) & (F.abs(c) < LIMIT)), F.lit(False))
    rows = scratch.write(own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable).select("id", "label", "anchor", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v")))
    copies = Window.partitionBy("label", "v").orderBy("id")
    chosen = scratch.write(rows.select("id", "label", "v").withColumn("__n", F.row_number().over(copies)).where(F.col("__n") <= max(positives + 1, negatives)).drop("__n"))
    distinct = rows.where("anchor").select("label", "v").distinct()
    ends = F.struct(F.lit(0).cast("long").alias("name"), F.lit(-(1 << 63)).cast("long").alias("low"), F.lit((1 << 63) - 1).cast("long").alias("high"))
    queries = scratch.write(distinct.withColumn("id", F.monotonically_increasing_id()))
    index = Index(chosen, scratch, sample, block_bytes)
    near = index.search(queries.withColumn("windows", F.array(ends)), positives + 1, True)
    score, exact = F.col("score"), F.col("score").cast("decimal(20,0)")
    windows = near.select("id", score.alias("name"), F.ceil(exact * low / 100).cast("long").alias("low"), F.floor(exact * high / 100).cast("long").alias("high"))
    windows = windows.where("low <= high").distinct().groupBy("id").agg(F.collect_list(F.struct("name", "low", "high")).alias("windows"))
    hard = index.search(queries.join(windows, "id"), negatives, False).select("id", F.col("name").alias("positive_score"), "rank", F.col("row").alias("negative_id"), F.col("score").alias("negative_score"))
    listed = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-score).alias("under"), F.col("row").alias("positive_id")))).alias("tops"))
    named = rows.where("anchor").join(queries.withColumnRenamed("id", "query"), ["label", "v"]).join(listed.withColumnRenamed("id", "query"), "query")
    itself = F.struct((-F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c.cast("long"))).alias("under"), F.col("id").alias("positive_id"))
    at = F.array_position("tops", itself).cast("int")
    others = F.when(at > 0, F.concat(F.slice("tops", F.lit(1), at - 1), F.slice("tops", at + 1, F.size("tops")))).otherwise(F.col("tops"))
    pairs = named.select("query", F.col("id").alias("anchor_id"), F.explode(F.slice(others, 1, positives)).alias("p")).select("query", "anchor_id", "p.positive_id", (-F.col("p.under")).alias("positive_score"))
    return pairs.join(hard.withColumnRenamed("id", "query"), ["query", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
