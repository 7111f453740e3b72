"""Toxicity by cumulative-link ordinal regression over sparse text features.

Labels are grades, 0 for clean and more for worse, taken as they are: the distinct grades in their order, K + 1 of them. One weight
vector is shared by all thresholds, P(rank >= k) = logistic(w.x - t_k) with t_1 < ... < t_K, and the expected severity is the sum
of these probabilities, 0 to K. Labels of two values say nothing about degrees: there the toxic documents are split at the median amount
of toxic evidence into ranks 1 and 2, so that severity 2 means much evidence, not a label of that kind; ``split=False`` leaves one threshold.

Features are words and word beginnings of 4 to 8 letters, as log(1 + count). They are chosen by a two-sample z statistic, clean against
all others, over a bounded sample of labelled documents (PER_CLASS a grade, by hash of the id); every document is scored whole.

Defined cases: a null or empty text has severity 0 and is not toxic; labels that are null or whose document is
missing are not used, negative ones count as 0, several labels of one id count as the largest; more than MAX_GRADES grades are an error; without
labelled documents both clean and not all documents get severity 0; repeated rows are scored row by row; a very long text is
scored whole, alone in its worker; an empty table gives an empty result; other columns pass through ``keep_clean`` untouched, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import column, groups, texts_of
from .decontaminate import Shipped
from .store import Scratch, prepare

#: Bound of the labelled sample, a grade; most grades.
PER_CLASS, MAX_GRADES = 4000, 10
#: Features kept at most, and the least z statistic and number of sample documents of one.
MAX_FEATURES, MIN_Z, MIN_DOCS = 1024, 5.0, 5
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def features_of(word: str) -> list[str]:
    return [f"={word}", *(f"^{word[:k]}" for k in range(4, 9) if len(word) > k)]


def word_counts(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


class Model:
    """Selected features with weights, and the thresholds."""

    def __init__(self, names: list[str], weights: np.ndarray, length_weight: float, thresholds: np.ndarray):
        self.index = {n: i for i, n in enumerate(names)}
        self.weights, self.length_weight, self.thresholds = weights, length_weight, thresholds
        self.known: dict[str, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> tuple[dict[int, int], int]:
        """Count of each selected feature, number of words."""
        words, found, index, known = word_counts(text), defaultdict(int), self.index, self.known
        for w, n in words.items():
            own = known.get(w)
            if own is None:
                if len(known) > 200_000:
                    known.clear()
                own = known[w] = tuple(index[f] for f in features_of(w) if f in index)
            for i in own:
                found[i] += n
        return found, sum(words.values())

    def reach(self, text: str | None) -> list[float]:
        """P(rank >= k) for k = 1 to K."""
        found, n = self.counts(text)
        s = sum(self.weights[i] * math.log1p(c) for i, c in found.items()) + self.length_weight * math.log1p(n)
        return [1 / (1 + math.exp(min(700.0, float(t - s)))) for t in self.thresholds]


def graded(labels: DataFrame, label_id: str, label: str) -> DataFrame:
    """id and y, the largest grade of each id."""
    known = labels.where(F.col(label).isNotNull() & F.col(label_id).isNotNull())
    return known.groupBy(F.col(label_id).alias("id")).agg(F.greatest(F.max(F.col(label).cast("int")), F.lit(0)).alias("y"))


def grade_counts(grades: DataFrame) -> dict[int, int]:
    """Labelled ids of each grade, in order."""
    found = grades.groupBy("y").count().orderBy("y").limit(MAX_GRADES + 1).collect()
    if len(found) > MAX_GRADES:
        raise ValueError(f"more than {MAX_GRADES} grades")
    return {r.y: r["count"] for r in found}


def labelled_sample(docs: DataFrame, grades: DataFrame, levels: list[int], doc_id: str, text: str, per_class: int) -> DataFrame:
    """text and y of at most per_class labelled documents a grade, by hash of the id."""
    ids = None
    for y in levels:
        chosen = grades.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        ids = chosen if ids is None else ids.unionByName(chosen)
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id").select("text", "y")  # at most MAX_GRADES * per_class ids


def choose_features(sample: DataFrame) -> tuple[list[str], list[int]]:
    """Names of the features kept; sample documents that are clean and that are not."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in groups(batches, "text"):
            for t, y in zip(texts_of(batch, "text"), texts_of(batch, "y"), strict=True):
                for f in {f for w in word_counts(t) for f in features_of(w)} | {""}:
                    seen.setdefault(f, [0, 0])[min(y, 1)] += 1
            if len(seen) > 200_000:
                yield _tallied(seen)
                seen = {}
        yield _tallied(seen)

    totals = sample.mapInArrow(tally, "name string, clean long, toxic long").groupBy("name").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= MIN_DOCS)
    sizes = sample.agg(F.count_if(F.col("y") == 0).alias("clean"), F.count_if(F.col("y") > 0).alias("toxic")).first()
    n = [sizes.clean, sizes.toxic]
    if not all(n):
        return [], n
    p, q, both = F.col("toxic") / n[1], F.col("clean") / n[0], (F.col("toxic") + F.col("clean")) / sum(n)
    z = F.abs(p - q) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-12)) * (1 / n[0] + 1 / n[1]))
    top = totals.where(F.col("name") != "").withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "name").limit(MAX_FEATURES)
    return [r.name for r in top.collect()], n


def _tallied(seen: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], ["name", "clean", "toxic"])


def fit_ordinal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 1500, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of ranks y = 0 to K by maximum likelihood (Adam, with an L2 penalty).

    The parameters are the weights, the first threshold and the logarithms of the gaps between thresholds.
    """
    n, d = x.shape
    k = int(y.max())
    p = np.zeros(d + k)
    p[d] = 1.0
    first, second = np.zeros_like(p), np.zeros_like(p)
    weight = weight / weight.sum()
    thresholds = lambda: p[d] + np.concatenate(([0.0], np.cumsum(np.exp(p[d + 1 :]))))
    at = np.arange(n)
    reach, slope = np.zeros((n, k + 2)), np.zeros((n, k + 2))  # P(rank >= j) for j = 0 to K + 1, and its derivative
    reach[:, 0] = 1.0
    for step in range(1, steps + 1):
        w = p[:d]
        reach[:, 1:-1] = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - thresholds()[None, :], -60, 60)))
        slope[:, 1:-1] = reach[:, 1:-1] * (1 - reach[:, 1:-1])
        mass = np.maximum(reach[at, y] - reach[at, y + 1], 1e-12)
        by_t = np.zeros((n, k + 2))  # change of the log likelihood by each threshold
        by_t[at, y] -= weight * slope[at, y] / mass
        by_t[at, y + 1] += weight * slope[at, y + 1] / mass
        by_t[:, [0, -1]] = 0
        down = np.cumsum(by_t[:, 1:-1].sum(axis=0)[::-1])[::-1]  # thresholds from each one on
        grad = np.concatenate((-(x.T @ by_t.sum(axis=1)) - decay * w, down[:1], down[1:] * np.exp(p[d + 1 :])))
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        p += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return p[:d], thresholds()


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "toxic", per_class: int = PER_CLASS, split: bool = True) -> Model | None:
    """A model from at most ``per_class`` labelled documents a grade; None without both clean and other ones."""
    spark = docs.sparkSession
    prepare(spark)
    grades = graded(labels, label_id, label)
    counts = grade_counts(grades)
    levels = list(counts)
    if len(levels) < 2 or levels[0] != 0:
        return None
    sample = Scratch(spark).write(labelled_sample(docs, grades, levels, doc_id, text, per_class))
    names, n = choose_features(sample)
    if not all(n):
        return None
    blank = Model(names, np.zeros(len(names)), 0.0, np.zeros(0))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "text"):
            rows = [blank.counts(t) for t in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([list(f) for f, _ in rows], pa.list_(pa.int32())), pa.array([list(f.values()) for f, _ in rows], pa.list_(pa.int32())), pa.array([k for _, k in rows], pa.int64()), column(batch, "y")], ["at", "n", "words", "y"])

    rows = sample.mapInArrow(vectors, "at array<int>, n array<int>, words long, y int").collect()  # at most MAX_GRADES * per_class rows of MAX_FEATURES
    x, words = np.zeros((len(rows), len(names) + 1), np.float32), np.array([r.words for r in rows])
    for i, r in enumerate(rows):
        x[i, r["at"]] = np.log1p(np.array(r["n"], np.float32))
    x[:, -1] = np.log1p(words)
    known = sorted({r.y for r in rows})
    y = np.searchsorted(known, [r.y for r in rows])
    sizes, total = np.bincount(y), sum(counts[v] for v in known)
    weight = np.array([counts[v] / total for v in known])[y] / (sizes[y] / len(rows))
    if split and len(known) == 2:
        toxic = y > 0
        pointed = [i for i in range(len(names)) if x[toxic, i].mean() > x[~toxic, i].mean()]
        evidence = x[:, pointed].sum(axis=1)
        y = np.where(toxic, np.where(evidence >= np.median(evidence[toxic]), 2, 1), 0)
    w, thresholds = fit_ordinal(x.astype(np.float64), y, weight)
    return Model(names, w[:-1], float(w[-1]), thresholds)


_held: dict[int, Model] = {}


def _model(shipped: Shipped) -> Model:
    if shipped.id not in _held:
        _held.clear()
        _held[shipped.id] = shipped.value
    return _held[shipped.id]


def _reaches(batch: pa.RecordBatch, text: str, shipped: Shipped) -> list[list[float]]:
    model = _model(shipped)
    return [[0.0] if model is None or not t else model.reach(t) for t in texts_of(batch, text)]


def score(docs: DataFrame, model: Model | None, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, expected severity (0 to K), grade (ranks reached with at least even odds), probability of any toxicity, toxic."""
    prepare(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shipped = Shipped(own.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, "text"):
            reach = _reaches(batch, "text", shipped)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([sum(r) for r in reach], pa.float64()), pa.array([sum(v >= 0.5 for v in r) for r in reach], pa.int32()), pa.array([r[0] for r in reach], pa.float64()), pa.array([r[0] >= threshold for r in reach], pa.bool_())], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return own.mapInArrow(run, T.StructType([T.StructField("doc_id", own.schema["doc_id"].dataType), T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())]))


def keep_clean(docs: DataFrame, model: Model | None, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that are not toxic."""
    prepare(docs.sparkSession)
    shipped = Shipped(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups(batches, text):
            yield batch.filter(pa.array([r[0] < threshold for r in _reaches(batch, text, shipped)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
