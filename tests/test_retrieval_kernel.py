"""Nearest passages and best candidates against all pairs, ties and odd vectors included."""

import time

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval


def frame(spark, rows, name, more=""):
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>{more}")


def plain_nearest(queries, passages, k):
    out = {}
    for q, v in queries:
        scored = sorted((round(sum((x - y) ** 2 for x, y in zip(v, w, strict=True)), 5), c) for c, w in passages if w is not None and None not in w and len(w) == len(v)) if v is not None else []
        out |= {(q, rank): (c, round(1 - s, 5)) for rank, (s, c) in enumerate(scored[:k], 1)}
    return out


def test_nearest_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (400, 4)).astype(float).tolist()  # many ties
    passages = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [1.0, 2.0]), (903, []), (904, vectors[0])]
    queries = [(i, v) for i, v in enumerate(vectors[:40])] + [(50, [1.0, 2.0]), (51, None), (52, [5.0] * 7), (53, [])]
    p, q = frame(spark, passages, "chunk_index").repartition(5), frame(spark, queries, "query")
    wanted = plain_nearest(queries, passages, 3)
    for block in (retrieval.MAX_QUERIES, 9):
        got = {(r.query, r["rank"]): (r.chunk_index, round(r.score, 5)) for r in retrieval.nearest(q, p, block=block).collect()}
        assert got == wanted


def test_best_by_cosine_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    unit = rng.integers(-1, 2, (200, 3)).astype(float) + 0.01
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    queries, candidates = [(i, v.tolist()) for i, v in enumerate(unit[:120])] + [(500, None)], [(i, i, v.tolist()) for i, v in enumerate(unit[120:])]
    frames = frame(spark, queries, "query"), spark.createDataFrame(candidates, "candidate long, ord long, embedding array<double>")
    wanted = {}
    for q, v in queries[:-1]:
        best = max((round(sum(a * b for a, b in zip(v, w, strict=True)), 6), -o, c) for c, o, w in candidates)
        if best[0] > 0.5:
            wanted[q] = (best[2], best[0])
    assert {r.query: (r.candidate, r.cosine) for r in retrieval.best_by_cosine(*frames, 0.5).collect()} == wanted and wanted


def test_no_pairs_in_the_plan_and_time(spark):
    rng = np.random.default_rng(5)
    p = spark.range(4000).select(F.col("id").alias("chunk_index"), F.transform(F.sequence(F.lit(1), F.lit(768)), lambda i: F.sin(i * F.col("id").cast("double"))).alias("embedding")).persist()
    q = frame(spark, [(i, rng.standard_normal(768).tolist()) for i in range(50)], "query")
    p.count()
    found = retrieval.nearest(q, p)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan
    found.collect()
    began = time.perf_counter()
    got = {(r.query, r["rank"]): r.chunk_index for r in retrieval.nearest(q, p).collect()}
    took = time.perf_counter() - began
    squares = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    pairs = p.join(F.broadcast(q.select("query", F.col("embedding").alias("v")))).select("query", "chunk_index", F.round(squares(F.col("embedding"), F.col("v")), 5).alias("d"))
    best = pairs.groupBy("query").agg(F.min(F.struct("d", "chunk_index")).alias("b"))
    began = time.perf_counter()
    wanted = {r.query: r.b.chunk_index for r in best.collect()}
    slow = time.perf_counter() - began
    print(f"{took:.2f} s against {slow:.2f} s by expressions")
    assert {q: got[q, 1] for q in wanted} == wanted
    p.unpersist()


def test_small_blocks_of_queries_read_the_passages_once(spark):
    p = frame(spark, [(i, [float(i), 1.0]) for i in range(50)], "chunk_index")
    found = retrieval.nearest(frame(spark, [(i, [i + 0.25, 1.0]) for i in range(40)], "query"), p, k=1, block=3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(r.query, r.chunk_index) for r in found.orderBy("query").collect()] == [(i, i) for i in range(40)]
