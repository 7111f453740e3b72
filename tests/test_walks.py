"""Walks over references against a plain recursion on random graphs."""

import random

import pytest

from ledgerloom.operators import notes


def plain_walk(root, ahead, known, most):
    seen, out = set(), []

    def visit(node, depth, via):
        if node in seen or node not in known:
            return
        seen.add(node)
        out.append((node, via))
        if depth < most:
            for n in ahead.get(node, ()):
                visit(n, depth + 1, node)

    visit(root, 0, None)
    return out


def graphs(n, seed=2):
    rng = random.Random(seed)
    found, edges = [], []
    for doc in range(n):
        names = [str(k) for k in range(1, rng.randrange(2, 10))]
        found += [(doc, x, i, f"Note {x}", f"text {doc} {x}") for i, x in enumerate(names)]
        pairs = [(a, b) for a in names for b in names if a != b and rng.random() < 0.35]
        for i, (a, b) in enumerate(pairs):
            edges.append((doc, a, b, (names.index(a), rng.randrange(3), i)))
    return found, edges


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 5])
def test_walks_equal_a_plain_recursion(spark, depth):
    found, edges = graphs(60)
    notes_of = spark.createDataFrame(found, "doc_id long, note_id string, note_ord int, full_id string, raw_text string")
    given = spark.createDataFrame(edges, "doc_id long, src string, dst string, edge_ord struct<src_ord:int,style:int,pos:int>")
    got = {(r.doc_id, r.note_id): r.resolved for r in notes.resolved_texts(notes_of, given, depth=depth).collect()}
    known, ahead, text = {}, {}, {}
    for doc, x, _, full, raw in found:
        known.setdefault(doc, set()).add(x)
        text[doc, x] = (full, raw)
    for doc, a, b, o in sorted(edges, key=lambda e: e[3]):
        ahead.setdefault(doc, {}).setdefault(a, []).append(b)
    wanted = {}
    for doc, x, *_ in found:
        parts = [f"=== {text[doc, n][0]}{f' (referenced by Note {via})' if via else ''} ===\n{text[doc, n][1]}" for n, via in plain_walk(x, ahead.get(doc, {}), known[doc], depth)]
        wanted[doc, x] = "\n\n".join(parts)
    assert got == wanted


def test_a_note_met_on_a_dead_branch_is_told_by_a_later_one():
    edges = [{"src": s, "dst": d} for s, d in (("r", "a"), ("r", "b"), ("r", "c"), ("a", "b"), ("b", "x"), ("c", "x"))]
    assert notes.depth_first("r", edges, 2) == [("r", None), ("a", "r"), ("b", "a"), ("c", "r"), ("x", "c")]


def test_only_wanted_roots_are_walked(spark):
    found, edges = graphs(20, 5)
    notes_of = spark.createDataFrame(found, "doc_id long, note_id string, note_ord int, full_id string, raw_text string")
    given = spark.createDataFrame(edges, "doc_id long, src string, dst string, edge_ord struct<src_ord:int,style:int,pos:int>")
    roots = spark.createDataFrame([(3, "1"), (3, "1"), (4, "2"), (4, "none"), (99, "1"), (None, "1"), (5, None)], "doc_id long, note_id string")
    every = {(r.doc_id, r.note_id): r.resolved for r in notes.resolved_texts(notes_of, given).collect()}
    got = {(r.doc_id, r.note_id): r.resolved for r in notes.resolved_texts(notes_of, given, roots).collect()}
    assert got == {k: v for k, v in every.items() if k in {(3, "1"), (4, "2")}} and len(got) >= 1
    assert notes.resolved_texts(notes_of, given.limit(0), roots).count() == len(got)
