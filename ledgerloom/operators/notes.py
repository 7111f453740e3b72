"""Numbered notes of a document's text: header matches, blocks, merging, tables, cross-references.

Header and reference search need match offsets of overlapping patterns with look-behind, which no column function gives; they
run in Arrow batch functions over whole texts. Everything after them is windows, joins and aggregates.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_ref
from . import pages as pages_ops
from .tables import distinct_tables

#: The three header styles, the opening of the notes, and the five styles of cross-reference.
LINE_HEADER = r"^(?:Note|NOTE)\s+(\d+)\s*(?:[\(\[]\s*([a-zA-Z])\s*[\)\]])?\s*[:\.]?\s*([^\n]*?)(?=\s+(?:Note|NOTE)\s+\d|$)"
INLINE_HEADER = r"(?<=\S)\s+(?:Note|NOTE)\s+(\d+)\s*(?:[\(\[]\s*([a-zA-Z])\s*[\)\]])?\s*:\s*([^\n]*?)(?=\s+(?:Note|NOTE)\s+\d|$)"
DECIMAL_HEADER = r"^(\d{1,2}\.\d{1,2})()\.?\s+([A-Z][^\n]*?)(?=\s+\d{1,2}\.\d{1,2}\.?\s+[A-Z]|$)"
OPENING = r"Notes\s+to\s+(?:\S+\s+){0,5}?(?:Financial\s+Statements?|Accounts)"
REFERENCES = (r"refer\s+note\s+no\.?\s*(\d+(?:\s*[\(\[]\s*[a-zA-Z]\s*[\)\]])?)", r"\(see\s+note\s+(\d+)\)", r"as\s+per\s+note\s+(\d+)", r"\(refer\s+note\s+(\d+)\)", r"note\s+no\.?\s*(\d+)\s+for\s+further")
#: What a text must hold, whatever its case, for each style of reference; other styles are not searched for.
LEADS = ("refer", "see", "per", "(refer", "further")
SENTENCE_END = r"(?<=[.!?])\s+"

_STYLES = [regex.compile(p, regex.M) for p in (LINE_HEADER, INLINE_HEADER, DECIMAL_HEADER)]
_OPENING = regex.compile(OPENING, regex.I)
_REFERENCES, _SENTENCE_END = [regex.compile(p, regex.I) for p in REFERENCES], regex.compile(SENTENCE_END)


def find_headers(text: str) -> list[tuple[int, int, str, str, str]]:
    """(offset, style, number, letter, title), in order of offset, then style; the styles may match one header twice."""
    opening = _OPENING.search(text)
    begin = opening.end() if opening else 0
    found = [(m.start(), k, m[1], (m[2] or "").lower(), m[3].strip()) for k, style in enumerate(_STYLES) for m in style.finditer(text, pos=begin)]
    return sorted(found, key=lambda x: (x[0], x[1]))


def headers(texts: DataFrame) -> DataFrame:
    """doc_id, start, style, note_id, full_id, title of each header in full_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = find_headers(text or "")
                rows += own
                docs += [i] * len(own)
            ids = [n + a for _, _, n, a, _ in rows]
            full = [f"Note {n}" + (f"({a})" if a else "") for _, _, n, a, _ in rows]
            titles = [t or f for (*_, t), f in zip(rows, full, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array(ids, pa.string()), pa.array(full, pa.string()), pa.array(titles, pa.string())], ["doc_id", "start", "style", "note_id", "full_id", "title"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "full_text").mapInArrow(run, f"doc_id {kind}, start int, style int, note_id string, full_id string, title string")


def blocks(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Each header's text up to the next header."""
    order = Window.partitionBy("doc_id").orderBy("start", "style")
    ended = found.withColumns({"block_ord": F.row_number().over(order), "next": F.lead("start").over(order)}).join(texts, "doc_id")
    end = F.coalesce("next", F.length("full_text"))
    return ended.select("doc_id", "block_ord", "note_id", "full_id", "title", "start", end.alias("end"), F.regexp_replace(F.substring("full_text", F.col("start") + 1, end - F.col("start")), r"(?U)^\s+|\s+$", "").alias("raw_text"))


def merge_blocks(placed: DataFrame) -> DataFrame:
    """One note an id: texts joined by line feeds, first title and first page, largest last page."""
    parts = F.array_sort(F.collect_list(F.struct("block_ord", "raw_text")))
    return placed.groupBy("doc_id", "note_id").agg(
        F.min("block_ord").alias("note_ord"), F.min_by("full_id", "block_ord").alias("full_id"), F.min_by("title", "block_ord").alias("title"),
        F.array_join(F.transform(parts, lambda p: p.raw_text), "\n").alias("raw_text"), F.min_by("page_start", "block_ord").alias("page_start"), F.max("page_end").alias("page_end"),
    )


def notes(pages: DataFrame) -> DataFrame:
    """The notes of documents given as pages (doc_id, page_num, raw_text)."""
    texts, placed = pages_ops.full_text(pages), pages_ops.page_offsets(pages)
    cut = blocks(headers(texts), texts).withColumn("stop", F.greatest(F.col("end") - 1, F.col("start")))
    first = pages_ops.offsets_to_pages(cut, placed, ["block_ord"], "start", "page_start")
    return merge_blocks(pages_ops.offsets_to_pages(first, placed, ["block_ord"], "stop", "page_end"))


def note_tables(found: DataFrame, tables: DataFrame) -> DataFrame:
    """Every table on a page of a note's range, equal ones once."""
    spread = found.select("doc_id", "note_id", "note_ord", F.explode(F.sequence("page_start", "page_end")).alias("page_num"))
    return distinct_tables(tables.join(spread, ["doc_id", "page_num"]), ["doc_id", "note_id"])


def sentence_around(text: str, starts: list[int], sentences: list[str], at: int) -> str:
    """The sentence that a place falls in, counting one character between sentences; 80 characters each way behind the last."""
    k = bisect_right(starts, at) - 1
    if at <= starts[k] + len(sentences[k]):
        return sentences[k].strip()
    return text[max(0, at - 80) : at + 80].strip()


def find_references(text: str) -> list[tuple[int, int, str, str]]:
    """(style, position among the style's matches, reference, sentence around it)."""
    folded = text.casefold()
    found = [(k, n, m[1], m.start()) for k, (style, lead) in enumerate(zip(_REFERENCES, LEADS, strict=True)) if lead in folded for n, m in enumerate(style.finditer(text))]
    if not found:
        return []
    sentences, starts, at = _SENTENCE_END.split(text), [], 0
    for s in sentences:
        starts.append(at)
        at += len(s) + 1
    return [(k, n, ref, sentence_around(text, starts, sentences, place)) for k, n, ref, place in found]


def mentions(found: DataFrame) -> DataFrame:
    """doc_id, src, src_ord, style, pos, ref and context of each reference in the notes' texts, in one pass over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                own = find_references(text or "")
                rows += own
                at += [i] * len(own)
            taken = pa.array(at, pa.int64())
            columns = [batch.column(i).take(taken) for i in range(3)]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], ["doc_id", "src", "src_ord", "style", "pos", "ref", "context"])

    texts = found.select("doc_id", F.col("note_id").alias("src"), F.col("note_ord").cast("int").alias("src_ord"), "raw_text")
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, src string, src_ord int, style int, pos int, ref string, context string")


def references(found: DataFrame) -> DataFrame:
    """Edges from note to note, doc_id, src, dst, edge_ord (first mention), mentions and context (of the last one); not to itself or to unknown notes."""
    named = mentions(found).withColumn("dst", normalize_ref(F.col("ref"))).where(F.col("src") != F.col("dst"))
    known = named.join(found.select("doc_id", F.col("note_id").alias("dst")), ["doc_id", "dst"], "left_semi")
    order = F.struct("src_ord", "style", "pos")
    return known.groupBy("doc_id", "src", "dst").agg(F.min(order).alias("edge_ord"), F.count("*").alias("mentions"), F.max_by("context", order).alias("context"))


def graph_counts(found: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = found.groupBy("doc_id").agg(F.count("*").alias("nodes"))
    return nodes.join(edges.groupBy("doc_id").agg(F.count("*").alias("edges")), "doc_id", "left").fillna(0, ["edges"])


def depth_first(root: str, edges: list[dict], depth: int) -> list[tuple[str, str | None]]:
    """(note, note it was met from) in the order of a walk from the root, each note once. edges: src, dst, in the order of their mentions.

    A note met first at the last depth is not gone on from, even if a later branch would meet it nearer to the root.
    """
    ahead: dict[str, list[str]] = {}
    for e in edges:
        ahead.setdefault(e["src"], []).append(e["dst"])
    seen, out = {root}, [(root, None)]
    walk = [(root, iter(ahead.get(root, ())))] if depth > 0 else []
    while walk:
        node, rest = walk[-1]
        met = next((n for n in rest if n not in seen), None)
        if met is None:
            walk.pop()
            continue
        seen.add(met)
        out.append((met, node))
        if len(walk) < depth:
            walk.append((met, iter(ahead.get(met, ()))))
    return out


def walks(roots: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """doc_id, root, place, node, via of the notes met from each root (doc_id, root) within ``depth`` steps, in depth-first order.

    The edges that a walk can use are gathered frontier by frontier, from the roots alone; the walk itself is over one root's edges, those of one filing at most.
    """
    # Kept edges and notes are small as files and large in memory, many times so; a join left to the planner would broadcast them.
    step = edges.select("doc_id", F.col("src").alias("node"), "dst", "edge_ord").hint("merge")
    seen = frontier = roots.select("doc_id", "root", F.col("root").alias("node")).distinct()
    used = None
    for k in range(depth):
        ahead = frontier.join(step, ["doc_id", "node"])
        used = ahead if used is None else used.unionByName(ahead)
        if k + 1 < depth:
            frontier = ahead.select("doc_id", "root", F.col("dst").alias("node")).distinct().join(seen, ["doc_id", "root", "node"], "left_anti")
            seen = seen.unionByName(frontier)
    start = roots.select("doc_id", "root").distinct()
    if used is None:
        listed = start.withColumn("edges", F.array().cast("array<struct<src:string,dst:string>>"))
    else:
        own = F.transform(F.array_sort(F.collect_list(F.struct("edge_ord", "node", "dst"))), lambda e: F.struct(e["node"].alias("src"), e["dst"].alias("dst")))
        listed = start.join(used.groupBy("doc_id", "root").agg(own.alias("edges")), ["doc_id", "root"], "left")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, rows = [], [], []
            for i, (root, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                found = depth_first(root, own or [], depth)
                at += [i] * len(found)
                places += range(len(found))
                rows += found
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(places, pa.int32()), *(pa.array([r[i] for r in rows], pa.string()) for i in (0, 1))], ["doc_id", "root", "place", "node", "via"])

    return listed.mapInArrow(walk, f"doc_id {roots.schema['doc_id'].dataType.simpleString()}, root string, place int, node string, via string")


def resolved_texts(found: DataFrame, edges: DataFrame, roots: DataFrame | None = None, depth: int = 2) -> DataFrame:
    """Notes with what they refer to, ``depth`` steps deep, in depth-first order, each note once; of the roots (doc_id, note_id) alone if they are given."""
    known = found.select("doc_id", F.col("note_id").alias("root"))
    wanted = known if roots is None else known.join(roots.select("doc_id", F.col("note_id").alias("root")).distinct(), ["doc_id", "root"], "left_semi")
    told = walks(wanted, edges, depth).join(found.select("doc_id", F.col("note_id").alias("node"), "full_id", "raw_text").hint("merge"), ["doc_id", "node"])
    piece = F.concat(F.lit("=== "), "full_id", F.coalesce(F.concat(F.lit(" (referenced by Note "), "via", F.lit(")")), F.lit("")), F.lit(" ===\n"), "raw_text")
    parts = F.array_sort(F.collect_list(F.struct("place", piece.alias("piece"))))
    return told.groupBy("doc_id", F.col("root").alias("note_id")).agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "\n\n").alias("resolved"))


def first_notes(flags: DataFrame) -> DataFrame:
    """doc_id, note_id of the notes whose text some flag asks for."""
    return flags.select("doc_id", normalize_ref(F.get("note_ids", F.lit(0))).alias("note_id")).where(F.col("note_id").isNotNull()).distinct()


def flag_notes(flags: DataFrame, resolved: DataFrame) -> DataFrame:
    """The flags with note_text: the resolved text of the first note they name, empty where it is not there."""
    wanted = flags.withColumn("__note", normalize_ref(F.get("note_ids", F.lit(0))))
    texts = resolved.select("doc_id", F.col("note_id").alias("__note"), F.col("resolved").alias("note_text"))
    return wanted.join(texts, ["doc_id", "__note"], "left").withColumn("note_text", F.coalesce("note_text", F.lit(""))).drop("__note")
