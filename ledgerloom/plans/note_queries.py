"""Queries of header styles, sentences around references, walks over references and refused labels, with SQL that computes from the same text.

A document is an order, its notes or lines are its line items.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapping, notes
from .analysis import Analysis
from .queries import _derived, _query

#: Line items, numbered within their order.
_LINES = "(SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INT) AS l_linenumber FROM lineitem) AS lines"
#: A line of each header style: decimal number, at the line's start, within a line.
_LINE = """CASE l_returnflag WHEN 'A' THEN concat(CAST(l_linenumber AS STRING), '.', CAST(CAST(l_quantity AS INT) AS STRING), ' Title ', CAST(l_partkey AS STRING))
 WHEN 'N' THEN concat('Note ', CAST(l_linenumber AS STRING), ' (', l_linestatus, ') Title ', CAST(l_partkey AS STRING)) ELSE concat('as told in Note ', CAST(l_linenumber AS STRING), ' [', l_linestatus, '] : Inline ', CAST(l_partkey AS STRING)) END"""


@_query("note_header_styles", f"""WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_returnflag AS kind, lower(l_linestatus) AS letter, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q, CAST(l_partkey AS VARCHAR) AS part, {_LINE} AS line FROM {_LINES}),
p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT doc_id, CAST(before + CASE kind WHEN 'R' THEN 10 ELSE 0 END AS INTEGER) AS start, CASE kind WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS style, CASE kind WHEN 'A' THEN n || '.' || q ELSE n || letter END AS note_id,
 CASE kind WHEN 'A' THEN 'Note ' || n || '.' || q ELSE 'Note ' || n || '(' || letter || ')' END AS full_id, CASE kind WHEN 'R' THEN 'Inline ' ELSE 'Title ' END || part AS title FROM p""")  # fmt: skip
def note_header_styles(spark, sf_dir):
    lines = _derived(spark, sf_dir, f"SELECT * FROM {_LINES}", "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", F.expr(_LINE).alias("line")).alias("l"))
    texts = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("full_text"))
    return notes.headers(texts)


#: A note that refers to the next one of its order, the last to the first.
_NOTE = f"""SELECT l_orderkey AS doc_id, CAST(l_linenumber AS STRING) AS note_id, l_linenumber AS note_ord, concat('Note ', CAST(l_linenumber AS STRING)) AS full_id, concat('Paid ', CAST(CAST(l_quantity AS INT) AS STRING), ' units.  ',
 CASE l_returnflag WHEN 'A' THEN concat('Refer note no. ', CAST(l_linenumber % count(*) OVER (PARTITION BY l_orderkey) + 1 AS STRING), ' for terms') WHEN 'N' THEN concat('It grew (see note ', CAST(l_linenumber % count(*) OVER (PARTITION BY l_orderkey) + 1 AS STRING), ') again')
 ELSE concat('As per note ', CAST(l_linenumber % count(*) OVER (PARTITION BY l_orderkey) + 1 AS STRING), ' it fell') END, '!  The end of ', CAST(l_suppkey AS STRING), '.') AS raw_text FROM {_LINES}"""
_NEXT = f"n AS ({_NOTE}), r AS (SELECT *, regexp_extract(raw_text, '(?i)note (?:no\\. )?(\\d+)', 1) AS dst FROM n)"


def _linked_notes(spark, sf_dir):
    return _derived(spark, sf_dir, _NOTE, "lineitem")


@_query("reference_contexts", rf"""WITH {_NEXT}, s AS (SELECT *, string_split(regexp_replace(raw_text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS sentences FROM r WHERE dst <> note_id)
SELECT doc_id, note_id AS src, dst, 1 AS mentions, trim(list_filter(sentences, lambda x: regexp_matches(x, '(?i)note'))[1]) AS context FROM s""")  # fmt: skip
def reference_contexts(spark, sf_dir):
    found = notes.references(_linked_notes(spark, sf_dir))
    return found.select("doc_id", "src", "dst", F.col("mentions").cast("int").alias("mentions"), "context")


@_query("note_walks", rf"""WITH {_NEXT}, f AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS VARCHAR) AS note_id FROM {_LINES} WHERE l_returnflag = 'R'),
own AS (SELECT r.* FROM r JOIN f USING (doc_id, note_id))
SELECT a.doc_id, a.note_id, '=== ' || a.full_id || ' ===' || chr(10) || a.raw_text || CASE WHEN b.note_id IS NULL OR a.dst = a.note_id THEN '' ELSE chr(10) || chr(10) || '=== ' || b.full_id || ' (referenced by Note ' || a.note_id || ') ===' || chr(10) || b.raw_text
 || CASE WHEN c.note_id IS NULL OR b.dst IN (a.note_id, b.note_id) THEN '' ELSE chr(10) || chr(10) || '=== ' || c.full_id || ' (referenced by Note ' || b.note_id || ') ===' || chr(10) || c.raw_text END END AS resolved
FROM own a LEFT JOIN r b ON b.doc_id = a.doc_id AND b.note_id = a.dst LEFT JOIN r c ON c.doc_id = a.doc_id AND c.note_id = b.dst""")  # fmt: skip
def note_walks(spark, sf_dir):
    """Two steps from the notes that a condition names, as flags do; notes and references are kept, as the analysis keeps them, not found anew in each step."""
    run = Analysis(spark)
    found = run.keep("notes", _linked_notes(spark, sf_dir))
    edges = run.keep("references", notes.references(found))
    named = _derived(spark, sf_dir, f"SELECT * FROM {_LINES}", "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("note_id"))
    return notes.resolved_texts(found, edges, named)


_LABEL = """SELECT DISTINCT CASE WHEN p_size < 12 THEN concat('Total ', CAST(p_size * 100 AS STRING)) WHEN p_size < 24 THEN concat(' (', p_brand, ') [', p_type, '] ') WHEN p_size < 36 THEN concat('Inventories (', p_name, '): ') ELSE concat('Trade receivables  ', CAST(p_size AS STRING), ',000') END AS raw_label FROM part"""


@_query("refused_labels", f"""WITH l AS ({_LABEL}), c AS (SELECT raw_label, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw_label)), '\\([^)]*\\)|\\[[^\\]]*\\]', '', 'g'), '\\s*:+$', ''), '(\\s+[\\d,]+)+$', '')) AS label FROM l)
SELECT raw_label, label, CASE label WHEN 'inventories' THEN 'inventories' WHEN 'trade receivables' THEN 'trade_receivables' END AS canonical_key, CASE WHEN label IN ('', 'total') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence, CASE WHEN label IN ('', 'total') THEN 'unknown' ELSE 'exact' END AS method FROM c""")  # fmt: skip
def refused_labels(spark, sf_dir):
    """Labels that are empty or "total" once they are cleaned map to nothing, whatever they are like; the others are known."""
    return mapping.map_labels(_derived(spark, sf_dir, _LABEL, "part"))
