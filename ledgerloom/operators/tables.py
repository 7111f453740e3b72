"""Extracted tables: cleaning, reconstruction, merging and reading rows. A table is headers and rows of strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.figures import figures
from ..functions.text import DIGIT, blank, fix_reversed, is_number, label_fill, let, note_reference, otherwise_null, parse_text_line, strip


def _drop_blank_and_repeats(rows: Column) -> Column:
    """Without blank rows, and without later rows equal to a first row that is not blank."""
    full = lambda r: F.exists(r, lambda c: ~F.coalesce(blank(c), F.lit(True)))
    headed = lambda rs: let(F.get(rs, F.lit(0)), lambda first: F.struct(rs.alias("rows"), first.alias("first"), full(first).alias("full")))
    kept = lambda t: F.filter(t["rows"], lambda r, i: full(r) & ((i == 0) | ~(t["full"] & r.eqNullSafe(t["first"]))))
    return let(let(rows, headed), kept)


def clean_pdf_rows(rows: Column) -> Column:
    cell = lambda c: strip(F.replace(fix_reversed(strip(F.coalesce(c, F.lit("")))), F.lit("\n"), F.lit(" ")))
    return _drop_blank_and_repeats(F.transform(rows, lambda r: F.transform(r, cell)))


def clean_docx_rows(rows: Column) -> Column:
    return _drop_blank_and_repeats(F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit(""))))))


def is_empty_table(headers: Column, rows: Column) -> Column:
    some = F.exists(rows, lambda r: F.exists(r, lambda c: ~F.coalesce(blank(c), F.lit(True))))
    return (F.coalesce(F.size(headers), F.lit(0)) < 1) | (F.coalesce(F.size(rows), F.lit(0)) < 1) | ~F.coalesce(some, F.lit(False))


def reconstruct(pages: DataFrame) -> DataFrame:
    """One table a page from its text lines: at least five value lines and a quarter of all lines."""
    lines = F.filter(F.transform(F.split("raw_text", r"\R|[\x1c-\x1e]"), strip), lambda s: s != "")
    parsed = lambda ls: F.filter(F.transform(ls, parse_text_line), lambda x: x.isNotNull())
    rows = lambda ls: F.transform(parsed(ls), lambda x: F.array(x["label"], x["note_ref"], x["first"], x["second"]))
    # Unfolded from an array of one: a filter of plain columns would be pushed down with the whole parsing in it, for each use anew.
    found = pages.select("doc_id", "page_num", F.inline(F.array(let(lines, lambda ls: F.struct(F.size(ls).alias("n_lines"), rows(ls).alias("rows"))))))
    fits = (F.size("rows") >= 5) & (F.size("rows") / F.col("n_lines") >= 0.25)
    return found.where(fits).select("doc_id", "page_num", F.array(*map(F.lit, ("Particulars", "Note", "Current", "Prior"))).alias("headers"), "rows")


def choose_tables(tables: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """A page's tables, or its rebuilt one where none is there or all have under half their labels and it has more."""
    page = Window.partitionBy("doc_id", "page_num")
    known = F.col("doc_id").isNotNull() & F.col("page_num").isNotNull()  # an unknown page's tables and rebuilt ones are not of one page
    side = lambda df, new: df.select(*tables.columns, label_fill(F.col("rows")).alias("__own"), F.lit(new).alias("__new"))
    both = side(tables, False).unionByName(side(rebuilt.withColumn("table_ord", F.lit(0)), True))
    judged = both.withColumn("__fill", F.when(known, F.max(F.when(~F.col("__new"), F.col("__own"))).over(page)))
    better = F.col("__new") & (F.col("__fill").isNull() | F.coalesce((F.col("__fill") < 0.5) & (F.col("__own") > F.col("__fill")), F.lit(False)))
    told = judged.withColumn("__better", better).withColumn("__replaced", known & F.bool_or("__better").over(page))
    return told.where(F.col("__better") | (~F.col("__new") & ~F.col("__replaced"))).select(*tables.columns)


def merge_across_pages(tables: DataFrame) -> DataFrame:
    """The last table of a page takes over the first of the next if their headers are equal; a page left empty passes nothing on.

    Runs of single-table pages therefore merge in pairs.
    """
    page = Window.partitionBy("doc_id", "page_num").orderBy("table_ord")
    whole = Window.partitionBy("doc_id").orderBy("page_num", "table_ord")
    marked = tables.withColumns({"first": F.row_number().over(page) == 1, "last": F.lead("table_ord").over(page).isNull(), "before": F.lag(F.struct("page_num", "headers")).over(whole)})
    joins = F.col("first") & (F.col("before.page_num") == F.col("page_num") - 1) & F.col("before.headers").eqNullSafe(F.col("headers"))
    marked = marked.withColumn("joins", F.coalesce(joins, F.lit(False)))
    # A run goes on while tables join and are alone on their page; within it every second table is taken over.
    starts = ~F.col("joins") | ~F.coalesce(F.lag(F.col("first") & F.col("last")).over(whole), F.lit(False))
    run = F.sum(F.when(starts, 1).otherwise(0)).over(whole)
    numbered = marked.withColumn("starts", starts).withColumn("run", run)
    place = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("page_num", "table_ord")) - 1
    # The first of a run may itself be taken over by a page of several tables.
    placed = numbered.withColumn("place", place).withColumn("shift", F.max(F.when((F.col("place") == 0) & F.col("joins"), 1).otherwise(0)).over(Window.partitionBy("doc_id", "run")))
    taken = F.when(F.col("place") == 0, F.col("joins")).otherwise((F.col("place") + F.col("shift")) % 2 == 1)
    owner = F.sum(F.when(taken, 0).otherwise(1)).over(whole)
    owned = placed.withColumn("taken", taken).withColumn("owner", owner)
    parts = F.array_sort(F.collect_list(F.struct("page_num", "table_ord", "rows")))
    return owned.groupBy("doc_id", "owner").agg(F.min(F.struct("page_num", "table_ord", "headers")).alias("t"), F.flatten(F.transform(parts, lambda p: p["rows"])).alias("rows")).select("doc_id", "t.page_num", "t.table_ord", "t.headers", "rows")


def distinct_tables(tables: DataFrame, by: list[str]) -> DataFrame:
    """The first of tables equal in headers and rows."""
    order = Window.partitionBy(*by, "headers", "rows").orderBy("page_num", "table_ord")
    return tables.withColumn("__n", F.row_number().over(order)).where(F.col("__n") == 1).drop("__n")


def note_columns(headers: Column) -> Column:
    """Numbers (from 0) of the columns whose header names notes or schedules."""
    fits = lambda h: F.coalesce(strip(h).rlike(r"(?iU)^(?:note|notes|schedule|schedules)\s*(?:no\.?|number)?$"), F.lit(False))
    return F.filter(F.transform(headers, lambda h, i: F.when(fits(h), i)), lambda i: i.isNotNull())


def _reference(cell: Column) -> Column:
    """The note that a text names; texts that cannot name one are not searched."""
    return note_reference(F.when(cell.contains(")") | F.lower(cell).contains("note"), cell))


def _short_reference(cell: Column, value: Column) -> Column:
    """A short cell that is a reference and no number."""
    return F.when(value.isNull() & (F.length(strip(cell)) <= 6), _reference(cell))


def _relisted(shape: pa.Array, values: pa.Array) -> pa.Array:
    """The values in lists of the lengths of other lists, null where those are."""
    lengths = pc.fill_null(pc.list_value_length(shape), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), values, mask=shape.is_null())


def _with_values(tables: DataFrame) -> DataFrame:
    """The tables with the number of each cell (``values``), a leading digit that extraction cut off put back. Distinct cells of a batch are parsed once."""
    own = tables.sparkSession._jsparkSession.sessionState().conf()
    if not own.contains("spark.sql.execution.arrow.maxBytesPerBatch"):
        tables.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("rows"))
            cells = rows.flatten()
            distinct = cells.flatten().dictionary_encode()
            found = figures(distinct.dictionary).take(distinct.indices)
            yield pa.RecordBatch.from_arrays([*batch.columns, _relisted(rows, _relisted(cells, found))], [*batch.schema.names, "values"])

    return tables.mapInArrow(run, T.StructType([*tables.schema.fields, T.StructField("values", T.ArrayType(T.ArrayType(T.DoubleType())))]))


def read_rows(tables: DataFrame) -> DataFrame:
    """label, current, prior and note_ref of each row that has a label in its first cell.

    current and prior are the first two numbers of the row outside note columns; note_ref is the label's, else the first that a note
    column or a short cell gives.
    """
    keys = [c for c in tables.columns if c not in ("headers", "rows")]
    valued = _with_values(tables.select(*keys, "rows", note_columns(F.col("headers")).alias("notes")))
    rows = valued.select(*keys, "notes", F.posexplode(F.arrays_zip("rows", "values")).alias("row_ord", "row"))
    cells = rows.select(*keys, "notes", "row_ord", F.col("row.rows").alias("cells"), F.col("row.values").alias("values"), strip(F.get("row.rows", F.lit(0))).alias("label"))
    number = F.col("label").rlike(DIGIT) & is_number(F.col("label"))  # few labels hold digits
    named = cells.where((F.length("label") >= 3) & ~number)
    noted = lambda i: F.coalesce(F.array_contains("notes", i), F.lit(False))
    numbers = F.filter(F.transform("values", lambda v, i: F.when((i > 0) & ~noted(i), v)), lambda v: v.isNotNull())
    own = lambda c, i: F.when(i > 0, F.when(noted(i), otherwise_null(strip(c))).otherwise(_short_reference(c, F.get("values", i))))
    ref = F.get(F.filter(F.transform("cells", own), lambda r: r.isNotNull()), F.lit(0))
    read = named.withColumns({"numbers": numbers, "own": _reference(F.col("label"))})
    note_ref = F.when(F.col("own").isNotNull(), F.col("own")).otherwise(ref)
    return read.select(*keys, "row_ord", "label", note_ref.alias("note_ref"), F.get("numbers", F.lit(0)).alias("current"), F.get("numbers", F.lit(1)).alias("prior"))


#: Rows of a sheet, as a power of two, whose merged ranges meet the cells together.
BLOCK = 3


def fill_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells of a merged range take its top left value, the largest where ranges overlap.

    Both sides carry the sheet's key and blocks of its rows, so it is an equi join; a range unfolds to blocks, not to cells, and only if its top left cell has a value.
    """
    sheet = ["doc_id", "sheet_ord"]
    held = cells.where(F.col("value").isNotNull()).withColumnsRenamed({"row_ord": "min_row", "col_ord": "min_col", "value": "top"})
    tops = ranges.join(held, [*sheet, "min_row", "min_col"])
    spans = {f"{end}_{of}": of_two(f"min_{of}", f"max_{of}") for of in ("row", "col") for end, of_two in (("low", F.least), ("high", F.greatest))}
    blocks = tops.withColumns(spans).select(*sheet, F.struct(*spans, "top").alias("span"), F.explode(F.sequence(F.shiftright("low_row", BLOCK), F.shiftright("high_row", BLOCK))).alias("__block"))
    listed = blocks.groupBy(*sheet, "__block").agg(F.collect_list("span").alias("__spans"))
    holds = lambda s: F.col("row_ord").between(s["low_row"], s["high_row"]) & F.col("col_ord").between(s["low_col"], s["high_col"])
    top = F.when(F.col("__spans").isNotNull(), F.array_max(F.transform(F.filter("__spans", holds), lambda s: s["top"])))
    met = cells.withColumn("__block", F.shiftright("row_ord", BLOCK)).join(listed, [*sheet, "__block"], "left")
    return met.withColumn("value", F.coalesce(top, "value")).select(*cells.columns)
