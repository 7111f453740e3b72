"""Pages, offsets and word chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import company_name, period

#: Words of a chunk and the step between chunks (500 and 100 tokens at 0.75 words a token).
CHUNK_WORDS, STEP_WORDS = 375, 300


def page_offsets(pages: DataFrame) -> DataFrame:
    """The pages with start and end of their text in the document's text, pages joined by one line feed."""
    before = Window.partitionBy("doc_id").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("raw_text")
    start = F.coalesce(F.sum(size + 1).over(before), F.lit(0))
    return pages.withColumn("start", start).withColumn("end", F.col("start") + size)


def full_text(pages: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("page_num", "raw_text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p.raw_text), "\n").alias("full_text"))


def offsets_to_pages(offsets: DataFrame, placed: DataFrame, key: list[str], offset: str, out: str) -> DataFrame:
    """For each offset the page it falls on, ends included; beyond the text the document's last page.

    Pages lie side by side (page_offsets), so it is the last one that starts at or before the offset: one window over both.
    """
    row = F.struct(*(F.col(c) for c in offsets.columns))
    marks = offsets.select("doc_id", F.col(offset).cast("long").alias("at"), F.lit(None).cast(placed.schema["page_num"].dataType).alias("page"), row.alias("row"))
    starts = placed.select("doc_id", F.col("start").cast("long").alias("at"), F.col("page_num").alias("page"), F.lit(None).cast(marks.schema["row"].dataType).alias("row"))
    order = Window.partitionBy("doc_id").orderBy("at", F.col("row").isNotNull())
    whole = Window.partitionBy("doc_id")
    found = starts.unionByName(marks).withColumn(out, F.coalesce(F.last("page", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.max("page").over(whole)))
    return found.where(F.col("row").isNotNull()).select("row.*", out)


def uncovered_pages(pages: DataFrame, notes: DataFrame) -> DataFrame:
    """Pages that no note's page range covers."""
    covered = notes.select("doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page_num"))
    return pages.join(covered, ["doc_id", "page_num"], "left_anti")


def word_chunks(text: Column, size: int = CHUNK_WORDS, step: int = STEP_WORDS) -> Column:
    """The text's words in overlapping chunks; the last one reaches the end. None for a text without words."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    n = F.size(words)
    more = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), more), lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))
    return F.when(n > 0, chunks).otherwise(F.array().cast("array<string>"))


def chunk_index(pages: DataFrame) -> DataFrame:
    """Chunks of each file's pages, numbered through the file."""
    parts = pages.select("source_filename", "page_number", F.posexplode(word_chunks(F.col("text"))).alias("pos", "text"))
    order = Window.partitionBy("source_filename").orderBy("page_number", "pos")
    return parts.select("source_filename", "page_number", (F.row_number().over(order) - 1).alias("chunk_index"), "text")


def is_typed(pages: DataFrame) -> DataFrame:
    """Whether a PDF has text: at least three of its first five pages with over 50 characters."""
    return pages.where(F.col("page_num") <= 5).groupBy("doc_id").agg(F.when(F.count_if(F.length("raw_text") > 50) >= 3, "typed").otherwise("scanned").alias("pdf_type"))


#: Pages that tell whose report it is, and for which period.
FIRST_PAGES = 3


def identity(pages: DataFrame) -> DataFrame:
    """doc_id, company and period, read from the first pages; documents of one page are read whole."""
    first = full_text(pages.where(F.col("page_num") <= FIRST_PAGES))
    return first.select("doc_id", company_name(F.col("full_text")).alias("company"), period(F.col("full_text")).alias("period"))
