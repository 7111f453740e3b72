"""The standards corpus in one call: archives and files in, an index of embedded chunks out, only what is new being read."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mapping, retrieval
from ..operators.pages import chunk_index
from ..sources import pdf, readers
from ..sources.index_table import IndexTable
from .analysis import Analysis, shared_folder


def build_standards(files: DataFrame, table: IndexTable, encode: mapping.Encoder, read_pdf: Callable | None = None, recognise: readers.Recogniser | None = None) -> tuple[int, DataFrame, Analysis]:
    """The index's version, the errors (doc_id, error) and the run, whose tables the caller releases.

    files: doc_id (the path), kind, content (``readers.files``). Archives are unpacked, their members dealt over all tasks and read page by page like
    other files, so that one archive is not one task. A file counts by its name without folders: one that the index has is not read again, and of several of one name
    the first path counts. Pages are cut to chunks numbered through the file, chunks are encoded and put in the index in one version. A broken archive, member or
    page is a row of the errors and stops nothing.
    """
    run = Analysis(files.sparkSession, f"{shared_folder(files.sparkSession)}/corpus-{uuid.uuid4().hex}")
    members = run.keep("members", readers.archive_members(files, beside="pdf"))
    file_name = F.element_at(F.split("doc_id", "[/\\\\]"), -1)
    found = members.where(F.col("error").isNull()).select(F.concat_ws("/", "doc_id", "name").alias("doc_id"), F.lit("pdf").alias("kind"), "content")
    names = found.groupBy(file_name.alias("source_filename")).agg(F.min("doc_id").alias("doc_id"))
    index = table.read()
    if index is not None:
        names = retrieval.not_indexed(names, index)
    new = run.keep("new_files", names)
    # Dealt as the pages' reader deals them, so that the files' bytes are shuffled once.
    unread = found.repartition(pdf.dealt(files.sparkSession), "doc_id").join(new.select("doc_id"), "doc_id", "left_semi")
    pages = run.relations["pages"] = readers.pdf_pages(unread, read_pdf, recognise, run.keep)
    good = pages.where(F.col("error").isNull())
    chunks = chunk_index(good.select(file_name.alias("source_filename"), F.col("page_num").alias("page_number"), F.col("raw_text").alias("text")))
    version = table.upsert(mapping.encoded(chunks, "text", encode))
    lost = members.where(F.col("error").isNotNull()).select(F.concat_ws("/", "doc_id", "name").alias("doc_id"), "error")
    other = readers.unread(files.where(F.col("kind").isNull() | ~F.col("kind").isin("pdf", "zip")).withColumn("kind", F.lit(None).cast("string")))
    run.relations["errors"] = lost.unionByName(pages.where(F.col("error").isNotNull()).select("doc_id", "error")).unionByName(other)
    return version, run["errors"], run
