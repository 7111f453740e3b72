"""Document readers over Spark's binaryFile source: spreadsheets (``xlsx``) and word documents by the standard library, archives,
PDF page by page (``pdf``) and images by a recogniser passed in. A file, sheet or page that cannot be read, and a file that no reader takes, gives an
error row, never a failed job; what else the file holds is read."""

from __future__ import annotations

import io
import pickle
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SHEET_PHRASES, sheet_type
from ..operators import tables as tables_ops
from . import pdf, xlsx
from .pdf import PAGE, PerWorker, Plumber, Recogniser

#: File endings and how they are read.
KINDS = {".pdf": "pdf", ".docx": "docx", ".png": "image", ".jpg": "image", ".jpeg": "image", ".xlsx": "xlsx", ".zip": "zip"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), kind and content of files; kind is null for an ending that is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("doc_id"), file_kind(F.col("path")).alias("kind"), "content")


def file_kind(path: Column) -> Column:
    case = F.lit(None).cast("string")
    for ending, kind in KINDS.items():
        case = F.when(F.lower(path).endswith(ending), kind).otherwise(case)
    return case


def read_xlsx(content: bytes) -> list[dict]:
    """Sheets, whole: name, rows, merged ranges (0-based, inclusive), comments, and the values of commented cells."""
    with xlsx.Workbook(content) as book:
        found = [book.sheet(i) for i in range(len(book.paths))]
        return [{"name": x.name, "rows": list(x.rows), "merged": x.merged, "comments": x.comments, "commented": x.commented} for x in found]


def read_docx(content: bytes) -> tuple[str, list[list[list[str]]]]:
    """Text of the paragraphs, in order, and the tables' rows."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    paragraph = lambda p: "".join("\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else t.text or "" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    text = "\n\n".join(paragraph(p) for p in body.iter(f"{_W}p"))
    tables = [[["\n".join(paragraph(p) for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc")] for row in table.findall(f"{_W}tr")] for table in body.iter(f"{_W}tbl")]
    return text, tables


def unzip(content: bytes, ending: str = ".pdf") -> Iterator[tuple[str, bytes]]:
    """Names and contents of an archive's files of one ending, one at a time; none of a broken archive."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return
    with z:
        for n in sorted(z.namelist()):
            if n.lower().endswith(ending):
                yield n, z.read(n)


#: Rows of one file that are handed on together, and bytes of files that reach a Python worker at once.
ROWS, BATCH_BYTES = 64, "64m"


def prepare(spark: SparkSession) -> None:
    """Bounds the files that a worker gets in one batch, where the session leaves that open."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(name):
        spark.conf.set(name, BATCH_BYTES)


def _reader(frame: DataFrame, kind: str, read: Callable[[bytes], Iterable[tuple]], schema: str, fields: list[tuple[str, pa.DataType]], rows: int = ROWS, weigh: Callable[[tuple], int] | None = None) -> DataFrame:
    """doc_id, the fields of each row read, and error. A file that breaks off gives the rows read till then and an error row.

    Rows are handed on a file at a time, ``rows`` of them at most; with ``weigh``, rows of several files together, up to ``rows`` in weight.
    """
    prepare(frame.sparkSession)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        """held: doc_id, row and error."""
        columns = [pa.array([r[i] for _, r, _ in held], t) for i, (_, t) in enumerate(fields)]
        return pa.RecordBatch.from_arrays([pa.array([d for d, *_ in held], pa.string()), *columns, pa.array([e for *_, e in held], pa.string())], ["doc_id", *(n for n, _ in fields), "error"])

    def given(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        """A row that does not fit the fields is its file's error."""
        if not held:
            return
        try:
            yield packed(held)
        except Exception:
            for doc_id, row, error in held:
                try:
                    yield packed([(doc_id, row, error)])
                except Exception as e:
                    yield packed([(doc_id, (None,) * len(fields), f"{type(e).__name__}: {e}")])

    def each(content: bytes) -> Iterator[tuple]:
        yield from read(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0
        for batch in batches:
            for i in range(batch.num_rows):  # one file's bytes at a time
                doc_id, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                found = each(content)
                while True:
                    try:
                        row, error = next(found, None), None
                    except Exception as e:  # a broken file is data, not a failure of the job
                        row, error = (None,) * len(fields), f"{type(e).__name__}: {e}"
                    if row is not None:
                        held.append((doc_id, row, error))
                        weight += weigh(row) if weigh and not error else 1
                    if weight >= rows or (row is None and not weigh):
                        yield from given(held)
                        held, weight = [], 0
                    if row is None or error:
                        break
        yield from given(held)

    return frame.where(F.col("kind") == kind).select("doc_id", "content").mapInArrow(run, f"doc_id string, {schema}, error string")


def unsupported(frame: DataFrame) -> DataFrame:
    """doc_id, error of files whose ending no reader takes."""
    return _refused(frame.where(F.col("kind").isNull()))


def unread(frame: DataFrame) -> DataFrame:
    """doc_id, error of files that ``documents`` does not read: those of other endings, and archives."""
    return unsupported(frame).unionByName(_refused(frame.where(F.col("kind") == "zip")))


def _refused(frame: DataFrame) -> DataFrame:
    name = F.regexp_extract("doc_id", r"(\.[^./\\]*)$", 1)
    return frame.select("doc_id", F.concat(F.lit("Unsupported file type: "), F.lower(name)).alias("error"))


_GRID = pa.list_(pa.list_(pa.string()))
_COMMENT = pa.struct([("cell_ref", pa.string()), ("value", pa.string()), ("author", pa.string())])
#: Fields of what the spreadsheet reader hands on: parts of a sheet's rows, each with what is known at the sheet's end; part is null of a sheet without rows.
_SHEET = [("sheet_ord", pa.int32()), ("part", pa.int32()), ("row_from", pa.int32()), ("headers", pa.list_(pa.string())), ("rows", _GRID), ("sheet_name", pa.string()), ("marks", pa.string()), ("comments", pa.list_(_COMMENT)), ("commented", pa.map_(pa.string(), pa.string())), ("failed", pa.string())]
_SHEET_SQL = "sheet_ord int, part int, row_from int, headers array<string>, rows array<array<string>>, sheet_name string, marks string, comments array<struct<cell_ref:string,value:string,author:string>>, commented map<string,string>, failed string"


def _sheet_parts(content: bytes) -> Iterator[tuple]:
    """A sheet that breaks off keeps what was read of it, and the sheets after it are read. Parts wait for the sheet's end in a file."""
    phrases = [p for _, own in SHEET_PHRASES for p in own]
    with xlsx.Workbook(content) as book:
        for i, (name, _) in enumerate(book.paths):
            headers, seen, kept, failed, sheet, waiting, n = None, 0, [], None, None, None, 0
            marks = xlsx.Phrases(phrases)
            try:
                sheet = book.sheet(i)
                for row in sheet.rows:
                    marks.see(row)
                    if headers is None:
                        headers = row
                        continue
                    kept.append(row)
                    if len(kept) == xlsx.PART:
                        waiting, n = waiting or tempfile.TemporaryFile(), n + 1
                        pickle.dump((seen, kept), waiting)
                        seen, kept = seen + len(kept), []
            except Exception as e:  # a broken sheet is data, not a failure of the job
                failed = f"sheet {name}: {type(e).__name__}: {e}"
            comments = [dict(zip(("cell_ref", "value", "author"), c, strict=True)) for c in sheet.comments] if sheet else []
            end = (name, " ".join(marks.found), comments, list(sheet.commented.items()) if sheet else [])
            if waiting:
                with waiting:
                    waiting.seek(0)
                    for part in range(n):
                        at, rows = pickle.load(waiting)
                        yield i, part, at, headers, rows, *end, None if part or kept else failed
            if kept or not n:
                yield i, n if kept else None, seen if kept else None, headers, kept or None, *end, failed


def sheet_parts(frame: DataFrame) -> DataFrame:
    """What the spreadsheet reader hands on: rows of sheets in parts of some thousand, each with what is known at its sheet's end. Memory is bounded by a part."""
    weigh = lambda row: 1 + len(row[4] or ()) + len(row[7])
    return _reader(frame, "xlsx", _sheet_parts, _SHEET_SQL, _SHEET, rows=xlsx.PART, weigh=weigh)


def sheets_of(parts: DataFrame) -> DataFrame:
    """doc_id, sheet_ord, sheet_name, sheet_type, headers (the first row), row_from, rows, comments, commented: a row for each part of a sheet's rows.

    row_from: the number of the part's first row. comments: cell, text and author; commented: the commented cells' values. Sheets are typed by their whole text.
    One pass over the parts, without a join: workbooks are not read again.
    """
    good = parts.where(F.col("error").isNull() & F.col("sheet_ord").isNotNull())
    empty = F.array().cast("array<array<string>>")
    return good.select("doc_id", "sheet_ord", "sheet_name", sheet_type(F.col("sheet_name"), F.col("marks")).alias("sheet_type"), F.coalesce("headers", F.array().cast("array<string>")).alias("headers"), F.coalesce("row_from", F.lit(0)).alias("row_from"), F.coalesce("rows", empty).alias("rows"), "comments", "commented")


def sheet_errors(parts: DataFrame) -> DataFrame:
    """doc_id, error of workbooks and of single sheets."""
    return parts.select("doc_id", F.coalesce("error", "failed").alias("error")).where(F.col("error").isNotNull())


def sheets(frame: DataFrame) -> DataFrame:
    """doc_id, sheet_ord, sheet_name, sheet_type, headers (the first row), rows, comments, commented, error of spreadsheets: each sheet a row.

    A workbook that cannot be read is a row with an error. Sheets of very many rows are better taken in parts (``sheets_of``).
    """
    parts = sheet_parts(frame)
    found = sheets_of(parts)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("row_from", "rows"))), lambda p: p["rows"])
    keys = ["doc_id", "sheet_ord", "sheet_name", "sheet_type", "headers"]
    whole = found.groupBy("doc_id", "sheet_ord").agg(*(F.first(c).alias(c) for c in keys[2:]), F.flatten(listed).alias("rows"), F.first("comments").alias("comments"), F.first("commented").alias("commented"))
    return whole.withColumn("error", F.lit(None).cast("string")).unionByName(sheet_errors(parts), allowMissingColumns=True)


def word_documents(frame: DataFrame) -> DataFrame:
    """doc_id, page_num (always 1), raw_text, tables (rows of each), error of word documents."""
    return _reader(frame, "docx", lambda c: [(1, *read_docx(c))], "page_num int, raw_text string, tables array<array<array<string>>>", [("page_num", pa.int32()), ("raw_text", pa.string()), ("tables", pa.list_(_GRID))])


def pdf_pages(frame: DataFrame, read: Callable[[bytes], Iterable[tuple[int, str, list, bool]]] | None = None, recognise: Recogniser | None = None, keep: Callable[[str, DataFrame], DataFrame] | None = None) -> DataFrame:
    """doc_id, page_num, raw_text, tables, ocr, error of PDF files.

    read: a ``plumber``, whose files are read page by page over all tasks, or a function that gives (page number, text, tables, whether by OCR) of
    each page of one file, in one task. Without it pages are read by pdfplumber; where that is not installed each file is an error row.
    keep: writes pages as they are read and gives them back as tables.
    """
    reader = read or plumber(recognise)
    if isinstance(reader, Plumber):
        prepare(frame.sparkSession)
        return pdf.pages(frame.where(F.col("kind") == "pdf"), reader, keep=keep)
    found = _reader(frame, "pdf", reader, PAGE, pdf.FIELDS[:-1])
    return keep("begun_pages", found) if keep else found


def plumber(recognise: Recogniser | None = None, opened: Callable[[bytes], object] | None = None) -> Plumber:
    """A reader of PDF pages. recognise: gives the lines of text of a page's picture (``PerWorker`` for one that is dear to build); opened: stands in for pdfplumber.open."""
    return Plumber(recognise, opened)


def image_pages(frame: DataFrame, recognise: Recogniser) -> DataFrame:
    """doc_id, page_num (1), raw_text, ocr, error of images; recognise gives the lines of text of an image's bytes."""
    return _reader(frame, "image", lambda c: [(1, "\n".join(recognise(c)), True)], "page_num int, raw_text string, ocr boolean", [("page_num", pa.int32()), ("raw_text", pa.string()), ("ocr", pa.bool_())])


def prefer_recognised(pages: DataFrame) -> DataFrame:
    """Pages with ocr_text and has_images: recognised text replaces text under 30 characters where it is longer."""
    better = (F.length(F.regexp_replace("raw_text", r"(?U)^\s+|\s+$", "")) < 30) & F.col("has_images") & (F.length("ocr_text") > F.length("raw_text"))
    better = F.coalesce(better, F.lit(False))
    return pages.withColumns({"raw_text": F.when(better, F.col("ocr_text")).otherwise(F.col("raw_text")), "ocr": better}).drop("ocr_text", "has_images")


def archived(frame: DataFrame, ending: str = ".pdf") -> DataFrame:
    """doc_id (the archive), name, content, error of the files in archives; one file's bytes at a time."""
    return _reader(frame, "zip", lambda c: unzip(c, ending), "name string, content binary", [("name", pa.string()), ("content", pa.binary())], rows=1)


def archive_members(frame: DataFrame, ending: str = ".pdf", beside: str | None = None) -> DataFrame:
    """doc_id (the archive), name, content, error of the files of one ending in archives. A broken archive is a row with an error, a broken member too.

    beside: files of this kind come out as they are, without a name, so that the files are read once for both.
    """
    prepare(frame.sparkSession)

    def packed(doc_id: str, name: str | None, content: bytes | None, error: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([name], pa.string()), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["doc_id", "name", "content", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if batch.column(2)[i].as_py() != "zip":
                    yield packed(doc_id, None, content, None)
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in sorted(n for n in z.namelist() if n.lower().endswith(ending)):
                            try:
                                yield packed(doc_id, name, z.read(name), None)
                            except Exception as e:  # a broken member is data, not a failure of the job
                                yield packed(doc_id, name, None, f"{type(e).__name__}: {e}")
                except Exception as e:
                    yield packed(doc_id, None, None, f"{type(e).__name__}: {e}")

    return frame.where(F.col("kind").isin("zip", *([beside] if beside else []))).select("doc_id", "content", "kind").mapInArrow(run, "doc_id string, name string, content binary, error string")


@dataclass
class Documents:
    """pages (doc_id, page_num, raw_text, ocr), tables (doc_id, page_num, table_ord, headers, rows), sheets (``sheets_of``), and errors (doc_id, error)."""

    pages: DataFrame
    tables: DataFrame
    sheets: DataFrame
    errors: DataFrame


def _split_tables(found: DataFrame, clean: Callable[[Column], Column]) -> DataFrame:
    """Each table of the pages, cleaned, its first row as headers; tables with nothing in them go."""
    cut = found.select("doc_id", "page_num", F.posexplode("tables").alias("table_ord", "grid")).withColumn("grid", clean(F.col("grid")))
    headers = F.transform(F.get("grid", F.lit(0)), lambda h: F.coalesce(h, F.lit("")))
    return cut.where(F.size("grid") > 0).select("doc_id", "page_num", "table_ord", headers.alias("headers"), F.slice("grid", 2, F.size("grid")).alias("rows"))


def documents(frame: DataFrame, read_pdf: Callable[[bytes], Iterable[tuple]] | None = None, recognise: Recogniser | None = None, keep: Callable[[str, DataFrame], DataFrame] | None = None) -> Documents:
    """All files (doc_id, kind, content), read, cleaned and put in the shape that the analysis takes.

    PDF: tables cleaned, a page's tables replaced by the one rebuilt from its lines where that has more labels, tables that go on
    over a page joined. Word documents: one page, tables cleaned. Images: recognised text, an error row without a recogniser.

    keep: writes what the readers give and gives it back as a table; without it each use of a result reads the files again.
    """
    keep = keep or (lambda name, df: df)
    found = keep("read_pdf", pdf_pages(frame, read_pdf, recognise))
    word = keep("read_word", word_documents(frame))
    image = keep("read_images", image_pages(frame, recognise or _no_recogniser))
    parts = keep("read_sheets", sheet_parts(frame))
    page = ["doc_id", "page_num", "raw_text", "ocr"]
    good = F.col("error").isNull()
    typed = found.where(good & ~F.col("ocr"))
    rebuilt = tables_ops.reconstruct(typed)
    pdf_tables = tables_ops.merge_across_pages(tables_ops.choose_tables(_split_tables(found.where(good), tables_ops.clean_pdf_rows), rebuilt))
    word_tables = _split_tables(word.where(good), tables_ops.clean_docx_rows)
    pages = found.where(good).select(*page).unionByName(word.where(good).withColumn("ocr", F.lit(False)).select(*page)).unionByName(image.where(good).select(*page))
    errors = unread(frame).unionByName(sheet_errors(parts))
    for part in (found, word, image):
        errors = errors.unionByName(part.where(~good).select("doc_id", "error"))
    return Documents(pages, pdf_tables.unionByName(word_tables), sheets_of(parts), errors)


def _no_recogniser(content: bytes) -> list[str]:
    raise RuntimeError("no recogniser for images was given")
