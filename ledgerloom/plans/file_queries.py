"""Queries that read files: workbooks and page files made from the driver's tables, read back by the readers, and SQL over those tables."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import retrieval
from ..sources import readers
from ..sources.index_table import IndexTable
from .analysis import shared_folder
from .corpus import build_standards
from .queries import _query

_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
#: Cell styles: plain, a built-in date, a percentage, a format of its own for dates, and one for numbers with letters of dates in quotes.
_STYLES = f'<styleSheet {_NS}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="171" formatCode="0.00&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="10"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>'


def _workbook(rows: list[dict], mac: bool) -> bytes:
    """Orders of one customer: number, day (a serial in either epoch), price (scientific notation), share of the price, whether it is done."""
    statuses, epoch = sorted({r["status"] for r in rows}), 1462 if mac else 0
    cells = [f'<row r="1"><c r="A1" t="inlineStr"><is><t>Orders</t></is></c><c r="B1" s="1"><v>{45747 - epoch}</v></c></row>']
    for i, r in enumerate(rows, 2):
        day = r["day"] - epoch
        cells.append(f'<row r="{i}"><c r="A{i}" t="s"><v>{statuses.index(r["status"])}</v></c><c r="B{i}"><v>{r["number"]}</v></c><c r="C{i}" s="{1 + 2 * (i % 2)}"><v>{day}</v></c><c r="D{i}" s="4"><v>{r["price"]:.16E}</v></c><c r="E{i}" s="2"><v>{r["price"] / 1e12!r}</v></c><c r="F{i}" t="b"><v>{int(r["done"])}</v></c></row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {_NS}><workbookPr date1904="{int(mac)}"/><sheets><sheet name="Profit" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _STYLES)
        z.writestr("xl/sharedStrings.xml", f"<sst {_NS}>" + "".join(f"<si><t>Status {s}</t></si>" for s in statuses) + "</sst>")
        noted = "".join(f'<comment ref="D{i}" authorId="0"><text><t>Order </t><t>{r["number"]}</t></text></comment>' for i, r in enumerate(rows, 2) if r["done"])
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", '<Relationships><Relationship Id="c" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/comments" Target="../comments1.xml"/></Relationships>')
        z.writestr("xl/comments1.xml", f"<comments {_NS}><authors><author>Clerk</author></authors><commentList>{noted}</commentList></comments>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {_NS}><sheetData>{''.join(cells)}</sheetData></worksheet>")
    return out.getvalue()


#: Workbooks that are handed on together.
_TOGETHER = 256


def _workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each customer's orders; odd customers' use the older epoch."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    row = F.struct(F.col("o_orderkey").alias("number"), F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1899-12-30").cast("date")).alias("day"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "F").alias("done"))
    listed = orders.groupBy(F.col("o_custkey").alias("customer")).agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TOGETHER):
                customers, listed = (c.slice(at, _TOGETHER).to_pylist() for c in batch.columns)
                books = [_workbook(rows, customer % 2 == 1) for customer, rows in zip(customers, listed, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(map(str, customers), pa.string()), pa.array(["xlsx"] * len(books)), pa.array(books, pa.binary())], ["doc_id", "kind", "content"])

    return listed.mapInArrow(made, "doc_id string, kind string, content binary")


@_query("workbook_cells", """SELECT CAST(o_custkey AS BIGINT) AS customer, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, '2025-03-31 00:00:00' AS head, 'Status ' || o_orderstatus AS status, CAST(o_orderkey AS BIGINT) AS number,
 strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d 00:00:00') AS day, o_totalprice AS price, round(o_totalprice / 1e12, 15) AS share, CAST(o_orderstatus = 'F' AS DOUBLE) AS done FROM orders""")  # fmt: skip
def workbook_cells(spark, sf_dir):
    sheets = readers.sheets_of(readers.sheet_parts(_workbooks(spark, sf_dir)))
    cells = sheets.select("doc_id", "headers", "row_from", F.posexplode("rows").alias("at", "c"))
    number = lambda i: X.parse_indian_number(F.get("c", F.lit(i)))
    return cells.select(
        F.col("doc_id").cast("long").alias("customer"), (F.col("at") + F.col("row_from") + 1).cast("long").alias("place"), F.get("headers", F.lit(1)).alias("head"), F.get("c", F.lit(0)).alias("status"),
        number(1).cast("long").alias("number"), F.get("c", F.lit(2)).alias("day"), number(3).alias("price"), F.round(number(4), 15).alias("share"), number(5).alias("done"),
    )


@_query("workbook_comments", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS line FROM orders)
SELECT CAST(o_custkey AS BIGINT) AS customer, 'D' || line AS cell_ref, 'Order ' || o_orderkey AS comment, 'Clerk' AS author, o_totalprice AS price FROM o WHERE o_orderstatus = 'F'""")  # fmt: skip
def workbook_comments(spark, sf_dir):
    """Comments with the values of the cells that they are at."""
    sheets = readers.sheets(_workbooks(spark, sf_dir)).where(F.col("error").isNull())
    found = sheets.select(F.col("doc_id").cast("long").alias("customer"), "commented", F.inline("comments"))
    return found.select("customer", "cell_ref", F.col("value").alias("comment"), "author", X.parse_indian_number(F.col("commented")[F.col("cell_ref")]).alias("price"))


class _Page:
    images = ()

    def __init__(self, text: str):
        self.text = text

    def extract_text(self, **_) -> str:
        return self.text

    def extract_tables(self, settings) -> list:
        """A grid of the page's first two words, as "lines" find it; the other way of looking is then not asked."""
        words = self.text.split()[:2]
        return [[["Head", "2025"], words]] if settings["vertical_strategy"] == "lines" and len(words) == 2 else []


class _File:
    def __init__(self, content: bytes):
        text = content.decode()
        self.pages = [_Page(text[at : at + 400]) for at in range(0, len(text), 400)]

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *_) -> None:
        pass


@_query("pdf_pages", "SELECT doc_id, CAST(p AS INTEGER) AS page_num, sha256(substr(text, (p - 1) * 400 + 1, 400)) AS text_sha256 FROM (SELECT doc_id, text, unnest(range(1, (length(text) + 399) // 400 + 1)) AS p FROM documents WHERE length(text) > 0)")
def pdf_pages(spark, sf_dir):
    """Texts as files of pages of 400 characters, dealt in ranges of pages over all tasks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") > 0)
    files = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("pdf").alias("kind"), F.encode("text", "UTF-8").alias("content"))
    found = readers.pdf_pages(files, readers.plumber(opened=_File))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "page_num", F.sha2(F.encode("raw_text", "UTF-8"), 256).alias("text_sha256"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"


@_query("index_table_upserts", "SELECT source AS source_filename, doc_id AS chunk_index, CASE WHEN lang = 'es' THEN 'new ' ELSE 'old ' END || coalesce(CAST(length(text) AS VARCHAR), 'none') AS text FROM documents")
def index_table_upserts(spark, sf_dir):
    """Three upserts of an index: all documents, those of one language anew, and the same once more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chunk = lambda d, mark: d.select(F.col("source").alias("source_filename"), F.col("doc_id").alias("chunk_index"), F.concat(F.lit(mark), F.coalesce(F.length("text").cast("string"), F.lit("none"))).alias("text"))
    table = IndexTable(spark, _folder(spark))
    table.upsert(chunk(docs, "old "))
    for _ in range(2):
        table.upsert(chunk(docs.where("lang = 'es'"), "new "))
    return table.read()


@_query("incremental_skip_by_name", "SELECT DISTINCT source || '-' || lang AS source_filename FROM documents WHERE lang <> 'es'")
def incremental_skip_by_name(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat_ws("-", "source", "lang").alias("source_filename"), "lang").distinct()
    return retrieval.not_indexed(names.select("source_filename"), names.where("lang = 'es'"))


#: Documents of an archive.
_MEMBERS = 20


def _archives(docs: DataFrame) -> DataFrame:
    """Archives of some documents each, as they come, a member a document; of each a second member that is no text of a page file."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _MEMBERS):
                members, out = batch.slice(at, _MEMBERS).to_pylist(), io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    for m in members:
                        z.writestr(f"in/{m['doc_id']}.pdf", m["text"])
                    z.writestr("read.me", "no file of pages")
                yield pa.RecordBatch.from_arrays([pa.array([f"{members[0]['doc_id']}.zip"]), pa.array(["zip"]), pa.array([out.getvalue()], pa.binary())], ["doc_id", "kind", "content"])

    return docs.select("doc_id", "text").mapInArrow(made, "doc_id string, kind string, content binary")


def _letters(texts: list[str]) -> np.ndarray:
    """An encoder that stands in for a model: counts of some letters."""
    return np.array([[1 + t.count(c) for c in "aeiou"] for t in texts], float)


@_query("standards_corpus", r"""WITH p AS (SELECT doc_id, p, array_to_string(list_filter(regexp_split_to_array(substr(text, (p - 1) * 400 + 1, 400), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> ''), ' ') AS t
 FROM (SELECT doc_id, text, unnest(range(1, (length(text) + 399) // 400 + 1)) AS p FROM documents WHERE length(text) > 0))
SELECT doc_id || '.pdf' AS source_filename, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER) AS chunk_index, CAST(p AS INTEGER) AS page_number, sha256(t) AS text_sha256 FROM p WHERE t <> ''""")  # fmt: skip
def standards_corpus(spark, sf_dir):
    """Archives to index in two runs, the second with a third of the documents more; pages are short, so each is a chunk."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") > 0)
    table = IndexTable(spark, _folder(spark))
    for part in (docs.where("lang <> 'es'"), docs):
        _, _, run = build_standards(_archives(part), table, _letters, readers.plumber(opened=_File))
        run.release()
    return table.read().select("source_filename", F.col("chunk_index").cast("int").alias("chunk_index"), "page_number", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
