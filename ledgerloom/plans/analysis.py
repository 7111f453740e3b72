"""The whole analysis of many filings: files in, notes, line items, flags, observations and reports out.

``analyze_files`` reads files and hands them to ``analyze``, which takes pages, tables and sheets. Every relation carries doc_id. Results
that several later steps read (notes, line items, movements, flags) are written once, as Parquet in a folder that driver and executors
share: a lost executor costs no recomputation, and later plans start from a scan instead of growing with all that led to them. The caller
removes them with ``Analysis.release``. Relations that are read once stay lazy.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import any_of
from ..operators import analytics, mapping, narrate, notes, pages as pages_ops, records, report, retrieval, rules, tables as tables_ops
from ..sources import readers


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder where it is unset, but only on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="ledgerloom-analysis-")


@dataclass
class Analysis:
    """Relations by name; the kept ones are tables in ``root``."""

    spark: SparkSession
    root: str = ""
    relations: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.root = self.root or f"{shared_folder(self.spark)}/analysis-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        self.relations[name] = self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")
        return self.relations[name]

    def __getitem__(self, name: str) -> DataFrame:
        return self.relations[name]

    def release(self) -> None:
        """Removes the kept tables; nothing can be read after it."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_value(rows: DataFrame, chosen: DataFrame, words: tuple[str, ...], name: str) -> DataFrame:
    """doc_id and the current value of the first row whose label has one of the words, in the chosen note's tables."""
    hit = rows.join(chosen, ["doc_id", "note_id"], "left_semi").where(any_of(F.lower("label"), words))
    # The first row decides even if its value is null.
    return hit.groupBy("doc_id").agg(F.min_by(F.struct("current"), F.struct("page_num", "table_ord", "row_ord")).alias("x")).select("doc_id", F.col("x.current").alias(name))


def note_with(found: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """doc_id, note_id of the first note with one of the words in its title or first 200 characters."""
    head = F.lower(F.concat("title", F.lit(" "), F.substring("raw_text", 1, 200)))
    return found.where(any_of(head, words)).groupBy("doc_id").agg(F.min_by("note_id", "note_ord").alias("note_id"))


def consistency_facts(found: DataFrame, rows: DataFrame, texts: DataFrame, csr: DataFrame) -> DataFrame:
    tax, rou, lease = (note_with(found, w) for w in (("income tax", "tax expense"), ("right-of-use", "right of use", "rou asset"), ("lease liabilit",)))
    values = [
        row_value(rows, tax, ("current tax",), "tax_current"), row_value(rows, tax, ("earlier year", "prior year", "earlier years"), "tax_prior"),
        row_value(rows, tax, ("deferred tax",), "tax_deferred"), row_value(rows, tax, ("total tax expense", "total income tax expense"), "tax_total"),
        row_value(rows, rou, ("addition",), "rou_additions"), row_value(rows, lease, ("total",), "lease_total"),
    ]
    balance = rules.restricted_balance(F.col("raw_text"))
    restricted = found.withColumn("b", balance).where(F.col("b").isNotNull()).groupBy("doc_id").agg(F.min_by("b", "note_ord").alias("restricted_balance"))
    facts = texts
    for part in (*values, restricted, csr):
        facts = facts.join(part, "doc_id", "left")
    return facts


def retrieve(flags: DataFrame, index: DataFrame, encode: mapping.Encoder, k: int = 3) -> DataFrame:
    """query, rank, source, page_number, text and score of the k passages nearest to each distinct query of the flags.

    index: source_filename, page_number, chunk_index, text, embedding, as ``retrieval.build_index`` makes it.
    """
    queries = mapping.encoded(flags.select(F.col("standard_query").alias("query")).distinct(), "query", encode)
    order = F.struct("source_filename", "chunk_index")
    return retrieval.nearest(queries, index.withColumn("place", order), k, tie="place").withColumnRenamed("source_filename", "source").drop("place")


def passages_of(retrieved: DataFrame) -> DataFrame:
    """query, passages and sources in rank order."""
    told = F.concat(F.lit("[From "), "source", F.lit(", p."), F.col("page_number").cast("string"), F.lit("]\n"), "text")
    listed = F.array_sort(F.collect_list(F.struct("rank", told.alias("text"), "source")))
    return retrieved.groupBy("query").agg(F.transform(listed, lambda x: x["text"]).alias("passages"), F.transform(listed, lambda x: x["source"]).alias("sources"))


def analyze(
    pages: DataFrame, tables: DataFrame, sheets: DataFrame | None = None, cited: DataFrame | None = None, generated_at=None, compat: bool = False, embed=None,
    *, out: Analysis | None = None, encode: mapping.Encoder | None = None, index: DataFrame | None = None, generate: narrate.Generator | None = None, templates: bool = True, addendum: bool = True, instances: int | None = None, note_depth: int = 2,
) -> Analysis:
    """out: an analysis to go on with. pages: doc_id, page_num, raw_text. tables: doc_id, page_num, table_ord, headers, rows. sheets: doc_id, sheet_ord, sheet_type, headers, rows, and
    row_from where a sheet's rows come in parts.

    encode: an encoder of texts; it turns on the embedding step of the mapping and, with index (the standards' passages), retrieval.
    cited: query and citation (narrate.citations), instead of retrieval. generate: a text generator (narrate.observations).
    note_depth: steps from a flag's note to the notes whose texts are told with it. compat reproduces the first-match reading of work-in-progress ageing.
    """
    spark = pages.sparkSession
    out = out or Analysis(spark)
    texts = out.keep("texts", pages_ops.full_text(pages))
    found = out.keep("notes", notes.notes(pages))
    note_tables = out.keep("note_tables", notes.note_tables(found, tables).drop("note_ord"))
    edges = out.keep("references", notes.references(found))

    face = pages_ops.uncovered_pages(tables.select("doc_id", "page_num").distinct(), found)
    read = tables_ops.read_rows(tables.join(face, ["doc_id", "page_num"], "left_semi")).withColumns({"source": F.lit(0), "sheet_type": F.lit(None).cast("string")})
    if sheets is not None:
        typed = mapping.face_sheets(sheets.select("doc_id", "sheet_ord", "sheet_type").distinct())
        parts = sheets if "row_from" in sheets.columns else sheets.withColumn("row_from", F.lit(0))
        own = parts.drop("sheet_type").join(typed, ["doc_id", "sheet_ord"]).withColumnRenamed("sheet_ord", "page_num").withColumn("table_ord", F.lit(0))
        more = tables_ops.read_rows(own.select("doc_id", "page_num", "table_ord", "sheet_type", "row_from", "headers", "rows"))
        read = read.unionByName(more.withColumns({"row_ord": F.col("row_ord") + F.col("row_from"), "source": F.lit(1)}).drop("row_from"))
    if embed is None and encode is not None:
        embed = mapping.embedding_step(spark, encode)
    rows = out.keep("rows", read)
    items = out.keep("line_items", mapping.map_items(rows, ["doc_id", "source", "page_num", "table_ord"], embed))
    best = out.keep("best_items", analytics.best_items(items))
    moves = out.keep("movements", analytics.movements(best))
    ratios = out.keep("ratios", analytics.ratios(best))

    names = {"contingent_liabilities": "contingent", "csr_details": "csr", "msmed_disclosure": "msmed", "actuarial_assumptions": "actuarial", "cwip_ageing": "cwip"}
    read_records = out.keep("records", records.all_records(found, note_tables, compat))
    for record in records.RECORDS:
        out.relations[record] = read_records.where(F.col(record).isNotNull()).select("doc_id", record)
    values = (F.col(f"{r}.projects" if r == "cwip_ageing" else r).alias(n) for r, n in names.items())
    facts = texts.select("doc_id").join(read_records.select("doc_id", *values), "doc_id", "left")
    dividend = found.where(F.col("note_id") == "7f").select("doc_id", F.col("raw_text").alias("note_7f"))
    facts = out.keep("facts", facts.join(dividend, "doc_id", "left"))
    note_rows = out.keep("note_rows", tables_ops.read_rows(note_tables))
    across = consistency_facts(found, note_rows, texts, facts.select("doc_id", "csr"))
    flags = out.keep("flags", rules.flags(moves, facts).unionByName(rules.consistency_flags(across)))
    told = flags
    if cited is None and index is not None and encode is not None:
        retrieved = out.keep("retrieved", retrieve(flags, index, encode))
        cited = narrate.citations(retrieved)
        if generate is not None:
            told = told.join(passages_of(retrieved), told.standard_query == F.col("query"), "left").drop("query")
    resolved = out.keep("resolved", notes.resolved_texts(found, edges, notes.first_notes(flags), note_depth))
    out.relations["flag_notes"] = notes.flag_notes(flags, resolved)
    if generate is not None:
        told = notes.flag_notes(told, resolved)
    observed = out.keep("observations", narrate.observations(told, cited, generate, templates, addendum, instances))
    summary = out.relations["summary"] = report.summary(observed)
    out.relations["next_steps"] = report.next_steps(summary)
    identity = out.relations["identity"] = pages_ops.identity(pages)
    when = generated_at if generated_at is not None else F.lit(None).cast("timestamp")
    out.relations["reports"] = report.reports(observed, moves, ratios, when).join(identity, "doc_id", "left")
    return out


def analyze_files(files: DataFrame, read_pdf=None, recognise: readers.Recogniser | None = None, filing: Callable[[Column], Column] | None = None, **options) -> Analysis:
    """The analysis of files (doc_id the path, kind, content; ``readers.files`` or a batch of ``streaming.ingest.file_stream``).

    filing: from a path to the filing it belongs to; without it the path less its ending, so that a workbook goes with the report of the
    same name. Each file is read once, each page once; what cannot be read is in ``errors``. options: as for ``analyze``.
    """
    filing = filing or (lambda path: F.regexp_replace(path, r"\.[^./\\]*$", ""))
    out = Analysis(files.sparkSession)
    read = readers.documents(files, read_pdf, recognise, out.keep)
    own = lambda df: df.withColumn("doc_id", filing(F.col("doc_id")))
    pages, tables, sheets = (out.keep(n, own(df)) for n, df in (("pages", read.pages), ("tables", read.tables), ("sheets", read.sheets)))
    out.relations["errors"] = read.errors
    return analyze(pages, tables, sheets, out=out, **options)
