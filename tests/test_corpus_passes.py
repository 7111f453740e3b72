"""What building the index reads, deals and writes once."""

from pyspark.sql import functions as F

from ledgerloom.plans.corpus import build_standards
from ledgerloom.sources import pdf, readers
from ledgerloom.sources.index_table import FOLDERS, IndexTable

from .test_index_table import Pdf, chunks, encode, rows
from .test_sources import packed


def test_files_are_opened_once_and_small_ones_in_one_step(spark, tmp_path):
    """Files were evaluated anew for archives and for page files, and the bytes of small files went with every eight pages."""
    texts = {f"{n}.pdf": "|".join(f"{n} {i} " + "x" * 60 for i in range(40)) for n in range(3)}
    texts["large.pdf"] = "|".join(f"large {i} " + "y" * 9000 for i in range(30))
    read, opened = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    given = spark.createDataFrame([("a.zip", "zip", packed(texts)), ("in/own.pdf", "pdf", b"own")], "doc_id string, kind string, content binary")

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    def counted(content):
        opened.add(1)
        return Pdf(content)

    version, _, run = build_standards(given.mapInArrow(seen, given.schema), IndexTable(spark, f"file://{tmp_path}/i", 4), encode, readers.plumber(opened=counted))
    assert read.value == 2  # each file of the input once
    found = sorted((r.doc_id, r.page_num, r.raw_text) for r in run["pages"].where("error IS NULL").collect())
    assert found == sorted([(f"a.zip/{name}", i + 1, t) for name, text in texts.items() for i, t in enumerate(text.split("|"))] + [("in/own.pdf", 1, "own")])
    ranges = -(-(30 - pdf.SAMPLED) // max(pdf.TYPED_RANGE, pdf.RANGE_BYTES * 30 // len(texts["large.pdf"])))
    assert ranges > 1 and opened.value == 5 + ranges
    run.release()


def test_new_files_are_put_beside_the_old(spark, tmp_path):
    """Every upsert wrote the touched buckets anew, old chunks and all."""
    table = IndexTable(spark, f"file://{tmp_path}/t", buckets=1)
    table.upsert(chunks(spark, "a.pdf"))
    first = table.manifest()["folders"]["0"]
    table.upsert(chunks(spark, "b.pdf"))
    assert table.manifest()["folders"]["0"][:-1] == first and len(rows(table)) == 6
    table.upsert(chunks(spark, "b.pdf", mark="c", n=1))
    assert len(table.manifest()["folders"]["0"]) == 1 and rows(table)["b.pdf", 0] == "c b.pdf 0" and len(rows(table)) == 6
    for k in range(FOLDERS):
        table.upsert(chunks(spark, f"{k}.pdf", n=1))
    assert len(table.manifest()["folders"]["0"]) < FOLDERS and len(rows(table)) == 6 + FOLDERS
    last = rows(table)
    table.vacuum()
    assert rows(table) == last
    unknown = spark.createDataFrame([(None, 0, "x")], "source_filename string, chunk_index int, text string")
    table.upsert(unknown), table.upsert(unknown.withColumn("text", F.lit("y")))
    assert rows(table) == last | {(None, 0): "y"}
