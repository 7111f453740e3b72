"""The index as a table of versions, and the standards corpus in one call."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import retrieval
from ledgerloom.plans.corpus import build_standards
from ledgerloom.sources import readers
from ledgerloom.sources.index_table import IndexTable

from .test_sources import packed

SCHEMA = "source_filename string, chunk_index int, text string"


def chunks(spark, *names, mark="a", n=3):
    return spark.createDataFrame([(f, i, f"{mark} {f} {i}") for f in names for i in range(n)], SCHEMA)


def rows(table, version=None):
    found = table.read(version)
    return {} if found is None else {(r.source_filename, r.chunk_index): r.text for r in found.collect()}


def test_upserts_are_versions(spark, tmp_path):
    table = IndexTable(spark, f"file://{tmp_path}/t", buckets=8)
    assert table.version() == 0 and table.read() is None
    names = [f"f{i}.pdf" for i in range(20)]
    assert table.upsert(chunks(spark, *names)) == 1
    first, before = rows(table), table.manifest()["folders"]
    assert len(first) == 60
    assert table.upsert(chunks(spark, "f3.pdf", mark="b", n=2)) == 2
    second = rows(table)
    assert second == first | {("f3.pdf", 0): "b f3.pdf 0", ("f3.pdf", 1): "b f3.pdf 1"} and rows(table, 1) == first
    after = table.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1  # one bucket was rewritten
    table.upsert(chunks(spark, "f3.pdf", mark="b", n=2))
    assert rows(table) == second  # twice is once
    assert table.upsert(chunks(spark).limit(0)) == 3 and rows(table) == second
    repeated = chunks(spark, "f3.pdf", mark="c", n=1)
    table.upsert(repeated.unionByName(repeated))
    assert len(rows(table)) == 60
    assert table.vacuum() > 0 and rows(table) == second | {("f3.pdf", 0): "c f3.pdf 0"} and table.vacuum() == 0
    with pytest.raises(Exception):
        table.manifest(1)


def test_a_killed_run_and_a_second_writer(spark, tmp_path, monkeypatch):
    table = IndexTable(spark, f"file://{tmp_path}/t", buckets=4)
    table.upsert(chunks(spark, "a.pdf", "b.pdf"))
    before = rows(table)

    def killed(self, manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(IndexTable, "_commit", killed)
        with pytest.raises(KeyboardInterrupt):
            table.upsert(chunks(spark, "a.pdf", mark="lost"))
    broken = chunks(spark, "a.pdf", mark="lost").withColumn("text", F.when(F.col("chunk_index") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        table.upsert(broken)
    assert rows(table) == before and table.version() == 1
    other = table.manifest()
    table.upsert(chunks(spark, "c.pdf"))
    with pytest.raises(RuntimeError, match="another run"):
        table._commit(other | {"version": 2})
    assert table.vacuum() >= 2 and len(rows(table)) == 9


class Page:
    images = ()

    def __init__(self, text):
        self.text = text

    def extract_text(self, **_):
        if self.text == "bad":
            raise ValueError("cannot be read")
        return self.text

    def extract_tables(self, settings):
        return []


class Pdf:
    def __init__(self, content):
        if content == b"broken":
            raise ValueError("no pdf")
        self.pages = [Page(t) for t in content.decode().split("|")]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


def encode(texts):
    return np.array([[1 + t.count("a"), 1 + t.count("b")] for t in texts], float)


def test_corpus_in_one_call(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    long = " ".join(f"w{i}" for i in range(400))
    (source / "one.zip").write_bytes(packed({"x/A.pdf": f"aaa a|{long}|bb", "B.pdf": "b b|bad|b", "n.txt": "no"}))
    (source / "two.zip").write_bytes(packed({"A.pdf": "another of the same name", "C.pdf": "broken"}))
    (source / "bad.zip").write_bytes(b"broken")
    (source / "D.pdf").write_bytes(b"d")
    (source / "E.txt").write_bytes(b"text")
    table, reader = IndexTable(spark, f"file://{tmp_path}/index", buckets=4), readers.plumber(opened=Pdf)
    version, errors, run = build_standards(readers.files(spark, str(source)), table, encode, reader)
    assert version == 1
    index = sorted((r.source_filename, r.chunk_index, r.page_number, r.text[:5], len(r.embedding)) for r in table.read().collect())
    assert index == [("A.pdf", 0, 1, "aaa a", 2), ("A.pdf", 1, 2, "w0 w1", 2), ("A.pdf", 2, 2, "w300 ", 2), ("A.pdf", 3, 3, "bb", 2), ("B.pdf", 0, 1, "b b", 2), ("B.pdf", 1, 3, "b", 2), ("D.pdf", 0, 1, "d", 2)]
    said = {(r.doc_id.split("/in/")[1], r.error.split(":")[0]) for r in errors.collect()}
    assert said == {("bad.zip", "BadZipFile"), ("one.zip/B.pdf", "page 2"), ("two.zip/C.pdf", "ValueError"), ("E.txt", "Unsupported file type")}
    run.release()
    (source / "F.pdf").write_bytes(b"f f")
    version, errors, run = build_standards(readers.files(spark, str(source)), table, encode, reader)
    assert version == 2 and [r.source_filename for r in run["new_files"].select("source_filename").orderBy("source_filename").collect()] == ["C.pdf", "F.pdf"]  # what has no chunk yet
    assert table.read().count() == 8
    run.release()
    nearest = retrieval.nearest(spark.createDataFrame([("q", [1.0, 0.0])], "query string, embedding array<double>"), table.read().withColumn("place", F.struct("source_filename", "chunk_index")), 2, tie="place")
    assert nearest.count() == 2
