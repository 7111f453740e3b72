"""Fill-in-the-middle against a plain version, and its round trip."""

import hashlib
import random

import regex
from pyspark.sql import functions as F

from ledgerloom.llm import fill_middle


def plain_version(doc_id, text, rate=90):
    text = text or ""
    units = regex.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of():
    rng = random.Random(3)
    alphabet = ["word", "Two", " ", "\n", "\t", "é", "字", "🙂", "<", ">", "S", "P", "M", "<S", "P>", "0", "\u0000", "$", "\\"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for i in range(600)]
    rows += [(1000, "a <M> in the text"), (1001, ""), (1002, None), (None, "no id here"), (None, None), (7, "twice the same"), (7, "twice the same"), (1003, "long text " * 50_000), (-5, "below zero")]
    return rows


def test_equals_plain_version_and_round_trip(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, units string, H int")
    got = fill_middle.transform(docs).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    wanted = sorted(map(repr, ((i, *plain_version(i, t), t or "") for i, t in rows)))
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in got) == wanted


def test_parameters_and_empty_table(spark):
    docs = spark.createDataFrame([(f"id{i}", f"some words of {i} <S> here") for i in range(50)], "name string, body string")
    options = {"doc_id": "name", "text": "body", "sentinels": ("[[p]]", "[[s]]", "[[m]]"), "seed": "other", "rate": 100, "suffix_first": 100}
    got = fill_middle.transform(docs, **options)
    assert {r.form for r in got.collect()} == {"spm"}
    assert got.where(fill_middle.restored(F.col("output"), F.col("form"), options["sentinels"]) == F.regexp_replace("output", r"\[\[.\]\]", "")).count() < 50
    back = got.select("doc_id", fill_middle.restored(F.col("output"), F.col("form"), options["sentinels"]).alias("body"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))
    assert fill_middle.transform(docs.limit(0), **options).count() == 0


def test_plan_is_native_without_exchange(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = fill_middle.transform(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and plan.count("regexp_extract_all(") == 1
