"""Company numbers of long texts: against a plain search, and in linear time."""

import random
import re
import time

from pyspark.sql import functions as F

from ledgerloom.operators import rules

CIN = re.compile(r"\b[LUu]\d{5}[A-Za-z]{2}\d{4}[A-Za-z]{3}\d{6}\b")


def plain(text):
    apart = re.compile(r"arm'?s\s+length|related\s+part(?:y|ies)", re.I)
    return sorted({m[0].upper() for m in CIN.finditer(text) if not apart.search(text[max(0, m.start() - 300) : m.start()])})


def number(rng):
    return f"{rng.choice('LUu')}{rng.randrange(10**5):05d}{rng.choice(['MH', 'dl'])}{rng.randrange(1900, 2030)}{rng.choice(['PLC', 'ptc'])}{rng.randrange(10**6):06d}"


def test_numbers_equal_a_plain_search(spark):
    rng = random.Random(6)
    known = [number(rng) for _ in range(5)]
    rows = ["", None, known[0], f"x{known[0]}", f"{known[0]}9", f"{known[0]} {known[1]}"]
    for _ in range(200):
        parts = [rng.choice([*known, "related party", "Arm's  length", "word " * rng.randrange(60), "\n", "é 字 ", "related\nparties", "x" * rng.randrange(300)]) for _ in range(rng.randrange(1, 12))]
        rows.append(rng.choice([" ", "\n", ", "]).join(parts))
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", rules.distinct_cins(F.col("t")).alias("c")).collect()
    for r in got:
        if rows[r.i] is not None:
            assert r.c == plain(rows[r.i]), rows[r.i]
    assert {r.i: r.c for r in got}[1] is None and sum(len(r.c or ()) for r in got) > 100


def test_many_numbers_take_linear_time(spark):
    rng = random.Random(7)
    took = {}
    for n in (2000, 2000, 16_000):
        text = " ".join(number(rng) for _ in range(n))
        df = spark.createDataFrame([(text,)], "t string").select(F.size(rules.distinct_cins(F.col("t"))).alias("n"))
        began = time.perf_counter()
        assert df.first().n > 0.9 * n
        took[n] = time.perf_counter() - began
    print(took)
    assert took[16_000] < 16 * took[2000] + 2
