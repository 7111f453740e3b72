"""Fill-in-the-middle transformation in Spark SQL functions alone.

A text's units (words of letters, or single other characters) are an array by ``regexp_extract_all``. Hexadecimal groups of the
SHA-256 of the seed and the id, read by ``conv``, give two cuts and the form; ``slice`` and ``array_join`` build the arrangement, and the original is
read back from it by its sentinels. Everything is a projection: no exchange, no state, a lost task is computed again to the same result.

Defined cases: a null text counts as empty and is plain, as is a text that holds a sentinel of its own; a null id is hashed as an
empty one; repeated rows are transformed alike; a very long text is transformed whole, in its row; an empty table gives an empty result;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle; seed; of a hundred documents, those that are transformed, and of those the ones with the suffix first.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SUFFIX_FIRST = "1", 90, 20
UNITS = r"[A-Za-z]+|[^A-Za-z]"


def _hashes(doc_id: Column, seed: str) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sentinels: tuple[str, str, str] = SENTINELS, seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Per document: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output."""
    p, s, m = (F.lit(x) for x in sentinels)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = own.withColumns({"units": F.regexp_extract_all("text", F.lit(UNITS), F.lit(0)), "h": F.array(*_hashes(F.col("doc_id"), seed))})
    size = F.size("units")
    a, b = (F.pmod(F.col("h")[i], (size + 1).cast("long")).cast("int") for i in (0, 1))
    plain = (F.col("text") == "") | F.contains("text", p) | F.contains("text", s) | F.contains("text", m) | (F.col("h")[2] % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < suffix_first, "spm").otherwise("psm")
    placed = cut.withColumns({"low": F.least(a, b), "high": F.greatest(a, b), "form": form})
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    parts = {"prefix": part(F.lit(1), F.col("low")), "middle": part(F.col("low") + 1, F.col("high") - F.col("low")), "suffix": part(F.col("high") + 1, size - F.col("high"))}
    shaped = F.col("form") != "plain"
    built = placed.select("doc_id", "text", "form", size.cast("long").alias("n"), *(F.when(shaped, x).alias(name) for name, x in parts.items()))
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("text"))
    return built.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The original text of an output. A transformed text held no sentinel, and no sentinel begins as another ends, so each stands there once."""
    p, s, m = sentinels
    between = lambda left, right: F.substring_index(F.substring_index(output, right, 1), left, -1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "psm", F.concat(between(p, s), middle, between(s, m))).when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(output)
