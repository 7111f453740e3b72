"""Mapping of line items to the chart of accounts: overrides and exact labels as joins, then similarity on what is left.

Only distinct labels that no cheaper step resolves reach the similarity step; the 121 variants travel with the function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import weighted_ratio
from ..functions.similarity_join import Variants
from ..functions.text import clean_label
from ..functions.vocabulary import STATEMENT, chart, lookup, variants_frame
from .retrieval import best_by_cosine

FUZZY, FUZZY_LEAST, COSINE = 90.0, 60.0, 0.82
#: Parts that the rows of one label are dealt to where they meet its key.
PARTS = 1024


def override(label: Column) -> Column:
    """Key of payables by size of the creditor, where the label's wording settles it."""
    low = F.lower(label)
    others = low.rlike(r"(?U)other than\s+micro")
    small = low.contains("micro") & low.contains("enterprise") & ~low.contains("other than") & (low.contains("due") | low.contains("payable"))
    return F.when(others, "trade_payables_others").when(small, "trade_payables_mse")


def _most(label: str, variant: str) -> float:
    """A bound of the weighted ratio by the lengths alone."""
    short, long = sorted((len(label), len(variant)))
    if not short:
        return 0.0
    return 100.0 if long < 1.5 * short else max(200 * short / (short + long), 90.0 if long <= 8 * short else 60.0)


def _best_variant(label: str, variants: list[tuple[str, str]]) -> tuple[str, float]:
    """Key and score of the best variant, the first of equals; variants that cannot reach the best so far are not compared."""
    best, score = 0, -1.0
    for most, i in sorted(((_most(label, v), i) for i, (_, v) in enumerate(variants)), key=lambda x: (-x[0], x[1])):
        if most < score or (most == score and i > best):
            continue
        found = weighted_ratio(label, variants[i][1])
        if found > score or (found == score and i < best):
            best, score = i, found
    return variants[best][0], score


def fuzzy_scores(labels: DataFrame) -> DataFrame:
    """label, fuzzy_key, score of distinct cleaned labels: the best variant, the first of equals."""
    variants = [(key, v) for _, key, vs in chart() for v in vs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fixed = np.array([k for k, _ in variants], object), Variants([v for _, v in variants])
        for batch in batches:
            best, score = fixed.best(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys[best], pa.string()), pa.array(score)], ["label", "fuzzy_key", "score"])

    return labels.select("label").mapInArrow(run, "label string, fuzzy_key string, score double")


def map_labels(labels: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """raw_label, label, canonical_key, confidence, method of distinct raw labels.

    embed: adds embedding_key and cosine to labels between the two similarity bounds; without a model that step is off.
    """
    spark = labels.sparkSession
    # Unfolded from an array of one: filters of plain columns would go below the distinct step and be evaluated for each row.
    wording = F.struct(clean_label(F.col("raw_label")).alias("label"), override(F.col("raw_label")).alias("override_key"))
    cleaned = labels.select("raw_label").distinct().select("raw_label", F.inline(F.array(wording)))
    dim = F.broadcast(variants_frame(spark).select(F.col("variant").alias("label"), F.col("key").alias("exact_key")))
    refused = F.col("label").isin("", "total")
    known = cleaned.join(dim, "label", "left").withColumn("refused", refused)
    open_labels = known.where(~F.col("refused") & F.col("override_key").isNull() & F.col("exact_key").isNull()).select("label").distinct()
    fuzzy = fuzzy_scores(open_labels)
    if embed is not None:
        between = fuzzy.where(F.col("score").between(FUZZY_LEAST, FUZZY))
        fuzzy = fuzzy.join(embed(between.select("label")).select("label", "embedding_key", "cosine"), "label", "left")
    else:
        fuzzy = fuzzy.withColumns({"embedding_key": F.lit(None).cast("string"), "cosine": F.lit(None).cast("double")})
    all_known = known.join(fuzzy, "label", "left")
    sure = F.coalesce("override_key", "exact_key")
    by = F.when(F.col("refused"), F.struct(F.lit(None).cast("string").alias("key"), F.lit(0.0).alias("confidence"), F.lit("unknown").alias("method")))
    by = by.when(sure.isNotNull(), F.struct(sure.alias("key"), F.lit(1.0).alias("confidence"), F.lit("exact").alias("method")))
    by = by.when(F.col("score") > FUZZY, F.struct(F.col("fuzzy_key").alias("key"), (F.col("score") / 100).alias("confidence"), F.lit("fuzzy").alias("method")))
    by = by.when(F.col("cosine") > COSINE, F.struct(F.col("embedding_key").alias("key"), F.col("cosine").alias("confidence"), F.lit("embedding").alias("method")))
    by = by.otherwise(F.struct(F.lit(None).cast("string").alias("key"), F.lit(0.0).alias("confidence"), F.lit("unknown").alias("method")))
    return all_known.withColumn("by", by).select("raw_label", "label", F.col("by.key").alias("canonical_key"), F.col("by.confidence"), F.col("by.method"))


def guard_statement(items: DataFrame) -> DataFrame:
    """A key of another statement than the sheet's is refused; sheets of unknown type refuse nothing."""
    crosses = F.col("canonical_key").isNotNull() & F.col("sheet_type").isNotNull() & (F.col("sheet_type") != "unknown") & (lookup(F.col("canonical_key"), STATEMENT) != F.col("sheet_type"))
    return items.withColumns({"canonical_key": F.when(~crosses, F.col("canonical_key")), "confidence": F.when(crosses, 0.0).otherwise(F.col("confidence")), "method": F.when(crosses, "unknown").otherwise(F.col("method"))})


def structural_total(items: DataFrame, table: list[str], order: str = "row_ord") -> DataFrame:
    """The first unmapped "total" of a table with at least three balance sheet keys is total assets."""
    own = Window.partitionBy(*table)
    sheet = F.count_if(lookup(F.col("canonical_key"), STATEMENT) == "balance_sheet").over(own)
    open_total = F.col("canonical_key").isNull() & (clean_label(F.col("raw_label")) == "total")
    first = F.min(F.when(open_total, F.col(order))).over(own)
    marked = items.withColumn("__hit", (sheet >= 3) & open_total & (F.col(order) == first))
    return marked.withColumns({"canonical_key": F.when(F.col("__hit"), "total_assets").otherwise(F.col("canonical_key")), "confidence": F.when(F.col("__hit"), 0.6).otherwise(F.col("confidence")), "method": F.when(F.col("__hit"), "structural").otherwise(F.col("method"))}).drop("__hit")


def map_items(rows: DataFrame, table: list[str], embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Read rows (doc_id, the table's keys, row_ord, sheet_type, label, current, prior, note_ref) as numbered line items.

    One label may stand in most rows: these meet its key by label and part, and a label's key goes only to the parts that it has.
    """
    named = rows.withColumnsRenamed({"label": "raw_label", "current": "current_value", "prior": "prior_value"}).withColumn("__part", F.pmod(F.xxhash64(*table, "row_ord"), F.lit(PARTS)))
    found = map_labels(named, embed).drop("label").withColumn("unresolved", F.col("method") == "unknown")
    parts = named.select("raw_label", "__part").distinct().join(found, "raw_label")
    mapped = structural_total(guard_statement(named.join(parts, ["raw_label", "__part"]).drop("__part")), table)
    order = Window.partitionBy("doc_id").orderBy(*[c for c in table if c != "doc_id"], "row_ord")
    return mapped.withColumn("item_idx", F.row_number().over(order) - 1)


def face_sheets(sheets: DataFrame) -> DataFrame:
    """Sheets of a recognised type; all sheets of a document that has none."""
    known = F.col("sheet_type") != "unknown"
    some = F.bool_or(known).over(Window.partitionBy("doc_id"))
    return sheets.withColumn("__some", some).where(known | ~F.col("__some")).drop("__some")


def _open(items: DataFrame) -> Column:
    """Items that no step resolved, other than empty labels and "total"; those that only the statement's type refused are resolved."""
    left = F.col("unresolved") if "unresolved" in items.columns else F.col("method") == "unknown"
    return left & ~clean_label(F.col("raw_label")).isin("", "total")


def unmapped_labels(items: DataFrame) -> DataFrame:
    """Labels worth a look, counted."""
    return items.where(_open(items)).groupBy("raw_label").agg(F.count("*").alias("n"))


def write_unmapped(items: DataFrame, path: str) -> None:
    """Appends the label of each unresolved item, as it stands in the filing, to a folder of text lines."""
    items.where(_open(items)).select(F.regexp_replace("raw_label", r"\R", " ").alias("value")).write.mode("append").text(path)


Encoder = Callable[[list[str]], "np.ndarray"]


def encoded(texts: DataFrame, column: str, encode: Encoder, out: str = "embedding", batch: int = 32) -> DataFrame:
    """The rows with the unit vectors that the encoder gives for a text column, in batches of its size; null texts give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            values = part.column(part.schema.get_field_index(column)).to_pylist()
            known = [i for i, v in enumerate(values) if v is not None]
            vectors: list[list[float] | None] = [None] * len(values)
            for at in range(0, len(known), batch):
                made = np.asarray(encode([values[i] for i in known[at : at + batch]]), np.float32)
                for i, v in zip(known[at : at + batch], made / np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-12), strict=True):
                    vectors[i] = v.tolist()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], [*part.schema.names, out])

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def embedding_step(spark: SparkSession, encode: Encoder, threshold: float = COSINE) -> Callable[[DataFrame], DataFrame]:
    """The embedding step of map_labels: the chart's variants are encoded once, here, and travel to the labels."""
    variants = [(key, v, i) for i, (key, v) in enumerate((key, v) for _, key, vs in chart() for v in vs)]
    vectors = np.asarray(encode([v for _, v, _ in variants]), np.float32)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    candidates = spark.createDataFrame([(key, i, x.tolist()) for (key, _, i), x in zip(variants, vectors, strict=True)], "candidate string, ord int, embedding array<float>")

    def step(labels: DataFrame) -> DataFrame:
        queries = encoded(labels.select(F.col("label").alias("query")), "query", encode)
        best = best_by_cosine(queries, candidates, threshold)
        return best.select(F.col("query").alias("label"), F.col("candidate").alias("embedding_key"), "cosine")

    return step
