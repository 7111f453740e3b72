"""Corpus pipeline: toxic documents go, repeated lines go, one document of each group of near duplicates stays, benchmark
passages' documents go, and what is left is encoded by byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. SQL cannot express the first stage, so there is no SQL for the whole; tests hold it against a brute-force version.

Defined cases, of all stages: a null or empty text is no reason to drop a row, it passes the first four and encodes to no ids; a null
doc_id passes as such; repeated rows are judged alike, and near duplicates leaves one of them; an empty table passes as an empty table, and empty
labels or benchmark drop nothing; very long texts are judged whole, alone in their worker; further columns pass the first four stages untouched,
whatever their names. What a tie means is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, decontaminate, line_dedup, ngram_join, toxicity
from ledgerloom.llm.store import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model finds toxic go; even odds count as toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; n_chars follows. A document that loses all lines stays, with an empty text.

    Of the documents that hold a line the one of largest doc_id keeps it, in all its rows.
    """
    names = line_dedup.free_names(docs, ("kept_text", "n_lines", "n_dropped"))
    kept, _, dropped = names
    found = line_dedup.with_kept_lines(docs, names=names)
    changes = {"text": F.when(F.col("text").isNotNull(), F.col(kept))}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.col(dropped) > 0, F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumns(changes).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one of smallest doc_id."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words benchmark windows cover a twentieth or more go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of the decoded bytes, a row for each row."""
    found = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("byte_bpe", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    scratch, docs = Scratch(spark), _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
