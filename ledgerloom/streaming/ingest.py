"""Documents as they arrive: a file stream whose batches go through the same plan as a batch job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import file_kind


def file_stream(spark: SparkSession, path: str, pattern: str = "*", per_trigger: int = 1000) -> DataFrame:
    """doc_id, kind and content of new files under a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)
    return raw.select(F.col("path").alias("doc_id"), file_kind(F.col("path")).alias("kind"), "content")


def ingest(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends handle(batch) to a Parquet folder partitioned by batch; a batch run again replaces its own partition."""

    def write(batch: DataFrame, number: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
