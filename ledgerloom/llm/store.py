"""Written intermediate tables in the folder that driver and executors share, and the session settings of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches of at most so many rows and bytes, so that long texts keep Python workers small.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, a folder of its own, but only on a local master (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Sets the batches' bounds where the session leaves them open; DataFrames run after the call, so they stay set."""
    own = spark._jsparkSession.sessionState().conf()
    for name, value in BATCH.items():
        if not own.contains(name):
            spark.conf.set(name, value)


def fresh(taken: Iterable[str], name: str, *others: str) -> str:
    """A column name like ``name`` that none of the taken ones clashes with, whatever their case."""
    held = {c.lower() for c in (*taken, *others)}
    while name.lower() in held:
        name += "_"
    return name


class Scratch:
    """Tables written by one run. They outlive a lost executor, cut the lineage, and go when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        path = self._path(self.root)
        self._fs(path).deleteOnExit(path)
        self.count = 0

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        name = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(name)
        back = self.spark.read.schema(df.schema).parquet(name)
        back._scratch_name = name
        return back

    def drop(self, df: DataFrame) -> None:
        """Removes a table that nothing reads any more."""
        path = self._path(df._scratch_name)
        self._fs(path).delete(path, True)
