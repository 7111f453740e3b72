"""An index of chunks as a table of versions: an upsert adds to buckets or rewrites those where it replaces chunks, and readers see one version.

Chunks lie in buckets by hash of their file's name. Each version is a manifest, a small file that names the folders of every bucket; an upsert writes its chunks, by bucket, into
a folder of its own beside them, and anew only buckets where it replaces chunks or that lie in many folders. Then it puts the next manifest in place by one rename. Until that a reader, and a later run after a kill, finds
the old version; two writers cannot both put the same manifest in place, the second one fails and may try again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.retrieval import upsert

#: Buckets of a new table; folders of a bucket from which on an upsert writes it anew.
BUCKETS, FOLDERS = 64, 8


def _listed(folders: str | list[str]) -> list[str]:
    """A bucket's folders; manifests of older tables name one."""
    return [folders] if isinstance(folders, str) else folders


class IndexTable:
    """A table in a folder that driver and executors share; made with the columns of the first chunks."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _listed(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def version(self) -> int:
        """0 before the first upsert."""
        return max((int(n.removesuffix(".json")) for n in self._listed("manifests") if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "buckets": self.buckets, "schema": None, "folders": {}}
        stream = self.fs.open(self._path(f"manifests/{version:010d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        """The chunks of a version (the last one if none is given), or of some of its buckets; None before the first upsert."""
        found = self.manifest(version)
        if found["schema"] is None:
            return None
        schema = T.StructType.fromJson(found["schema"])
        return self._rows(schema, [f for b, own in found["folders"].items() if only is None or int(b) in only for f in _listed(own)])

    def _rows(self, schema: T.StructType, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, chunks: DataFrame) -> int:
        """Puts chunks (source_filename, chunk_index, more) in place of those of the same file and number; the new version's number."""
        before = self.manifest()
        n, key = before["buckets"], ["source_filename", "chunk_index"]
        schema = T.StructType.fromJson(before["schema"]) if before["schema"] else chunks.schema
        bucket = F.pmod(F.xxhash64("source_filename"), F.lit(n)).cast("int")
        folder = f"data/{uuid.uuid4().hex}"
        dealt = lambda df, over, to: df.withColumn("__bucket", bucket).repartition(over, "__bucket").write.option("compression", "zstd").partitionBy("__bucket").parquet(f"{self.root}/{folder}/{to}")
        self.fs.mkdirs(self._path(folder))
        # Written once, where most of it stays: the chunks may come from an encoder.
        dealt(chunks.select(*schema.names), n, "rows")
        at = {int(x.split("=")[1]): f"{folder}/rows/{x}" for x in self._listed(f"{folder}/rows") if x.startswith("__bucket=")}
        if not at:
            self._delete(folder)
            return before["version"]
        own = {b: _listed(before["folders"].get(str(b), [])) for b in at}
        keys = self._rows(schema, [*at.values(), *(f for old in own.values() for f in old)]).select(*key)
        # Chunks repeated in one upsert count once, too.
        twice = keys.groupBy(*key).count().where("count > 1").select(bucket.alias("b")).distinct()
        anew = sorted({r.b for r in twice.collect()} | {b for b, old in own.items() if len(old) >= FOLDERS})  # at most all buckets
        if anew:
            both = upsert(self._rows(schema, [f for b in anew for f in own[b]]), self._rows(schema, [at[b] for b in anew]))
            dealt(both, len(anew), "anew")
            for b in anew:
                self._delete(at[b])
        folders = before["folders"] | {str(b): [f"{folder}/anew/__bucket={b}"] if b in anew else [*own[b], x] for b, x in at.items()}
        self._commit({"version": before["version"] + 1, "buckets": n, "schema": json.loads(schema.json()), "folders": folders})
        return before["version"] + 1

    def _commit(self, manifest: dict) -> None:
        hidden, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{manifest['version']:010d}.json")
        stream = self.fs.create(hidden, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if self.fs.exists(final) or not self.fs.rename(hidden, final):
            self.fs.delete(hidden, False)
            raise RuntimeError(f"version {manifest['version']} was written by another run meanwhile")

    def _delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def vacuum(self, keep: int = 1) -> int:
        """Removes versions but the last ``keep``, and what no kept version names: also what killed runs left. Not while an upsert runs."""
        last = self.version()
        kept = [self.manifest(v) for v in range(max(1, last - keep + 1), last + 1)]
        for v in range(1, last - keep + 1):
            self._delete(f"manifests/{v:010d}.json")
        named = {"/".join(f.split("/")[:2]) for m in kept for own in m["folders"].values() for f in _listed(own)}
        gone = [f"data/{n}" for n in self._listed("data") if f"data/{n}" not in named]
        for name in gone:
            self._delete(name)
        return len(gone)
