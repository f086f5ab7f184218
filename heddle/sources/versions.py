"""A table of keyed rows that is replaced as a whole: readers see one version, never a half.

Rows lie in buckets by hash of their key. A version is a small manifest that says where each bucket's files are; a write puts the buckets that it
touches into a new folder, lists them with the others' old places in the next manifest, and commits it by a rename that fails if
another writer was first (then nothing of this write is seen). Readers take the newest manifest and are not disturbed by writes, nor
by ones that died before their rename. What comes to the driver is a number for each bucket.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heddle.sources.sinks import upsert

BUCKETS, BUCKET = 64, "__bucket"


class Conflict(RuntimeError):
    """Another write was committed since this one began. It may be tried again."""


class Versions:
    def __init__(self, spark: SparkSession, folder: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self.log = self._path(f"{self.folder}/versions")
        self.files = self.log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.fs.Path(name)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def versions(self) -> list[int]:
        if not self.files.exists(self.log):
            return []
        names = [f.getPath().getName() for f in self.files.listStatus(self.log)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, version: int | None) -> dict:
        known = self.versions()
        at = (known[-1] if known else 0) if version is None else version
        if not at:
            return {"version": 0, "schema": None, "places": {}}
        stream = self.files.open(self._path(f"{self.folder}/versions/{at:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _rows(self, manifest: dict, only: set[int] | None = None) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.folder}/data/{place}/{BUCKET}={b}" for b, place in manifest["places"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version's rows, or an older one's."""
        rows = self._rows(self._manifest(version))
        if rows is None:
            raise FileNotFoundError(f"nothing was written to {self.folder}")
        return rows

    def upsert(self, new: DataFrame, seq: str, base: int | None = None) -> int:
        """Of each key the row with the highest seq, of the table's and the new ones; the version that has it. ``base`` is the version that the
        caller has seen; only buckets with new keys are read and written."""
        manifest = self._manifest(base)
        place = uuid.uuid4().hex
        placed = new.withColumn(BUCKET, self._bucket())
        touched = {r[0] for r in placed.select(BUCKET).distinct().collect()}  # at most ``buckets`` numbers
        merged = upsert(self._rows(manifest, touched), new, self.key, seq)
        merged.withColumn(BUCKET, self._bucket()).repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.folder}/data/{place}")
        next_one = {"version": manifest["version"] + 1, "schema": merged.schema.jsonValue(), "places": manifest["places"] | {str(b): place for b in sorted(touched)}}
        self._commit(next_one)
        return next_one["version"]

    def _commit(self, manifest: dict) -> None:
        name = self._path(f"{self.folder}/versions/{manifest['version']:012d}.json")
        draft = self._path(f"{self.folder}/versions/.{uuid.uuid4().hex}")
        out = self.files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        context = self.hadoop.fs.FileContext.getFileContext(self.log.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.hadoop.fs.Options.Rename, 1)
        none[0] = self.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, name, none)
        except Exception as error:
            self.files.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {manifest['version']} is there already") from error
            raise

    def forget(self, keep: int = 2) -> None:
        """Remove all but the newest versions, and the files that only those had."""
        known = self.versions()
        used = {p for v in known[-keep:] for p in self._manifest(v)["places"].values()}
        gone = {p for v in known[:-keep] for p in self._manifest(v)["places"].values()} - used
        for v in known[:-keep]:
            self.files.delete(self._path(f"{self.folder}/versions/{v:012d}.json"), False)
        for place in gone:
            self.files.delete(self._path(f"{self.folder}/data/{place}"), True)
