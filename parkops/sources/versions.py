"""Numbered versions of a set of tables, with copy-on-write updates (the sink of SURVEY §2 A3,
A4 and I).

A version is a manifest file: for every table its schema and, per bucket of its key, the
folder that holds the bucket's rows. Data folders are written first, under new names; the
manifest is written under a scratch name and then renamed to its number, which fails if that
number exists. So a reader finds either the version before or the whole version after, and of
two writers that start from one version one is refused. Nothing is changed in place.

An update rewrites only the buckets that hold a key of the batch; the new manifest lists them
and the untouched folders of the others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parkops.sources import schema as S

_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer made the version first."""


class Versions:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- manifests ---

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("_versions").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> int:
        """The number of the last version, 0 if there is none."""
        fs, folder = self._fs(), self._path("_versions")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        if version == 0:
            return {"tables": {}}
        path = f"{self.root}/_versions/{version:012d}.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def commit(self, tables: dict, base: int) -> int:
        """Make version ``base + 1`` of the tables; Conflict if it exists already."""
        jvm, number = self.spark._jvm, base + 1
        made, final = self._path(f"_versions/.{uuid.uuid4().hex}"), self._path(f"_versions/{number:012d}.json")
        out = self._fs().create(made, False)
        try:
            out.write(bytearray(json.dumps({"version": number, "tables": tables}).encode()))
        finally:
            out.close()
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(made, final, no_options)
        except Py4JJavaError as e:
            self._fs().delete(made, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {number} exists") from e
            raise
        return number

    # --- tables ---

    def _key(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in S.PRIMARY_KEYS[table]]),
                      F.lit(self.buckets)).cast("int")

    def _write(self, table: str, df: DataFrame) -> dict[str, str]:
        """Write rows under a new folder; (bucket -> folder) of the buckets that got rows."""
        folder = f"data/{table}/{uuid.uuid4().hex}"
        (df.withColumn(_BUCKET, self._key(table)).repartition(self.buckets, _BUCKET)
         .write.partitionBy(_BUCKET).parquet(f"{self.root}/{folder}"))
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path(folder)) if s.isDirectory()]
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(_BUCKET + "=")}

    def write(self, tables: dict[str, DataFrame]) -> int:
        """A version with these tables whole and the others as they were."""
        base = self.latest()
        now = self.manifest(base)["tables"]
        for name, df in tables.items():
            now[name] = {"schema": df.schema.json(), "buckets": self._write(name, df)}
        return self.commit(now, base)

    def read(self, table: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of a version (the last one), or only some of its buckets."""
        entry = self.manifest(version)["tables"][table]
        schema = StructType.fromJson(json.loads(entry["schema"]))
        wanted = [p for b, p in entry["buckets"].items() if buckets is None or int(b) in buckets]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in sorted(wanted)])

    def update(self, table: str, batch: DataFrame,
               change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """A version in which ``change(rows, batch)`` takes the place of the rows of the buckets
        that the batch's keys lie in. ``batch`` has the table's key columns; ``change`` keeps,
        changes, adds or leaves out rows of those keys. Other buckets are neither read nor
        written."""
        base = self.latest()
        now = self.manifest(base)["tables"]
        entry = now[table]
        # at most one row per bucket
        touched = [r[0] for r in batch.select(self._key(table)).distinct().collect()]
        rows = self.read(table, base, touched)
        written = self._write(table, change(rows, batch).select(*rows.columns))
        kept = {b: p for b, p in entry["buckets"].items() if int(b) not in touched}
        stray = set(map(int, written)) - set(touched)
        if stray:
            raise ValueError(f"the change made rows outside the batch's buckets: {sorted(stray)[:5]}")
        now[table] = {"schema": entry["schema"], "buckets": kept | written}
        return self.commit(now, base)
