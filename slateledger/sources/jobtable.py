"""A table of jobs that several writers change: whole snapshots, switched by a log of numbered versions.

A version is a small file that names its snapshot; it is put in place under a name that must not exist yet, so of
two writers that both read version n only one makes n + 1, and the other merges again into what it then finds. Readers
follow the highest version, whose snapshot was complete before it was named. The store must refuse to rename onto an existing file
(as HDFS and local folders do).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY, REVISION = "job_id", "revision"


class Conflict(Exception):
    """A row was changed since the writer read it, or a version was taken too often by others."""


class JobTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._fs = self._path("log").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("log"))

    def versions(self) -> list[int]:
        return sorted(int(n) for s in self._fs.listStatus(self._path("log")) if (n := s.getPath().getName()).isdigit())

    def _snapshot(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"log/{version:020d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> tuple[int, DataFrame | None]:
        """The current (or a given) version and its rows; version 0 without any."""
        found = self.versions()
        at = version if version is not None else found[-1] if found else 0
        if not at:
            return 0, None
        s = self._snapshot(at)
        return at, self.spark.read.schema(s["schema"]).parquet(f"{self.path}/{s['snapshot']}")

    def _commit(self, version: int, snapshot: str, schema: str) -> bool:
        """Name the snapshot as this version; False if the version exists."""
        jvm, own = self.spark._jvm, self._path(f"log/.{uuid.uuid4().hex}")
        out = self._fs.create(own, False)
        out.write(json.dumps({"snapshot": snapshot, "schema": schema}).encode())
        out.close()
        to = self._path(f"log/{version:020d}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(own, to, none)
            return True
        except Exception as e:
            self._fs.delete(own, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise

    def merge(self, changes: DataFrame, attempts: int = 20) -> int:
        """Put the changes in, by job_id: new jobs are added, of known ones the columns that changes has and that aren't null
        are set; the new version's number is returned. Every change raises a row's revision by one.

        Where changes has a revision (the one that its writer read), rows whose revision has moved on since raise
        Conflict, and nothing is written. Without one the last writer's columns hold. Of several changes of a job in one call
        the first by its columns counts; changes without a job_id are left out.
        """
        order = [F.col(c) for c in changes.columns if c != KEY] or [F.col(KEY)]
        one = changes.where(F.col(KEY).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy(KEY).orderBy(*order))).where("_k = 1").drop("_k")
        checked = REVISION in changes.columns
        for _ in range(attempts):
            version, now = self.read()
            new = self._merged(now, one, checked)
            snapshot = f"data/{uuid.uuid4().hex}"
            new.write.parquet(f"{self.path}/{snapshot}")
            if self._commit(version + 1, snapshot, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema)):
                return version + 1
            self._fs.delete(self._path(snapshot), True)
        raise Conflict(f"version {version + 1} was taken in each of {attempts} attempts")

    def _merged(self, now: DataFrame | None, changes: DataFrame, checked: bool) -> DataFrame:
        fields = [c for c in changes.columns if c not in (KEY, REVISION)]
        if now is None:
            return changes.select(KEY, *fields, F.lit(1).cast("long").alias(REVISION))
        theirs = changes.select(F.col(KEY).alias("_key"), *[F.col(c).alias(f"_{c}") for c in fields], (F.col(REVISION) if checked else F.lit(None)).cast("long").alias("_revision"))
        both = now.join(theirs, now[KEY] == theirs["_key"], "full")
        if checked and not both.where((F.col("_key").isNotNull()) & F.col("_revision").isNotNull() & ~F.col("_revision").eqNullSafe(F.coalesce(REVISION, F.lit(0)))).isEmpty():
            raise Conflict("rows were changed since they were read")
        old = [c for c in now.columns if c not in (KEY, REVISION)]
        value = lambda c: (F.coalesce(f"_{c}", c) if c in fields and c in old else F.col(f"_{c}") if c in fields else F.col(c)).alias(c)
        raised = (F.coalesce(REVISION, F.lit(0)) + F.when(F.col("_key").isNotNull(), 1).otherwise(0)).cast("long")
        return both.select(F.coalesce(KEY, "_key").alias(KEY), *[value(c) for c in [*old, *[c for c in fields if c not in old]]], raised.alias(REVISION))

    def vacuum(self, keep: int = 2) -> None:
        """Drop all versions but the last `keep`, and their snapshots; readers of older ones must be done."""
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(self._snapshot(v)["snapshot"]), True)
            self._fs.delete(self._path(f"log/{v:020d}"), False)
