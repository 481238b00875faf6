"""Stored tables that micro-batches change: whole snapshots for readers, idempotent commits for writers.

A table is a folder of Parquet buckets by a hash of its key. A commit writes new files only for
the buckets that its rows fall in, and then swaps one small pointer that names the files of
all buckets and the last batch of each writer. Readers follow the pointer and so see all of a
batch or none of it; a batch that comes again, or one that died before the swap, changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "_current.json"


def latest_changes(changes: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key: each column's last value that isn't null, in the order of ``order``; combined in each task before it is shuffled.

    A null in a change means that the change doesn't give that column. Rows without a key are left out.
    """
    rest = [c for c in changes.columns if c != key and c not in order]
    at = F.struct(*order)
    return changes.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in rest])


class SnapshotTable:
    """A table of ``schema`` (DDL) under ``folder``, one row per key."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 16):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets

    # -- the pointer -------------------------------------------------------------------

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def pointer(self) -> dict:
        path, fs = self._path(_POINTER)
        if not fs.exists(path):
            return {"version": 0, "buckets": {}, "batches": {}}
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, pointer: dict) -> None:
        """Replaces the pointer in one step: a rename over it."""
        path, fs = self._path(_POINTER)
        fresh, _ = self._path(f"_next-{uuid.uuid4().hex}.json")
        stream = fs.create(fresh, True)
        try:
            stream.write(bytearray(json.dumps(pointer).encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm.org.apache.hadoop
        options = self.spark._sc._gateway.new_array(jvm.fs.Options.Rename, 1)
        options[0] = jvm.fs.Options.Rename.OVERWRITE
        jvm.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, path, options)

    # -- readers and writers -----------------------------------------------------------

    def read(self, version: dict | None = None, spark: SparkSession | None = None) -> DataFrame:
        """The table as of the last commit, or of a pointer read before."""
        spark, paths = spark or self.spark, sorted((version or self.pointer())["buckets"].values())
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*(f"{self.folder}/{p}" for p in paths))

    def committed(self, writer: str) -> int:
        """The last batch of a writer, -1 before its first."""
        return self.pointer()["batches"].get(writer, -1)

    def commit(self, batch: int, writer: str, change: Callable[[DataFrame, DataFrame], DataFrame], delta: DataFrame, before_swap: Callable[[], None] = lambda: None, always: bool = False) -> bool:
        """Replaces the touched buckets by ``change(their rows, delta)``; False if the writer's batch was committed already.

        With ``always`` all buckets count as touched. ``change`` must leave rows in their buckets,
        that is keep their keys. One writer at a
        time may commit to a table. ``before_swap`` runs when all is written and nothing visible.
        """
        pointer = self.pointer()
        if pointer["batches"].get(writer, -1) >= batch:
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = list(range(self.buckets)) if always else [r[0] for r in delta.select(bucket.alias("b")).distinct().collect()]  # at most one row a bucket
        old = {p for b, p in pointer["buckets"].items() if int(b) in touched}
        current = self.read({"buckets": {p: p for p in old}}, delta.sparkSession)
        version, name = pointer["version"] + 1, f"data/{uuid.uuid4().hex}"
        columns = [c.split()[0] for c in self.schema.split(", ")]
        rows = change(current, delta).select(*columns).withColumn("_bucket", bucket)
        if touched:
            rows.repartition(min(len(touched), self.buckets), "_bucket").write.partitionBy("_bucket").mode("error").parquet(f"{self.folder}/{name}")
        _, fs = self._path(_POINTER)
        there = {b for b in touched if fs.exists(self._path(f"{name}/_bucket={b}")[0])}
        buckets = {b: p for b, p in pointer["buckets"].items() if int(b) not in touched} | {str(b): f"{name}/_bucket={b}" for b in there}
        before_swap()
        self._swap({"version": version, "buckets": buckets, "batches": pointer["batches"] | {writer: batch}})
        return True

    def merge(self, changes: DataFrame, batch: int, writer: str, order: Sequence[str], **more) -> bool:
        """Inserts or updates by key: only what the changes give overwrites, the last of a batch wins."""
        rest = [c for c in (f.split()[0] for f in self.schema.split(", ")) if c != self.key]

        def change(current: DataFrame, delta: DataFrame) -> DataFrame:
            b, d = current.alias("b"), delta.alias("d")
            kept = [F.coalesce(F.col(f"d.{c}"), F.col(f"b.{c}")).alias(c) if c in delta.columns else F.col(f"b.{c}") for c in rest]
            return b.join(d, F.col(f"b.{self.key}") == F.col(f"d.{self.key}"), "full_outer").select(F.coalesce(f"d.{self.key}", f"b.{self.key}").alias(self.key), *kept)

        return self.commit(batch, writer, change, latest_changes(changes, self.key, order), **more)

    def remove_old_files(self) -> int:
        """Deletes the folders of buckets that the pointer no longer names; run it when no reader follows an older one. Gives how many."""
        path, fs = self._path("data")
        live, gone = set(self.pointer()["buckets"].values()), 0
        if fs.exists(path):
            for commit in fs.listStatus(path):
                parts = [p.getPath() for p in fs.listStatus(commit.getPath()) if p.isDirectory()]
                for part in parts:
                    if f"data/{commit.getPath().getName()}/{part.getName()}" not in live:
                        fs.delete(part, True)
                        gone += 1
        return gone


def merge_stream(changes: DataFrame, table: SnapshotTable, writer: str, order: Sequence[str], checkpoint: str):
    """Starts merging a stream of changes into a table, all that is there; each micro-batch is one commit."""
    def write(batch: DataFrame, number: int) -> None:
        table.merge(batch, number, writer, order)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
