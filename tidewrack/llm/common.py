"""Shared plumbing of the corpus operators: scratch tables and column names."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors (``spark.checkpoint.dir``).

    It is set to a local folder only where a local-mode session leaves it
    unset, as in tests. On a cluster an unset folder is an error: executors
    would not see each other's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


#: Whether Spark removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables as Parquet in the shared checkpoint folder.

    A written table cuts the lineage, survives the loss of executors and is
    read by all of them. Tables that a result still reads live until the
    driver ends; the others are dropped by the operator itself. With `tidy`,
    the shuffle files of a table go as soon as it is written.
    """

    def __init__(self, spark: SparkSession, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        self.base = f"{checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.base)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit; leftovers are harmless
            pass

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write `df` as table `name` (replacing it) and read it back."""
        path = f"{self.base}/{name}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true" if self.tidy else before)
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.base}/{name}")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch holds: whole texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def parts(spark: SparkSession) -> int:
    """The session's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by `key`, one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1 if batch.num_rows > 1 else np.zeros(0, int)
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            name = tuple(c[a] for c in cols)
            if held and name != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = name
    if held:
        yield pa.Table.from_batches(held)
