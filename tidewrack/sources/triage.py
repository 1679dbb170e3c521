"""The `triage` data source: a directory of collected artifacts as units of work.

Every regular file is listed, hidden names too; links are not followed and a
missing directory is empty. Files are recognised by their first bytes alone.
Shortcuts are read whole, event logs by runs of chunks and file tables by runs
of records, so the largest row stays small however large a file is.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import evtx, lnk, mft
from ..operators.base import ROWS, UNITS

SIGNATURES = (("lnk", lnk.SIGNATURE), ("evtx", evtx.SIGNATURE), ("mft", mft.SIGNATURE))
#: Bytes of a partition and of a row of each kind.
PART = 64 << 20
ROW = {"evtx": evtx.CHUNK, "mft": 256 * mft.RECORD}
#: Bytes of an Arrow batch beyond which no row is added.
BATCH = 4 << 20
#: UNITS in Arrow; a worker has no session to parse them with.
ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("mtime_sec", pa.int64()), ("mtime_nano", pa.int32()), ("size", pa.int64()), ("offset", pa.int64()), ("content", pa.binary())])


def kind_of(head: bytes) -> str | None:
    return next((kind for kind, magic in SIGNATURES if head.startswith(magic)), None)


@dataclass
class Part(InputPartition):
    """Byte ranges of files: (path, offset, end); none is a whole file."""

    ranges: tuple


def walk(root: str) -> Iterator[tuple[str, int]]:
    """(path, size) of regular files below `root`, in path order; entries that cannot be read are left out."""
    try:
        at = os.lstat(root)
    except OSError:
        return
    if stat.S_ISREG(at.st_mode):
        yield root, at.st_size
        return
    for folder, below, names in os.walk(root):
        below.sort()
        for name in sorted(names):
            path = os.path.join(folder, name)
            try:
                at = os.lstat(path)
                if stat.S_ISREG(at.st_mode):
                    yield path, at.st_size
            except OSError:
                pass


def kind_at(path: str) -> str | None:
    try:
        with open(path, "rb") as f:
            return kind_of(f.read(20))
    except OSError:
        return None


def ranges(path: str, size: int) -> Iterator[tuple]:
    """Byte ranges of a file, each within one partition; a file that fits one is not opened here."""
    kind = kind_at(path) if size > PART else None
    if kind == "evtx":
        first, last = evtx.HEADER, min(size, evtx.HEADER + evtx.CHUNKS * evtx.CHUNK)
    elif kind == "mft":
        first, last = 0, size
    else:
        yield path, None, None
        return
    step = PART // ROW[kind] * ROW[kind]
    for at in range(first, max(last, first + 1), step):
        yield path, at, min(last, at + step)


class Opened:
    """The bare descriptor of a file: most are closed after their first bytes, for which a file object costs too much."""

    def __init__(self, path: str):
        self.fd = os.open(path, os.O_RDONLY | os.O_CLOEXEC)

    def __enter__(self) -> int:
        return self.fd

    def __exit__(self, *_) -> None:
        os.close(self.fd)


class TriageReader(DataSourceReader):
    def __init__(self, root: str, kind: str | None):
        self.root, self.kind = root, kind

    def partitions(self) -> list[Part]:
        """The driver only lists; files are recognised where they are read."""
        parts, held, weight = [], [], 0
        for path, size in walk(self.root):
            for r in ranges(path, size):
                held.append(r)
                weight += min(size, PART) + 4096
                if weight >= PART:
                    parts.append(Part(tuple(held)))
                    held, weight = [], 0
        return [*parts, Part(tuple(held))] if held or not parts else parts

    def read(self, partition: Part) -> Iterator[tuple]:
        for path, at, end in partition.ranges:
            try:
                with Opened(path) as fd:
                    head = os.read(fd, 20)
                    kind = kind_of(head)
                    if self.kind and kind != self.kind:
                        continue
                    f, said = os.fdopen(fd, "rb", closefd=False), os.fstat(fd)
                    mtime, size = said.st_mtime_ns, said.st_size
                    row = lambda offset, content: (path, kind, mtime // 10**9, mtime % 10**9, size, offset, content)  # noqa: B023, E731
                    if kind is None:
                        yield row(0, None)
                        continue
                    if kind == "lnk":
                        yield row(0, head + f.read())
                        continue
                    if at is None:
                        at, end = (evtx.HEADER, min(size, evtx.HEADER + evtx.CHUNKS * evtx.CHUNK)) if kind == "evtx" else (0, size)
                    f.seek(at)
                    empty = at >= end
                    while at < end and (content := f.read(min(ROW[kind], end - at))):
                        yield row(at, content)
                        at += len(content)
                    if empty:
                        yield row(at, None)
            except OSError:
                continue


class BatchReader(TriageReader):
    """The same rows in Arrow batches of bounded rows and bytes."""

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows, weight = [], 0
        for row in super().read(partition):
            rows.append(row)
            weight += len(row[-1] or b"")
            if len(rows) >= ROWS or weight >= BATCH:
                yield _batch(rows)
                rows, weight = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class TriageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "triage"

    def schema(self) -> str:
        return UNITS

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options["path"], self.options.get("kind"))


def read(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """Units of all files below `root` (a folder or one file), or of those of one kind; files of no known kind have a null kind."""
    spark.dataSource.register(TriageSource)
    source = spark.read.format("triage")
    return (source.option("kind", kind) if kind else source).load(root)


def units_of(files: DataFrame) -> DataFrame:
    """Units of `files` (path, content, optional mtime_sec and mtime_nano), cut by native expressions."""
    for name, kind in (("mtime_sec", "long"), ("mtime_nano", "int")):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(kind))
    kind = F.when(F.lit(False), "")
    for name, magic in SIGNATURES:
        kind = kind.when(F.substring("content", 1, len(magic)) == F.lit(magic), name)
    size = F.octet_length("content").cast("long")
    rows = files.select("path", kind.alias("kind"), "mtime_sec", "mtime_nano", size.alias("size"), "content")
    first = F.when(F.col("kind") == "evtx", evtx.HEADER).otherwise(0)
    step = F.when(F.col("kind") == "evtx", ROW["evtx"]).otherwise(ROW["mft"])
    least = F.when(F.col("kind") == "evtx", evtx.CHUNK).otherwise(mft.RECORD)
    whole = F.floor((F.col("size") - first) / least)
    count = F.when(F.col("kind") == "evtx", F.least(whole, F.lit(evtx.CHUNKS))).otherwise(F.ceil(whole * least / step))
    many = F.col("kind").isin("evtx", "mft") & (count > 0)
    # a sequence to -1 would run downwards, so there is always one part
    parts = F.when(many, F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array(F.lit(0).cast("long")))
    rows = rows.withColumn("part", F.explode(parts)).withColumn("offset", (first + F.col("part") * step).cast("long"))
    cut = F.when(F.col("kind") == "lnk", F.col("content")).when(F.col("kind").isNotNull(), F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), step.cast("int")))
    return rows.select("path", "kind", "mtime_sec", "mtime_nano", "size", "offset", cut.alias("content"))
