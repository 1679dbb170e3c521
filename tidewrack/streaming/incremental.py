"""Incremental timelines: files that arrive in a folder are decoded once each."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.timeline import timeline
from ..sources.triage import units_of


def watch(spark: SparkSession, root: str, out: str, state: str, once: bool = True) -> StreamingQuery:
    """Append the events of new files below `root` to the Parquet table `out`; `state` keeps what is done.

    once: handle what is there and stop, else go on. Files are whole rows here,
    so the largest must fit binaryFile's limit; larger ones go through the
    triage source.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)
    micros = F.unix_micros("modificationTime")
    timed = files.select("path", "content", F.floor(micros / 1_000_000).alias("mtime_sec"), (F.pmod(micros, F.lit(1_000_000)) * 1000).cast("int").alias("mtime_nano"))
    writer = timeline(units_of(timed)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
