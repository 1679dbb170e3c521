"""What the decoders share: unit rows, the event envelope and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import times

#: A unit of work: a shortcut file, one event log chunk or a block of file table records.
UNITS = "path string, kind string, mtime_sec long, mtime_nano int, size long, offset long, content binary"
#: The columns of an event. extra is JSON with sorted keys; event_seq is its place in the file.
ENVELOPE = ["ts_sec", "ts_nano", "timestamp", "source", "event_type", "description", "artifact_path", "target_path", "extra", "event_seq"]


#: Rows of an Arrow batch, and bytes of the units that give them, by which a batch is closed.
ROWS, BYTES = 4096, 1 << 20


def decoded(units: DataFrame, decode: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that `decode` yields for each unit; a unit it fails on gives the rows before the failure."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return units.mapInArrow(lambda batches: batched(batches, decode, arrow), schema)


def batched(batches: Iterator[pa.RecordBatch], decode: Callable[[dict], Iterator[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of all units in few batches: small files give one row each, and a batch costs far more than a row."""
    rows, weight = [], 0
    for batch in batches:
        for unit in batch.to_pylist():
            try:
                rows.extend(decode(unit))
            except (ValueError, IndexError, OverflowError):  # malformed bytes never fail a run
                pass
            weight += len(unit["content"] or b"")
            if len(rows) >= ROWS or weight >= BYTES:
                yield from _cut(rows, schema)
                rows, weight = [], 0
    yield from _cut(rows, schema)


def _cut(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), ROWS):
        yield pa.RecordBatch.from_pylist(rows[a : a + ROWS], schema=schema)


def json_text(*fields: Column) -> Column:
    """JSON of a struct: null fields left out, keys sorted at every level."""
    return F.to_json(F.parse_json(F.to_json(F.struct(*fields))))


def envelope(df: DataFrame, at: Column, source: str, event_type: Column, description: Column, target: Column, extra: Column, seq: Column) -> DataFrame:
    return df.withColumn("_at", at).select(
        F.col("_at.sec").alias("ts_sec"),
        F.col("_at.nano").alias("ts_nano"),
        times.timestamp(F.col("_at")).alias("timestamp"),
        F.lit(source).alias("source"),
        event_type.alias("event_type"),
        description.alias("description"),
        F.col("path").alias("artifact_path"),
        target.alias("target_path"),
        extra.alias("extra"),
        seq.cast("long").alias("event_seq"),
    )


def now_moment(now: Column | None) -> Column:
    """The time of events without any: one for the whole run."""
    now = F.current_timestamp() if now is None else now
    micros = F.unix_micros(now)
    return times.moment(F.floor(micros / 1_000_000), F.pmod(micros, F.lit(1_000_000)) * 1000)
