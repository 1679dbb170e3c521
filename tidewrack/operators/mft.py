"""NTFS master file table: 1024-byte records to up to four events each."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import number, piece, signed, wide
from ..functions.times import filetime_strict
from .base import decoded, envelope, json_text

SIGNATURE = b"FILE"
RECORD, SECTOR, ATTRIBUTES, LAST = 1024, 512, 64, 0xFFFFFFFF
STANDARD, NAME = 0x10, 0x30
PARENT_BITS = (1 << 48) - 1
#: Seconds by which creation times may differ.
SKEW = 60
# Fixed texts: kind, event type, verb, in the order of events.
KINDS = (("created", "mft_file_created", "created"), ("modified", "mft_file_modified", "modified"), ("changed", "mft_entry_modified", "MFT entry modified"), ("accessed", "mft_file_accessed", "accessed"))
NOTE = "$STANDARD_INFORMATION creation time differs from $FILE_NAME creation time by more than 60s"
RAW = "path string, entry long, created long, modified long, changed long, accessed long, parent long, fn_created long, name string, namespace int"


def repaired(record: bytes) -> bytes | None:
    """The record with its saved sector ends put back; None if the update sequence is missing or outside."""
    at, count = number(record, 4, 2), number(record, 6, 2)
    saved = piece(record, at, 2 * count) if count else None
    if saved is None:
        return None
    out = bytearray(record)
    for k in range(1, count):
        end = k * SECTOR
        if end <= len(out):
            out[end - 2 : end] = saved[2 * k : 2 * k + 2]
    return bytes(out)


def attributes(record: bytes) -> Iterator[tuple[int, bytes]]:
    """(type, content) of the resident attributes."""
    at = number(record, 20, 2) or 0
    for _ in range(ATTRIBUTES):
        kind, length = number(record, at, 4), number(record, at + 4, 4)
        if kind is None or length is None or kind == LAST or length < 8 or at + length > len(record):
            return
        if number(record, at + 8, 1) == 0:
            size, start = number(record, at + 16, 4), number(record, at + 20, 2)
            content = piece(record, at + start, size) if size is not None and start is not None else None
            if content is not None:
                yield kind, content
        at += length


def record_row(record: bytes) -> dict | None:
    """Times and best name of a record; of several names the lowest namespace wins, the last of equals."""
    record = repaired(record)
    if record is None:
        return None
    row: dict = {}
    for kind, content in attributes(record):
        if kind == STANDARD:  # the last one counts, also if it is too short to hold all times
            row |= {name: signed(number(content, 8 * k, 8)) for k, (name, _, _) in enumerate(KINDS)}
        elif kind == NAME and (size := number(content, 64, 1)) is not None and (space := number(content, 65, 1)) is not None:
            name = piece(content, 66, 2 * size)
            if name is not None and space <= row.get("namespace", 256):
                row |= {"parent": signed(number(content, 0, 8)), "fn_created": signed(number(content, 8, 8)), "name": wide(name), "namespace": space}
    return row


def decode(unit: dict) -> Iterator[dict]:
    content = unit["content"] or b""
    for at in range(0, len(content) - RECORD + 1, RECORD):
        if content[at : at + 4] == SIGNATURE and (row := record_row(content[at : at + RECORD])) is not None:
            yield row | {"path": unit["path"], "entry": (unit["offset"] + at) // RECORD}


def records(units: DataFrame) -> DataFrame:
    return decoded(units.where("kind = 'mft'").select("path", "offset", "content"), decode, RAW)


def whole_seconds_apart(a: Column, b: Column) -> Column:
    """Absolute difference of two tick counts in whole seconds, cut off."""
    return F.call_function("div", F.abs(a - b), F.lit(10_000_000))


def events(raw: DataFrame) -> DataFrame:
    """Up to four events a record: null times give none, nor does a record without standard information."""
    strict = lambda c: F.when(filetime_strict(F.col(c)).isNotNull(), F.col(c))
    tampered = F.coalesce(whole_seconds_apart(strict("created"), strict("fn_created")) > SKEW, F.lit(False))
    kinds = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(kind).alias("type"), F.lit(verb).alias("verb"), F.col(c).alias("ticks")) for k, (c, kind, verb) in enumerate(KINDS)))
    rows = raw.withColumn("tampered", tampered).withColumn("e", F.explode(kinds)).withColumn("at", filetime_strict(F.col("e.ticks"))).where("at is not null")
    name = F.coalesce("name", F.lit("(unknown name)"))
    flagged = F.when((F.col("e.k") == 0) & F.col("tampered"), True)
    extra = json_text(
        F.col("entry").alias("mft_entry"),
        F.when(F.col("namespace").isNotNull(), F.col("parent").bitwiseAND(F.lit(PARENT_BITS))).alias("parent_mft_ref"),
        "namespace",
        flagged.alias("timestomp_suspected"),
        F.when(flagged, NOTE).alias("note"),
    )
    return envelope(rows, F.col("at"), "mft", F.col("e.type"), F.concat(F.lit("File "), F.col("e.verb"), F.lit(": "), name), name, extra, F.col("entry") * 4 + F.col("e.k"))
