"""Windows shortcut files: one event each."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import c_string, number, piece, signed, wide
from ..functions.times import filetime_strict, moment, rfc3339
from .base import decoded, envelope, json_text, now_moment

#: Header size and link class.
SIGNATURE = bytes.fromhex("4c0000000114020000000000c000000000000046")
BODY = 0x4C
# Link flags.
HAS_IDS, HAS_INFO, UNICODE = 0x1, 0x2, 0x80
STRINGS = ((0x4, "name"), (0x8, "relative"), (0x10, "working_dir"), (0x20, "arguments"), (0x40, "icon_location"))
BLOCKS, FIRST_BLOCK, LAST_BLOCK, TRACKER = 64, 0xA0000000, 0xA000000C, 0xA0000003
PATH_BYTES, OVERLAY = 1024, 16
RAW = """path string, mtime_sec long, mtime_nano int, flags long, ctime long, atime long, wtime long, show long, local string, network string, relative string,
 working_dir string, arguments string, icon_location string, machine string, mac string, overlay long"""


def mac_address(uuid: bytes) -> str | None:
    """Node of a version 1 UUID; None for other versions and empty nodes."""
    if len(uuid) != 16 or number(uuid, 6, 2) >> 12 != 1 or not any(uuid[10:]):
        return None
    return ":".join(f"{b:02x}" for b in uuid[10:])


def link_info(data: bytes, at: int, row: dict) -> int:
    size = number(data, at, 4)
    if size is None or size < 0x1C:
        return at
    flags = number(data, at + 8, 4) or 0
    if flags & 1 and (start := number(data, at + 16, 4)):
        row["local"] = c_string(data, at + start, PATH_BYTES)
    if flags & 2 and (start := number(data, at + 20, 4)):
        share = at + start
        if name := number(data, share + 8, 4):
            row["network"] = c_string(data, share + name, PATH_BYTES)
    return at + size


def string_data(data: bytes, at: int, flags: int, row: dict) -> int:
    """Counted strings in fixed order; the first that does not fit ends them, its count already read."""
    for bit, name in STRINGS:
        if not flags & bit:
            continue
        count = number(data, at, 2)
        if count is None:
            return at
        at += 2
        raw = piece(data, at, count * 2 if flags & UNICODE else count)
        if raw is None:
            return at
        row[name] = wide(raw) if flags & UNICODE else raw.decode("utf-8", "replace")
        at += len(raw)
    return at


def extra_data(data: bytes, at: int, row: dict) -> int:
    for _ in range(BLOCKS):
        size = number(data, at, 4)
        if size is None:
            return at
        if size < 4:
            return at + 4
        kind = number(data, at + 4, 4)
        if kind is None or not FIRST_BLOCK <= kind <= LAST_BLOCK:
            return at
        if kind == TRACKER and size >= 0x60:
            if (machine := piece(data, at + 16, 16)) is not None:
                row["machine"] = machine.split(b"\0", 1)[0].decode("utf-8", "replace")
            if (uuid := piece(data, at + 48, 16)) is not None:
                row["mac"] = mac_address(uuid)
        at += size
    return at


def decode(unit: dict) -> Iterator[dict]:
    data = unit["content"] or b""
    if data[:20] != SIGNATURE:
        return
    flags = number(data, 20, 4) or 0
    row = {k: unit.get(k) for k in ("path", "mtime_sec", "mtime_nano")} | {"flags": flags, "show": number(data, 60, 4) or 0}
    row |= {name: signed(number(data, at, 8) or 0) for name, at in (("ctime", 28), ("atime", 36), ("wtime", 44))}
    at = BODY
    if flags & HAS_IDS and (size := number(data, at, 2)) is not None:
        at += 2 + size
    if flags & HAS_INFO:
        at = link_info(data, at, row)
    at = string_data(data, at, flags, row)
    at = extra_data(data, at, row)
    row.pop("name", None)
    yield row | {"overlay": max(0, len(data) - at)}


def links(units: DataFrame) -> DataFrame:
    return decoded(units.where("kind = 'lnk'").select("path", "mtime_sec", "mtime_nano", "content"), decode, RAW)


def events(raw: DataFrame, now: Column | None = None) -> DataFrame:
    """Time: write, create, file, now. Target: local path, relative path, network name; an empty text counts."""
    at = F.coalesce(filetime_strict(F.col("wtime")), filetime_strict(F.col("ctime")), F.when(F.col("mtime_sec").isNotNull(), moment(F.col("mtime_sec"), F.col("mtime_nano"))), now_moment(now))
    target = F.coalesce("local", "relative", "network", F.lit("(no target)"))
    said = F.regexp_replace(F.coalesce("arguments", F.lit("")), r"^[\p{IsWhite_Space}]+", "") != ""
    text = F.concat(F.lit("Shortcut targets "), target, F.when(said, F.concat(F.lit(" with arguments: "), F.col("arguments"))).otherwise(""))
    extra = json_text(
        F.col("show").alias("show_command"),
        F.format_string("0x%08x", F.col("flags")).alias("link_flags"),
        rfc3339(filetime_strict(F.col("ctime")), "+00:00").alias("target_created"),
        rfc3339(filetime_strict(F.col("atime")), "+00:00").alias("target_accessed"),
        "arguments", "working_dir", "icon_location",
        F.col("machine").alias("builder_machine_id"),
        F.col("mac").alias("builder_mac_address"),
        F.when(F.col("overlay") > OVERLAY, F.col("overlay")).alias("overlay_bytes"),
    )
    return envelope(raw, at, "lnk", F.lit("lnk_target_referenced"), text, target, extra, F.lit(0))
