"""Time expressions on (seconds, nanoseconds) pairs, which keep more than Spark's microseconds."""

from __future__ import annotations

from datetime import datetime, timezone

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: FILETIME ticks (100 ns since 1601) at 1970-01-01, and ticks in a second.
EPOCH, SECOND = 116444736000000000, 10_000_000


def moment(sec: Column, nano: Column) -> Column:
    return F.struct(sec.cast("long").alias("sec"), nano.cast("int").alias("nano"))


def _from_ticks(ticks: Column) -> Column:
    since = ticks - F.lit(EPOCH)
    rest = F.pmod(since, F.lit(SECOND))
    # an exact division: a double would not hold the ticks, and div cuts towards zero
    return moment(F.call_function("div", since - rest, F.lit(SECOND)), rest * 100)


def filetime_strict(ticks: Column) -> Column:
    """Moment of a FILETIME read as a signed long; null at or before 1970-01-01."""
    return F.when(ticks > EPOCH, _from_ticks(ticks))


def filetime_signed(ticks: Column) -> Column:
    """Moment of a FILETIME; null at or below 0 only, so times before 1970 are kept."""
    return F.when(ticks > 0, _from_ticks(ticks))


def rfc3339(at: Column, zone: str) -> Column:
    """Text of a moment with 0, 3, 6 or 9 digits of a second, as few as are exact, and `zone` (Z or +00:00)."""
    whole = F.date_format(F.timestamp_seconds(at["sec"]), "yyyy-MM-dd'T'HH:mm:ss")
    nano = at["nano"]
    part = (
        F.when(nano == 0, "")
        .when(nano % 1_000_000 == 0, F.format_string(".%03d", (nano / 1_000_000).cast("int")))
        .when(nano % 1_000 == 0, F.format_string(".%06d", (nano / 1_000).cast("int")))
        .otherwise(F.format_string(".%09d", nano))
    )
    return F.when(at.isNotNull(), F.concat(whole, part, F.lit(zone)))


def timestamp(at: Column) -> Column:
    """Spark timestamp of a moment, to the microsecond."""
    return F.timestamp_micros(at["sec"] * 1_000_000 + F.floor(at["nano"] / 1000))


RFC3339 = regex.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:\.(\d+))?(?:([Zz])|([+-])(\d\d):(\d\d))")


def parse_rfc3339(text: str) -> tuple[int, int] | None:
    """(seconds, nanoseconds) of an RFC 3339 text; None if it is none."""
    m = RFC3339.fullmatch(text)
    if not m:
        return None
    leap = m[6] == "60"
    try:
        whole = datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4]), int(m[5]), 59 if leap else int(m[6]), tzinfo=timezone.utc)
    except ValueError:
        return None
    shift = (int(m[10]) * 3600 + int(m[11]) * 60) * (-1 if m[9] == "-" else 1) if m[9] else 0
    if m[9] and (int(m[10]) > 23 or int(m[11]) > 59):
        return None
    nano = int((m[7] or "0")[:9].ljust(9, "0"))
    return int(whole.timestamp()) - shift, nano + (1_000_000_000 if leap else 0)


def ticks_text(ticks: int) -> str:
    """RFC 3339 text (+00:00) of FILETIME ticks in values of event logs; 1601-01-01T00:00:00Z at or below 0."""
    ticks = ticks - (1 << 64) if ticks >> 63 else ticks
    if ticks <= 0:
        return "1601-01-01T00:00:00Z"
    sec, rest = divmod(ticks - EPOCH, SECOND)
    days, day = divmod(sec, 86400)
    year, month, date = _civil(days)
    part = "" if not rest else f".{rest // 10_000:03d}" if rest % 10_000 == 0 else f".{rest // 10:06d}" if rest % 10 == 0 else f".{rest * 100:09d}"
    head = f"{year:04d}" if year <= 9999 else f"+{year}"
    return f"{head}-{month:02d}-{date:02d}T{day // 3600:02d}:{day // 60 % 60:02d}:{day % 60:02d}{part}+00:00"


def _civil(days: int) -> tuple[int, int, int]:
    """Date of a day number since 1970; 400-year cycles stand in for years datetime does not have."""
    cycles, inside = divmod(days, 146097)
    at = datetime.fromordinal(datetime(1970, 1, 1).toordinal() + inside)
    return at.year + 400 * cycles, at.month, at.day
