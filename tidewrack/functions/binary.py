"""Bounds-checked little-endian reads. Nothing here raises on malformed bytes."""

from __future__ import annotations


def number(data: bytes, at: int, size: int) -> int | None:
    """Unsigned integer of `size` bytes at `at`; None if it is out of range."""
    return int.from_bytes(data[at : at + size], "little") if 0 <= at <= len(data) - size else None


def piece(data: bytes, at: int, size: int) -> bytes | None:
    return bytes(data[at : at + size]) if 0 <= at and size >= 0 and at + size <= len(data) else None


def c_string(data: bytes, at: int, most: int) -> str | None:
    """UTF-8 text up to the first NUL of at most `most` bytes; None past the end."""
    if at > len(data):
        return None
    return bytes(data[at : at + most]).split(b"\0", 1)[0].decode("utf-8", "replace")


def wide(data: bytes) -> str:
    """UTF-16LE text; an odd last byte is dropped."""
    return bytes(data[: len(data) // 2 * 2]).decode("utf-16-le", "replace")


def signed(value: int | None) -> int | None:
    """A 64-bit unsigned value as the signed long Spark holds."""
    return None if value is None else value - (1 << 64) if value >> 63 else value


class Stream:
    """Reads in sequence; a read that does not fit gives None and does not move."""

    __slots__ = ("data", "at")

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, size: int) -> bytes | None:
        found = piece(self.data, self.at, size)
        if found is not None:
            self.at += size
        return found

    def uint(self, size: int) -> int | None:
        found = number(self.data, self.at, size)
        if found is not None:
            self.at += size
        return found

    def skip(self, size: int) -> bool:
        fits = size <= self.left
        if fits:
            self.at += size
        return fits
