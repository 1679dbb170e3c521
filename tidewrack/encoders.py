"""Synthetic artifacts, written from the public format descriptions: inputs of tests and of the registered queries.

Nothing here shares code with the decoders.
"""

from __future__ import annotations

import struct

EPOCH = 116444736000000000


def ticks(micros: int) -> int:
    """FILETIME of microseconds since 1970."""
    return micros * 10 + EPOCH


# NTFS master file table.


def _attribute(kind: int, content: bytes, resident: bool = True) -> bytes:
    size = (24 + len(content) + 7) // 8 * 8
    head = struct.pack("<IIBBHHHIHBB", kind, size, 0 if resident else 1, 0, 0, 0, 0, len(content), 24, 0, 0)
    return (head + content).ljust(size, b"\0")


def standard_information(times: tuple[int, int, int, int]) -> bytes:
    return _attribute(0x10, struct.pack("<4q", *times) + bytes(16))


def file_name(name: str, parent: int, created: int, namespace: int = 1, resident: bool = True) -> bytes:
    raw = name.encode("utf-16-le")
    content = struct.pack("<Qq", parent, created) + struct.pack("<3q", created, created, created) + bytes(24) + bytes([len(raw) // 2, namespace]) + raw
    return _attribute(0x30, content, resident)


def mft_record(attributes: list[bytes], magic: bytes = b"FILE", saved: int = 3) -> bytes:
    """A record with its sector ends swapped out, as on disk; saved = 0 leaves no update sequence."""
    out = bytearray(1024)
    out[:4] = magic
    struct.pack_into("<HH", out, 4, 42, saved)
    struct.pack_into("<H", out, 20, 56)
    body = b"".join(attributes) + struct.pack("<I", 0xFFFFFFFF)
    out[56 : 56 + len(body)] = body
    if saved:
        struct.pack_into("<H", out, 42, 0x0007)
        for k in range(1, saved):
            out[42 + 2 * k : 44 + 2 * k] = out[512 * k - 2 : 512 * k]
            out[512 * k - 2 : 512 * k] = b"\x07\0"
    return bytes(out)


# Shortcuts.


def counted(text: str) -> bytes:
    raw = text.encode("utf-16-le")
    return struct.pack("<H", len(raw) // 2) + raw


def tracker(machine: str, uuid: bytes) -> bytes:
    return struct.pack("<IIII", 0x60, 0xA0000003, 0x58, 0) + machine.encode().ljust(16, b"\0")[:16] + bytes(16) + uuid + bytes(32)


def uuid_with_node(node: bytes, version: int = 1) -> bytes:
    return bytes(6) + struct.pack("<H", version << 12 | 0x123) + b"\x80\x01" + node


def shortcut(ctime: int, atime: int, wtime: int, local: str | None = None, relative: str | None = None, arguments: str | None = None, blocks: bytes = b"", show: int = 1, tail: bytes = b"", ids: bytes | None = None, network: str | None = None) -> bytes:
    flags = 0x80 | (0x01 if ids is not None else 0) | (0x02 if local is not None or network is not None else 0) | (0x08 if relative is not None else 0) | (0x20 if arguments is not None else 0)
    head = struct.pack("<I", 0x4C) + bytes.fromhex("0114020000000000c000000000000046") + struct.pack("<II", flags, 0x20) + struct.pack("<3q", ctime, atime, wtime) + struct.pack("<III", 0, 0, show)
    out = head.ljust(0x4C, b"\0")
    if ids is not None:
        out += struct.pack("<H", len(ids)) + ids
    if local is not None:
        path = local.encode() + b"\0"
        size = 0x2C + len(path) + 1
        out += struct.pack("<7I", size, 0x1C, 1, 0x1C, 0x2C, 0, 0x2C + len(path)) + bytes(16) + path + b"\0"
    elif network is not None:
        share = network.encode() + b"\0"
        out += struct.pack("<7I", 0x1C + 0x14 + len(share), 0x1C, 2, 0, 0, 0x1C, 0) + struct.pack("<5I", 0x14 + len(share), 0, 0x14, 0, 0) + share
    for text in (relative, arguments):
        if text is not None:
            out += counted(text)
    return out + blocks + struct.pack("<I", 0) + tail


# Event logs.

TYPES = {"wstr": 0x01, "str": 0x02, "u8": 0x04, "u16": 0x06, "u32": 0x08, "u64": 0x0A, "bool": 0x0D, "binary": 0x0E, "guid": 0x0F, "filetime": 0x11, "systemtime": 0x12, "sid": 0x13, "hex32": 0x14, "hex64": 0x15, "nested": 0x21, "i32": 0x07}
PACKED = {"u8": "<B", "u16": "<H", "u32": "<I", "u64": "<Q", "bool": "<I", "filetime": "<q", "hex32": "<I", "hex64": "<Q", "i32": "<i"}


def packed(kind: str, value) -> bytes:
    if kind in PACKED:
        return struct.pack(PACKED[kind], value)
    return value.encode("utf-16-le") if kind == "wstr" else value.encode() if kind == "str" else value


class Body:
    """Token stream at a known place of a chunk; names are written where they are first used."""

    def __init__(self, place: int):
        self.place, self.out, self.names = place, b"", {}

    def name(self, text: str) -> None:
        if text in self.names:
            self.out += struct.pack("<I", self.names[text])
            return
        at = self.place + len(self.out) + 4
        self.names[text] = at
        raw = text.encode("utf-16-le")
        self.out += struct.pack("<IIHH", at, 0, 0, len(raw) // 2) + raw + b"\0\0"

    def open(self, text: str, attributes: bool = False) -> None:
        self.out += (b"\x41" if attributes else b"\x01") + struct.pack("<HI", 0xFFFF, 0)
        self.name(text)
        if attributes:
            self.out += bytes(4)

    def attribute(self, text: str) -> None:
        self.out += b"\x06"
        self.name(text)

    def slot(self, number: int, kind: str, optional: bool = True) -> None:
        self.out += (b"\x0e" if optional else b"\x0d") + struct.pack("<HB", number, TYPES[kind])

    def literal(self, text: str) -> None:
        self.out += b"\x05\x01" + counted(text)

    def element(self, text: str, number: int, kind: str) -> None:
        self.open(text)
        self.out += b"\x02"
        self.slot(number, kind)
        self.out += b"\x04"

    def bound(self, element: str, pairs: list[tuple[str, int, str]]) -> None:
        """An empty element whose attributes hold slots."""
        self.open(element, True)
        for name, number, kind in pairs:
            self.attribute(name)
            self.slot(number, kind)
        self.out += b"\x03"

    def data(self, label: str, number: int, kind: str) -> None:
        self.open("Data", True)
        self.attribute("Name")
        self.literal(label)
        self.out += b"\x02"
        self.slot(number, kind)
        self.out += b"\x04"


class Inline:
    """A record without template: tokens, then the names, whose places count from the body's start."""

    def __init__(self):
        self.parts: list[bytes | str] = [b"\x0f\x01\x01\0"]

    def open(self, name: str) -> None:
        self.parts += [b"\x01" + bytes(6), name]

    def attribute(self, name: str, text: str) -> None:
        self.parts += [b"\x06", name]
        self.text(text)

    def text(self, text: str) -> None:
        self.parts.append(b"\x05\x01" + counted(text))

    def close(self) -> None:
        self.parts.append(b"\x03")

    def body(self) -> bytes:
        at, places, tail = sum(4 if isinstance(p, str) else len(p) for p in self.parts) + 1, {}, b"\0"
        for name in dict.fromkeys(p for p in self.parts if isinstance(p, str)):
            raw = name.encode("utf-16-le")
            node = struct.pack("<IHH", 0, 0, len(raw) // 2) + raw + b"\0\0"
            places[name], at, tail = at, at + len(node), tail + node
        return b"".join(struct.pack("<I", places[p]) if isinstance(p, str) else p for p in self.parts) + tail


def definition(body: bytes) -> bytes:
    return struct.pack("<I", 0) + bytes(16) + struct.pack("<I", len(body)) + body


def values(items: list[tuple[str, object]]) -> bytes:
    """Count, descriptors and bytes of a template instance's values; None is a null value."""
    raw = [b"" if v is None else packed(k, v) for k, v in items]
    shapes = b"".join(struct.pack("<HBB", len(r), 0 if v is None else TYPES[k], 0) for (k, v), r in zip(items, raw, strict=True))
    return struct.pack("<I", len(items)) + shapes + b"".join(raw)


def system_part(body: Body, skip: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """The System element of a template over slots 0..7; returns (field, type) by slot."""
    slots = [("Provider", "wstr"), ("EventID", "u16"), ("TimeCreated", "filetime"), ("EventRecordID", "u32"), ("ProcessID", "u32"), ("ThreadID", "u32"), ("Channel", "wstr"), ("Computer", "wstr")]
    body.out += b"\x0f\x01\x01\0"
    body.open("Event")
    body.out += b"\x02"
    body.open("System")
    body.out += b"\x02"
    if "Provider" not in skip:
        body.bound("Provider", [("Name", 0, "wstr")])
    body.element("EventID", 1, "u16")
    body.bound("TimeCreated", [("SystemTime", 2, "filetime")])
    body.element("EventRecordID", 3, "u32")
    body.bound("Execution", [("ProcessID", 4, "u32"), ("ThreadID", 5, "u32")])
    body.element("Channel", 6, "wstr")
    body.element("Computer", 7, "wstr")
    body.out += b"\x04"
    return slots


class ChunkWriter:
    """Records of one chunk; each is a template instance, the definition inline at first use."""

    def __init__(self):
        self.out = b"ElfChnk\0".ljust(512, b"\0")
        self.templates: dict = {}

    def record(self, number: int, time: int, key, build, items: list[tuple[str, object]], junk: bytes = b"") -> None:
        """build(Body) writes the template `key`; items are its slot values; junk stands before the record."""
        self.out += junk
        start = len(self.out) + 24
        body = b"\x0f\x01\x01\0" + b"\x0c\0" + struct.pack("<I", 0)
        if key in self.templates:
            body += struct.pack("<I", self.templates[key])
        else:
            at = start + len(body) + 4
            self.templates[key] = at
            tokens = Body(at + 24)
            build(tokens)
            body += struct.pack("<I", at) + definition(tokens.out + b"\0")
        place = start + len(body)
        made = [(k, v(place_of(place, items, i)) if callable(v) else v) for i, (k, v) in enumerate(items)]
        body += values(made)
        self.raw(number, time, body)

    def raw(self, number: int, time: int, body: bytes) -> None:
        size = 24 + len(body) + 4
        self.out += b"\x2a\x2a\0\0" + struct.pack("<IQq", size, number, time) + body + struct.pack("<I", size)

    def full(self) -> bytes:
        if len(self.out) > 65536:
            raise ValueError("a chunk holds 65536 bytes")
        return self.out.ljust(65536, b"\0")


def place_of(start: int, items: list[tuple[str, object]], index: int) -> int:
    """Chunk place of the bytes of value `index`; values made by place must come last."""
    return start + 4 + 4 * len(items) + sum(len(packed(k, v)) for k, v in items[:index] if v is not None)


def nested_fragment(place: int, build, items: list[tuple[str, object]]) -> bytes:
    """A fragment with its own inline template, for a value at `place` of the chunk."""
    head = b"\x0f\x01\x01\0" + b"\x0c\0" + struct.pack("<I", 0)
    at = place + len(head) + 4
    tokens = Body(at + 24)
    build(tokens)
    return head + struct.pack("<I", at) + definition(tokens.out + b"\0") + values(items)


def event_log(chunks: list[bytes]) -> bytes:
    return b"ElfFile\0".ljust(4096, b"\0") + b"".join(chunks)
