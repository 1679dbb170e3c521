"""Windows event logs: one event a record, through binary XML templates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binary import Stream, number, piece, signed, wide
from ..functions.times import filetime_signed, moment, parse_rfc3339, ticks_text
from .base import decoded, envelope, json_text, now_moment

SIGNATURE, CHUNK_SIGNATURE, RECORD_SIGNATURE = b"ElfFile\0", b"ElfChnk\0", b"\x2a\x2a\0\0"
HEADER, CHUNK, CHUNK_HEADER, RECORD_HEADER = 4096, 65536, 512, 24
CHUNKS, FIELDS, CHARS, NAME_BYTES, VALUES, DEFINITION = 32768, 256, 4096, 64, 512, 24
NESTED = 0x21
# System elements by template slot, and by (element, attribute) in templates.
SLOTS = ("Provider", "ProviderGuid", "Qualifiers", "EventID", "Version", "Level", "Task", "Opcode", "Keywords", "TimeCreated", "EventRecordID", "ActivityID", "RelatedActivityID", "ProcessID", "ThreadID", "Channel", "Computer", "UserID")
BY_ATTRIBUTE = {
    ("Provider", "Name"): "Provider",
    ("Provider", "Guid"): "ProviderGuid",
    ("EventID", "Qualifiers"): "Qualifiers",
    ("TimeCreated", "SystemTime"): "TimeCreated",
    ("Execution", "ProcessID"): "ProcessID",
    ("Execution", "ThreadID"): "ThreadID",
    ("Correlation", "ActivityID"): "ActivityID",
    ("Security", "UserID"): "UserID",
}
BY_TEXT = ("EventID", "Level", "Task", "Opcode", "Keywords", "EventRecordID", "Channel", "Computer", "Version")
BINDINGS = BY_ATTRIBUTE | {(x, ""): x for x in BY_TEXT}
DATA_NAME = "_DataName"

RAW = "path string, record_id decimal(20,0), ticks long, created_sec long, created_nano int, fields map<string,string>, seq long"


# Values.


def hex_text(data: bytes) -> str:
    return data.hex()


def sid(data: bytes) -> str:
    if len(data) < 8 or len(data) < 8 + 4 * data[1]:
        return ""
    subs = "-".join(str(number(data, 8 + 4 * k, 4)) for k in range(data[1]))
    return f"S-{data[0]}-{int.from_bytes(data[2:8], 'big')}-{subs}"


def guid(data: bytes) -> str:
    """Braced upper-case text; its last group shows four of the six node bytes, as the timelines do."""
    return f"{{{number(data, 0, 4):08X}-{number(data, 4, 2):04X}-{number(data, 6, 2):04X}-{data[8]:02X}{data[9]:02X}-{data[10:14].hex().upper()}}}"


def system_time(data: bytes) -> str:
    year, month, _, day, hour, minute, second = (number(data, 2 * k, 2) for k in range(7))
    return f"{year:04d}-{month:02d}-{day:02d}T{hour:02d}:{minute:02d}:{second:02d}Z"


#: Type: (least bytes, text of the value). Other types and shorter values are shown as hex.
VALUE_TYPES: dict[int, tuple[int, Callable[[bytes], str]]] = {
    0x01: (0, wide),
    0x02: (0, lambda b: b.decode("utf-8", "replace")),
    0x04: (1, lambda b: str(b[0])),
    0x06: (2, lambda b: str(number(b, 0, 2))),
    0x08: (4, lambda b: str(number(b, 0, 4))),
    0x0A: (8, lambda b: str(number(b, 0, 8))),
    0x0D: (4, lambda b: "true" if number(b, 0, 4) else "false"),
    0x0E: (0, hex_text),
    0x0F: (16, guid),
    0x11: (8, lambda b: ticks_text(number(b, 0, 8))),
    0x12: (16, system_time),
    0x13: (0, sid),
    0x14: (4, lambda b: f"0x{number(b, 0, 4):08x}"),
    0x15: (8, lambda b: f"0x{number(b, 0, 8):016x}"),
}
#: Bytes of fixed-size types in a token stream; those with a 16-bit count, and bytes a count stands for.
STREAM_SIZES = {0x04: 1, 0x06: 2, 0x08: 4, 0x0A: 8, 0x0D: 4, 0x0F: 16, 0x11: 8, 0x12: 16, 0x14: 4, 0x15: 8}
COUNTED = {0x01: 2, 0x02: 1, 0x0E: 1}


def value_text(data: bytes, kind: int) -> str:
    least, show = VALUE_TYPES.get(kind, (1 << 30, hex_text))
    return show(data) if len(data) >= least else hex_text(data)


def stream_value(stream: Stream, kind: int) -> str:
    """The value at the stream's place; unknown types read nothing."""
    size = STREAM_SIZES.get(kind)
    if kind in COUNTED and (count := stream.uint(2)) is not None:
        size = count * COUNTED[kind]
    elif kind == 0x13 and stream.left >= 2:
        size = 8 + 4 * stream.data[stream.at + 1]
    raw = stream.take(size) if size is not None else None
    return value_text(raw, kind) if raw is not None else ""


def name_at(data: bytes, at: int) -> str:
    """Name node at an offset: hash, count, UTF-16 text; empty for 0 and outside."""
    count = number(data, at + 6, 2) if at else None
    raw = piece(data, at + 8, 2 * count) if count else None
    return wide(raw) if raw is not None else ""


# Templates.


class Template:
    """Slots bound to names and the literal texts of a template definition."""

    def __init__(self, body: bytes, chunk: bytes, start: int):
        self.names: dict[int, str] = {}
        self.literals: dict[str, str] = {}
        self.chunk, self.start, self.stream = chunk, start, Stream(body)
        self.elements: list[str] = []
        self.attribute = self.data_name = ""
        while self.stream.left and (token := self.stream.uint(1)):
            if self.step(token) is False:
                break

    def name(self) -> str | None:
        """A name by offset; one that lies ahead stands in the stream and is passed over."""
        at = self.stream.uint(4)
        if at is None:
            return None
        if at >= self.start + self.stream.at and at + 8 <= len(self.chunk):
            self.stream.skip(10 + 2 * number(self.chunk, at + 6, 2))
        return name_at(self.chunk, at)

    def step(self, token: int) -> bool | None:
        """Handle one token; False ends the walk, unknown tokens are passed over byte by byte."""
        stream, inside = self.stream, self.elements[-1] if self.elements else ""
        if token == 0x0F:
            stream.skip(3)
        elif token in (0x01, 0x41):
            stream.skip(2)
            stream.skip(4)
            if (name := self.name()) is None:
                return False
            if token == 0x41:
                stream.skip(4)
            self.elements.append(name)
            self.data_name = ""
        elif token in (0x03, 0x04):
            self.elements[-1:] = []
        elif token in (0x06, 0x46):
            if (name := self.name()) is None:
                return False
            self.attribute = name
        elif token == 0x05:
            if (kind := stream.uint(1)) is None:
                return False
            text = stream_value(stream, kind)
            if self.attribute == "Name" and inside == "Data":
                self.data_name = text
            elif text and not self.attribute and (inside, "") in BINDINGS:
                self.literals[BINDINGS[inside, ""]] = text
            self.attribute = ""
        elif token in (0x0D, 0x0E, 0x4D, 0x4E):
            slot = stream.uint(2)
            if slot is None or stream.uint(1) is None:
                return False
            bound = self.data_name if inside == "Data" and self.data_name else BINDINGS.get((inside, self.attribute))
            if bound:
                self.names[slot] = bound
            self.attribute = ""
        return None


class Chunk:
    """A chunk with the templates met so far; offsets count from its start."""

    def __init__(self, data: bytes):
        self.data = data
        self.templates: dict[int, Template | None] = {}

    def template(self, at: int) -> Template | None:
        if at not in self.templates:
            size = number(self.data, at + 20, 4)
            body = piece(self.data, at + DEFINITION, size) if size is not None else None
            self.templates[at] = Template(body, self.data, at + DEFINITION) if body is not None else None
        return self.templates[at]

    def instance(self, stream: Stream, start: int) -> tuple[Template | None, list[tuple[int, int, bytes, int]]] | None:
        """(template, [(slot, type, bytes, place in the chunk)]) of the instance after its token; None if it breaks off."""
        at = stream.uint(4)
        if at is None:
            return None
        if at == start + stream.at and at + DEFINITION <= len(self.data) and not stream.skip(DEFINITION + number(self.data, at + 20, 4)):
            return None
        count = stream.uint(4)
        if count is None or count > VALUES:
            return None
        shapes = []
        for _ in range(count):
            shape = stream.uint(2), stream.uint(1), stream.uint(1)
            if None in shape:
                return None
            shapes.append(shape)
        place = start + stream.at
        blob = stream.take(sum(size for size, _, _ in shapes))
        if blob is None:
            return None
        values, here = [], 0
        for slot, (size, kind, flags) in enumerate(shapes):
            if size and not flags & 1:
                values.append((slot, kind, blob[here : here + size], place + here))
            here += size
        return self.template(at) if at < len(self.data) else None, values

    def fill(self, stream: Stream, start: int, fields: dict[str, str], nested: bool = False) -> None:
        """Put the named values of a template instance into `fields`."""
        if not nested and (stream.uint(1) is None or not stream.skip(4)):
            return
        if nested:
            stream.skip(1)
            stream.skip(4)
        found = self.instance(stream, start)
        if found is None:
            return
        template, values = found
        for slot, kind, raw, place in values:
            if kind == NESTED and not nested:
                inner = Stream(raw)
                if raw[0] == 0x0F:
                    inner.skip(4)
                if inner.uint(1) == 0x0C:
                    self.fill(inner, place, fields, nested=True)
                continue
            name = template.names.get(slot) if template else None
            if name is None and not nested and slot < len(SLOTS):
                name = SLOTS[slot]
            if name is not None:
                put(fields, name, value_text(raw, kind))
        if template and not nested:
            for name, text in template.literals.items():
                fields.setdefault(name, text[:CHARS])

    def record(self, body: bytes, start: int) -> dict[str, str]:
        """Fields of a record: template instances, and what leading inline elements show."""
        fields: dict[str, str] = {}
        elements: list[str] = []
        attribute, stream = "", Stream(body)
        while stream.left and len(fields) < FIELDS:
            token = stream.uint(1)
            if token == 0x0F or token in (0x0D, 0x0E):
                if not stream.skip(3):
                    break
            elif token == 0x01:
                if not (stream.skip(2) and stream.skip(4)) or (at := stream.uint(4)) is None:
                    break
                elements.append(name_at(body, at))
            elif token in (0x02, 0x03):
                elements[-1:] = []
                attribute = ""
            elif token == 0x06:
                if (at := stream.uint(4)) is None:
                    break
                attribute = name_at(body, at)
            elif token == 0x05:
                if (kind := stream.uint(1)) is None:
                    break
                inline(fields, elements[-1] if elements else "", attribute, stream_value(stream, kind))
                attribute = ""
            elif token == 0x0C:
                self.fill(stream, start, fields)
            else:
                break
        return fields


def put(fields: dict[str, str], name: str, text: str) -> None:
    if text and len(name.encode()) <= NAME_BYTES:
        fields[name] = text[:CHARS]


def inline(fields: dict[str, str], element: str, attribute: str, text: str) -> None:
    """Bind a value outside templates; the name of a Data element is kept until its text comes."""
    if not text:
        return
    if attribute:
        put(fields, DATA_NAME if (element, attribute) == ("Data", "Name") else BY_ATTRIBUTE.get((element, attribute), f"{element}/{attribute}"), text)
    elif element == "Data":
        if (name := fields.pop(DATA_NAME, None)) is not None:
            fields[name] = text[:CHARS]
    elif element:
        put(fields, element, text)


def chunk_records(data: bytes) -> Iterator[tuple[int, int, bytes, int]]:
    """(record number, ticks, body, its place); where no record fits, the search goes on 4 bytes later."""
    at = CHUNK_HEADER
    while at + RECORD_HEADER <= len(data):
        found = data.find(RECORD_SIGNATURE, at)
        while found >= 0 and (found - at) % 4:
            found = data.find(RECORD_SIGNATURE, found + 1)
        if found < 0 or found + RECORD_HEADER > len(data):
            return
        size = number(data, found + 4, 4)
        if size < RECORD_HEADER or found + size > len(data):
            at = found + 4
            continue
        body = found + RECORD_HEADER
        yield number(data, found + 8, 8), number(data, found + 16, 8), data[body : found + size], body
        at = found + size


def decode(unit: dict) -> Iterator[dict]:
    from decimal import Decimal

    content = unit["content"] or b""
    for base in range(0, len(content) - CHUNK + 1, CHUNK):
        data = content[base : base + CHUNK]
        if data[:8] != CHUNK_SIGNATURE:
            continue
        chunk, slot = Chunk(data), (unit["offset"] + base - HEADER) // CHUNK
        for k, (record, ticks, body, at) in enumerate(chunk_records(data)):
            fields = chunk.record(body, at)
            created = parse_rfc3339(fields["TimeCreated"]) if "TimeCreated" in fields else None
            sec, nano = created or (None, None)
            yield {"path": unit["path"], "record_id": Decimal(record), "ticks": signed(ticks), "created_sec": sec, "created_nano": nano, "fields": fields, "seq": slot * CHUNK + k}


def records(units: DataFrame) -> DataFrame:
    return decoded(units.where("kind = 'evtx'").select("path", "offset", "content"), decode, RAW)


def field(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("fields"), F.lit(name)), F.lit(""))


def unsigned_or_zero(text: Column) -> Column:
    """Value of a decimal text that fits 32 bits, an optional plus before it; else 0."""
    digits = F.regexp_extract(text, r"^\+?([0-9]+)\z", 1)
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    value = F.when((digits != "") & (F.length(short) <= 10), short.cast("long")).otherwise(F.lit(0).cast("long"))
    return F.when(value <= 0xFFFFFFFF, value).otherwise(F.lit(0).cast("long"))


# Fixed texts of descriptions: (event ids, only for Sysmon, parts, field of the target path). A part in braces is a field.
DESCRIPTIONS = (
    ((4624,), False, "Logon: {TargetUserName} (type {LogonType}) from {IpAddress}", None),
    ((4625,), False, "Failed logon: {TargetUserName} from {IpAddress} (status {Status})", None),
    ((4688,), False, "Process created: {NewProcessName} (parent {ParentProcessName}) cmd: {CommandLine}", "NewProcessName"),
    ((1,), True, "Sysmon process create: {Image} (parent {ParentImage}) cmd: {CommandLine}", "Image"),
    ((3,), True, "Sysmon network connection: {Image} -> {DestinationIp}:{DestinationPort}", "Image"),
    ((4720,), False, "User account created: {TargetUserName}", None),
    ((4728, 4732, 4756), False, "Member added to privileged group {TargetUserName}: {MemberName}", None),
    ((7045,), False, "Service installed: {ServiceName} ({ImagePath})", "ImagePath"),
    ((4698,), False, "Scheduled task created: {TaskName}", None),
    ((1102,), False, "Security audit log cleared by {SubjectUserName}", None),
    ((104,), False, "System event log cleared", None),
    ((4769,), False, "Kerberos service ticket requested: {ServiceName} by {TargetUserName} (etype {TicketEncryptionType})", None),
    ((4768,), False, "Kerberos TGT requested by {TargetUserName} (etype {TicketEncryptionType})", None),
)


def described(event_id: Column, provider: Column, channel: Column) -> tuple[Column, Column]:
    """(description, target path or null) of an event."""
    text, target = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for ids, sysmon, parts, of in DESCRIPTIONS:
        known = event_id.isin(*ids) & provider.contains("Sysmon") if sysmon else event_id.isin(*ids)
        pieces = [field(p[1:-1]) if p.startswith("{") else F.lit(p) for p in _parts(parts)]
        text = text.when(known, F.concat(*pieces))
        if of:
            target = target.when(known & (field(of) != ""), field(of))
    other = F.concat(F.when(provider == "", "Unknown provider").otherwise(provider), F.lit(" event "), event_id.cast("string"), F.lit(" on "), channel)
    return text.otherwise(other), target


def _parts(template: str) -> list[str]:
    import re

    return [p for p in re.split(r"(\{\w+\})", template) if p]


def events(raw: DataFrame, now: Column | None = None) -> DataFrame:
    """One event a record. Time: TimeCreated, record header, now."""
    created = F.when(F.col("created_sec").isNotNull(), moment(F.col("created_sec"), F.col("created_nano")))
    at = F.coalesce(created, filetime_signed(F.col("ticks")), now_moment(now))
    rows = raw.withColumns({"event_id": unsigned_or_zero(field("EventID")), "process_id": unsigned_or_zero(field("ProcessID")), "provider": field("Provider"), "channel": field("Channel"), "computer": field("Computer")})
    text, target = described(F.col("event_id"), F.col("provider"), F.col("channel"))
    extra = json_text(
        "record_id", "event_id", "channel", "computer", "provider", "fields",
        F.when(field("UserID") != "", field("UserID")).alias("user_sid"),
        F.when(F.col("process_id") != 0, F.col("process_id")).alias("process_id"),
    )
    return envelope(rows, at, "evtx", F.concat(F.lit("evtx_event_"), F.col("event_id").cast("string")), text, target, extra, F.col("seq"))
