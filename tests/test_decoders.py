"""Decoders on bytes: known shapes, quirks, and damage of every kind."""

from __future__ import annotations

import random
import struct

import pyarrow as pa
import pytest

from tidewrack import encoders as E
from tidewrack.functions import times
from tidewrack.functions.binary import Stream, c_string, number, piece, wide
from tidewrack.operators import base, evtx, lnk, mft

T = E.ticks(1_700_000_000_000_000)


def unit(content: bytes, offset: int = 0) -> dict:
    return {"path": "p", "content": content, "offset": offset, "mtime_sec": None, "mtime_nano": None}


def record(**changes) -> bytes:
    return E.mft_record([E.standard_information((T, T + 1, T + 2, T + 3)), E.file_name("evil.exe", 5, T)], **changes)


def log(items=None, build=None, **more) -> bytes:
    chunk = E.ChunkWriter()
    system = [("wstr", "Prov"), ("u16", 4624), ("filetime", T), ("u32", 1), ("u32", 4), ("u32", 8), ("wstr", "Security"), ("wstr", "PC")]

    def both(body):
        E.system_part(body)
        (build or (lambda b: None))(body)

    chunk.record(1, T, "t", both, system + (items or []), **more)
    return E.event_log([chunk.full()])


def test_reads_are_bounded():
    assert number(b"\x01\x02", 0, 2) == 0x201 and number(b"\x01", 0, 2) is None and number(b"", -1, 1) is None
    assert piece(b"abc", 1, 2) == b"bc" and piece(b"abc", 2, 2) is None
    assert c_string(b"ab\0c", 0, 10) == "ab" and c_string(b"abc", 1, 1) == "b" and c_string(b"a", 2, 1) is None and c_string(b"\xff", 0, 1) == "\ufffd"
    assert wide(b"a\0\x00\xd8b") == "a\ufffd"
    stream = Stream(b"\x01\x02\x03")
    assert stream.uint(4) is None and stream.at == 0 and stream.uint(2) == 0x201 and not stream.skip(2) and stream.left == 1


def test_mft_record():
    (row,) = mft.decode(unit(record()))
    assert row["name"] == "evil.exe" and row["created"] == T and row["accessed"] == T + 3 and row["parent"] == 5 and row["entry"] == 0


def test_mft_fixup_restores_sector_ends():
    name = "n" * 200  # its text runs over the end of the first sector
    (row,) = mft.decode(unit(E.mft_record([E.standard_information((T,) * 4), E.file_name(name, 5, T)])))
    assert row["name"] == name


def test_mft_rejects_and_skips():
    bad = b"BAAD" + record()[4:]
    assert [r["entry"] for r in mft.decode(unit(record() + bad + record(saved=0) + record() + b"FILE", offset=4096))] == [4, 7]
    assert list(mft.decode(unit(b"junk"))) == []


@pytest.mark.parametrize(("spaces", "want"), [((1, 2), "a"), ((2, 1), "b"), ((1, 1), "b"), ((3, 0), "b"), ((0, 3), "a")])
def test_mft_lowest_namespace_last_of_equals(spaces, want):
    names = [E.file_name(n, 5, T, s) for n, s in zip("ab", spaces, strict=True)]
    (row,) = mft.decode(unit(E.mft_record([E.standard_information((T,) * 4), *names])))
    assert row["name"] == want


def test_mft_nonresident_is_ignored():
    (row,) = mft.decode(unit(E.mft_record([E._attribute(0x10, bytes(48), resident=False), E.file_name("x", 5, T)])))
    assert "created" not in row and row["name"] == "x"


def test_lnk_parts():
    blocks = E.tracker("HOST", E.uuid_with_node(b"\xaa\xbb\xcc\xdd\xee\xff"))
    (row,) = lnk.decode(unit(E.shortcut(T, 0, T, local="C:\\a", relative="r", arguments="/x", blocks=blocks, tail=b"z" * 17, ids=b"123")))
    assert (row["local"], row["relative"], row["arguments"], row["machine"], row["mac"], row["overlay"]) == ("C:\\a", "r", "/x", "HOST", "aa:bb:cc:dd:ee:ff", 17)
    assert list(lnk.decode(unit(b"junk" * 10))) == []


def test_lnk_truncated_string_ends_strings():
    whole = E.shortcut(T, 0, T, relative="relative", arguments="arguments")
    (row,) = lnk.decode(unit(whole[: 0x4C + 2 + 16 + 2 + 4]))
    assert row["relative"] == "relative" and "arguments" not in row


def test_lnk_network_path_and_ansi():
    share = struct.pack("<5I", 0x20, 0, 0x14, 0, 0) + b"\\\\srv\\\xe9\0"
    info = struct.pack("<7I", 0x1C + len(share), 0x1C, 2, 0, 0, 0x1C, 0) + share
    raw = bytearray(E.shortcut(0, 0, T)[:0x4C])
    struct.pack_into("<I", raw, 20, 0x02)
    (row,) = lnk.decode(unit(bytes(raw) + info + bytes(4)))
    assert row["network"] == "\\\\srv\\\ufffd"


def test_evtx_values_and_nested():
    assert evtx.value_text(b"\x01", 0x06) == "01" and evtx.value_text(b"", 0x99) == ""
    assert evtx.sid(bytes([1, 0, 0, 0, 0, 0, 0, 5])) == "S-1-5-" and evtx.sid(b"\1\2") == ""
    assert evtx.value_text(struct.pack("<q", 0), 0x11) == "1601-01-01T00:00:00Z"
    assert evtx.value_text(struct.pack("<q", T + 5), 0x11) == "2023-11-14T22:13:20.000000500+00:00"

    def data(body):
        body.data("k", 0, "wstr")

    (row,) = evtx.decode(unit(log([("nested", lambda p: E.nested_fragment(p, data, [("wstr", "v")]))])[4096:], 4096))
    fields = dict(row["fields"])
    assert fields["k"] == "v" and fields["EventID"] == "4624" and fields["Computer"] == "PC" and row["created_sec"] == 1_700_000_000


def test_evtx_limits():
    def data(body):
        for k in range(3):
            body.data("n" * (63 + k), 8 + k, "wstr")

    (row,) = evtx.decode(unit(log([("wstr", "x" * 5000), ("wstr", "y"), ("wstr", "z")], data)[4096:], 4096))
    fields = row["fields"]
    assert len(fields["n" * 63]) == 4096 and fields["n" * 64] == "y" and "n" * 65 not in fields


def test_evtx_inline_record_keeps_leading_attributes():
    body = b"\x0f\x01\x01\0"
    name = lambda text, at: struct.pack("<IHH", 0, 0, len(text)) + text.encode("utf-16-le")
    tokens = b"\x01" + bytes(6) + struct.pack("<I", 100) + b"\x06" + struct.pack("<I", 140) + b"\x05\x01" + E.counted("Prov") + b"\x41"
    body = (body + tokens).ljust(100, b"\0") + name("Provider", 100)
    body = body.ljust(140, b"\0") + name("Name", 140)
    chunk = E.ChunkWriter()
    chunk.raw(9, T, body)
    (row,) = evtx.decode(unit(chunk.full(), 4096))
    assert row["fields"] == {"Provider": "Prov"} and row["created_sec"] is None


def test_evtx_missing_template_uses_system_slots():
    body = b"\x0f\x01\x01\0\x0c\0" + struct.pack("<II", 0, 70000) + E.values([("wstr", "P"), ("wstr", "G"), ("u16", 1), ("u16", 77)])
    chunk = E.ChunkWriter()
    chunk.raw(9, T, body)
    (row,) = evtx.decode(unit(chunk.full(), 4096))
    assert row["fields"] == {"Provider": "P", "ProviderGuid": "G", "Qualifiers": "1", "EventID": "77"}


def test_rfc3339_parsing():
    assert times.parse_rfc3339("2023-11-14T22:13:20.123456789+01:00") == (1_699_996_400, 123456789)
    assert times.parse_rfc3339("1601-01-01T00:00:00Z")[0] < 0
    for bad in ("", "2023-11-14", "2023-13-01T00:00:00Z", "2023-11-14T22:13:20"):
        assert times.parse_rfc3339(bad) is None


SAMPLES = {
    "mft": (mft.decode, record()),
    "lnk": (lnk.decode, E.shortcut(T, T, T, local="C:\\a", relative="r", arguments="/x", blocks=E.tracker("H", E.uuid_with_node(b"123456")), ids=b"12")),
    "evtx": (evtx.decode, log([("wstr", "x")], lambda b: b.data("k", 8, "wstr"))[4096:]),
}


@pytest.mark.parametrize("kind", SAMPLES)
def test_damage_never_raises(kind):
    decode, whole = SAMPLES[kind]
    rng = random.Random(3)
    used = min(len(whole), 2200)
    for n in range(0, used, 1 if kind != "evtx" else 7):
        list(decode(unit(whole[:n].ljust(len(whole), b"\0") if kind == "evtx" else whole[:n], 4096)))
    for _ in range(400):
        hurt = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            hurt[rng.randrange(used)] = rng.randrange(256)
        list(decode(unit(bytes(hurt), 4096)))


def test_unsigned_or_zero(spark):
    """Digits alone count: a line end behind them does not."""
    texts = {"5": 5, "+5": 5, "5\n": 0, " 5": 0, "": 0, "4294967295": 4294967295, "4294967296": 0, "0000000000007": 7, "-1": 0, "5x": 0}
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", evtx.unsigned_or_zero(F.col("text")).alias("n")).collect()
    assert {r["text"]: r["n"] for r in rows} == texts


def test_small_units_share_a_batch():
    """A batch of Arrow costs far more than a row, and each shortcut gives one row only."""
    units = pa.RecordBatch.from_pylist([{"content": bytes([k % 3])} for k in range(5000)])
    schema = pa.schema([("n", pa.int64())])

    def decode(unit):
        yield {"n": unit["content"][0]}
        if unit["content"][0] == 1:
            raise ValueError

    got = list(base.batched(iter([units, units]), decode, schema))
    assert [b.num_rows for b in got] == [4096, 4096, 1808]
    assert [n for b in got for n in b.column(0).to_pylist()] == [k % 3 for k in range(5000)] * 2
    large = pa.RecordBatch.from_pylist([{"content": bytes(base.BYTES)}] * 3)
    assert [b.num_rows for b in base.batched(iter([large]), decode, schema)] == [1, 1, 1]
