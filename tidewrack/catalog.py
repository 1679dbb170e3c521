"""The registered queries of the timeline engine and their DuckDB oracles.

Each query encodes rows of a table into artifact bytes, decodes them with the
engine and is compared with SQL that computes the expected events directly
from the table.
"""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoders as E
from .functions import times
from .operators import evtx, lnk, mft
from .plans import timeline as plan
from .sources import sinks, triage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Events of one encoded file.
PER_FILE = 32


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Encoding of table rows.


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", micros("ts").alias("us"))


def files(rows: DataFrame, key: str, folder: str, encode: Callable[[list[dict]], bytes], per: int = PER_FILE) -> DataFrame:
    """(path, content): `per` rows with neighbouring keys make one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = [f"/case/{folder}/{n}" for n in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([encode(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    return grouped(rows, key, per).mapInArrow(run, "path string, content binary")


def grouped(rows: DataFrame, key: str, per: int = PER_FILE) -> DataFrame:
    """(file, rows): `per` rows with neighbouring keys, in their order."""
    rows = rows.select(F.floor(F.col(key) / per).cast("long").alias("file"), F.struct(key, *(c for c in rows.columns if c != key)).alias("row"))
    # an explicit width: adaptive coalescing would put these few bytes, which decode to much work, into one task
    spark = rows.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(width, "file").groupBy("file").agg(F.sort_array(F.collect_list("row")).alias("rows"))


def mft_files(spark: SparkSession, sf_dir: str, record: Callable[[dict], bytes], rows: DataFrame | None = None) -> DataFrame:
    return files(rows or events_of(spark, sf_dir), "event_id", "mft", lambda rows: b"".join(record(r) for r in rows))


def mft_events(made: DataFrame) -> DataFrame:
    return mft.events(mft.records(triage.units_of(made)))


def plain_record(r: dict, created_shift: int = 0, parent: int | None = None) -> bytes:
    t = [E.ticks(r["us"] + s * 1_000_000) for s in (0, 5, 10, 15)]
    return E.mft_record([E.standard_information(tuple(t)), E.file_name(f"{r['event_type']}_{r['event_id']}.dat", r["user_id"] if parent is None else parent, E.ticks(r["us"] - created_shift * 1_000_000))])


def at_text(zone: str = "+00:00") -> Column:
    return times.rfc3339(F.struct(F.col("ts_sec").alias("sec"), F.col("ts_nano").alias("nano")), zone)


def number_of(path: str) -> Column:
    return F.get_json_object("extra", f"$.{path}").cast("long")


def sql_time(us: str, zone: str = "+00:00") -> str:
    return (
        f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ({us}) % 1000000 = 0 THEN '' WHEN ({us}) % 1000 = 0 THEN '.' || lpad(CAST((({us}) % 1000000) // 1000 AS VARCHAR), 3, '0')"
        f" ELSE '.' || lpad(CAST(({us}) % 1000000 AS VARCHAR), 6, '0') END || '{zone}'"
    )


US = "epoch_us(ts)"
NAME = "event_type || '_' || event_id || '.dat'"
MACB = "(VALUES (0, 0, 'mft_file_created', 'created'), (1, 5, 'mft_file_modified', 'modified'), (2, 10, 'mft_entry_modified', 'MFT entry modified'), (3, 15, 'mft_file_accessed', 'accessed')) k(seq, sec, event_type, verb)"
MACB_US = f"{US} + k.sec * 1000000"


# File table.


@query(
    f"""SELECT '/case/mft/' || event_id // {PER_FILE} AS artifact_path, {sql_time(MACB_US)} AS ts_text, k.event_type AS event_type, 'File ' || k.verb || ': ' || e.{NAME} AS description,
    e.{NAME} AS target_path, rank() OVER (PARTITION BY event_id // {PER_FILE}, k.seq ORDER BY event_id) - 1 AS mft_entry, user_id AS parent_mft_ref FROM events e, {MACB}"""
)
def mft_macb_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record split, attribute walk, four events a record."""
    got = mft_events(mft_files(spark, sf_dir, plain_record))
    return got.select("artifact_path", at_text().alias("ts_text"), "event_type", "description", "target_path", number_of("mft_entry").alias("mft_entry"), number_of("parent_mft_ref").alias("parent_mft_ref"))


@query(f"SELECT {NAME} AS target_path, event_id % 123 > 60 AS timestomp_suspected, CASE WHEN event_id % 123 > 60 THEN '{mft.NOTE}' END AS note FROM events")
def mft_timestomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creation times that differ by more than 60 whole seconds; the skews straddle 60 and 61."""
    got = mft_events(mft_files(spark, sf_dir, lambda r: plain_record(r, r["event_id"] % 123))).where("event_type = 'mft_file_created'")
    return got.select("target_path", F.coalesce(F.get_json_object("extra", "$.timestomp_suspected").cast("boolean"), F.lit(False)).alias("timestomp_suspected"), F.get_json_object("extra", "$.note").alias("note"))


@query("SELECT CASE WHEN event_id % 4 < (event_id // 4) % 4 THEN 'a_' ELSE 'b_' END || event_id AS target_path, least(event_id % 4, (event_id // 4) % 4) AS namespace FROM events")
def mft_best_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two names the lowest namespace wins, the later of equals."""

    def record(r: dict) -> bytes:
        n, t = r["event_id"], E.ticks(r["us"])
        return E.mft_record([E.standard_information((t, 0, 0, 0)), E.file_name(f"a_{n}", 5, t, n % 4), E.file_name(f"b_{n}", 5, t, n // 4 % 4)])

    return mft_events(mft_files(spark, sf_dir, record)).select("target_path", number_of("namespace").alias("namespace"))


@query(f"SELECT {NAME} AS target_path, user_id AS parent_mft_ref FROM events")
def mft_parent_ref_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence bits of a parent reference are masked, the sign bit among them."""
    made = mft_files(spark, sf_dir, lambda r: plain_record(r, parent=r["user_id"] | (r["event_id"] * 97 % 65536) << 48))
    return mft_events(made).where("event_type = 'mft_file_created'").select("target_path", number_of("parent_mft_ref").alias("parent_mft_ref"))


@query(f"SELECT {NAME} AS target_path, count(*) AS events FROM events, range(4) WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 GROUP BY ALL")
def mft_skip_bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of another signature and records without update sequence give nothing."""

    def record(r: dict) -> bytes:
        n = r["event_id"]
        good = plain_record(r)
        return b"BAAD" + good[4:] if n % 7 == 0 else good[:6] + b"\0\0" + good[8:] if n % 11 == 0 else good

    # a file is recognised by its first slot, so one good record stands before the others
    head = E.mft_record([])
    made = files(events_of(spark, sf_dir), "event_id", "mft", lambda rows: head + b"".join(record(r) for r in rows))
    return mft_events(made).groupBy("target_path").agg(F.count("*").alias("events"))


# Shortcuts.


def lnk_files(spark: SparkSession, sf_dir: str, encode: Callable[[dict], bytes]) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority", micros("o_orderdate").alias("us"))
    return files(rows, "o_orderkey", "lnk", lambda got: encode(got[0]), per=1)


def lnk_events(made: DataFrame) -> DataFrame:
    return lnk.events(lnk.links(triage.units_of(made)), F.lit("2020-01-01 00:00:00").cast("timestamp"))


ORDER_US = "epoch_us(o_orderdate)"
LNK_TARGET = "CASE o_orderkey % 3 WHEN 0 THEN 'C:\\files\\' || o_orderkey || '.doc' WHEN 1 THEN '..\\é' || o_custkey ELSE '(no target)' END"


@query(f"SELECT '/case/lnk/' || o_orderkey AS artifact_path, {sql_time(ORDER_US)} AS ts_text, {LNK_TARGET} AS target_path, 'Shortcut targets ' || {LNK_TARGET} AS description FROM orders")
def lnk_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local path, else relative path, else none; an item list before them is passed over."""

    def encode(r: dict) -> bytes:
        n, t = r["o_orderkey"], E.ticks(r["us"])
        return E.shortcut(t, t, t, local=f"C:\\files\\{n}.doc" if n % 3 == 0 else None, relative=f"..\\é{r['o_custkey']}" if n % 3 < 2 else None, ids=b"x" * (n % 9) if n % 2 else None)

    return lnk_events(lnk_files(spark, sf_dir, encode)).select("artifact_path", at_text().alias("ts_text"), "target_path", "description")


@query(
    """SELECT '/case/lnk/' || o_orderkey AS artifact_path, 'Shortcut targets t' || CASE WHEN o_orderkey % 4 = 1 THEN ' with arguments:  /x ' || o_orderpriority ELSE '' END AS description,
    CASE o_orderkey % 4 WHEN 1 THEN ' /x ' || o_orderpriority WHEN 2 THEN '  ' || chr(9) || chr(12288) WHEN 3 THEN '' END AS arguments FROM orders"""
)
def lnk_arguments_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments are told if they are not blank, white space of all scripts included."""

    def encode(r: dict) -> bytes:
        n, t = r["o_orderkey"], E.ticks(r["us"])
        return E.shortcut(t, t, t, relative="t", arguments=(None, f" /x {r['o_orderpriority']}", "  \t\u3000", "")[n % 4])

    return lnk_events(lnk_files(spark, sf_dir, encode)).select("artifact_path", "description", F.get_json_object("extra", "$.arguments").alias("arguments"))


LNK_US = f"CASE WHEN o_orderkey % 2 = 0 THEN {ORDER_US} WHEN o_orderkey % 3 = 0 THEN {ORDER_US} + 7000000 WHEN o_orderkey % 5 = 0 THEN {ORDER_US} + 9123000 ELSE 1577836800000000 END"


@query(
    f"""SELECT '/case/lnk/' || o_orderkey AS artifact_path, {sql_time(f'({LNK_US})')} AS ts_text, CASE WHEN o_orderkey % 3 = 0 THEN {sql_time(ORDER_US + ' + 7000000')} END AS target_created FROM orders"""
)
def lnk_time_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write time, else creation time, else the file's, else now."""

    def encode(r: dict) -> bytes:
        n = r["o_orderkey"]
        return E.shortcut(E.ticks(r["us"] + 7_000_000) if n % 3 == 0 else E.EPOCH, 0, E.ticks(r["us"]) if n % 2 == 0 else -5, relative="t")

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("/case/lnk/"), "o_orderkey").alias("path"), "o_orderkey", (micros("o_orderdate") + 9_123_000).alias("m"))
    timed = orders.where("o_orderkey % 5 = 0").select("path", F.floor(F.col("m") / 1_000_000).alias("mtime_sec"), (F.pmod("m", F.lit(1_000_000)) * 1000).cast("int").alias("mtime_nano"))
    made = lnk_files(spark, sf_dir, encode).join(timed, "path", "left")
    return lnk_events(made).select("artifact_path", at_text().alias("ts_text"), F.get_json_object("extra", "$.target_created").alias("target_created"))


@query(
    """SELECT '/case/lnk/' || c_custkey AS artifact_path, left(c_name, 16) AS machine,
    CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN '02:00:00:' || regexp_replace(lpad(lower(to_hex(c_custkey % 16777216)), 6, '0'), '(..)(..)(..)', '\\1:\\2:\\3') END AS mac FROM customer"""
)
def lnk_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine and network address of the tracker block; other UUID versions and empty nodes give no address."""

    def encode(rows: list[dict]) -> bytes:
        n = rows[0]["c_custkey"]
        node = bytes(6) if n % 7 == 0 else b"\x02\0\0" + (n % 16777216).to_bytes(3, "big")
        return E.shortcut(0, 0, E.EPOCH + 1, relative="t", blocks=E.tracker(rows[0]["c_name"], E.uuid_with_node(node, 4 if n % 5 == 0 else 1)))

    made = files(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name"), "c_custkey", "lnk", encode, per=1)
    return lnk_events(made).select("artifact_path", F.get_json_object("extra", "$.builder_machine_id").alias("machine"), F.get_json_object("extra", "$.builder_mac_address").alias("mac"))


@query("SELECT '/case/lnk/' || o_orderkey AS artifact_path, CASE WHEN o_orderkey % 40 > 16 THEN o_orderkey % 40 ELSE 0 END AS overlay_bytes, '0x00000088' AS link_flags, o_orderkey % 10 AS show_command FROM orders")
def lnk_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes after the last block, told above 16; flags as padded hex."""
    made = lnk_files(spark, sf_dir, lambda r: E.shortcut(0, 0, E.ticks(r["us"]), relative="t", show=r["o_orderkey"] % 10, tail=b"z" * (r["o_orderkey"] % 40)))
    return lnk_events(made).select("artifact_path", F.coalesce(number_of("overlay_bytes"), F.lit(0)).alias("overlay_bytes"), F.get_json_object("extra", "$.link_flags").alias("link_flags"), number_of("show_command").alias("show_command"))


# Event logs.


def log_of(rows: list[dict], add: Callable[[E.ChunkWriter, dict], None]) -> bytes:
    chunks = []
    for half in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        chunk = E.ChunkWriter()
        for r in half:
            add(chunk, r)
        chunks.append(chunk.full())
    return E.event_log(chunks)


def log_files(spark: SparkSession, sf_dir: str, add: Callable[[E.ChunkWriter, dict], None], folder: str = "evtx", rows: DataFrame | None = None) -> DataFrame:
    return files(rows or events_of(spark, sf_dir), "event_id", folder, lambda rows: log_of(rows, add))


def log_events(made: DataFrame) -> DataFrame:
    return evtx.events(evtx.records(triage.units_of(made)))


def system_values(r: dict, event: int, provider: str | None, channel: str = "Security", created: bool = True) -> list[tuple[str, object]]:
    return [("wstr", provider), ("u16", event), ("filetime", E.ticks(r["us"]) if created else None), ("u32", r["event_id"] % 2**32), ("u32", r["user_id"] % 5), ("u32", 8), ("wstr", channel), ("wstr", "WIN-DC01")]


def template(names: tuple[str, ...], skip: tuple[str, ...] = ()) -> Callable[[E.Body], None]:
    """System part over slots 0..7, then named data of type wstr."""

    def build(body: E.Body) -> None:
        E.system_part(body, skip)
        body.open("EventData")
        body.out += b"\x02"
        for k, name in enumerate(names):
            body.data(name, 8 + k, "wstr")
        body.out += b"\x04\x04"

    return build


LOGON = ("TargetUserName", "LogonType", "IpAddress")


def logon(chunk: E.ChunkWriter, r: dict, created: bool = True, shift: int = 0, junk: bytes = b"") -> None:
    items = system_values(r, 4624, "Microsoft-Windows-Security-Auditing", created=created) + [("wstr", f"user{r['user_id']}"), ("u32", r["event_id"] % 12), ("wstr", r["event_type"])]
    chunk.record(r["event_id"], E.ticks(r["us"] + shift), "logon", template(LOGON), items, junk)


@query(
    f"""SELECT '/case/evtx/' || event_id // {PER_FILE} AS artifact_path, {sql_time(US)} AS ts_text, 'evtx_event_4624' AS event_type, 'Logon: user' || user_id || ' (type ' || event_id % 12 || ') from ' || event_type AS description,
    event_id AS record_id, user_id % 5 AS process_id, 'WIN-DC01' AS computer, CAST(event_id % 12 AS VARCHAR) AS logon_type FROM events"""
)
def evtx_logon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, records, templates shared by later records, values."""
    got = log_events(log_files(spark, sf_dir, logon))
    return got.select(
        "artifact_path", at_text().alias("ts_text"), "event_type", "description", number_of("record_id").alias("record_id"), F.coalesce(number_of("process_id"), F.lit(0)).alias("process_id"),
        F.get_json_object("extra", "$.computer").alias("computer"), F.get_json_object("extra", "$.fields.LogonType").alias("logon_type"),
    )


#: Event id, provider and field names of every kind of description; each field's value is its name and the event id.
CASES = (
    (4624, "P", LOGON), (4625, "P", ("TargetUserName", "IpAddress", "Status")), (4688, "P", ("NewProcessName", "ParentProcessName", "CommandLine")),
    (1, "Microsoft-Windows-Sysmon", ("Image", "ParentImage", "CommandLine")), (3, "Microsoft-Windows-Sysmon", ("Image", "DestinationIp", "DestinationPort")),
    (4720, "P", ("TargetUserName",)), (4728, "P", ("TargetUserName", "MemberName")), (4732, "P", ("TargetUserName", "MemberName")), (4756, "P", ("TargetUserName", "MemberName")),
    (7045, "P", ("ServiceName", "ImagePath")), (4698, "P", ("TaskName",)), (1102, "P", ("SubjectUserName",)), (104, "P", ()), (4769, "P", ("ServiceName", "TargetUserName", "TicketEncryptionType")),
    (4768, "P", ("TargetUserName", "TicketEncryptionType")), (1, "P", ("Image",)), (999, None, ()),
)
X = "|| event_id"
DESCRIBED = f"""CASE event_id % {len(CASES)}
 WHEN 0 THEN 'Logon: TargetUserName' {X} || ' (type LogonType' {X} || ') from IpAddress' {X} WHEN 1 THEN 'Failed logon: TargetUserName' {X} || ' from IpAddress' {X} || ' (status Status' {X} || ')'
 WHEN 2 THEN 'Process created: NewProcessName' {X} || ' (parent ParentProcessName' {X} || ') cmd: CommandLine' {X} WHEN 3 THEN 'Sysmon process create: Image' {X} || ' (parent ParentImage' {X} || ') cmd: CommandLine' {X}
 WHEN 4 THEN 'Sysmon network connection: Image' {X} || ' -> DestinationIp' {X} || ':DestinationPort' {X} WHEN 5 THEN 'User account created: TargetUserName' {X}
 WHEN 9 THEN 'Service installed: ServiceName' {X} || ' (ImagePath' {X} || ')' WHEN 10 THEN 'Scheduled task created: TaskName' {X} WHEN 11 THEN 'Security audit log cleared by SubjectUserName' {X} WHEN 12 THEN 'System event log cleared'
 WHEN 13 THEN 'Kerberos service ticket requested: ServiceName' {X} || ' by TargetUserName' {X} || ' (etype TicketEncryptionType' {X} || ')' WHEN 14 THEN 'Kerberos TGT requested by TargetUserName' {X} || ' (etype TicketEncryptionType' {X} || ')'
 WHEN 15 THEN 'P event 1 on Security' WHEN 16 THEN 'Unknown provider event 999 on Security' ELSE 'Member added to privileged group TargetUserName' {X} || ': MemberName' {X} END"""


@query(
    f"""SELECT event_id AS record_id, {DESCRIBED} AS description, 'evtx_event_' || ([{', '.join(str(c[0]) for c in CASES)}])[event_id % {len(CASES)} + 1] AS event_type,
    CASE event_id % {len(CASES)} WHEN 2 THEN 'NewProcessName' {X} WHEN 3 THEN 'Image' {X} WHEN 4 THEN 'Image' {X} WHEN 9 THEN 'ImagePath' {X} END AS target_path FROM events"""
)
def evtx_describe_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every description, by event id and provider."""

    def add(chunk: E.ChunkWriter, r: dict) -> None:
        kind = r["event_id"] % len(CASES)
        event, provider, names = CASES[kind]
        chunk.record(r["event_id"], 0, kind, template(names), system_values(r, event, provider) + [("wstr", f"{n}{r['event_id']}") for n in names])

    return log_events(log_files(spark, sf_dir, add)).select(number_of("record_id").alias("record_id"), "description", "event_type", "target_path")


@query(f"SELECT event_id AS record_id, 'Logon: user' || user_id || ' (type ' || event_id % 12 || ') from ' || event_type AS description FROM events")
def evtx_nested_eventdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event data as a fragment of its own in a value, with its own template."""

    def data(body: E.Body) -> None:
        body.out += b"\x0f\x01\x01\0"
        body.open("EventData")
        body.out += b"\x02"
        for k, name in enumerate(LOGON):
            body.data(name, k, "wstr")
        body.out += b"\x04"

    def add(chunk: E.ChunkWriter, r: dict) -> None:
        inner = [("wstr", f"user{r['user_id']}"), ("u32", r["event_id"] % 12), ("wstr", r["event_type"])]
        outer = system_values(r, 4624, "P") + [("nested", lambda place: E.nested_fragment(place, data, inner))]
        chunk.record(r["event_id"], 0, "outer", E.system_part, outer)

    return log_events(log_files(spark, sf_dir, add)).select(number_of("record_id").alias("record_id"), "description")


VALUES = ("u8", "u64", "bool", "binary", "guid", "filetime", "systemtime", "sid", "hex32", "hex64", "str", "i32")
HEX4 = "upper(lpad(to_hex(event_id % 65536), 4, '0'))"


@query(
    f"""SELECT event_id AS record_id, CAST(event_id % 256 AS VARCHAR) AS u8, CAST(event_id AS VARCHAR) AS u64, CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END AS bool,
    lpad(lower(to_hex(event_id % 65536)), 4, '0') AS binary, '{{00000000-' || {HEX4} || '-0000-0102-03040506}}' AS guid, {sql_time(US)} AS filetime, strftime(make_timestamp({US}), '%Y-%m-%dT%H:%M:%SZ') AS systemtime,
    'S-1-5-21-' || event_id || CASE WHEN event_id % 2 = 0 THEN '-500' ELSE '' END AS sid, '0x' || lpad(lower(to_hex(event_id % 65536)), 8, '0') AS hex32, '0x' || lpad(lower(to_hex(event_id)), 16, '0') AS hex64, 'é' || event_id AS str,
    lpad(lower(to_hex(event_id % 256)), 2, '0') || '000000' AS i32 FROM events"""
)
def evtx_value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value of each type; signed integers are shown as bytes, identifiers with four node bytes."""

    def build(body: E.Body) -> None:
        E.system_part(body)
        for k, name in enumerate(VALUES):
            body.data(name, 8 + k, name)

    def add(chunk: E.ChunkWriter, r: dict) -> None:
        from datetime import datetime, timedelta

        n, at = r["event_id"], datetime(1970, 1, 1) + timedelta(microseconds=r["us"])
        subs = [21, n, 500][: 3 if n % 2 == 0 else 2]
        made = {
            "u8": n % 256, "u64": n, "bool": n % 2, "binary": (n % 65536).to_bytes(2, "big"), "guid": struct.pack("<IHH", 0, n % 65536, 0) + bytes(range(1, 9)), "filetime": E.ticks(r["us"]),
            "systemtime": struct.pack("<8H", at.year, at.month, 0, at.day, at.hour, at.minute, at.second, 0), "sid": bytes([1, len(subs), 0, 0, 0, 0, 0, 5]) + struct.pack(f"<{len(subs)}I", *subs),
            "hex32": n % 65536, "hex64": n, "str": f"é{n}", "i32": n % 256,
        }
        chunk.record(n, 0, "types", build, system_values(r, 5, "P") + [(k, made[k]) for k in VALUES])

    got = log_events(log_files(spark, sf_dir, add))
    return got.select(number_of("record_id").alias("record_id"), *(F.get_json_object("extra", f"$.fields.{k}").alias(k) for k in VALUES))


@query("SELECT event_id AS record_id, 'Fallback' || event_id AS provider, 'S-1-5-18' AS user_sid, CAST(NULL AS VARCHAR) AS opcode FROM events")
def evtx_system_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots without a name in the template get the fixed system names, one by one."""

    def add(chunk: E.ChunkWriter, r: dict) -> None:
        empty = [("wstr", None)] * 9
        items = system_values(r, 5, f"Fallback{r['event_id']}") + empty + [("sid", bytes([1, 1, 0, 0, 0, 0, 0, 5, 18, 0, 0, 0]))]
        chunk.record(r["event_id"], 0, "bare", lambda body: E.system_part(body, ("Provider",)), items)

    got = log_events(log_files(spark, sf_dir, add))
    return got.select(number_of("record_id").alias("record_id"), *(F.get_json_object("extra", f"$.{k}").alias(a) for k, a in (("provider", "provider"), ("user_sid", "user_sid"), ("fields.Opcode", "opcode"))))


@query(f"SELECT event_id AS record_id, CASE WHEN event_id % 3 = 0 THEN {sql_time(US + ' + 1500')} ELSE {sql_time(US)} END AS ts_text FROM events")
def evtx_time_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TimeCreated, else the record header's time."""
    got = log_events(log_files(spark, sf_dir, lambda chunk, r: logon(chunk, r, created=r["event_id"] % 3 != 0, shift=1500)))
    return got.select(number_of("record_id").alias("record_id"), at_text().alias("ts_text"))


@query("SELECT event_id AS record_id, 'evtx_event_4624' AS event_type FROM events")
def evtx_record_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbage and records of impossible size between records are passed over."""
    bad = b"\x2a\x2a\0\0" + struct.pack("<I", 7) + bytes(8)
    far = b"\x2a\x2a\0\0" + struct.pack("<I", 1 << 30) + bytes(8)
    junk = (b"", b"junk" * 5, bad, far)
    got = log_events(log_files(spark, sf_dir, lambda chunk, r: logon(chunk, r, junk=junk[r["event_id"] % 4])))
    return got.select(number_of("record_id").alias("record_id"), "event_type")


# Whole timelines.


def mixed(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Files of every kind, and some of none, for all events or for `rows` of them, out of one shuffle."""

    def several(n: int | None, rows: list[dict]) -> Iterator[tuple[str, bytes]]:
        yield f"/case/mft/{n}", b"".join(plain_record(r) for r in rows)
        yield f"/case/evtx/{n}", log_of(rows, logon)
        yield f"/case/junk/{n}", b"MZ" + bytes(len(rows))
        firsts: dict = {}
        for r in rows:
            firsts.setdefault(r["event_id"], r)
        for r in firsts.values():
            yield f"/case/lnk/{r['event_id']}", E.shortcut(0, 0, E.ticks(r["us"]), relative=f"t{r['event_id']}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):  # about 11 MB of files
                part = batch.slice(a, 64)
                paths, contents = zip(*(x for n, rows in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for x in several(n, rows)), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(contents, pa.binary())], names=["path", "content"])

    return grouped(events_of(spark, sf_dir) if rows is None else rows, "event_id").mapInArrow(run, "path string, content binary")


def mixed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.timeline(triage.units_of(mixed(spark, sf_dir)), F.lit("2020-01-01 00:00:00").cast("timestamp"))


PATHS = f"""SELECT 'mft' AS source, '/case/mft/' || event_id // {PER_FILE} AS artifact_path, event_id, {US} + k.sec * 1000000 AS us, k.seq AS seq, k.event_type AS event_type, 'File ' || k.verb || ': ' || e.{NAME} AS description, e.{NAME} AS target_path FROM events e, {MACB}
 UNION ALL SELECT 'evtx', '/case/evtx/' || event_id // {PER_FILE}, event_id, {US}, 0, 'evtx_event_4624', 'Logon: user' || user_id || ' (type ' || event_id % 12 || ') from ' || event_type, NULL FROM events
 UNION ALL SELECT 'lnk', '/case/lnk/' || event_id, event_id, {US}, 0, 'lnk_target_referenced', 'Shortcut targets t' || event_id, 't' || event_id FROM events"""


@query(f"SELECT coalesce(kind, 'none') AS kind, count(*) AS files FROM (SELECT DISTINCT source AS kind, artifact_path FROM ({PATHS}) UNION ALL SELECT DISTINCT NULL, CAST(event_id // {PER_FILE} AS VARCHAR) FROM events) GROUP BY ALL")
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by kind; files of no known kind are counted too."""
    units = triage.units_of(mixed(spark, sf_dir)).select("kind", "path").distinct()
    return units.groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("files"))


@query(f"SELECT source, artifact_path, count(*) AS events FROM ({PATHS}) GROUP BY ALL")
def per_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each file that has any."""
    return plan.event_counts(mixed_events(spark, sf_dir))


@query(f"SELECT row_number() OVER (ORDER BY us, artifact_path, event_id, seq) AS place, source, artifact_path, event_type, description FROM ({PATHS})")
def timeline_union_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in order of time; ties by path and place in the file."""
    return plan.ordered(plan.numbered(mixed_events(spark, sf_dir))).select("place", "source", "artifact_path", "event_type", "description")


@query(f"SELECT {sql_time('us', 'Z')} AS timestamp, source, event_type, description, artifact_path, target_path, target_path IS NOT NULL AS has_target FROM ({PATHS})")
def timeline_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, read back field by field."""
    lines = plan.json_lines(mixed_events(spark, sf_dir)).select("value")
    names = ("timestamp", "source", "event_type", "description", "artifact_path", "target_path")
    return lines.select(*(F.get_json_object("value", f"$.{n}").alias(n) for n in names), F.contains("value", F.lit('"target_path":')).alias("has_target"))


@query(f'SELECT {sql_time("us")} AS "Timestamp", source AS "Source", event_type AS "EventType", description AS "Description", artifact_path AS "ArtifactPath", coalesce(target_path, \'\') AS "TargetPath" FROM ({PATHS})')
def timeline_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the CSV form."""
    return plan.csv_rows(mixed_events(spark, sf_dir)).select(*plan.CSV_HEADER)


# Folders and files.


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in the checkpoint folder if that is a mounted one, else a temporary one of this machine."""
    said = spark.conf.get("spark.checkpoint.dir", None) or ""
    base = said.removeprefix("file://") if said.startswith("file://") else said if said.startswith("/") else tempfile.gettempdir()
    root = os.path.join(base, f"case-{uuid.uuid4().hex}")
    os.makedirs(root)
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def store(made: DataFrame, root: str) -> None:
    """Write the files `made` (path, content, optional us: modification time) below `root` in place of /case.

    Files of the same folder of `root`.spare, if there is one, are used again:
    on a file system that discards freed blocks, deleting takes longer than all else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spare: dict[str, Iterator[str]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                path = root + row["path"].removeprefix("/case")
                if (parent := os.path.dirname(path)) not in spare:
                    os.makedirs(parent, exist_ok=True)
                    spare[parent] = spares(parent, root)
                at = next(spare[parent], path)
                with open(at, "r+b" if at != path else "wb") as f:
                    f.write(row["content"])
                    f.truncate()
                if "us" in row:
                    os.utime(at, ns=(row["us"] * 1000, row["us"] * 1000))
                if at != path:
                    os.rename(at, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    made.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def spares(parent: str, root: str) -> Iterator[str]:
    """Files of the folder that stands for `parent` in `root`.spare, each taken by this task alone."""
    old, own = f"{root}.spare{parent.removeprefix(root)}", uuid.uuid4().hex
    for name in os.listdir(old) if os.path.isdir(old) else ():
        with contextlib.suppress(FileNotFoundError):
            os.rename(os.path.join(old, name), taken := os.path.join(old, f"{own}-{name}"))
            yield taken


#: Events whose files lie on disk at a time, about 1.2 GB with those of every kind.
WAVE = 1 << 17


def waves(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame], scan: Callable[[str], DataFrame]) -> DataFrame:
    """What `scan` gives for the files that `make` gives for all events, a slice of whole files at a time.

    The next slice is written while one is scanned, over the files of the slice
    that was scanned last. So those of two slices lie on disk at most.
    """
    events, base = events_of(spark, sf_dir), folder(spark)
    out, dealt = (f"file://{base}/{name}" for name in ("rows", "dealt"))
    count = max(1, -(-events.count() // WAVE))
    if count > 1:  # each slice by itself, so that none reads all events
        place = F.coalesce(F.pmod(F.floor(F.col("event_id") / PER_FILE), F.lit(count)), F.lit(0)).cast("int")
        events.withColumn("slice", place).repartition(count, "slice").write.partitionBy("slice").parquet(dealt)
        slices = spark.read.parquet(dealt)

    def save(k: int, gone: str | None) -> str:
        root = folder(spark)
        if gone:
            os.rename(gone, f"{root}.spare")
        store(boxed(make(slices.where(F.col("slice") == k).drop("slice") if count > 1 else events)), root)
        if gone:
            discard(spark, f"{root}.spare")
        return root

    with ThreadPoolExecutor(1) as pool:
        root, ahead = None, pool.submit(save, 0, None)
        for k in range(count):
            last, root = root, ahead.result()
            if k + 1 < count:
                ahead = pool.submit(save, k + 1, last)
            elif last:
                ahead = pool.submit(discard, spark, last)
            scan(root).write.mode("append").parquet(out)
        ahead.result()
    discard(spark, root)
    return spark.read.parquet(out)


def discard(spark: SparkSession, root: str) -> None:
    """Delete a folder, the folders in it side by side."""
    names = os.listdir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shutil.rmtree(os.path.join(root, names[k]), ignore_errors=True)
            yield batch

    spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(run, "id long").write.format("noop").mode("overwrite").save()
    shutil.rmtree(root)


def boxed(made: DataFrame) -> DataFrame:
    """Files of each task in a folder of its own, a case in each: tasks that write into one folder wait for each other.

    The rows come from a shuffle by hash, so a task that is run again has the same ones.
    """
    return made.withColumn("path", F.replace("path", F.lit("/case/"), F.concat(F.lit("/case/"), F.spark_partition_id().cast("string"), F.lit("/"))))


def below(root: str, column: str = "artifact_path") -> Column:
    """The path below the folder that a file was dealt to."""
    return F.concat(F.lit("/case"), F.regexp_extract(F.substring(column, len(root) + 1, 1 << 20), "^/[0-9]+(/.*)$", 1)).alias(column)


@query(f"SELECT source, replace(artifact_path, '/case/mft/', '/case/.mft/_') AS artifact_path, count(*) AS events FROM ({PATHS}) GROUP BY ALL")
def scan_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files on disk, hidden names among them, scanned, routed and decoded."""

    def make(rows: DataFrame) -> DataFrame:
        return mixed(spark, sf_dir, rows).select(F.replace("path", F.lit("/case/mft/"), F.lit("/case/.mft/_")).alias("path"), "content")

    return waves(spark, sf_dir, make, lambda root: plan.event_counts(plan.collect(spark, root)).select("source", below(root), "events"))


@query(f"SELECT '/case/lnk/' || event_id AS artifact_path, {sql_time(US)} AS ts_text FROM events")
def scan_mtime_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortcuts without times of their own take the modification times of their files."""
    link = E.shortcut(E.EPOCH, E.EPOCH, E.EPOCH, relative="t")

    def make(rows: DataFrame) -> DataFrame:
        # dealt out: a small table is one partition, but every row makes a file
        dealt = rows.repartition(2 * spark.sparkContext.defaultParallelism, "event_id")
        return dealt.select(F.concat(F.lit("/case/lnk/"), "event_id").alias("path"), F.lit(link).alias("content"), "us")

    return waves(spark, sf_dir, make, lambda root: plan.collect(spark, root).select(below(root), at_text().alias("ts_text")))


@query(f"SELECT us, source, event_type, description, artifact_path, target_path, source = 'evtx' AS has_fields FROM ({PATHS})")
def sink_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON Lines file, read back with VARIANT extras."""
    out = os.path.join(folder(spark), "timeline.jsonl")
    sinks.write_jsonl(mixed_events(spark, sf_dir), out)
    got = sinks.read_jsonl(spark, "file://" + out)
    fields = F.try_variant_get("extra", "$.fields.LogonType", "string").isNotNull()
    return got.select(F.unix_micros("timestamp").alias("us"), "source", "event_type", "description", "artifact_path", "target_path", fields.alias("has_fields"))


@query(f'SELECT {sql_time("us")} AS "Timestamp", source AS "Source", event_type AS "EventType", description AS "Description", artifact_path AS "ArtifactPath", coalesce(target_path, \'\') AS "TargetPath" FROM ({PATHS})')
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CSV file with its header, read back."""
    out = os.path.join(folder(spark), "timeline.csv")
    sinks.write_csv(mixed_events(spark, sf_dir), out)
    got = spark.read.options(header=True, escape='"', multiLine=True).csv("file://" + out)
    return got.select(*(F.coalesce(n, F.lit("")).alias(n) for n in plan.CSV_HEADER))


@query(
    f"""SELECT '[mft] /case/mft/' || event_id // {PER_FILE} || ' -> ' || 4 * count(*) || ' event(s)' AS line FROM events GROUP BY event_id // {PER_FILE}
    UNION ALL SELECT count(DISTINCT event_id // {PER_FILE}) || ' file(s) scanned, ' || 4 * count(*) || ' event(s) written to timeline.jsonl' FROM events"""
)
def cli_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line says of a folder: a line a file, and the sums."""
    from . import cli

    root, said = folder(spark), io.StringIO()
    store(mft_files(spark, sf_dir, plain_record), root)
    out = os.path.join(folder(spark), "timeline.jsonl")
    with contextlib.redirect_stderr(said):
        cli.collect(spark, root, out, "jsonl")
    lines = [x.replace(root, "/case").replace(out, "timeline.jsonl") for x in said.getvalue().splitlines() if "event(s)" in x]
    return spark.createDataFrame([(x,) for x in lines], "line string")


# Shapes that the other queries do not have.


@query(f"SELECT '/case/mft/' || event_id // {PER_FILE} AS artifact_path, rank() OVER (PARTITION BY event_id // {PER_FILE} ORDER BY event_id) - 1 AS mft_entry, CASE WHEN event_id % 2 = 0 THEN {NAME} ELSE '(unknown name)' END AS target_path FROM events")
def mft_resident_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that are not resident are passed over."""

    def record(r: dict) -> bytes:
        t = E.ticks(r["us"])
        return E.mft_record([E.file_name("elsewhere", 5, t, 0, resident=False), E.standard_information((t, 0, 0, 0)), E.file_name(f"{r['event_type']}_{r['event_id']}.dat", 5, t, resident=r["event_id"] % 2 == 0)])

    return mft_events(mft_files(spark, sf_dir, record)).select("artifact_path", number_of("mft_entry").alias("mft_entry"), "target_path")


@query(
    """SELECT '/case/lnk/' || o_orderkey AS artifact_path, CASE o_orderkey % 3 WHEN 0 THEN '\\\\srv' || o_custkey || '\\share' WHEN 1 THEN 't' || o_orderkey ELSE '\\\\' || repeat('s', 1000 + o_orderkey % 2) || left('0123456789abcdefghijklmnopqrstuvwxyz', 21) END AS target_path FROM orders"""
)
def lnk_network_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of a network share, if there is no other path; at most 1024 bytes of it."""

    def encode(r: dict) -> bytes:
        n, t = r["o_orderkey"], E.ticks(r["us"])
        long = "\\\\" + "s" * (1000 + n % 2) + "0123456789abcdefghijklmnopqrstuvwxyz"[:21]
        return E.shortcut(t, t, t, network=long if n % 3 == 2 else f"\\\\srv{r['o_custkey']}\\share", relative=f"t{n}" if n % 3 == 1 else None)

    return lnk_events(lnk_files(spark, sf_dir, encode)).select("artifact_path", "target_path")


@query(
    f"""SELECT '/case/inline/' || event_id // {PER_FILE} AS artifact_path, {sql_time(US)} AS ts_text, 'evtx_event_4624' AS event_type, 'Logon: user' || user_id || ' (type ' || event_id % 12 || ') from ' || event_type AS description,
    event_id AS record_id, user_id % 5 + 1 AS process_id, 'Inline' AS provider, 'k' || event_id AS other FROM events"""
)
def evtx_inline_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without template: values bound to elements, attributes and named data."""

    def add(chunk: E.ChunkWriter, r: dict) -> None:
        x = E.Inline()
        x.open("Provider")
        x.attribute("Name", "Inline")
        x.close()
        x.open("EventID")
        x.text("4624")
        x.close()
        x.open("Execution")
        x.attribute("ProcessID", str(r["user_id"] % 5 + 1))
        x.close()
        x.open("Custom")
        x.attribute("Kind", f"k{r['event_id']}")
        x.close()
        for name, text in zip(LOGON, (f"user{r['user_id']}", str(r["event_id"] % 12), r["event_type"]), strict=True):
            x.open("Data")
            x.attribute("Name", name)
            x.text(text)
            x.close()
        chunk.raw(r["event_id"], E.ticks(r["us"]), x.body())

    got = log_events(log_files(spark, sf_dir, add, "inline"))
    other = F.try_element_at(F.from_json(F.get_json_object("extra", "$.fields"), "map<string,string>"), F.lit("Custom/Kind"))
    return got.select(
        "artifact_path", at_text().alias("ts_text"), "event_type", "description", number_of("record_id").alias("record_id"), number_of("process_id").alias("process_id"),
        F.get_json_object("extra", "$.provider").alias("provider"), other.alias("other"),
    )


@query("SELECT event_id AS record_id, CASE WHEN event_id % 2 = 0 THEN 'Stated' ELSE 'Given' END AS channel FROM events")
def evtx_template_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that the template itself holds stands where no value does."""

    def build(body: E.Body) -> None:
        body.out += b"\x0f\x01\x01\0"
        for name in ("Event", "System"):
            body.open(name)
            body.out += b"\x02"
        body.bound("Provider", [("Name", 0, "wstr")])
        body.element("EventID", 1, "u16")
        body.bound("TimeCreated", [("SystemTime", 2, "filetime")])
        body.element("EventRecordID", 3, "u32")
        body.open("Channel")
        body.out += b"\x02"
        body.literal("Stated")
        body.slot(6, "wstr")
        body.out += b"\x04\x04\x04"

    def add(chunk: E.ChunkWriter, r: dict) -> None:
        chunk.record(r["event_id"], E.ticks(r["us"]), "stated", build, system_values(r, 1, "P", channel="Given" if r["event_id"] % 2 else None))

    return log_events(log_files(spark, sf_dir, add)).select(number_of("record_id").alias("record_id"), F.get_json_object("extra", "$.channel").alias("channel"))


@query("SELECT event_id AS record_id, least(4090 + event_id % 12, 4096) AS chars FROM events")
def evtx_value_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value keeps 4096 characters."""

    def encode(rows: list[dict]) -> bytes:
        chunk = E.ChunkWriter()
        for r in rows:
            chunk.record(r["event_id"], E.ticks(r["us"]), "logon", template(LOGON), system_values(r, 4624, "P") + [("wstr", "é" * (4090 + r["event_id"] % 12)), ("u32", 2), ("wstr", "")])
        return E.event_log([chunk.full()])

    got = log_events(files(events_of(spark, sf_dir), "event_id", "evtx", encode, per=6))
    return got.select(number_of("record_id").alias("record_id"), F.char_length(F.get_json_object("extra", "$.fields.TargetUserName")).cast("long").alias("chars"))


# Times.

TICKS = "(event_id - 500) * 36000000123457"


def ticks_of(step: int) -> Column:
    """Ticks of an event as a decimal: from event 23,498 (`filetime_signed`) or 253,471 on, a long does not hold them."""
    return (F.col("event_id").cast("decimal(19,0)") - 500) * F.lit(step) + F.lit(times.EPOCH)


@query(f"SELECT event_id, CASE WHEN {TICKS} + 116444736000000000 > 116444736000000000 THEN ({TICKS}) // 10000000 ELSE -99999999999 END AS sec, CASE WHEN {TICKS} > 0 THEN ({TICKS}) % 10000000 * 100 ELSE -1 END AS nano FROM events")
def filetime_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at and before 1970 are none."""
    at = times.filetime_strict(ticks_of(36000000123457))
    return events_of(spark, sf_dir).select("event_id", F.coalesce(at["sec"], F.lit(-99999999999)).alias("sec"), F.coalesce(at["nano"].cast("long"), F.lit(-1)).alias("nano"))


@query(
    f"""SELECT event_id, CASE WHEN t + 116444736000000000 > 0 THEN CAST((t - ((t % 10000000) + 10000000) % 10000000) // 10000000 AS BIGINT) ELSE -99999999999 END AS sec,
    CASE WHEN t + 116444736000000000 > 0 THEN (((t % 10000000) + 10000000) % 10000000) * 100 ELSE -1 END AS nano FROM (SELECT event_id, ({TICKS}) * 11 AS t FROM events)"""
)
def filetime_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times before 1970 are kept, by floor division; those before 1601 are none."""
    at = times.filetime_signed(ticks_of(36000000123457 * 11))
    return events_of(spark, sf_dir).select("event_id", F.coalesce(at["sec"], F.lit(-99999999999)).alias("sec"), F.coalesce(at["nano"].cast("long"), F.lit(-1)).alias("nano"))


STEP = "CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END"


@query(f"SELECT event_id, {sql_time(f'(epoch_us(ts) // ({STEP}) * ({STEP}))', 'Z')} AS text FROM events")
def rfc3339_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As few digits of a second as are exact."""
    step = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 1000).otherwise(1_000_000)
    us = F.floor(F.col("us") / step) * step
    at = times.moment(F.floor(us / 1_000_000), F.pmod(us, F.lit(1_000_000)) * 1000)
    return events_of(spark, sf_dir).select("event_id", times.rfc3339(at, "Z").alias("text"))
