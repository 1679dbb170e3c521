"""Folders to timelines: scan, route, order, sinks and the command line."""

from __future__ import annotations

import csv
import json
import os

from pyspark.sql import functions as F

from tidewrack import cli
from tidewrack import encoders as E
from tidewrack.operators import lnk
from tidewrack.plans import timeline as plan
from tidewrack.sources import sinks, triage
from tidewrack.streaming import incremental

T = E.ticks(1_700_000_000_123_000)


def folder(tmp_path):
    root = tmp_path / "case"
    (root / "sub").mkdir(parents=True)
    record = E.mft_record([E.standard_information((T + 20, T + 10, 0, T + 10)), E.file_name('a,"b"\n', 5, T + 20 - 610_000_000)])
    (root / "$MFT").write_bytes(record * 300)
    (root / ".hidden.lnk").write_bytes(E.shortcut(0, 0, T, relative="x"))
    (root / "sub" / "_y.lnk").write_bytes(E.shortcut(0, 0, T + 10, local=""))
    (root / "junk").write_bytes(b"MZ")
    (root / "empty").write_bytes(b"")
    os.symlink(root / ".hidden.lnk", root / "link.lnk")
    return root


def test_scan_and_route(spark, tmp_path):
    units = triage.read(spark, str(folder(tmp_path)))
    kinds = {os.path.basename(r["path"]): r["kind"] for r in units.collect()}
    assert kinds == {"$MFT": "mft", ".hidden.lnk": "lnk", "_y.lnk": "lnk", "junk": None, "empty": None}
    assert plan.file_count(units) == 5
    assert triage.read(spark, str(tmp_path / "none")).count() == 0


def test_order_and_json(spark, tmp_path):
    events = plan.collect(spark, str(folder(tmp_path)))
    out = str(tmp_path / "t.jsonl")
    sinks.write_jsonl(events, out)
    lines = [json.loads(x) for x in open(out, encoding="utf-8")]
    assert len(lines) == 900 + 2
    times = [x["timestamp"].rstrip("Z").ljust(29, "0") for x in lines]
    assert times == sorted(times)
    assert lines[0]["timestamp"] == "2023-11-14T22:13:20.123Z" and lines[0]["extra"] == {"link_flags": "0x00000088", "show_command": 1}
    flagged = [x for x in lines if x["extra"].get("timestomp_suspected")]
    assert len(flagged) == 300 and all(x["event_type"] == "mft_file_created" and list(x["extra"]) == sorted(x["extra"]) for x in flagged)
    tied = [(x["artifact_path"], x["extra"].get("mft_entry"), x["event_type"]) for x in lines if x["event_type"] != "mft_file_created"]
    assert tied[1][1:] == (0, "mft_file_modified") and tied[2][1:] == (0, "mft_file_accessed") and tied[3][1:] == (1, "mft_file_modified")
    back = sinks.read_jsonl(spark, out)
    assert back.where("extra:mft_entry::int = 7").count() == 3
    assert spark.sql("SELECT count(*) FROM timeline").first()[0] == 902
    counts = {os.path.basename(r["artifact_path"]): r["events"] for r in plan.event_counts(events).collect()}
    assert counts == {"$MFT": 900, ".hidden.lnk": 1, "_y.lnk": 1}


def test_csv(spark, tmp_path):
    events = plan.collect(spark, str(folder(tmp_path)))
    out = str(tmp_path / "t.csv")
    sinks.write_csv(events, out)
    rows = list(csv.reader(open(out, encoding="utf-8", newline="")))
    assert tuple(rows[0]) == plan.CSV_HEADER and len(rows) == 903
    assert rows[-1][5] == 'a,"b"\n' and rows[1][0].endswith("+00:00")
    sinks.write_csv(events.limit(0), out)
    assert open(out).read() == ",".join(plan.CSV_HEADER) + "\n"
    sinks.write_jsonl(events.limit(0), out)
    assert open(out).read() == ""


def test_lnk_fallbacks(spark):
    rows = [("a", E.shortcut(0, 0, 0), None, None), ("b", E.shortcut(0, 0, 0, relative="r"), 5, 7), ("c", E.shortcut(0, 0, T, local="", relative="r"), None, None)]
    units = triage.units_of(spark.createDataFrame(rows, "path string, content binary, mtime_sec long, mtime_nano int"))
    got = {r["artifact_path"]: r for r in lnk.events(lnk.links(units), F.lit("2020-01-01 00:00:00").cast("timestamp")).collect()}
    assert (got["a"]["ts_sec"], got["a"]["target_path"]) == (1577836800, "(no target)")
    assert (got["b"]["ts_sec"], got["b"]["ts_nano"]) == (5, 7)
    assert got["c"]["target_path"] == ""


def test_whole_file_and_folder_agree(spark, tmp_path):
    root = folder(tmp_path)
    paths = [str(p) for p in root.rglob("*") if p.is_file() and not p.is_symlink()]
    rows = [(p, open(p, "rb").read()) for p in paths]
    native = plan.timeline(triage.units_of(spark.createDataFrame(rows, "path string, content binary"))).select(*plan.ORDER, "description", "extra")
    listed = plan.timeline(triage.read(spark, str(root))).select(*plan.ORDER, "description", "extra")
    assert native.exceptAll(listed).count() == 0 and listed.exceptAll(native).count() == 0


def test_command_line(spark, tmp_path, capsys):
    root = folder(tmp_path)
    out = str(tmp_path / "o.jsonl")
    assert cli.collect(spark, str(root), out, "jsonl") == 0
    assert "[mft]" in capsys.readouterr().err and os.path.getsize(out)
    assert cli.parse_lnk(spark, str(root / ".hidden.lnk")) == 0
    assert json.loads(capsys.readouterr().out)["source"] == "lnk"
    assert cli.parse_lnk(spark, str(root / "junk")) == 1 and cli.parse_lnk(spark, str(root / "none")) == 1
    assert cli.collect(spark, str(tmp_path / "missing"), out, "jsonl") == 0 and os.path.getsize(out) == 0


def test_incremental(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in range(3):
        (src / f"f{n}.lnk").write_bytes(E.shortcut(0, 0, T + n, relative=f"t{n}"))
    asked = incremental.watch(spark, str(src), str(tmp_path / "out"), str(tmp_path / "state"))
    asked.awaitTermination()
    (src / "f3.lnk").write_bytes(E.shortcut(0, 0, T + 3, relative="t3"))
    incremental.watch(spark, str(src), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["target_path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["t0", "t1", "t2", "t3"]


def test_planning_opens_no_small_file(tmp_path, monkeypatch):
    """The driver lists a folder; files are recognised where they are read."""
    root = folder(tmp_path)
    whole = {r[0]: r[1] for part in triage.TriageReader(str(root), None).partitions() for r in triage.TriageReader(str(root), None).read(part)}
    links = {r[0] for part in triage.TriageReader(str(root), "lnk").partitions() for r in triage.TriageReader(str(root), "lnk").read(part)}
    assert links == {p for p, kind in whole.items() if kind == "lnk"} and links
    monkeypatch.setattr(triage, "open", lambda *_: 1 / 0, raising=False)
    assert {r[0] for part in triage.TriageReader(str(root), None).partitions() for r in part.ranges} == set(whole)
