"""Every timeline query against its DuckDB oracle over whole tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidewrack import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "orders", "events")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_matches_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(str, (r[c] for c in columns))) for r in df.collect()))
    said = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in said.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["filetime_strict", "filetime_signed"])
def test_filetimes_beyond_a_long(spark, tmp_path, name):
    """Ids whose ticks no long holds; DuckDB computes the same SQL over the ids as huge integers."""
    c = duckdb.connect()
    ids = "SELECT unnest([0, 499, 500, 501, 23290, 23291, 23792, 99999, 256204, 256704, 256705, 5999999, 100000000])::BIGINT AS event_id"
    c.execute(f"COPY (SELECT event_id, event_id % 7 AS user_id, 'view' AS event_type, TIMESTAMP '2024-01-01' AS ts FROM ({ids})) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select("event_id", "sec", "nano").collect())
    c.execute(f"CREATE VIEW events AS SELECT CAST(event_id AS HUGEINT) AS event_id FROM read_parquet('{tmp_path}/events.parquet')")
    assert got == sorted(c.execute(f"SELECT event_id, sec, nano FROM ({catalog.ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("name", ["scan_folder", "scan_mtime_fallback"])
def test_scans_hold_a_slice_of_the_files(spark, duck, monkeypatch, name):
    """However many events there are, a bounded number of them has files on disk."""
    monkeypatch.setattr(catalog, "WAVE", 300)
    held, stored, store = [], [], catalog.store

    def counted(made, root):
        store(made, root)
        stored.append(root)
        held.append(sum(len(names) for r in stored for _, _, names in os.walk(r)))

    monkeypatch.setattr(catalog, "store", counted)
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())
    want = duck.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert got == sorted(tuple(map(str, r)) for r in want)
    assert len(stored) == 4 and max(held) < 1000 and not any(os.path.exists(r) for r in stored)


@pytest.mark.parametrize("name", ["scan_folder", "scan_mtime_fallback"])
def test_scans_write_over_the_files_of_slices_before(spark, duck, monkeypatch, name):
    """Most files of a slice are those of the slice before the last one, so few are made and deleted."""
    monkeypatch.setattr(catalog, "WAVE", 300)
    stored, store = [], catalog.store

    def noted(made, root):
        store(made, root)
        stored.append({os.stat(os.path.join(r, n)).st_ino for r, _, names in os.walk(root) for n in names})

    monkeypatch.setattr(catalog, "store", noted)
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())
    want = duck.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert got == sorted(tuple(map(str, r)) for r in want)
    assert all(2 * len(new & old) > len(new) for old, new in zip(stored, stored[2:]))
