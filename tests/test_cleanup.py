from __future__ import annotations

import os
from pathlib import Path

import pytest
from conftest import at, make_events

from decoyscope.schemas import SESSION
from decoyscope.sources import store as table_store
from decoyscope.sources.store import read_days, upsert
from decoyscope.streaming.cleanup import clean_store, internal_rows
from decoyscope.streaming.processor import Store, process_batch

DAY = 86_400


def _session(spark, rows):
    """Sessions from (id, source, day)."""
    full = [tuple({"session_id": i, "source_ip": ip, "start_time": at(DAY * day)}.get(name) for name in SESSION.fieldNames()) for i, ip, day in rows]
    return spark.createDataFrame(full, SESSION)


def _files(root):
    return {str(path): os.stat(path).st_mtime_ns for path in sorted(Path(root).rglob("*.parquet"))}


def _stored(spark, store):
    return sorted(row.session_id for row in read_days(spark, store.sessions, SESSION).collect())


@pytest.fixture
def store(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    rows = [("s1", "10.0.0.1", 0), ("s2", "127.0.0.1", 0), ("s3", "10.0.0.1", 1), ("s4", "::1", 2), ("s5", "127.9.9.9", 2), ("s6", None, 3), ("s7", "::1", 3)]
    upsert(spark, _session(spark, rows), store.sessions, SESSION, "session_id", "start_time")
    return store


def _counts(spark, store):
    return {row.table_name: row["rows"] for row in internal_rows(spark, store).collect()}


def test_dry_run_deletes_nothing_and_the_delete_touches_its_days_only(spark, store):
    before = _files(store.sessions)
    assert _counts(spark, store) == {"sessions": 4, "detections": 0, "session_cells": 0, "session_paths": 0}
    assert _files(store.sessions) == before
    clean_store(spark, store)
    assert _stored(spark, store) == ["s1", "s3", "s6"] and set(_counts(spark, store).values()) == {0}
    after = _files(store.sessions)
    untouched = {path: stamp for path, stamp in before.items() if "day=2026-01-02" in path}
    assert untouched and untouched.items() <= after.items()
    clean_store(spark, store)  # nothing is left to do, so nothing is written
    assert _files(store.sessions) == after


def test_a_delete_that_stopped_halfway_is_finished_by_the_next(spark, store, monkeypatch):
    real = table_store._replace_days

    def failing(*args):
        raise OSError("lost")

    monkeypatch.setattr(table_store, "_replace_days", failing)
    with pytest.raises(OSError):
        clean_store(spark, store)
    assert len(_stored(spark, store)) == 7
    monkeypatch.setattr(table_store, "_replace_days", real)
    clean_store(spark, store)
    assert _stored(spark, store) == ["s1", "s3", "s6"]


def test_the_processor_goes_on_after_a_cleanup(spark, store):
    process_batch(spark, make_events(spark, [{"id": "a", "at": 5, "ip": "10.0.0.9"}, {"id": "b", "at": 6, "ip": "127.0.0.1", "internal": True}]), 0, store)
    clean_store(spark, store)
    process_batch(spark, make_events(spark, [{"id": "c", "at": 7, "ip": "10.0.0.9"}]), 1, store)
    sizes = {row.source_ip: row.event_count for row in read_days(spark, store.sessions, SESSION).where("event_count IS NOT NULL").collect()}
    assert sizes == {"10.0.0.9": 2} and set(_counts(spark, store).values()) == {0}
