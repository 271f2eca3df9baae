from __future__ import annotations

import json
from types import SimpleNamespace

import pytest
from conftest import at, make_events
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from decoyscope.operators import quality as Q
from decoyscope.operators.analytics import recent_window, search_events
from decoyscope.plans.tables import materialize, shared_folder
from decoyscope.schemas import RESOURCE_FIELDS, SESSION
from decoyscope.sources import store
from decoyscope.sources.jsonl import read_lines


def text(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def test_stored_share_of_the_sensor_lines(spark):
    """Seven lines: three stored ids (one delivered twice), one lost id, one without any id, one that is no JSON, one blank."""
    session = {"eventid": "cowrie.command.input", "session": "9f0c", "timestamp": "2026-02-03T04:05:06.5Z"}
    lines = text(spark, {"event_id": "a-17"}, {"event_id": "a-18", "timestamp": "never"}, session, session, {"event_id": "lost"}, {"summary": "no id"}, "{broken", "\t")
    events = make_events(spark, [{"id": name, "at": 5} for name in ("a-17", "a-18", "cowrie.command.input-9f0c-2026-02-03T04:05:06.5Z", "not-from-here")])
    ids = Q.sensor_ids(lines)
    row = Q.completeness(ids, events).first()
    assert row.asDict() == {
        "sensor_events_total": 7, "sensor_events_in_window": 7, "filtered_out_events": 0, "unmappable_events": 2, "mappable_events": 4,
        "matched_events": 3, "completeness_percent": 75.0,
    }
    assert [r.event_id for r in Q.missing_ids(ids, events).collect()] == ["lost"]
    assert Q.present_ids(ids, events).count() == 3


@pytest.mark.parametrize("start, end, filtered, unmappable", [(None, None, 0, 0), (10, None, 1, 1), (None, 10, 1, 1), (5, 15, 2, 1), (0, 20, 0, 1)])
def test_a_window_filters_by_time_and_needs_one(spark, start, end, filtered, unmappable):
    lines = text(spark, {"event_id": "early", "timestamp": "2026-01-01T00:00:02Z"}, {"event_id": "late", "timestamp": "2026-01-01T00:00:18Z"}, {"event_id": "undated"})
    ids = Q.sensor_ids(lines, None if start is None else at(start), None if end is None else at(end))
    row = Q.completeness(ids, make_events(spark, [{"id": "early", "at": 2}])).first()
    assert (row.filtered_out_events, row.unmappable_events, row.mappable_events) == (filtered, unmappable, 3 - filtered - unmappable)


def test_resource_summary_reads_every_kind_of_cell(spark, tmp_path):
    rows = [("edge-1", "broker", "nan", "2048", " 7.5 "), ("edge-1", "broker", "inf", "x", "2.5"), ("edge-1", "broker", "2.0", "", "-"),
            ("edge-1", "", "1", "1", "1"), ("", "web", "1", "1", "1"), ("edge-2", "web", "n/a", "n/a", "n/a")]
    path = tmp_path / "usage.csv"
    cells = [dict(zip(("host_label", "container_name", "cpu_percent", "memory_usage_bytes", "memory_percent"), row)) for row in rows]
    path.write_text("\n".join([",".join(RESOURCE_FIELDS), *(",".join(cell.get(name, "0") for name in RESOURCE_FIELDS) for cell in cells)]))
    samples = store.read_resources(spark, str(path))
    found = {r.container_name: r for r in Q.resource_summary(samples).collect()}
    broker = found["broker"]
    assert (broker.sample_count, broker.cpu_percent_count, broker.cpu_percent_mean, broker.cpu_percent_max) == (3, 1, 2.0, 2.0)
    assert (broker.memory_usage_bytes_mean, broker.memory_percent_mean, broker.memory_percent_max) == (2048.0, 5.0, 7.5)
    assert (found["web"].sample_count, found["web"].cpu_percent_mean) == (0, None)
    assert Q.invalid_samples(samples).first()[0] == 2 + 3 + 3


STATS = {"Container": "c0ffee", "CPUPerc": "12.75%", "MemUsage": "3.5GiB / 8GiB", "MemPerc": "43.75%", "NetIO": "640B / 2.5GB", "BlockIO": "0B / 12kB", "PIDs": "31"}


def test_container_stats_are_numbers_or_counted_as_unreadable(spark):
    bad = [{**STATS, "CPUPerc": "--"}, {**STATS, "PIDs": "many"}, {**STATS, "BlockIO": "12kB"}, {**STATS, "MemUsage": "some / more"}]
    lines = text(spark, STATS, *bad, "no json").select("value", F.lit("edge-1").alias("host_label"), F.lit("t0").alias("timestamp"))
    (row,) = Q.decode_container_stats(lines).collect()
    assert row.asDict() == {
        "timestamp": "t0", "host_label": "edge-1", "container_name": "c0ffee", "cpu_percent": 12.75, "memory_usage_bytes": 3_758_096_384,
        "memory_limit_bytes": 8_589_934_592, "memory_percent": 43.75, "network_rx_bytes": 640, "network_tx_bytes": 2_500_000_000,
        "block_read_bytes": 0, "block_write_bytes": 12_000, "pids": 31,
    }
    assert [r.unreadable for r in Q.unreadable_container_stats(lines).collect()] == [5]


def test_intermediates_need_a_shared_folder_on_a_cluster(spark):
    def session(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))

    assert shared_folder(session("spark://host:7077", "s3a://bucket/x")) == "s3a://bucket/x"
    assert shared_folder(session("local[2]")) == shared_folder(session("local[4]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://host:7077"))
    df = text(spark, "a", "b")
    assert sorted(materialize(df, "t").collect()) == sorted(df.collect())


def sessions(spark, *rows):
    data = [{"session_id": i, "source_ip": ip, "start_time": at(s), "event_count": n} for i, ip, s, n in rows]
    return spark.createDataFrame([tuple(d.get(f) for f in SESSION.fieldNames()) for d in data], SESSION)


def test_upsert_replaces_by_key_and_removes_stale_rows(spark, tmp_path):
    path = str(tmp_path / "sessions")

    def stored():
        return sorted((r.session_id, r.event_count) for r in store.read_or_empty(spark, path, SESSION).collect())

    assert stored() == []
    first = sessions(spark, ("a", "1", 0, 1), ("b", "1", 90_000, 1), ("c", "2", 180_000, 1))
    for _ in range(2):
        store.upsert(spark, first, path, SESSION, "session_id", "start_time")
        assert stored() == [("a", 1), ("b", 1), ("c", 1)]
    stale = sessions(spark, ("a", "1", 0, 1), ("b", "1", 90_000, 1))
    store.upsert(spark, sessions(spark, ("a", "1", 0, 5)), path, SESSION, "session_id", "start_time", stale)
    assert stored() == [("a", 5), ("c", 1)]


def test_only_a_missing_path_reads_as_empty(spark, tmp_path):
    assert store.read_or_empty(spark, str(tmp_path / "none"), SESSION).count() == 0
    with pytest.raises(PySparkException):
        store.read_or_empty(spark, "nosuchscheme-:bad", SESSION).count()


def test_old_rows_read_under_a_newer_schema(spark, tmp_path):
    path = str(tmp_path / "old")
    sessions(spark, ("a", "1", 0, 1)).select("session_id", "source_ip").write.parquet(path)
    row = store.read_or_empty(spark, path, SESSION).first()
    assert row.session_id == "a" and row.schema_version is None
    assert store.align(spark.read.parquet(path), SESSION).columns == SESSION.fieldNames()


def test_ground_truth_files_and_line_scan(spark, tmp_path):
    (tmp_path / "runs").mkdir()
    run = {"run_id": "RUN-1", "experiment_id": "E", "steps": [{"step": 1, "service": "ssh", "started_at": "2026-01-01T00:00:01Z",
           "ended_at": "2026-01-01T00:00:02Z", "status": "completed", "detail": "x"}], "start_time": "2026-01-01T00:00:00Z"}
    (tmp_path / "runs" / "a.json").write_text(json.dumps(run, indent=2))
    row = store.read_ground_truth(spark, str(tmp_path / "runs")).first()
    assert row.steps[0].started_at == at(1) and row.start_time == at(0)
    (tmp_path / "log.jsonl").write_text('{"a":1}\n\n')
    assert [r.value for r in read_lines(spark, str(tmp_path / "log.jsonl"), "s", "ip").collect()] == ['{"a":1}']


def test_search_limits_and_windows_are_checked(spark):
    events = make_events(spark, [{"id": "a", "at": 0}, {"id": "b", "at": 60, "service": "router"}])
    assert [r.event.id for r in search_events(events, 1).collect()] == ["b"]
    assert [r.event.id for r in search_events(events, honeypot="camera-01").collect()] == ["a"]
    assert recent_window(events, "ts", at(900), 15).count() == 2 and recent_window(events, "ts", at(930), 15).count() == 1
    with pytest.raises(ValueError):
        search_events(events, 501)
    with pytest.raises(ValueError):
        recent_window(events, "ts", at(0), 7)
