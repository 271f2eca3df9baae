from __future__ import annotations

import json
import os
import random
import shutil
import time
from pathlib import Path

import pytest
from conftest import at, make_events
from pyspark.sql import functions as F

from decoyscope.operators.detections import detect
from decoyscope.operators.experiments import match_events, settle_status
from decoyscope.operators.ingest import dedupe_events
from decoyscope.operators.sessions import build_sessions
from decoyscope.schemas import DEAD_LETTER, DETECTION, EVENT, SESSION
from decoyscope.sources import store as table_store
from decoyscope.sources.jsonl import stream_lines
from decoyscope.sources.store import read_or_empty, write_batch
from decoyscope.streaming import processor
from decoyscope.streaming.ingest import ingest_stream
from decoyscope.streaming.panels import arrival_stream, edge_arrivals, run_arrivals, run_metrics, settle_marks, settle_stream, settle_watch
from decoyscope.streaming.processor import Store, compact_events, compact_letters, process_batch, process_stream, read_events, stream_raw_events

LINE = {
    "event_id": "e1", "timestamp": "2026-03-05T06:07:08Z", "service": "router", "protocol": "tcp", "honeypot_id": "lab-router-7", "honeypot_type": "router",
    "source_ip": "203.0.113.77", "category": "session", "action": "probe", "outcome": "failure", "type": "start",
}


def test_every_line_reaches_exactly_one_table(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    store = Store(str(tmp_path / "store"))

    def drain():
        lines = stream_lines(spark, str(logs), "s-1", "192.168.50.10")
        query = ingest_stream(lines, store.raw_events, store.dead_letters, str(tmp_path / "progress"), available_now=True)
        query.awaitTermination()
        return query

    (logs / "a.jsonl").write_text("\n".join([json.dumps(LINE), "not-json", json.dumps({**LINE, "event_id": "e2", "category": "x"})]))
    drain()
    (logs / "b.jsonl").write_text("\n".join([json.dumps(LINE), json.dumps({**LINE, "event_id": "e3"})]))
    assert run_metrics(drain())["rows_read"] == 2
    raw = dedupe_events(read_or_empty(spark, store.raw_events, EVENT))
    assert sorted(r.event.id for r in raw.collect()) == ["e1", "e3"]
    letters = read_or_empty(spark, store.dead_letters, DEAD_LETTER).collect()
    assert sorted(r.reason for r in letters) == ["invalid_event_category_", "json_parse_failure"]


def test_incremental_processing_equals_a_full_rebuild_and_replays_are_harmless(spark, tmp_path):
    rng = random.Random(9)
    rows = [{"id": str(i), "at": rng.randrange(0, 40_000), "ip": f"10.0.0.{rng.choice([1, 1, 2, 3])}", "url": f"/{rng.randrange(9)}",
             "service": rng.choice(["camera", "router", "mqtt"]), "protocol": "http"} for i in range(90)]
    rng.shuffle(rows)  # late events extend, bridge and precede stored sessions
    store = Store(str(tmp_path / "store"))
    for n in range(3):
        batch = make_events(spark, rows[n * 30:(n + 1) * 30])
        process_batch(spark, batch, n, store)
        if n == 1:
            process_batch(spark, batch, n, store)
    expected = build_sessions(make_events(spark, rows))
    stored = read_or_empty(spark, store.sessions, SESSION)
    assert sorted(stored.collect()) == sorted(expected.collect())
    found = read_or_empty(spark, store.detections, DETECTION)
    assert sorted(r.detection_id for r in found.collect()) == sorted(r.detection_id for r in detect(expected).collect())


def test_first_detection_time_survives_a_second_cycle(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    commands = [{"id": "a", "at": 0, "command": "id"}, {"id": "b", "at": 10, "command": "ls"}]
    process_batch(spark, make_events(spark, commands[:1]), 0, store)
    first = read_or_empty(spark, store.detections, DETECTION).first()
    process_batch(spark, make_events(spark, commands[1:]), 1, store)
    second = read_or_empty(spark, store.detections, DETECTION).first()
    assert (second.detection_id, second.detected_at) == (first.detection_id, first.detected_at)
    assert second.evidence_count == 2 and first.evidence_count == 1


def test_process_stream_over_a_file_source(spark, tmp_path):
    make_events(spark, [{"id": "a", "at": 0}, {"id": "b", "at": 20}]).write.parquet(str(tmp_path / "in"))
    store, seen = Store(str(tmp_path / "store")), []
    events = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    process_stream(events, store, str(tmp_path / "progress"), available_now=True, report=lambda n, c: seen.append(c)).awaitTermination()
    assert sum(c["sessions"] for c in seen) == 1 and read_or_empty(spark, store.sessions, SESSION).first().event_count == 2


def test_settle_watch_states(spark):
    runs = spark.createDataFrame([("a", at(0)), ("b", at(0)), ("c", at(0))], "experiment_id string, end_time timestamp")
    arrivals = spark.createDataFrame([("a", 2, at(1)), ("b", 1, at(9))], "experiment_id string, matched_event_count long, last_arrival timestamp")

    def states(now):
        return [r.state for r in settle_watch(runs, arrivals, F.lit(now)).orderBy("experiment_id").collect()]

    assert states(at(10)) == ["settled", "waiting", "waiting"] and states(at(25)) == ["settled", "settled", "timed_out"]


def _ingest(spark, folder, store, progress, *lines):
    folder.mkdir(exist_ok=True)
    (folder / f"{len(list(folder.iterdir()))}.jsonl").write_text("\n".join(json.dumps(line) for line in lines))
    ingest_stream(stream_lines(spark, str(folder), folder.name, "192.0.2.10"), store.raw_events, store.dead_letters, str(progress), available_now=True).awaitTermination()


def test_streams_and_new_checkpoints_share_a_table(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    _ingest(spark, tmp_path / "north", store, tmp_path / "p1", {**LINE, "event_id": "n1"})
    _ingest(spark, tmp_path / "south", store, tmp_path / "p2", {**LINE, "event_id": "s1"})
    shutil.rmtree(tmp_path / "p1")  # the same place, another stream
    _ingest(spark, tmp_path / "north", store, tmp_path / "p1", {**LINE, "event_id": "n2"})
    stored = read_or_empty(spark, store.raw_events, EVENT)
    assert sorted(r.event.id for r in dedupe_events(stored).collect()) == ["n1", "n2", "s1"]


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/Los_Angeles"])
def test_ingest_and_processor_on_one_store_in_any_driver_zone(spark, tmp_path, zone, monkeypatch):
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        store = Store(str(tmp_path / "store"))
        for n, hour in enumerate((20, 23, 1)):
            lines = [{**LINE, "event_id": f"{n}-{k}", "timestamp": f"2026-03-0{5 + (hour < 12)}T{hour:02d}:0{k}:00Z"} for k in range(4)]
            _ingest(spark, tmp_path / "logs", store, tmp_path / "ingest", *lines)
            events = spark.readStream.schema(EVENT).parquet(store.raw_events)
            process_stream(events, store, str(tmp_path / "process"), available_now=True).awaitTermination()
        raw = dedupe_events(read_or_empty(spark, store.raw_events, EVENT))
        assert raw.count() == 12 and read_events(spark, store).count() == 12
        stored = sorted((r.session_id, r.event_count) for r in read_or_empty(spark, store.sessions, SESSION).collect())
        assert stored == sorted((r.session_id, r.event_count) for r in build_sessions(raw).collect()) and len(stored) == 3
    finally:
        monkeypatch.undo()
        time.tzset()


def test_batches_leave_no_scratch_and_read_recent_days_only(spark, tmp_path):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(os.listdir(shared))
    store = Store(str(tmp_path / "store"))
    for n in range(3):
        process_batch(spark, make_events(spark, [{"id": f"{n}", "at": 200_000 * n}, {"id": f"{n}b", "at": 200_000 * n + 5}]), n, store)
    assert set(os.listdir(shared)) == before
    assert read_or_empty(spark, store.sessions, SESSION).count() == 3


def test_compaction_leaves_one_partition_and_one_row_per_id(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    for n in range(4):
        process_batch(spark, make_events(spark, [{"id": "same", "at": 0, "seen": n + 1}, {"id": f"own{n}", "at": 10}]), n, store)
    expected = sorted((r.event.id, r.event.ingested) for r in read_events(spark, store).collect())
    for _ in range(2):
        compact_events(spark, store, F.lit("2027-01-01").cast("date"))
        stored = read_or_empty(spark, store.events, EVENT)
        assert sorted((r.event.id, r.event.ingested) for r in stored.collect()) == expected and len(expected) == 5
    process_batch(spark, make_events(spark, [{"id": "late", "at": 20}]), 9, store)
    compact_events(spark, store, F.lit("2027-01-01").cast("date"))
    assert read_or_empty(spark, store.events, EVENT).count() == 6


def _files(path):
    return sorted(Path(path).rglob("part-*.parquet"))


def _scanned(frame):
    """Rows that the file scans of a collected frame gave."""
    node, total = frame._jdf.queryExecution().executedPlan(), 0
    nodes = [node.finalPhysicalPlan() if "AdaptiveSparkPlan" in node.nodeName() else node]
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        nodes += [node.children().apply(n) for n in range(node.children().size())]
    return total


def test_compacted_days_are_clustered_and_skip_files(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    for n in range(6):
        rows = [{"id": f"{n}-{k}-{'even' if k % 2 else 'odd'}", "at": 3000 * k + n, "ip": f"10.0.{k % 7}.{n}"} for k in range(60)]  # two days
        write_batch(make_events(spark, rows), store.raw_events, n, "north")
    before = len(_files(store.raw_events))
    expected = sorted(r.event.id for r in read_or_empty(spark, store.raw_events, EVENT).collect())
    # Small results stay apart here as they would at size.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compact_events(spark, store, F.lit("2027-01-01").cast("date"), store.raw_events)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = _files(store.raw_events)
    assert len(files) < before / 2 and {f.parent.parent.name for f in files} == {"writer=compacted"} and len({f.parts[-4] for f in files}) == 3
    stored = read_or_empty(spark, store.raw_events, EVENT)
    assert sorted(r.event.id for r in stored.collect()) == expected
    for path in files:
        sources = [(r.ip, r.ts) for r in spark.read.parquet(str(path)).select("source.ip", "ts").collect()]
        assert sources == sorted(sources)
    for wanted, found in ((F.col("event.id") == "3-30-odd", 1), (F.col("event.id") == "3-30-nowhere", 0), (F.col("source.ip") == "10.0.4.2", 8)):
        frame = read_or_empty(spark, store.raw_events, EVENT).where(wanted).select("event.id", "source.ip", "ts")
        assert len(frame.collect()) == found and _scanned(frame) < len(expected) / 2


@pytest.mark.parametrize("stop", ["write_batch", "delete_path"])
def test_a_compaction_that_stopped_halfway_loses_and_repeats_nothing(spark, tmp_path, monkeypatch, stop):
    path, schema = str(tmp_path / "letters"), DEAD_LETTER
    fields = "seen_at timestamp, tags array<string>, reason string, sensor_id string, raw string, event_date date"
    for n in range(3):  # equal letters are letters of their own
        write_batch(spark.createDataFrame([(at(1), ["t"], "r", "s", "same", at(d * 86_400).date()) for d in range(2)], fields), path, n, "north")
    real = getattr(table_store, stop)

    def failing(*values, **named):
        if stop == "write_batch":
            real(values[0].where("event_date = '2026-01-01'"), *values[1:], **named)  # one day of two gets through
            raise OSError("lost")
        real(*values, **named)
        if "batch_id=" in values[1]:
            raise OSError("lost")

    store = Store(str(tmp_path))
    monkeypatch.setattr(Store, "dead_letters", path)
    monkeypatch.setattr(table_store, stop, failing)
    with pytest.raises(OSError):
        compact_letters(spark, store, F.lit("2027-01-01").cast("date"))
    monkeypatch.setattr(table_store, stop, real)
    for _ in range(2):
        compact_letters(spark, store, F.lit("2027-01-01").cast("date"))
        rows = read_or_empty(spark, path, schema).groupBy("event_date").count().collect()
        assert sorted(r["count"] for r in rows) == [3, 3] and {f.parent.parent.name for f in _files(path)} == {"writer=compacted"}
    assert not (tmp_path / "letters" / "_compaction").exists()


def test_compacted_raw_events_are_not_processed_again(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    for n in range(2):
        write_batch(make_events(spark, [{"id": f"{n}{k}", "at": 10 * n + k} for k in range(3)]), store.raw_events, n, "north")
        process_stream(stream_raw_events(spark, store), store, str(tmp_path / "progress"), available_now=True).awaitTermination()
    compact_events(spark, store, F.lit("2027-01-01").cast("date"), store.raw_events)
    parts = len(_files(store.events))
    process_stream(stream_raw_events(spark, store), store, str(tmp_path / "progress"), available_now=True).awaitTermination()
    assert len(_files(store.events)) == parts and read_events(spark, store).count() == read_or_empty(spark, store.raw_events, EVENT).count() == 6


def test_settle_stream_reports_every_run_once_as_the_batch_form_does(spark, tmp_path):
    waits = {"a": [0.5, 2], "b": [], "c": [1, 3.5, 9, 20], "d": [2 * k for k in range(14)], "e": [-5, 24.5], "f": [26]}
    schema = "experiment_id string, end_time timestamp, ingested timestamp, seen_at timestamp"
    end = 100
    marks = [(name, at(end), None, at(end)) for name in waits] + [(name, at(end), at(end + w), at(end + w)) for name, ws in waits.items() for w in ws]
    marks.sort(key=lambda row: row[3])
    marks.append(("z", at(1000), None, at(1000)))  # moves the watermark past all timers
    for n in range(0, len(marks), 6):  # one file per micro-batch, in order of arrival
        spark.createDataFrame(marks[n:n + 6], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n:03d}"))
        os.utime(next((tmp_path / f"in{n:03d}").glob("part-*")), (1_000_000 + n, 1_000_000 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    running = settle_stream(stream, "1 second").writeStream.format("memory").queryName("settled").outputMode("append")
    running = running.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    running.awaitTermination()

    def walk(ws):
        last = None
        for w in sorted(max(w, 0) for w in ws if w <= 25):
            if last is not None and w - last > 3:
                break
            last = w
        return (True, last + 3.0) if last is not None and last + 3 <= 25 else (False, 25.0)

    rows = spark.table("settled").collect()
    assert sorted((r.experiment_id, r.telemetry_settled, r.settle_wait_seconds) for r in rows) == sorted((name, *walk(ws)) for name, ws in waits.items())
    assert running.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1


RUN = "experiment_id string, attacker_ip string, target_ip string, target_honeypots array<string>, start_time timestamp, end_time timestamp"


def test_runs_and_events_joined_as_streams_settle_as_in_the_batch_form(spark, tmp_path):
    source, target = "10.0.0.2", "192.168.50.10"
    runs = [
        ("quiet", source, target, None, at(0), at(60)), ("camera", source, target, ["camera"], at(0), at(60)), ("none", "10.0.0.9", target, [], at(0), at(60)),
        ("day", source, target, [], at(0), at(86_400)), ("open", source, target, [], at(0), None), ("nowhere", None, target, [], at(0), at(60)),
        ("backwards", source, target, [], at(60), at(0)),
    ]
    events = [
        {"id": f"{service}{n}", "at": n, "service": service, "seen": seen}
        for service, seen in (("camera", 62), ("cowrie", 64), ("cowrie", 70), ("camera", 61.5), ("cowrie", 66.9)) for n in (1, 30, 60)
    ] + [{"id": "alone", "at": 86_399, "seen": 86_424.9}, {"id": "inside", "at": 50, "seen": 51, "internal": True}]
    table, stored = make_events(spark, events), spark.createDataFrame(runs, RUN)
    for name, frame in (("runs", stored), ("events", table)):
        frame.write.parquet(str(tmp_path / name))

    def stream(name, schema):
        return spark.readStream.schema(schema).parquet(str(tmp_path / name))

    arrivals = run_arrivals(stream("runs", stored.schema), stream("events", table.schema), "2 days", "10 minutes")
    for _ in range(2):  # the second pass finds nothing new
        arrival_stream(arrivals, str(tmp_path / "arrivals"), str(tmp_path / "joined"), available_now=True).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "arrivals"))
    matched = match_events(stored, table, carry=["end_time"]).select("experiment_id", F.col("run_end_time").alias("end_time"), "ingested")
    columns = ["experiment_id", "end_time", "ingested"]
    assert sorted(found.select(columns).collect()) == sorted(edge_arrivals(matched).select(columns).collect()) and found.count() < matched.count()

    beat = spark.createDataFrame([(None, at(200_000), at(200_000))], "experiment_id string, end_time timestamp, ingested timestamp")
    beat.select("end_time").write.mode("append").parquet(str(tmp_path / "runs"))
    beat.selectExpr("*", "date('2026-01-03') event_date", "'beat' writer", "0L batch_id").write.mode("append").partitionBy("event_date", "writer", "batch_id").parquet(str(tmp_path / "arrivals"))
    reports = settle_stream(settle_marks(stream("arrivals", arrivals.schema), stream("runs", stored.schema), "1 minute"))
    for n in range(2):
        running = reports.writeStream.format("parquet").option("path", str(tmp_path / "settled")).option("checkpointLocation", str(tmp_path / "progress"))
        running = running.trigger(availableNow=True).start()
        running.awaitTermination()
    reported = sorted(tuple(row) for row in spark.read.schema(reports.schema).parquet(str(tmp_path / "settled")).collect())
    expected = settle_status(stored.where("end_time IS NOT NULL"), table).drop("matched_event_count")
    assert reported == sorted(tuple(row) for row in expected.collect()) and len(reported) == 6 and {row[1] for row in reported} == {True, False}


def test_a_short_run_is_held_in_few_copies_and_no_batch_without_rows_is_run(spark, tmp_path):
    runs = spark.createDataFrame([("short", "10.0.0.2", "192.168.50.10", [], at(60), at(120))], RUN)
    events = make_events(spark, [{"id": f"e{n}", "at": n, "seen": n + 1} for n in (61, 90, 119)])
    for name, frame in (("runs", runs), ("events", events)):
        frame.write.parquet(str(tmp_path / name))
    ended, seen = (spark.readStream.schema(frame.schema).parquet(str(tmp_path / name)) for name, frame in (("runs", runs), ("events", events)))
    running = arrival_stream(run_arrivals(ended, seen, "1 hour", "1 minute"), str(tmp_path / "arrivals"), str(tmp_path / "joined"), available_now=True)
    running.awaitTermination()
    batches = [progress for progress in running.recentProgress if progress["stateOperators"]]
    assert [progress["stateOperators"][0]["numRowsTotal"] for progress in batches] == [3 + 4]
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"
    assert sorted(r.ingested for r in spark.read.parquet(str(tmp_path / "arrivals")).collect()) == [at(62), at(120)]


def test_marks_out_of_order_settle_alike_and_leave_no_state(spark, tmp_path):
    waits = [9, 2, 0.5, 4.9, 20, -3, 7.5, 2.0]  # quiet from 9 on
    marks = [("a", at(100), at(100 + wait), at(100 + wait)) for wait in waits]
    marks += [("a", at(100), None, at(100)), ("a", at(100), at(140), at(140)), ("z", at(1000), None, at(1000))]
    marks += [("a", at(100), at(101), at(101)), ("y", at(2000), None, at(2000)), (None, at(3000), None, at(3000))]
    for n, mark in enumerate(marks):  # one mark per micro-batch
        spark.createDataFrame([mark], "experiment_id string, end_time timestamp, ingested timestamp, seen_at timestamp").coalesce(1).write.parquet(str(tmp_path / f"in{n:03d}"))
        os.utime(next((tmp_path / f"in{n:03d}").glob("part-*")), (1_000_000 + n, 1_000_000 + n))
    schema = "experiment_id string, end_time timestamp, ingested timestamp, seen_at timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    running = settle_stream(stream, "30 seconds").writeStream.format("memory").queryName("disordered").outputMode("append")
    running = running.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    running.awaitTermination()
    rows = sorted(tuple(row) for row in spark.table("disordered").collect())
    assert rows == [("a", True, 12.0), ("y", False, 25.0), ("z", False, 25.0)]
    assert running.lastProgress["stateOperators"][0]["customMetrics"].get("numRegisteredTimers", 0) <= 1


def _same_as_a_rebuild(spark, store, rows):
    expected = build_sessions(make_events(spark, rows))
    assert sorted(read_or_empty(spark, store.sessions, SESSION).collect()) == sorted(expected.collect())
    plain = lambda frame: sorted(tuple(r) for r in frame.drop("detected_at").collect())
    assert plain(read_or_empty(spark, store.detections, DETECTION)) == plain(detect(expected))


def test_an_open_session_is_merged_not_read_again(spark, tmp_path):
    store, rows = Store(str(tmp_path / "store")), []
    for n in range(3):  # one session that never closes, 40 events a batch, four slots each
        batch = [{"id": f"{n}-{k}", "at": 1200 * n + 30 * k, "url": f"/{k % 7}", "service": ("camera", "mqtt")[k % 2]} for k in range(40)]
        rows += batch
        counts = process_batch(spark, make_events(spark, batch), n, store)
        assert counts["sessions"] == 1 and counts["events_read"] <= 41
        assert counts["cells_read"] <= 2 * 4 * n  # service and slot
    late = {"id": "late", "at": 610, "url": "/new"}
    counts = process_batch(spark, make_events(spark, [late]), 3, store)
    assert counts["events_read"] == 11  # the ten of its slot and itself
    _same_as_a_rebuild(spark, store, [*rows, late])


def test_a_late_row_reads_its_own_session_only(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    day = 86_400
    rows = [{"id": f"{d}-{k}", "at": day * d + 100 * k, "ip": f"10.0.0.{k % 2}"} for d in range(30) for k in range(4)]
    process_batch(spark, make_events(spark, rows), 0, store)
    counts = process_batch(spark, make_events(spark, [late := {"id": "late", "at": day + 150, "ip": "10.0.0.0"}]), 1, store)
    assert counts["events_read"] == 3 and counts["cells_read"] <= 2 and counts["sessions"] == 1
    _same_as_a_rebuild(spark, store, [*rows, late])


def test_a_redelivery_that_moves_splits_its_session(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    rows = [{"id": name, "at": t, "url": f"/{name}", "seen": 5000} for name, t in (("a", 0), ("b", 290), ("c", 580))]
    process_batch(spark, make_events(spark, rows), 0, store)
    assert read_or_empty(spark, store.sessions, SESSION).count() == 1
    moved = {"id": "b", "at": 2000, "url": "/b2", "seen": 6000}
    process_batch(spark, make_events(spark, [moved]), 1, store)
    _same_as_a_rebuild(spark, store, [rows[0], rows[2], moved])


@pytest.mark.parametrize("survived", [2])
def test_a_batch_that_failed_while_it_was_applied_is_finished_by_its_replay(spark, tmp_path, monkeypatch, survived):
    store = Store(str(tmp_path / "store"))
    first = [{"id": "a", "at": 1000, "command": "id"}, {"id": "b", "at": 1700, "command": "ls"}]
    bridge = [{"id": "c", "at": 1350, "url": "/x"}, {"id": "d", "at": 800}]
    process_batch(spark, make_events(spark, first), 0, store)
    done, real = [], processor.upsert

    def failing(*args, **kwargs):
        if len(done) == survived:
            raise RuntimeError("lost")
        done.append(real(*args, **kwargs))

    monkeypatch.setattr(processor, "upsert", failing)
    with pytest.raises(RuntimeError, match="lost"):
        process_batch(spark, make_events(spark, bridge), 1, store)
    monkeypatch.setattr(processor, "upsert", real)
    process_batch(spark, make_events(spark, bridge), 1, store)
    _same_as_a_rebuild(spark, store, first + bridge)
    assert not (tmp_path / "store" / "redo" / "direct-1").exists()


def test_a_batch_of_internal_events_changes_nothing(spark, tmp_path):
    store = Store(str(tmp_path / "store"))
    counts = process_batch(spark, make_events(spark, [{"id": "a", "at": 0, "ip": "127.0.0.1"}]), 0, store)
    assert counts == {"sessions": 0, "detections": 0, "events_read": 0, "cells_read": 0}
