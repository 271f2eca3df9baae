from __future__ import annotations

import json

from test_streaming import LINE

from decoyscope.operators.ingest import REASONS, dead_letter_counts
from decoyscope.schemas import DEAD_LETTER, EVENT
from decoyscope.sources.jsonl import stream_lines
from decoyscope.sources.store import read_or_empty
from decoyscope.streaming import ingest as N
from decoyscope.streaming.processor import Store


def _drain(spark, tmp_path, store, metrics, name, *lines):
    logs = tmp_path / "logs"
    logs.mkdir(exist_ok=True)
    (logs / f"{name}.jsonl").write_text("\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines))
    stream = stream_lines(spark, str(logs), "s-1", "192.168.50.10")
    N.ingest_stream(stream, store.raw_events, store.dead_letters, str(tmp_path / "progress"), available_now=True, metrics_path=metrics).awaitTermination()


def test_observed_counts_equal_the_tables(spark, tmp_path):
    store, path = Store(str(tmp_path / "store")), str(tmp_path / "metrics")
    assert N.read_metrics(spark, path).count() == 0
    _drain(spark, tmp_path, store, path, "a", LINE, LINE, {**LINE, "event_id": "e2"}, "not-json", "[1]", {**LINE, "source_ip": "x"})
    _drain(spark, tmp_path, store, path, "b", {**LINE, "event_id": "e3", "category": "odd"}, {**LINE, "event_id": ""})
    _drain(spark, tmp_path, store, path, "c", {**LINE, "event_id": "e4"})
    metrics = N.read_metrics(spark, path)
    rows = sorted((r.batch, r.lines, r.valid, r.rejected, r.stored, r.repeated) for r in metrics.collect())
    assert rows == [(0, 6, 3, 3, 2, 1), (1, 2, 0, 2, 0, 0), (2, 1, 1, 0, 1, 0)]
    total = N.metric_totals(metrics).first()
    assert (total.lines, total.batches) == (9, 3)
    assert total.stored == read_or_empty(spark, store.raw_events, EVENT).count()
    letters = read_or_empty(spark, store.dead_letters, DEAD_LETTER)
    assert total.rejected == letters.count()
    counted = {r.reason: r["count"] for r in dead_letter_counts(letters).collect()}
    assert {r.reason: r["count"] for r in N.reason_totals(metrics).collect()} == counted and counted.keys() <= set(REASONS)


def test_a_batch_that_failed_on_its_last_write_counts_once(spark, tmp_path, monkeypatch):
    store, path, real = Store(str(tmp_path / "store")), str(tmp_path / "metrics"), N.write_batch

    def failing(frame, where, *rest):
        real(frame, where, *rest)
        if where == path:
            raise OSError("lost")

    monkeypatch.setattr(N, "write_batch", failing)
    try:
        _drain(spark, tmp_path, store, path, "a", LINE, "not-json")
    except Exception as error:
        assert "lost" in str(error)
    else:
        raise AssertionError("the batch should have failed")
    monkeypatch.setattr(N, "write_batch", real)
    _drain(spark, tmp_path, store, path, "b", {**LINE, "event_id": "e2"})
    rows = sorted((r.batch, r.lines, r.stored, r.rejected) for r in N.read_metrics(spark, path).collect())
    assert rows == [(0, 2, 1, 1), (1, 1, 1, 0)]
    assert read_or_empty(spark, store.raw_events, EVENT).count() == 2
