from __future__ import annotations

import random

import pytest
from conftest import at, make_events
from pyspark.sql import functions as F

from decoyscope.operators.analytics import time_histogram
from decoyscope.operators.ingest import dedupe_events
from decoyscope.operators.sessions import external_events
from decoyscope.streaming import rollups as R

WIDTHS = ("1 minute", "10 minutes", "1 hour", "12 hours", "1 day", "7 days")


def _histograms_agree(spark, rollups, rows):
    events = external_events(dedupe_events(make_events(spark, rows)))
    minutes = R.minute_counts(spark, rollups)
    assert minutes.inputFiles() and all("/minutes/" in name for name in minutes.inputFiles())
    for width in WIDTHS:
        assert sorted(R.rolled_histogram(minutes, width).collect()) == sorted(time_histogram(events, width).collect()), width


def test_late_rows_redeliveries_and_replays_correct_the_minutes(spark, tmp_path):
    rollups = R.Rollups(str(tmp_path))
    first = [{"id": f"e{n}", "at": 40 * n, "seen": 9000} for n in range(30)] + [{"id": "far", "at": 700_000, "seen": 9000}]
    second = [
        {"id": "late", "at": 3, "seen": 9100}, {"id": "e1", "at": 1000, "seen": 9100},  # one moves,
        {"id": "e2", "at": 80, "seen": 9100, "internal": True}, {"id": "e3", "at": 5000, "seen": 8000},  # one is withdrawn, one is outdated,
        {"id": "e4", "at": 160, "seen": 9000}, {"id": "far", "at": 5, "seen": 9100},  # one is a copy, one has another day
        {"id": "twice", "at": 10, "seen": 9100}, {"id": "twice", "at": 70, "seen": 9101},
    ]
    R.roll_up_batch(make_events(spark, first), 0, rollups)
    for _ in range(2):  # the second time is a replay
        R.roll_up_batch(make_events(spark, second), 1, rollups)
        _histograms_agree(spark, rollups, first + second)
    R.compact_rollups(spark, rollups, F.lit("2027-01-01").cast("date"))
    _histograms_agree(spark, rollups, first + second)
    third = [{"id": "e2", "at": 80, "seen": 9200}, {"id": "twice", "at": 10, "seen": 9102}]  # after compaction, an id comes back
    R.roll_up_batch(make_events(spark, third), 2, rollups)
    _histograms_agree(spark, rollups, first + second + third)


def test_a_batch_that_lost_its_last_write_is_finished_by_its_replay(spark, tmp_path, monkeypatch):
    rollups, rows = R.Rollups(str(tmp_path)), [{"id": f"e{n}", "at": n} for n in range(5)]
    real = R.write_batch

    def failing(frame, path, *rest):
        if path == rollups.deliveries:
            raise OSError("lost")
        real(frame, path, *rest)

    monkeypatch.setattr(R, "write_batch", failing)
    with pytest.raises(OSError):
        R.roll_up_batch(make_events(spark, rows), 0, rollups)
    monkeypatch.setattr(R, "write_batch", real)
    R.roll_up_batch(make_events(spark, rows), 0, rollups)
    _histograms_agree(spark, rollups, rows)


def test_merged_sketches_stay_within_their_error(spark, tmp_path):
    rollups, chance = R.Rollups(str(tmp_path)), random.Random(5)
    days = [{chance.randrange(9000) for _ in range(4000)} for _ in range(3)]
    for n, sources in enumerate(days):
        rows = spark.createDataFrame([(n, s) for s in sources], "day int, s int")
        events = make_events(spark, [{"id": "x", "at": 86_400 * n}]).drop("source").crossJoin(rows).select(
            "*", F.struct(F.concat_ws(".", F.lit("10.1"), (F.col("s") / 250).cast("int"), F.col("s") % 250).alias("ip"), F.lit(1).alias("port")).alias("source")
        ).withColumn("event", F.col("event").withField("id", F.col("s").cast("string"))).drop("day", "s")
        R.roll_up_batch(events, n, rollups)
    estimates = {row.last_day: row.unique_sources for row in R.source_windows(spark, rollups, 2).collect()}
    exact = {at(86_400 * n).date(): len(set().union(*days[max(n - 1, 0):n + 1])) for n in range(4)}
    assert estimates.keys() == exact.keys() and all(abs(estimates[day] - exact[day]) <= 0.03 * exact[day] for day in exact)


def test_absent_tables_are_empty(spark, tmp_path):
    rollups = R.Rollups(str(tmp_path))
    assert R.minute_counts(spark, rollups).count() == 0 and R.source_windows(spark, rollups, 7).count() == 0
    R.roll_up_batch(make_events(spark, [{"id": "a", "at": 0}]).limit(0), 0, rollups)
    assert R.minute_counts(spark, rollups).count() == 0
