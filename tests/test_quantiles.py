from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from decoyscope.plans.skew import exact_percentiles
from decoyscope.streaming import quantiles as K

SCHEMA = "experiment_id string, event_date date, evaluation_config_fingerprint string, scenario_id string, measurement string, sample double"


def _day(n):
    return date(2026, 1, 1) + timedelta(days=n)


def _samples(spark, rows):
    """Rows of (run, day, scenario, sample)."""
    return spark.createDataFrame([(run, None if day is None else _day(day), "f", scenario, "delay", sample) for run, day, scenario, sample in rows], SCHEMA)


def _windows(spark, store, days=3, **options):
    return sorted(tuple(row) for row in K.window_quantiles(spark, store, days, **options).collect())


def test_windows_are_merged_from_days_and_small_ones_are_exact(spark, tmp_path):
    store = K.QuantileStore(str(tmp_path))
    K.sketch_batch(_samples(spark, [(f"a{n}", 0, "s", float(n)) for n in range(1, 11)]), 0, store)
    K.sketch_batch(_samples(spark, [("b", 2, "s", 100.0), ("c", 2, "t", 7.0)]), 1, store)
    assert _windows(spark, store) == [
        (_day(0), "f", "s", "delay", 10, 5.0, 10.0), (_day(1), "f", "s", "delay", 10, 5.0, 10.0), (_day(2), "f", "s", "delay", 11, 6.0, 100.0),
        (_day(2), "f", "t", "delay", 1, 7.0, 7.0), (_day(3), "f", "s", "delay", 1, 100.0, 100.0), (_day(3), "f", "t", "delay", 1, 7.0, 7.0),
        (_day(4), "f", "s", "delay", 1, 100.0, 100.0), (_day(4), "f", "t", "delay", 1, 7.0, 7.0),
    ]
    merged = _windows(spark, store, days=1, keys=("measurement",), percents={"top": 1.0})
    assert merged == [(_day(0), "delay", 10, 10.0), (_day(2), "delay", 2, 100.0)]


def test_a_run_counts_once_and_replays_and_compaction_change_nothing(spark, tmp_path):
    store = K.QuantileStore(str(tmp_path))
    first = [("a", 0, "s", 1.0), ("a", 0, "s", 3.0), ("b", 0, "s", 5.0), ("none", 0, "s", None), ("odd", 0, "s", float("nan")), ("far", 0, "s", float("inf")), ("lost", None, "s", 9.0)]
    second = [("a", 0, "s", 50.0), ("c", 0, "s", 2.0), ("a", 1, "s", 4.0)]  # a run of that id on another day is another run
    K.sketch_batch(_samples(spark, first), 0, store)
    for _ in range(2):  # the second time is a replay
        K.sketch_batch(_samples(spark, second), 1, store)
        found = _windows(spark, store, 1, percents={"least": 0.0, "p50": 0.5, "top": 1.0})
        assert found == [(_day(0), "f", "s", "delay", 4, 1.0, 2.0, 5.0), (_day(1), "f", "s", "delay", 1, 4.0, 4.0, 4.0)]
    for _ in range(2):
        K.compact_quantiles(spark, store, F.lit("2027-01-01").cast("date"))
        assert _windows(spark, store, 1, percents={"least": 0.0, "p50": 0.5, "top": 1.0}) == found
    K.sketch_batch(_samples(spark, second), 2, store)  # known runs are found after compaction as well
    assert _windows(spark, store, 1, percents={"least": 0.0, "p50": 0.5, "top": 1.0}) == found


@pytest.mark.parametrize("shape", ["spread", "ties"])
def test_rank_error_of_large_windows_stays_within_the_bound(spark, tmp_path, shape):
    store, chance = K.QuantileStore(str(tmp_path)), random.Random(11)
    draw = (lambda: chance.lognormvariate(0, 2)) if shape == "spread" else (lambda: float(chance.randrange(5)))
    rows = [(f"r{n}", n % 3, "s", draw()) for n in range(12_000)]
    for n in range(4):
        K.sketch_batch(_samples(spark, rows[n::4]), n, store)
    keys = ["last_day", *K.KEYS]
    merged = K.window_quantiles(spark, store, 3).where(F.col("last_day") == _day(2))
    weekly = _samples(spark, rows).withColumn("last_day", F.lit(_day(2)))
    (error,) = K.rank_errors(weekly, merged, keys).collect()
    assert error.samples == 12_000 and error.rank_error <= 0.01
    exact, (estimate,) = exact_percentiles(weekly, keys, "sample", K.PERCENTS).first(), merged.collect()
    assert estimate["count"] == 12_000
    if shape == "ties":
        assert (estimate.p50, estimate.p95) == (exact.p50, exact.p95)


def test_no_samples_no_windows(spark, tmp_path):
    store = K.QuantileStore(str(tmp_path))
    assert _windows(spark, store) == []
    K.sketch_batch(_samples(spark, [("a", 0, "s", 1.0)]).limit(0), 0, store)
    K.sketch_batch(_samples(spark, [("a", 0, "s", None)]), 1, store)
    assert _windows(spark, store) == []
