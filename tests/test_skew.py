from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import at
from pyspark.sql import functions as F

from decoyscope.plans.skew import (
    describe_values, exact_percentiles, interval_join, latest_per_key, repeated_lookup, running_counts, spread_lookup,
)
from decoyscope.settings import configure


def test_exact_percentiles_match_linear_interpolation_under_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.uniform(-5, 5), rng.lognormvariate(3, 4), 0.0, 7.25])) for _ in range(3000)]
    rows += [(f"k{i % 40}", rng.gauss(0, 1e6)) for i in range(300)] + [("one", 4.0), ("none", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.p5, r.p50, r.p95) for r in exact_percentiles(df, ["k"], "v", {"p5": 0.05, "p50": 0.5, "p95": 0.95}).collect()}
    groups = defaultdict(list)
    for key, value in rows:
        if value is not None and np.isfinite(value):
            groups[key].append(value)
    assert got.keys() == groups.keys()
    for key, numbers in groups.items():
        assert got[key] == pytest.approx(tuple(np.quantile(numbers, [0.05, 0.5, 0.95])), rel=1e-12, abs=1e-12)


def test_known_percentiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 1.0), ("b", 2.0), ("b", 100.0), ("b", None)], "k string, v double")
    rows = {r.k: r for r in describe_values(df, ["k"], "v").collect()}
    assert rows["a"].p95 == pytest.approx(3.85) and rows["a"].median == 2.5
    assert rows["b"].p95 == pytest.approx(90.2) and rows["b"].mean == pytest.approx(103 / 3)
    assert rows["b"]["count"] == 3 and rows["b"].missing_or_invalid_count == 1


def test_describe_keeps_keys_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, v double")
    rows = {r.k: r for r in describe_values(df, ["k"], "v").collect()}
    assert rows["a"]["count"] == 0 and rows["a"].p50 is None and rows["b"].standard_deviation is None


def test_spread_lookup_equals_join(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(500)], "k string, i int")
    right = spark.createDataFrame([("hot", "H")] + [(f"k{i}", str(i)) for i in range(5)], "k string, v string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, spread_lookup(left, right, ["k"], ["i"], 8, how).select("k", "i", "v").collect()), key=str)
        assert got == sorted(map(tuple, left.join(right, "k", how).select("k", "i", "v").collect()), key=str)


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(2)
    points = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", rng.randrange(0, 20_000), i) for i in range(400)]
    spans = []
    for i in range(60):
        start = rng.randrange(0, 20_000)
        spans.append((rng.choice(["hot", "k1", "k9"]), start, start + rng.choice([0, 5, 3600, 9000]), i))
    p = spark.createDataFrame([(k, at(t), i) for k, t, i in points], "k string, ts timestamp, i int")
    s = spark.createDataFrame([(k, at(a), at(b), j) for k, a, b, j in spans], "k string, a timestamp, b timestamp, j int")
    got = {(r.i, r.j) for r in interval_join(p, s, ["k"], "ts", "a", "b", 1800, 4, ["i"]).collect()}
    assert got == {(i, j) for k, t, i in points for key, a, b, j in spans if key == k and a <= t <= b}


def test_repeated_rows_are_never_broadcast(spark):
    """The size estimate of an exploded table leaves out the repeats: a broadcast of them took all of the driver's memory."""
    points = spark.createDataFrame([("a", at(i), i) for i in range(50)], "k string, ts timestamp, i int")
    spans = spark.createDataFrame([("a", at(0), at(7200), 1)], "k string, a timestamp, b timestamp, j int")
    looked = repeated_lookup(points, spans.select("k", "j"), ["k"], ["i"], 4)
    for df in (looked, *[interval_join(points, spans, ["k"], "ts", "a", "b", 1800, 4, ["i"], few) for few in (False, True)]):
        assert len(df.collect()) == 50
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("allowed", "kept"), [("10m", "1048576"), (None, "1048576"), ("256k", "256k"), ("-1", "-1")])
def test_joins_broadcast_a_megabyte_at_most(spark, allowed, kept):
    """Tables of several MB went through the driver, ten and more of them in a query on scored runs."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    try:
        spark.conf.unset(key) if allowed is None else spark.conf.set(key, allowed)
        configure(spark)
        assert spark.conf.get(key) == kept
        rows = spark.range(200_000).select("id", (F.col("id") + 1).alias("n"))
        joined = rows.join(rows.withColumnRenamed("n", "m"), "id")
        assert joined.agg(F.count("*")).first()[0] == 200_000
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(key)
        configure(spark)


def test_running_counts_equal_prefix_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "b"]), rng.randrange(0, 20_000), rng.randrange(3)) for _ in range(500)]
    df = spark.createDataFrame([(k, at(t), n) for k, t, n in rows], "k string, ts timestamp, n int")
    for row in running_counts(df, ["k"], "ts", ["n"], 600).collect():
        seconds = (row.ts - at(0)).total_seconds()
        assert row.n_to_date == sum(n for k, t, n in rows if k == row.k and t <= seconds)


def test_latest_per_key_keeps_one_whole_row(spark):
    df = spark.createDataFrame([("a", i % 5, f"v{i}") for i in range(50)] + [("b", 1, "x")], "k string, version int, v string")
    rows = {r.k: (r.version, r.v) for r in latest_per_key(df, ["k"], ["version"]).collect()}
    assert rows == {"a": (4, "v9"), "b": (1, "x")}
