from __future__ import annotations

import random

import pytest
from conftest import at, make_events
from pyspark.sql import functions as F

from decoyscope.operators.analytics import top_terms
from decoyscope.operators.ingest import dedupe_events
from decoyscope.operators.sessions import external_events
from decoyscope.streaming import toplists as L

DAY = 86_400


def _expected(spark, rows, size):
    return [tuple(row) for row in top_terms(external_events(dedupe_events(make_events(spark, rows))), "source.ip", size).collect()]


def _agree(spark, lists, rows, sizes=(3, 50)):
    for size in sizes:
        assert [tuple(row) for row in L.top_names(spark, lists, size).collect()] == _expected(spark, rows, size), size
    counts = dict(_expected(spark, rows, 10_000))
    for row in L.name_limits(spark, lists).collect():
        assert row.least <= counts.get(row.name, 0) <= row.most


@pytest.mark.parametrize("tracked", [4, 1024])
def test_lists_are_exact_after_every_batch(spark, tmp_path, tracked):
    lists, chance, rows = L.TopLists(str(tmp_path), tracked=tracked), random.Random(tracked), []
    for n in range(3):
        batch = [{
            "id": f"{n}-{k}", "at": DAY * chance.randrange(3) + k, "seen": 9 * DAY + n,
            "ip": f"10.0.0.{int(chance.paretovariate(0.6)) % 60 + 1}" if k % 5 else "127.0.0.1",
        } for k in range(150)]
        # Some ids come again, with another source, an internal one or as an older copy.
        again = chance.sample(rows, 30) if rows else []
        batch += [{**row, "ip": chance.choice(["10.0.0.99", row["ip"], "127.0.0.1"]), "seen": row["seen"] + chance.choice([-1, 1, 5])} for row in again]
        rows += batch
        for _ in range(1 + (n == 1)):  # one batch is replayed
            L.count_batch(make_events(spark, batch), n, lists)
        _agree(spark, lists, rows)
    L.compact_top_lists(spark, lists, F.lit("2027-01-01").cast("date"))
    _agree(spark, lists, rows)
    late = [{"id": "0-1", "at": rows[1]["at"], "seen": 10 * DAY, "ip": "10.0.0.98"}]
    L.count_batch(make_events(spark, late), 3, lists)
    _agree(spark, lists, rows + late)


def test_a_name_that_is_never_frequent_but_adds_up_is_found(spark, tmp_path):
    lists, rows = L.TopLists(str(tmp_path), tracked=3), []
    for n in range(4):  # in each batch another source leads, "steady" is second every time
        batch = [{"id": f"{n}-l{k}", "at": k, "ip": f"10.0.1.{n}"} for k in range(10)]
        batch += [{"id": f"{n}-s{k}", "at": k, "ip": "10.0.2.1"} for k in range(4)]
        batch += [{"id": f"{n}-o{k}", "at": k, "ip": f"10.0.3.{10 * n + k}"} for k in range(4)]
        L.count_batch(make_events(spark, batch), n, lists)
        rows += batch
    assert "10.0.2.1" not in [row.name for row in L.name_limits(spark, lists).collect()]
    assert [tuple(row) for row in L.top_names(spark, lists, 1).collect()] == [("10.0.2.1", 16)]
    _agree(spark, lists, rows)


def test_days_prune_and_candidates_are_few(spark, tmp_path):
    lists = L.TopLists(str(tmp_path), tracked=4)
    rows = [{"id": f"h{k}", "at": DAY * (k % 2), "ip": f"10.0.0.{1 + k % 2}"} for k in range(60)]
    rows += [{"id": f"r{k}", "at": DAY * (k % 2), "ip": f"10.0.{1 + k // 200}.{k % 200}"} for k in range(40)]
    L.count_batch(make_events(spark, rows), 0, lists)
    assert sorted(row.name for row in L.name_limits(spark, lists).collect()) == ["10.0.0.1", "10.0.0.2"]
    first = F.lit(at(DAY).date())
    assert [tuple(row) for row in L.top_names(spark, lists, 1, first=first).collect()] == [("10.0.0.2", 30)]
    files = L.top_names(spark, lists, 1, first=first)
    plan = files._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "LeftSemi" in plan  # counted for candidates only
    assert L.top_names(spark, lists, 5).count() == 5  # unfrequent names are in a longer list: all are counted
    _agree(spark, lists, rows)


def test_absent_and_empty_tables(spark, tmp_path):
    lists = L.TopLists(str(tmp_path))
    assert L.top_names(spark, lists, 3).collect() == []
    L.count_batch(make_events(spark, [{"id": "a", "at": 0}]).limit(0), 0, lists)
    L.count_batch(make_events(spark, [{"id": "a", "at": 0, "ip": None}]), 1, lists)
    assert L.top_names(spark, lists, 3).collect() == []
