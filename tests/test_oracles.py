"""A cross-section of the registered queries against their SQL; check_oracles.py runs all of them."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_oracles import connect, difference
from decoyscope.catalog.oracles import ORACLES
from decoyscope.catalog.queries import QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "session_rollup", "detections_by_type", "source_honeypot_matrix", "valid_events", "dead_letters", "score_experiments",
    "per_scenario", "resource_summary", "completeness", "stream_sessions",
)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    assert difference(queries()[name](spark, SF), duck, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", ("match_events", "link_sessions", "detection_evidence", "settle_status", "ingestion_stats_by_scenario", "ground_truth_checks"))
def test_shuffled_joins_give_the_same(spark, duck, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert difference(queries()[name](spark, SF), duck, oracle_sql()[name]) is None
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_query_has_sql_and_the_entry_runs(spark):
    assert QUERIES.keys() == ORACLES.keys() and QUERIES.keys() <= queries().keys()
    assert entry(spark).count() > 0
