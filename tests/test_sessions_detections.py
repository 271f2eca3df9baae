from __future__ import annotations

import hashlib
import random

import pytest
from conftest import T0, at, make_events
from pyspark.sql import functions as F

from decoyscope.operators.detections import detect, detection_evidence, keep_first_seen
from decoyscope.operators.sessions import build_sessions, label_events, session_window_rollup
from decoyscope.settings import Settings


def sessions_of(spark, rows, timeout=300):
    return build_sessions(make_events(spark, rows), Settings(session_timeout_seconds=timeout)).collect()


def test_one_source_over_two_services_is_one_session_in_any_order(spark):
    rows = [{"id": "b", "at": 60, "service": "router"}, {"id": "a", "at": 0}]
    first, second = sessions_of(spark, rows), sessions_of(spark, rows[::-1])
    assert first == second and first[0].event_count == 2
    assert first[0].honeypots_touched == ["camera-01", "router-01"]
    text = f"10.0.0.2|{T0:%Y-%m-%dT%H:%M:%S.%f}Z"
    assert first[0].session_id == "SES-" + hashlib.sha256(text.encode()).hexdigest()[:16]


def test_timeout_and_sources_split_but_an_equal_gap_stays(spark):
    rows = [{"id": "a", "at": 0}, {"id": "b", "at": 360}, {"id": "c", "at": 1, "ip": "10.0.0.3"}]
    assert len(sessions_of(spark, rows)) == 3
    assert len(sessions_of(spark, [{"id": "a", "at": 0}, {"id": "b", "at": 300}])) == 1
    assert len(sessions_of(spark, [{"id": "a", "at": 0}, {"id": "b", "at": 300.000001}])) == 2


def test_loopback_and_flagged_events_are_left_out(spark):
    rows = [{"id": "a", "at": 0, "ip": "127.0.0.2"}, {"id": "b", "at": 0, "ip": "::1"}, {"id": "c", "at": 0, "internal": True},
            {"id": "d", "at": 0}]
    assert [s.event_count for s in sessions_of(spark, rows)] == [1]


def test_sessions_match_brute_force_with_a_hot_source(spark):
    rng = random.Random(5)
    rows = [{"id": str(i), "at": rng.randrange(0, 90_000) + rng.random(), "ip": "10.0.0.9" if rng.random() < 0.4 else f"10.0.1.{rng.randrange(9)}",
             "url": f"/p{rng.randrange(6)}" if rng.random() < 0.5 else None} for i in range(600)]
    expected = []
    for ip in {r["ip"] for r in rows}:
        group = []
        for r in sorted((r for r in rows if r["ip"] == ip), key=lambda r: r["at"]):
            if group and r["at"] - group[-1]["at"] > 300:
                expected.append(group)
                group = []
            group.append(r)
        expected.append(group)
    events, settings = make_events(spark, rows), Settings(spread=4)
    got = {(s.source_ip, s.event_count, s.distinct_url_count, s.url_count) for s in build_sessions(events, settings).collect()}
    assert got == {(g[0]["ip"], len(g), len({r["url"] for r in g} - {None}), sum(r["url"] is not None for r in g)) for g in expected}
    members = {}
    for r in label_events(events, settings).collect():
        members.setdefault(r.session_id, set()).add(r.event_id)
    assert sorted(map(sorted, members.values())) == sorted(sorted(r["id"] for r in g) for g in expected)
    built_in = session_window_rollup(events, 300)
    assert {r.session_id for r in built_in.collect()} == set(members)


def auth(i, outcome="failure", user=None, password=None):
    return {"id": str(i), "at": i, "category": "authentication", "outcome": outcome, "service": "cowrie", "protocol": "ssh",
            "username": user, "password": password}


def mqtt(i, operation):
    return {"id": str(i), "at": i, "service": "mqtt", "protocol": "mqtt", "operation": operation}


def iot(i):
    return {"id": str(i), "at": i, "service": "iot-service", "protocol": "tcp"}


CASES = [
    ([auth(i) for i in range(5)], {"BRUTE_FORCE"}),
    ([auth(i) for i in range(4)], set()),
    ([auth(1, "success", "admin", "admin")], {"DEFAULT_CREDENTIALS"}),
    ([auth(1, "success", "admin", "other")], set()),
    ([{"id": str(i), "at": i, "url": f"/{i}"} for i in range(4)], {"WEB_ENUMERATION"}),
    ([{"id": str(i), "at": i, "url": f"/{i % 3}"} for i in range(9)], set()),
    ([{"id": "1", "at": 0, "command": "id"}], {"COMMAND_INTERACTION"}),
    ([mqtt(1, "connect")], set()),
    ([mqtt(1, "connect"), mqtt(2, "connect")], {"MQTT_PROBING"}),
    ([mqtt(1, "subscribe")], {"MQTT_PROBING"}),
    ([iot(1)], set()),
    ([iot(1), iot(2), iot(3)], {"RECONNAISSANCE"}),
    ([iot(1), iot(2), iot(3), mqtt(4, "connect"), mqtt(5, "subscribe")], {"RECONNAISSANCE", "MQTT_PROBING"}),
    ([{"id": s, "at": 0, "service": s} for s in ("camera", "router", "cowrie")], {"MULTI_SERVICE_ACTIVITY"}),
    ([auth(1), {"id": "2", "at": 2, "service": "router", "url": "/admin"}], {"MULTI_STAGE_ATTACK"}),
]


@pytest.fixture(scope="module")
def found(spark):
    """All cases at once: case n is source 10.1.0.n."""
    rows = [{**row, "ip": f"10.1.0.{n}", "id": f"{n}-{row['id']}"} for n, (events, _) in enumerate(CASES) for row in events]
    events = make_events(spark, rows)
    detections = detect(build_sessions(events), F.lit(at(500)))
    return detections, detection_evidence(label_events(events), detections)


def test_rules_fire_exactly_at_their_thresholds(found):
    kinds = {}
    for row in found[0].collect():
        kinds.setdefault(row.source_ip, set()).add(row.type)
        assert row.reason and row.rule_id and row.evidence_count > 0
    assert [kinds.get(f"10.1.0.{n}", set()) for n in range(len(CASES))] == [kind for _, kind in CASES]


def test_evidence_has_the_counted_events(found):
    detections, evidence = found
    counted = {r.detection_id: r.n for r in evidence.groupBy("detection_id").agg(F.count_distinct("event_id").alias("n")).collect()}
    assert counted == {r.detection_id: r.evidence_count for r in detections.collect()}


def test_reason_text_and_key(found):
    row = found[0].where("source_ip = '10.1.0.0'").first()
    assert row.reason == "5 authentication failures occurred in one session (threshold 5)."
    assert row.detection_id == "DET-" + hashlib.sha256(f"{row.session_id}:auth-failures-v1".encode()).hexdigest()[:16]


def test_first_detection_time_is_kept(found):
    detections = found[0]
    later = detections.withColumn("detected_at", F.lit(at(900)))
    stored = detections.where("type = 'BRUTE_FORCE'")
    times = {r.type: r.detected_at for r in keep_first_seen(later, stored).collect()}
    assert times["BRUTE_FORCE"] == at(500) and times["RECONNAISSANCE"] == at(900)
