from __future__ import annotations

import json

import pytest
from conftest import at, make_events
from pyspark.sql import functions as F

from decoyscope.sources.jsonl import read_sensor_lines, stream_sensor_lines
from decoyscope.operators.ingest import (
    classify_interactions, dead_letters, dedupe_events, normalize, normalize_lenient, valid_events,
)

CUSTOM = {
    "timestamp": "2025-07-14T23:59:58.25+02:00", "event_id": "rt-7", "category": "web", "type": "info", "action": "request",
    "outcome": "success", "source_ip": "198.51.100.77", "source_port": "51515", "destination_ip": "203.0.113.5",
    "destination_port": 8443, "protocol": "http", "service": "router", "honeypot_id": "router-03", "honeypot_type": "router",
    "summary": "status page",
}
NATIVE = {
    "timestamp": "2025-03-09T08:07:06Z", "eventid": "cowrie.login.failed", "session": "77ab", "src_ip": "198.51.100.8", "src_port": 60022,
    "destination_ip": "203.0.113.9", "dst_port": 2223, "username": "pi", "password": "raspberry", "message": "try",
}


def lines(spark, *rows):
    data = [(r if isinstance(r, str) else json.dumps(r), "pole-4", "203.0.113.9", None, None) for r in rows]
    return spark.createDataFrame(data, "value string, sensor_id string, sensor_ip string, honeypot_id string, honeypot_type string")


def native_lines(spark, *rows):
    return lines(spark, *rows).withColumn("honeypot_id", F.lit("cowrie-01")).withColumn("honeypot_type", F.lit("ssh_telnet"))


def test_custom_line_maps_to_the_canonical_event(spark):
    row = valid_events(normalize(lines(spark, {**CUSTOM, "mqtt": {"operation": "connect", "packet_type": 1, "password": "x"},
                                               "authentication": {"username": "u", "password": "p"}}), F.lit(at(9)))).first()
    assert (row.event.id, row.event.ingested, row.source.port, row.destination.port) == ("rt-7", at(9), 51515, 8443)
    assert row.mqtt.packet_type == 1 and "password" not in row.mqtt.asDict()
    assert row.authentication.username == "u" and row.meta.internal is False and row.message == "status page"


def test_cowrie_line_maps_login_and_protocol(spark):
    row = valid_events(normalize(native_lines(spark, NATIVE))).first()
    assert row.event.id == "cowrie.login.failed-77ab-2025-03-09T08:07:06Z"
    assert (row.event.category, row.event.action, row.event.outcome) == ("authentication", "login_attempt", "failure")
    assert (row.network.protocol, row.service.name, row.authentication.password) == ("telnet", "cowrie", "raspberry")
    command = {**NATIVE, "eventid": "cowrie.command.input", "input": "id", "dst_port": 2222}
    other = {**NATIVE, "eventid": "cowrie.session.connect", "protocol": "ssh"}
    rows = valid_events(normalize(native_lines(spark, command, other))).collect()
    assert (rows[0].event.action, rows[0].process.command_line, rows[0].network.protocol) == ("command", "id", "ssh")
    assert (rows[1].event.category, rows[1].event.action) == ("session", "cowrie.session.connect")


FAULTS = [
    ("not-json", "json_parse_failure"),
    ({k: v for k, v in CUSTOM.items() if k != "timestamp"}, "json_parse_failure"),
    ({**CUSTOM, "timestamp": "soon"}, "invalid_timestamp"),
    ({k: v for k, v in CUSTOM.items() if k != "protocol"}, "unresolved_interpolation"),
    ({**CUSTOM, "action": ""}, "missing_event_action"),
    ({**CUSTOM, "source_ip": "203.0.113.256"}, "invalid_source_ip"),
    ({**CUSTOM, "source_ip": "2001:db8:::7"}, "invalid_source_ip"),
    ({**CUSTOM, "category": "bogus"}, "invalid_event_category_"),
    ({**CUSTOM, "type": "bogus"}, "invalid_event_type_"),
    ({**CUSTOM, "outcome": "bogus"}, "invalid_event_outcome_"),
    ({**CUSTOM, "source_port": 70000}, "invalid_port"),
    ({**CUSTOM, "source_port": "x"}, "invalid_port"),
    ({**CUSTOM, "mqtt": {"packet_type": -1}}, "invalid_mqtt_packet_type"),
    ({**CUSTOM, "category": "bogus", "source_ip": "x"}, "invalid_source_ip"),
    ({**CUSTOM, "source_ip": "2001:db8:5::a1"}, None),
    ({k: v for k, v in CUSTOM.items() if k != "source_port"}, None),
]


def test_first_failed_rule_is_the_reason_and_the_line_is_kept(spark):
    normalized = normalize(lines(spark, *[line for line, _ in FAULTS]))
    assert [r.reason for r in normalized.select("reason").collect()] == [reason for _, reason in FAULTS]
    letters = dead_letters(normalized).collect()
    assert [r.raw for r in letters] == [line if isinstance(line, str) else json.dumps(line) for line, reason in FAULTS if reason]
    assert letters[0].tags == ["parse_failure"] and letters[-1].tags == ["validation_failure"]


def test_lines_of_many_inputs_get_the_columns_of_their_folder(spark, tmp_path):
    inputs = tmp_path / "inputs"
    for name in ("north", "south"):
        (inputs / name).mkdir(parents=True)
        (inputs / name / "today.jsonl").write_text("\n".join(json.dumps({**CUSTOM, "event_id": f"{name}-{k}"}) for k in range(2)) + "\n \t\n")
    (inputs / "stray").mkdir()
    (inputs / "stray" / "x.jsonl").write_text(json.dumps(CUSTOM))
    sensors = spark.createDataFrame(
        [(str(inputs / name), f"pole-{name}", "203.0.113.1", None, None) for name in ("north", "south")],
        "directory string, sensor_id string, sensor_ip string, honeypot_id string, honeypot_type string",
    )
    found = read_sensor_lines(spark, str(inputs / "*"), sensors)
    rows = valid_events(normalize(found)).select("event.id", "meta.sensor_id").collect()
    assert sorted((r.id, r.sensor_id) for r in rows) == [("north-0", "pole-north"), ("north-1", "pole-north"), ("south-0", "pole-south"), ("south-1", "pole-south")]
    assert found.where("sensor_id IS NULL").count() == 1  # no sensor is known for that folder, so its line is no event
    stream = stream_sensor_lines(spark, str(inputs / "*"), sensors)
    running = stream.writeStream.format("memory").queryName("sensor_lines").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "progress")).start()
    running.awaitTermination()
    streamed, read = (sorted((r.value, r.sensor_id or "") for r in rows.select("value", "sensor_id").collect()) for rows in (spark.table("sensor_lines"), found))
    assert streamed == read


@pytest.mark.parametrize("address,internal", [("127.255.0.3", True), ("::1", True), ("128.0.0.1", False), ("2001:db8::1", False)])
def test_loopback_is_flagged(spark, address, internal):
    row = valid_events(normalize(lines(spark, {**CUSTOM, "source_ip": address}))).first()
    assert row.meta.internal is internal and row.meta.internal_reason == ("loopback_source" if internal else None)


def test_lenient_defaults(spark):
    bare = {"timestamp": "2026-04-09T21:30:15Z", "source_ip": "198.51.100.23", "destination_ip": "203.0.113.200", "service": "router", "protocol": "tcp"}
    rows = normalize_lenient(lines(spark, bare, {})).collect()
    assert (rows[0].event.category, rows[0].event.type, rows[0].event.action, rows[0].event.outcome) == ("network", "info", "observe", "unknown")
    assert rows[0].reason is None and len(rows[0].event.id) == 64 and rows[1].reason == "missing_time_or_address"


def test_redelivered_ids_collapse_per_day_to_the_last(spark):
    rows = [{"id": "a", "at": 0, "seen": 10, "outcome": "old"}, {"id": "a", "at": 0, "seen": 20, "outcome": "new"}, {"id": "a", "at": 90_000}]
    kept = dedupe_events(make_events(spark, rows)).orderBy("ts").collect()
    assert [(r.event_date.day, r.event.outcome) for r in kept] == [(1, "new"), (2, "unknown")]


def test_interaction_classification(spark):
    schema = "service string, protocol string, username string, password string, operation string, method string, data_received boolean, malformed boolean"
    data = [("camera", "http", "admin", "admin", None, "POST", True, None), ("camera", "http", None, None, None, "GET", True, None),
            ("mqtt", "mqtt", None, None, "ping", None, True, None), ("iot-service", "tcp", "admin", "admin", "auth", None, True, True),
            ("router", "http", "admin", "x", None, None, True, None), ("mqtt", "mqtt", None, None, None, None, False, None)]
    rows = classify_interactions(spark.createDataFrame(data, schema)).collect()
    assert [(r.category, r.action, r.outcome) for r in rows] == [
        ("authentication", "login_attempt", "success"), ("web", "request", "unknown"), ("network", "ping", "unknown"),
        ("authentication", "login_attempt", "failure"), ("authentication", "login_attempt", "failure"), ("network", "connect", "unknown")]
    assert rows[0].summary == "camera POST" and rows[3].honeypot_type == "iot_service"
