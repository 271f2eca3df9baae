"""Table schemas and the controlled vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Vocabularies that decide validation and scoring results.
CATEGORIES = ("authentication", "network", "web", "process", "session")
EVENT_TYPES = ("connection", "start", "end", "info", "error")
OUTCOMES = ("success", "failure", "unknown")
SCHEMA_VERSION = "1"
RULESET_VERSION = "2"
DETECTION_TYPES = (
    "BRUTE_FORCE",
    "COMMAND_INTERACTION",
    "DEFAULT_CREDENTIALS",
    "MQTT_PROBING",
    "MULTI_SERVICE_ACTIVITY",
    "MULTI_STAGE_ATTACK",
    "RECONNAISSANCE",
    "WEB_ENUMERATION",
)
WEAK_CREDENTIALS = (("admin", "admin"), ("admin", "password"), ("root", "root"), ("admin", "1234"))
ACTIVE_MQTT_OPERATIONS = ("subscribe", "publish", "unsubscribe", "ping")
FLEET = ("cowrie", "camera", "iot-service", "mqtt", "router")
SERVICE_TO_HONEYPOT = {
    "ssh": "cowrie",
    "telnet": "cowrie",
    "camera": "camera",
    "http": "camera",
    "iot": "iot-service",
    "mqtt": "mqtt",
    "router": "router",
}
ALLOWED_MINUTES = (15, 60, 360, 1440, 10080, 43200, 525600)
STEP_STATUSES = ("completed", "rejected", "failed")
RUN_STATUSES = ("completed", "partial", "failed")
COWRIE_FAMILY = "ssh_telnet"
EXPORT_COLUMNS = (
    "experiment_id",
    "evaluation_batch_id",
    "replicate",
    "scenario_id",
    "trial_kind",
    "expected_detection",
    "result",
    "result_reason",
    "ground_truth_valid",
    "telemetry_settled",
    "software_revision",
    "detector_ruleset_version",
    "scenario_manifest_sha256",
    "evaluation_config_fingerprint",
    "unexpected_detection_types",
    "matched_event_count",
    "linked_session_count",
    "linked_detection_count",
    "evidence_latency_seconds",
    "detection_latency_seconds",
    "processing_latency_seconds",
    "ingestion_latency_count",
    "ingestion_latency_min_seconds",
    "ingestion_latency_mean_seconds",
    "ingestion_latency_p50_seconds",
    "ingestion_latency_p95_seconds",
    "ingestion_latency_max_seconds",
    "runner_duration_seconds",
    "experiment_duration_seconds",
    "observed_event_rate_eps",
    "telemetry_step_count",
    "telemetry_steps_covered",
    "telemetry_step_coverage",
    "start_time",
    "end_time",
)


_SIMPLE = {
    "text": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "flag": T.BooleanType(),
    "time": T.TimestampType(),
    "date": T.DateType(),
    "texts": T.ArrayType(T.StringType()),
}


def _fields(text: str, **nested: T.DataType) -> T.StructType:
    """'a:text b:int c' with `c` taken from `nested`, in the written order."""
    fields = []
    for item in text.split():
        name, _, kind = item.partition(":")
        fields.append(T.StructField(name, _SIMPLE[kind] if kind else nested[name]))
    return T.StructType(fields)


_AUTHENTICATION = _fields("username:text password:text")
_HTTP = _fields("request user_agent:text", request=_fields("method:text"))
_URL = _fields("path:text")
_IOT = _fields("operation:text")

# Raw sensor objects: every leaf is text, so a badly typed value never spoils its line.
RAW = _fields(
    "timestamp:text @timestamp:text "
    "eventid:text session:text src_ip:text src_port:text dst_port:text username:text password:text "
    "input:text message:text "
    "event_id:text category:text type:text action:text outcome:text source_ip:text source_port:text "
    "destination_ip:text destination_port:text protocol:text service:text honeypot_id:text "
    "honeypot_type:text summary:text url http authentication iot mqtt",
    url=_URL,
    http=_HTTP,
    authentication=_AUTHENTICATION,
    iot=_IOT,
    mqtt=_fields(
        "operation:text packet_type:text flags:text remaining_length:text client_id:text protocol_level:text "
        "connect_flags:text keep_alive:text username_present:text password_present:text packet_id:text "
        "topic:text qos:text requested_qos:text"
    ),
)

# Controlled namespaces: mqtt keeps these fourteen fields, never a password.
MQTT = _fields(
    "operation:text packet_type:int flags:int remaining_length:int client_id:text protocol_level:int "
    "connect_flags:int keep_alive:int username_present:flag password_present:flag packet_id:int "
    "topic:text qos:int requested_qos:int"
)

EVENT = _fields(
    "ts:time event source destination network service honeypot observer meta authentication url http mqtt iot "
    "process message:text event_date:date",
    event=_fields("id:text ingested:time category:text type:text action:text outcome:text"),
    source=_fields("ip:text port:int"),
    destination=_fields("ip:text port:int"),
    network=_fields("transport:text protocol:text"),
    service=_fields("name:text"),
    honeypot=_fields("id:text type:text"),
    observer=_fields("name:text type:text"),
    meta=_fields("sensor_id:text schema_version:text internal:flag internal_reason:text"),
    authentication=_AUTHENTICATION,
    url=_URL,
    http=_HTTP,
    mqtt=MQTT,
    iot=_IOT,
    process=_fields("command_line:text"),
)

DEAD_LETTER = _fields("seen_at:time tags:texts reason:text sensor_id:text raw:text event_date:date")

SESSION = _fields(
    "session_id:text source_ip:text start_time:time end_time:time duration:double honeypots_touched:texts "
    "services_touched:texts protocols:texts event_count:long authentication_attempts:long "
    "failed_authentication_attempts:long credential_count:long command_count:long url_count:long "
    "distinct_url_count:long weak_credential_count:long mqtt_event_count:long mqtt_active_count:long "
    "iot_probe_count:long schema_version:text"
)

SESSION_CELL = _fields(
    "source_ip:text slot:long honeypot:text service:text protocol:text first_ts:time last_ts:time "
    "event_count:long command_count:long url_count:long authentication_attempts:long "
    "failed_authentication_attempts:long credential_count:long weak_credential_count:long mqtt_event_count:long "
    "mqtt_active_count:long iot_probe_count:long session_start:time slot_time:time"
)
SESSION_PATH = _fields("source_ip:text slot:long url:text slot_time:time")

DETECTION = _fields(
    "detection_id:text session_id:text source_ip:text type:text severity:text timestamp:time "
    "evidence_end_time:time detected_at:time reason:text rule_id:text evidence_count:long "
    "session_start:time schema_version:text"
)

STEPS = T.ArrayType(_fields("step:int service:text started_at:time ended_at:time status:text"))
CONFIG = _fields(
    "session_timeout_seconds:int brute_force_threshold:int web_enumeration_threshold:int "
    "multi_service_threshold:int detector_ruleset_version:text schema_version:text"
)

GROUND_TRUTH = _fields(
    "run_id:text experiment_id:text scenario_id:text scenario_manifest_sha256:text target:text source:text "
    "expected_detection:text start_time:time end_time:time overall_status:text steps",
    steps=STEPS,
)

EXPERIMENT = _fields(
    "experiment_id:text name:text scenario_id:text trial_kind:text expected_detection:text status:text "
    "attacker_ip:text target_ip:text target_honeypots:texts created_at:time start_time:time end_time:time "
    "runner_start_time:time runner_end_time:time ground_truth_valid:flag telemetry_settled:flag "
    "settle_wait_seconds:double runner_status:text runner_steps config_snapshot detector_ruleset_version:text "
    "software_revision:text evaluation_batch_id:text replicate:int scenario_manifest_sha256:text "
    "scenario_step_services:texts scenario_step_allowed_statuses:texts "
    "evaluation_step_time_tolerance_seconds:double",
    runner_steps=STEPS,
    config_snapshot=CONFIG,
)

RESOURCE_FIELDS = (
    "timestamp",
    "host_label",
    "container_name",
    "cpu_percent",
    "memory_usage_bytes",
    "memory_limit_bytes",
    "memory_percent",
    "network_rx_bytes",
    "network_tx_bytes",
    "block_read_bytes",
    "block_write_bytes",
    "pids",
)
RESOURCE_CSV = _fields(" ".join(f"{name}:text" for name in RESOURCE_FIELDS))
CONTAINER_STATS = _fields(
    "Name:text Container:text CPUPerc:text MemUsage:text MemPerc:text NetIO:text BlockIO:text PIDs:text"
)
