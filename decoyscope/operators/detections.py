"""Eight explainable detection rules over session rows, with long-form evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoyscope.functions.values import detection_key
from decoyscope.plans.skew import repeated_lookup
from decoyscope.schemas import SCHEMA_VERSION
from decoyscope.settings import DEFAULTS, Settings

# Rule ids enter the detection ids.
AUTH_FAILURES = "auth-failures-v1"
DEFAULT_CREDENTIALS = "default-credentials-v1"
WEB_PATHS = "web-paths-v1"
COMMANDS = "command-v1"
MQTT = "mqtt-v2"
MULTI_SERVICE = "multi-service-v1"
MULTI_STAGE = "multi-stage-v1"
RECON = "recon-v2"

# Rules whose evidence is every event of the session; the others name a flag of the event.
WHOLE_SESSION_RULES = (WEB_PATHS, COMMANDS, MULTI_SERVICE, MULTI_STAGE)
FLAGGED_RULES = {
    AUTH_FAILURES: "is_auth_failure",
    DEFAULT_CREDENTIALS: "is_weak",
    MQTT: "is_mqtt",
    RECON: "is_iot_probe",
}


def _finding(fires: Column, kind: str, severity: str, rule: str, evidence: str, reason: Column) -> Column:
    return F.when(
        fires,
        F.struct(
            F.lit(kind).alias("type"),
            F.lit(severity).alias("severity"),
            F.lit(rule).alias("rule_id"),
            F.col(evidence).cast("bigint").alias("evidence_count"),
            reason.alias("reason"),
        ),
    )


def _findings(settings: Settings) -> list[Column]:
    failed, weak = F.col("failed_authentication_attempts"), F.col("weak_credential_count")
    paths, commands = F.col("distinct_url_count"), F.col("command_count")
    mqtt, iot = F.col("mqtt_event_count"), F.col("iot_probe_count")
    services = F.size("services_touched")
    brute, web, multi = (
        settings.brute_force_threshold,
        settings.web_enumeration_threshold,
        settings.multi_service_threshold,
    )
    # Types, severities and reason texts.
    return [
        _finding(failed >= brute, "BRUTE_FORCE", "high", AUTH_FAILURES, "failed_authentication_attempts",
                 F.format_string(f"%d authentication failures occurred in one session (threshold {brute}).", failed)),
        _finding(weak >= 1, "DEFAULT_CREDENTIALS", "high", DEFAULT_CREDENTIALS, "weak_credential_count",
                 F.format_string("%d known default credential pair(s) attempted.", weak)),
        _finding(paths >= web, "WEB_ENUMERATION", "medium", WEB_PATHS, "event_count",
                 F.format_string(f"%d distinct web paths requested (threshold {web}).", paths)),
        _finding(commands >= 1, "COMMAND_INTERACTION", "high", COMMANDS, "event_count",
                 F.format_string("%d command interaction(s) recorded.", commands)),
        _finding((mqtt >= 2) | (F.col("mqtt_active_count") >= 1), "MQTT_PROBING", "medium", MQTT, "mqtt_event_count",
                 F.format_string("%d MQTT operation(s) observed.", mqtt)),
        _finding(services >= multi, "MULTI_SERVICE_ACTIVITY", "high", MULTI_SERVICE, "event_count",
                 F.format_string("Source touched %d services: %s.", services, F.array_join("services_touched", ", "))),
        _finding((failed >= 1) & ((paths >= 1) | (commands >= 1)) & (services >= 2),
                 "MULTI_STAGE_ATTACK", "critical", MULTI_STAGE, "event_count",
                 F.lit("Authentication activity was followed by interaction across multiple services.")),
        _finding(iot >= 3, "RECONNAISSANCE", "low", RECON, "iot_probe_count",
                 F.format_string("%d IoT probe interactions occurred.", iot)),
    ]


def detect(sessions: DataFrame, detected_at: Column | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """All findings of all sessions, one row each: a map-side expansion without a shuffle."""
    stamp = F.current_timestamp() if detected_at is None else detected_at
    fired = F.filter(F.array(*_findings(settings)), lambda finding: finding.isNotNull())
    return (
        sessions.withColumn("_finding", F.explode(fired))
        .select(
            detection_key(F.col("session_id"), F.col("_finding.rule_id")).alias("detection_id"),
            "session_id",
            "source_ip",
            F.col("_finding.type").alias("type"),
            F.col("_finding.severity").alias("severity"),
            F.col("end_time").alias("timestamp"),
            F.col("end_time").alias("evidence_end_time"),
            stamp.cast("timestamp").alias("detected_at"),
            F.col("_finding.reason").alias("reason"),
            F.col("_finding.rule_id").alias("rule_id"),
            F.col("_finding.evidence_count").alias("evidence_count"),
            F.col("start_time").alias("session_start"),
            F.lit(SCHEMA_VERSION).alias("schema_version"),
        )
    )


def detection_evidence(labelled: DataFrame, detections: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(detection_id, event_id) for every event that supports a finding, in long form."""
    fired = detections.groupBy("session_id").agg(F.collect_set("rule_id").alias("_fired"))  # at most eight
    flagged = [F.when(F.col(flag), F.lit(rule)) for rule, flag in FLAGGED_RULES.items()]
    candidates = F.array_compact(F.array(*[F.lit(rule) for rule in WHOLE_SESSION_RULES], *flagged))
    events = labelled.select("session_id", "ts", "event_id", candidates.alias("_rules"))
    joined = repeated_lookup(events, fired, ["session_id"], ["event_id"], settings.spread)
    return (
        joined.withColumn("rule_id", F.explode(F.array_intersect("_rules", "_fired")))
        .select(
            detection_key(F.col("session_id"), F.col("rule_id")).alias("detection_id"),
            "session_id", "rule_id", "event_id", "ts",
        )
    )


def keep_first_seen(detections: DataFrame, stored: DataFrame) -> DataFrame:
    """Keep the `detected_at` of detections that are already stored."""
    seen = stored.groupBy("detection_id").agg(F.min("detected_at").alias("_first"))
    return (
        detections.join(seen, "detection_id", "left")
        .withColumn("detected_at", F.coalesce("_first", "detected_at"))
        .select(*detections.columns)
    )
