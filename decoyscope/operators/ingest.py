"""Sensor lines to canonical events or reasoned dead letters, in one projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoyscope.functions.ip import is_loopback, is_valid_ip
from decoyscope.plans.skew import latest_per_key
from decoyscope.schemas import (
    CATEGORIES,
    COWRIE_FAMILY,
    DEAD_LETTER,
    EVENT,
    EVENT_TYPES,
    MQTT,
    OUTCOMES,
    SCHEMA_VERSION,
)
from decoyscope.sources.jsonl import occurred_at, parse_lines

# Required fields in check order, and the tags of rejected rows.
REQUIRED = (
    ("event.id", "event_id"),
    ("event.category", "event_category"),
    ("event.type", "event_type"),
    ("event.action", "event_action"),
    ("event.outcome", "event_outcome"),
    ("source.ip", "source_ip"),
    ("destination.ip", "destination_ip"),
    ("network.transport", "network_transport"),
    ("network.protocol", "network_protocol"),
    ("service.name", "service_name"),
    ("honeypot.id", "honeypot_id"),
    ("honeypot.type", "honeypot_type"),
    ("meta.sensor_id", "sensor_id"),
    ("meta.schema_version", "schema_version"),
)
PARSE_TAG, VALIDATION_TAG = "parse_failure", "validation_failure"
LOGIN_FAILED, LOGIN_SUCCESS, COMMAND_INPUT = "cowrie.login.failed", "cowrie.login.success", "cowrie.command.input"


def _integer(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def _mqtt(raw: Column) -> Column:
    """The fourteen allowed mqtt fields, null when the record has no mqtt object."""
    fields = []
    for field in MQTT.fields:
        text = raw["mqtt"][field.name]
        kind = field.dataType.simpleString()
        typed = text if kind == "string" else _integer(text) if kind == "int" else text.try_cast("boolean")
        fields.append(typed.alias(field.name))
    return F.when(raw["mqtt"].isNotNull(), F.struct(*fields))


def _event_struct(event_id, ingested, category, kind, action, outcome) -> Column:
    return F.struct(
        event_id.alias("id"), ingested.cast("timestamp").alias("ingested"), category.alias("category"),
        kind.alias("type"), action.alias("action"), outcome.alias("outcome"),
    )


def _meta(sensor_id: Column, source_ip: Column) -> Column:
    internal = is_loopback(source_ip)
    return F.struct(
        sensor_id.alias("sensor_id"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        internal.alias("internal"),
        F.when(internal, "loopback_source").alias("internal_reason"),
    )


def _cowrie_only(is_cowrie: Column, native: Column, custom: Column) -> Column:
    return F.when(is_cowrie, native).otherwise(custom)


def normalize(lines: DataFrame, ingested: Column | None = None, observer: str | None = None) -> DataFrame:
    """Map raw lines of both sensor families to the canonical columns and give each row its `reason`.

    `lines` has value, sensor_id, sensor_ip, honeypot_id, honeypot_type. `ingested` defaults to the
    processing time. A null `reason` marks a valid event; otherwise it names the first failed rule.
    """
    stamp = F.current_timestamp() if ingested is None else ingested
    parsed = parse_lines(lines)
    raw, shipped = F.col("raw"), F.col
    cowrie = F.coalesce(shipped("honeypot_type") == COWRIE_FAMILY, F.lit(False))
    kind = raw["eventid"]
    login = F.coalesce(kind.isin(LOGIN_FAILED, LOGIN_SUCCESS), F.lit(False))
    command = F.coalesce(kind == COMMAND_INPUT, F.lit(False))

    native_id = F.when(
        kind.isNotNull() & raw["session"].isNotNull() & raw["timestamp"].isNotNull(),
        F.concat_ws("-", kind, raw["session"], raw["timestamp"]),
    )
    native_category = F.when(login, "authentication").when(command, "process").otherwise("session")
    native_action = F.when(login, "login_attempt").when(command, "command").otherwise(kind)
    native_outcome = F.when(kind == LOGIN_FAILED, "failure").when(kind == LOGIN_SUCCESS, "success").otherwise("unknown")
    native_protocol = F.coalesce(raw["protocol"], F.when(raw["dst_port"] == "2223", "telnet").otherwise("ssh"))
    native_login = F.when(login, F.struct(raw["username"].alias("username"), raw["password"].alias("password")))
    custom_login = F.when(raw["authentication"]["username"].isNotNull(), raw["authentication"])

    source_ip = _cowrie_only(cowrie, raw["src_ip"], raw["source_ip"])
    ports = {
        "source": _cowrie_only(cowrie, raw["src_port"], raw["source_port"]),
        "destination": _cowrie_only(cowrie, raw["dst_port"], raw["destination_port"]),
    }
    shaped = parsed.select(
        "value",
        "raw",
        "parse_failed",
        *[text.alias(f"_{side}_port") for side, text in ports.items()],
        raw["mqtt"]["packet_type"].alias("_packet_type"),
        occurred_at(raw).alias("ts"),
        _event_struct(
            _cowrie_only(cowrie, native_id, raw["event_id"]),
            stamp,
            _cowrie_only(cowrie, native_category, raw["category"]),
            _cowrie_only(cowrie, F.lit("info"), raw["type"]),
            _cowrie_only(cowrie, native_action, raw["action"]),
            _cowrie_only(cowrie, native_outcome, raw["outcome"]),
        ).alias("event"),
        F.struct(source_ip.alias("ip"), _integer(ports["source"]).alias("port")).alias("source"),
        F.struct(shipped("sensor_ip").alias("ip"), _integer(ports["destination"]).alias("port")).alias("destination"),
        F.struct(
            F.lit("tcp").alias("transport"), _cowrie_only(cowrie, native_protocol, raw["protocol"]).alias("protocol")
        ).alias("network"),
        F.struct(_cowrie_only(cowrie, F.lit("cowrie"), raw["service"]).alias("name")).alias("service"),
        F.struct(
            _cowrie_only(cowrie, shipped("honeypot_id"), raw["honeypot_id"]).alias("id"),
            _cowrie_only(cowrie, F.lit(COWRIE_FAMILY), raw["honeypot_type"]).alias("type"),
        ).alias("honeypot"),
        F.struct(F.lit(observer).cast("string").alias("name"), F.lit("honeypot_sensor").alias("type")).alias("observer"),
        _meta(shipped("sensor_id"), source_ip).alias("meta"),
        _cowrie_only(cowrie, native_login, custom_login).alias("authentication"),
        F.when(~cowrie, raw["url"]).alias("url"),
        F.when(~cowrie, raw["http"]).alias("http"),
        F.when(~cowrie, _mqtt(raw)).alias("mqtt"),
        F.when(~cowrie, raw["iot"]).alias("iot"),
        F.when(cowrie & command, F.struct(raw["input"].alias("command_line"))).alias("process"),
        _cowrie_only(cowrie, raw["message"], raw["summary"]).alias("message"),
    )
    # The verdict is a step of its own (see parse_lines): filters on it must not inline every rule.
    verdict = F.explode(F.array(rejection_reason()))
    return shaped.withColumn("event_date", F.to_date("ts")).withColumn("reason", verdict)


def rejection_reason() -> Column:
    """First failed rule: parse, time, required fields in order, addresses, vocabularies, numbers."""
    required = [
        F.when(F.col(path).isNull() | F.col(path).contains("%{"), "unresolved_interpolation").when(
            F.col(path) == "", f"missing_{label}"
        )
        for path, label in REQUIRED
    ]
    return F.coalesce(
        F.when(F.col("parse_failed"), "json_parse_failure"),
        F.when(F.col("ts").isNull(), "invalid_timestamp"),
        *required,
        F.when(~is_valid_ip(F.col("source.ip")), "invalid_source_ip"),
        F.when(~is_valid_ip(F.col("destination.ip")), "invalid_destination_ip"),
        F.when(~F.col("event.category").isin(*CATEGORIES), "invalid_event_category_"),
        F.when(~F.col("event.type").isin(*EVENT_TYPES), "invalid_event_type_"),
        F.when(~F.col("event.outcome").isin(*OUTCOMES), "invalid_event_outcome_"),
        _bad_number("_source_port", "invalid_port", 65535),
        _bad_number("_destination_port", "invalid_port", 65535),
        _bad_number("_packet_type", "invalid_mqtt_packet_type", 2**31 - 1),
    )


def _bad_number(text: str, reason: str, maximum: int) -> Column:
    return F.when(
        (F.col(text) != "") & ~F.coalesce(_integer(F.col(text)).between(0, maximum), F.lit(False)), reason
    )


# Every reason that `rejection_reason` can give, in its order.
REASONS = (
    "json_parse_failure", "invalid_timestamp", "unresolved_interpolation", *[f"missing_{label}" for _, label in REQUIRED],
    "invalid_source_ip", "invalid_destination_ip", "invalid_event_category_", "invalid_event_type_", "invalid_event_outcome_",
    "invalid_port", "invalid_mqtt_packet_type",
)


def valid_events(normalized: DataFrame) -> DataFrame:
    return normalized.where("reason IS NULL").select(*[f.name for f in EVENT.fields])


def dead_letters(normalized: DataFrame) -> DataFrame:
    """Rejected rows with the exact original line."""
    failed = F.col("reason") == "json_parse_failure"
    return normalized.where("reason IS NOT NULL").select(
        F.col("event.ingested").alias("seen_at"),
        F.array(F.when(failed, PARSE_TAG).otherwise(VALIDATION_TAG)).alias("tags"),
        "reason",
        F.col("meta.sensor_id").alias("sensor_id"),
        F.col("value").alias("raw"),
        F.coalesce("event_date", F.to_date("event.ingested")).alias("event_date"),
    ).select(*[f.name for f in DEAD_LETTER.fields])


def dead_letter_counts(letters: DataFrame) -> DataFrame:
    return letters.groupBy("reason").agg(F.count("*").alias("count"))


def dedupe_events(events: DataFrame) -> DataFrame:
    """Re-delivered ids of one day collapse to the last ingested row."""
    keyed = events.withColumn("_id", F.col("event.id")).withColumn("_seen", F.col("event.ingested"))
    return latest_per_key(keyed, ["event_date", "_id"], ["_seen"]).drop("_id", "_seen")


def normalize_lenient(lines: DataFrame, ingested: Column | None = None, observer: str | None = None) -> DataFrame:
    """Defaults instead of rejection; only a missing time or address, or a bad address, gives a `reason`.

    Here the destination address comes from the record itself and honeypot id and type from the shipper.
    """
    stamp = F.current_timestamp() if ingested is None else ingested
    parsed = parse_lines(lines)
    raw, shipped = F.col("raw"), F.col
    cowrie = F.coalesce(shipped("honeypot_type") == COWRIE_FAMILY, F.lit(False))
    kind = F.coalesce(raw["eventid"], F.lit(""))
    login, command = kind.isin(LOGIN_FAILED, LOGIN_SUCCESS), kind == COMMAND_INPUT
    time_text = F.coalesce(F.nullif(raw["timestamp"], F.lit("")), F.nullif(raw["@timestamp"], F.lit("")))
    source_ip = F.nullif(_cowrie_only(cowrie, raw["src_ip"], raw["source_ip"]), F.lit(""))
    target_ip = F.nullif(raw["destination_ip"], F.lit(""))
    native_id = F.when(
        cowrie & (kind != ""), F.concat_ws("-", kind, F.coalesce(raw["session"], F.lit("")), time_text)
    )
    identifier = F.coalesce(
        native_id,
        F.nullif(raw["event_id"], F.lit("")),
        F.sha2(F.concat_ws("|", time_text, source_ip, F.col("value")), 256),
    )
    port = {
        "source": F.coalesce(raw["src_port"], raw["source_port"]),
        "destination": F.coalesce(raw["dst_port"], raw["destination_port"]),
    }
    protocol = F.nullif(raw["protocol"], F.lit(""))
    shaped = parsed.select(
        "value",
        "raw",
        occurred_at(raw).alias("ts"),
        _event_struct(
            identifier,
            stamp,
            F.when(login, "authentication").when(command, "process")
            .otherwise(F.coalesce(raw["category"], _cowrie_only(cowrie, F.lit("session"), F.lit("network")))),
            F.coalesce(raw["type"], F.lit("info")),
            F.when(login, "login_attempt").when(command, "command").otherwise(F.coalesce(raw["action"], F.lit("observe"))),
            F.when(kind == LOGIN_FAILED, "failure").when(kind == LOGIN_SUCCESS, "success")
            .otherwise(F.coalesce(raw["outcome"], F.lit("unknown"))),
        ).alias("event"),
        F.struct(source_ip.alias("ip"), _integer(port["source"]).alias("port")).alias("source"),
        F.struct(target_ip.alias("ip"), _integer(port["destination"]).alias("port")).alias("destination"),
        F.struct(
            F.lit("tcp").alias("transport"),
            _cowrie_only(
                cowrie, F.coalesce(protocol, F.when(raw["dst_port"] == "2223", "telnet").otherwise("ssh")), protocol
            ).alias("protocol"),
        ).alias("network"),
        F.struct(_cowrie_only(cowrie, F.lit("cowrie"), raw["service"]).alias("name")).alias("service"),
        F.struct(shipped("honeypot_id").alias("id"), shipped("honeypot_type").alias("type")).alias("honeypot"),
        F.struct(F.lit(observer).cast("string").alias("name"), F.lit("honeypot_sensor").alias("type")).alias("observer"),
        _meta(shipped("sensor_id"), source_ip).alias("meta"),
        F.coalesce(
            raw["authentication"],
            F.when(login, F.struct(raw["username"].alias("username"), raw["password"].alias("password"))),
        ).alias("authentication"),
        raw["url"].alias("url"),
        raw["http"].alias("http"),
        _mqtt(raw).alias("mqtt"),
        raw["iot"].alias("iot"),
        F.when(command, F.struct(F.coalesce(raw["input"], F.lit("")).alias("command_line"))).alias("process"),
        F.coalesce(F.nullif(raw["summary"], F.lit("")), raw["message"], identifier).alias("message"),
    )
    required = _has_time_text() & F.col("source.ip").isNotNull() & F.col("destination.ip").isNotNull()
    valid = is_valid_ip(F.col("source.ip")) & is_valid_ip(F.col("destination.ip"))
    reason = F.when(~required, "missing_time_or_address").when(~valid, "invalid_address").when(
        F.col("ts").isNull(), "invalid_timestamp"
    )
    return shaped.withColumn("event_date", F.to_date("ts")).withColumn("reason", reason)


def _has_time_text() -> Column:
    raw = F.col("raw")
    return F.coalesce(F.nullif(raw["timestamp"], F.lit("")), F.nullif(raw["@timestamp"], F.lit(""))).isNotNull()


def classify_interactions(decoded: DataFrame) -> DataFrame:
    """Category, action, outcome and labels of decoded sensor interactions.

    Input: service, protocol, username, password, operation, method, data_received, malformed.
    """
    c = F.col
    named = F.coalesce(c("username"), F.lit("")) != ""
    iot_auth = (c("service") == "iot-service") & F.coalesce(c("operation") == "auth", F.lit(False))
    web_login = c("service").isin("camera", "router") & c("username").isNotNull()
    correct = F.coalesce((c("username") == "admin") & (c("password") == "admin"), F.lit(False))
    proven = F.when(correct & ~(iot_auth & F.coalesce(c("malformed"), F.lit(False))), "success").otherwise("failure")
    action = F.coalesce(c("operation"), F.when(F.coalesce(c("data_received"), F.lit(True)), "request").otherwise("connect"))
    return decoded.withColumns(
        {
            "category": F.when(named | iot_auth, "authentication").when(c("protocol") == "http", "web").otherwise("network"),
            "type": F.lit("info"),
            "action": F.when(named | iot_auth, "login_attempt").otherwise(action),
            "outcome": F.when(iot_auth | web_login, proven).when(named, "failure").otherwise("unknown"),
            "honeypot_id": F.concat(c("service"), F.lit("-01")),
            "honeypot_type": F.replace(c("service"), F.lit("-"), F.lit("_")),
            "summary": F.concat_ws(
                " ",
                c("service"),
                F.coalesce(F.nullif(c("operation"), F.lit("")), F.nullif(c("method"), F.lit("")), F.lit("interaction")),
            ),
        }
    )
