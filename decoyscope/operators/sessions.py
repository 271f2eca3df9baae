"""Inactivity-gap sessions per source address.

Events of one source that fall into the same slot of `timeout` width are always closer than the
timeout, so they share a session and a session can only break between slots. Sessions are
therefore chained over per-slot minima and maxima: the number of chained rows depends on the
covered time, not on how many events a source sent, and every event-level aggregate combines
map-side before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from decoyscope.functions.ip import is_loopback
from decoyscope.functions.values import micros, seconds_between, session_key
from decoyscope.plans.skew import repeated_lookup, slot, spread_column
from decoyscope.schemas import ACTIVE_MQTT_OPERATIONS, SCHEMA_VERSION, WEAK_CREDENTIALS
from decoyscope.settings import DEFAULTS, Settings


def is_internal(source_ip: str = "source.ip", flag: str = "meta.internal"):
    """Flagged internal, or a loopback source for rows written before the flag existed."""
    return F.coalesce(F.col(flag), F.lit(False)) | is_loopback(F.col(source_ip))


def event_slot(ts, settings: Settings = DEFAULTS):
    """The number of the timeout-wide slot in which a time lies."""
    return slot(ts, _slot_width(settings.session_timeout_seconds))


def external_events(events: DataFrame) -> DataFrame:
    return events.where(~is_internal())


def _slot_width(timeout_seconds: float) -> int:
    return max(int(timeout_seconds * 1_000_000), 1)


def slot_start(slot_number, settings: Settings = DEFAULTS):
    """The time at which a slot begins."""
    return F.timestamp_micros(slot_number * F.lit(_slot_width(settings.session_timeout_seconds)))


def _flat(events: DataFrame, timeout_seconds: float) -> DataFrame:
    """The few columns sessions need, with the rule predicates as flags."""
    user, password = F.col("authentication.username"), F.col("authentication.password")
    weak = F.lit(False)
    for name, secret in WEAK_CREDENTIALS:
        weak = weak | ((user == name) & (password == secret))
    is_auth = F.col("event.category") == "authentication"
    is_mqtt = F.col("network.protocol") == "mqtt"
    return events.select(
        F.col("source.ip").alias("source_ip"),
        F.col("ts"),
        slot(F.col("ts"), _slot_width(timeout_seconds)).alias("slot"),
        F.col("event.id").alias("event_id"),
        F.col("honeypot.id").alias("honeypot"),
        F.col("service.name").alias("service"),
        F.col("network.protocol").alias("protocol"),
        F.nullif(F.col("url.path"), F.lit("")).alias("url"),
        F.nullif(F.col("process.command_line"), F.lit("")).alias("command"),
        user.alias("username"),
        password.alias("password"),
        F.coalesce(is_auth, F.lit(False)).alias("is_auth"),
        F.coalesce(is_auth & (F.col("event.outcome") == "failure"), F.lit(False)).alias("is_auth_failure"),
        F.coalesce(is_auth & (user.isNotNull() | password.isNotNull()), F.lit(False)).alias("has_credentials"),
        F.coalesce(weak, F.lit(False)).alias("is_weak"),
        F.coalesce(is_mqtt, F.lit(False)).alias("is_mqtt"),
        F.coalesce(is_mqtt & F.col("mqtt.operation").isin(*ACTIVE_MQTT_OPERATIONS), F.lit(False)).alias("is_mqtt_active"),
        F.coalesce(
            (F.col("service.name") == "iot-service") & (F.col("network.protocol") == "tcp"), F.lit(False)
        ).alias("is_iot_probe"),
    )


def _chain(slots: DataFrame, timeout_seconds: float) -> DataFrame:
    """Add `session_start` to rows carrying (source_ip, slot, first_ts, last_ts).

    Rows are intervals whose inner gaps are within the timeout; a session starts where an
    interval begins more than the timeout after everything before it. An equal gap stays.
    """
    order = Window.partitionBy("source_ip").orderBy("first_ts", "last_ts")
    reached = F.max("last_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = micros(F.col("first_ts")) - micros(F.col("_reached"))
    opened = F.when(F.col("_reached").isNull() | (gap > int(timeout_seconds * 1_000_000)), F.col("first_ts"))
    return (
        slots.withColumn("_reached", reached)
        .withColumn("_opened", opened)
        .withColumn("session_start", F.last("_opened", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("_reached", "_opened")
    )


def label_events(events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Every external event with its session: the membership table in long form.

    One row per event instead of one id array per session, so a session of any length is never
    held by one task. (ts, event_id) orders the members of a session.
    """
    flat = _flat(external_events(events), settings.session_timeout_seconds).withColumn(
        "_spread", spread_column(["event_id"], settings.spread)
    )
    cells = flat.groupBy("source_ip", "slot", "_spread").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    slots = cells.groupBy("source_ip", "slot").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    starts = _chain(slots, settings.session_timeout_seconds).select("source_ip", "slot", "session_start")
    placed = cells.select("source_ip", "slot", "_spread").join(starts, ["source_ip", "slot"])
    return (
        flat.join(placed, ["source_ip", "slot", "_spread"])
        .drop("slot", "_spread")
        .withColumn("session_id", session_key(F.col("source_ip"), F.col("session_start")))
    )


def session_events(labelled: DataFrame) -> DataFrame:
    return labelled.select("session_id", "source_ip", "ts", "event_id")


def session_credentials(labelled: DataFrame) -> DataFrame:
    return labelled.where("has_credentials").select("session_id", "ts", "event_id", "username", "password")


def session_commands(labelled: DataFrame) -> DataFrame:
    return labelled.where("command IS NOT NULL").select("session_id", "ts", "event_id", "command")


def session_urls(labelled: DataFrame) -> DataFrame:
    return labelled.where("url IS NOT NULL").select("session_id", "ts", "event_id", "url")


_FLAG_COUNTS = {
    "authentication_attempts": "is_auth",
    "failed_authentication_attempts": "is_auth_failure",
    "credential_count": "has_credentials",
    "weak_credential_count": "is_weak",
    "mqtt_event_count": "is_mqtt",
    "mqtt_active_count": "is_mqtt_active",
    "iot_probe_count": "is_iot_probe",
}


_COUNTERS = [*_FLAG_COUNTS, "event_count", "command_count", "url_count"]
CELL_KEYS = ("source_ip", "slot", "honeypot", "service", "protocol")


def session_cells(flat: DataFrame) -> DataFrame:
    """The mergeable state of sessions: bounds and counters per source, slot and touched names. See schemas.SESSION_CELL.

    Touched names are part of the key, so plain counters stay in the hash aggregate.
    """
    return flat.groupBy(*CELL_KEYS).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("event_count"),
        F.count("command").alias("command_count"),
        F.count("url").alias("url_count"),
        *[F.count_if(F.col(flag)).alias(name) for name, flag in _FLAG_COUNTS.items()],
    )


def session_paths(flat: DataFrame) -> DataFrame:
    """Distinct web paths per source and slot. Paths are chosen by the sender, so they are never gathered in a set."""
    return flat.where("url IS NOT NULL").select("source_ip", "slot", "url").distinct()


def chain_cells(cells: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return _chain(cells, settings.session_timeout_seconds)


def merge_cells(chained: DataFrame, paths: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Sessions of cells that carry their session_start, and of the paths of the same slots."""
    sessions = (
        chained.groupBy("source_ip", "session_start")
        .agg(
            F.max("last_ts").alias("end_time"),
            F.array_sort(F.collect_set("honeypot")).alias("honeypots_touched"),
            F.array_sort(F.collect_set("service")).alias("services_touched"),
            F.array_sort(F.collect_set("protocol")).alias("protocols"),
            *[F.sum(name).alias(name) for name in _COUNTERS],
        )
        .withColumnRenamed("session_start", "start_time")
    )
    starts = chained.groupBy("source_ip", "slot").agg(F.min("session_start").alias("start_time"))
    placed = repeated_lookup(paths, starts, ["source_ip", "slot"], ["url"], settings.spread)
    different = (
        placed.select("source_ip", "start_time", "url").distinct()
        .groupBy("source_ip", "start_time").agg(F.count("*").alias("distinct_url_count"))
    )
    return sessions.join(different, ["source_ip", "start_time"], "left").select(
        session_key(F.col("source_ip"), F.col("start_time")).alias("session_id"),
        "source_ip",
        "start_time",
        "end_time",
        seconds_between(F.col("start_time"), F.col("end_time")).alias("duration"),
        "honeypots_touched",
        "services_touched",
        "protocols",
        "event_count",
        "authentication_attempts",
        "failed_authentication_attempts",
        "credential_count",
        "command_count",
        "url_count",
        F.coalesce("distinct_url_count", F.lit(0)).cast("bigint").alias("distinct_url_count"),
        "weak_credential_count",
        "mqtt_event_count",
        "mqtt_active_count",
        "iot_probe_count",
        F.lit(SCHEMA_VERSION).alias("schema_version"),
    )


def flat_events(events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """External events as the few columns that sessions need, with their slot."""
    return _flat(external_events(events), settings.session_timeout_seconds)


def build_sessions(events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per session: times, touched services, counters. See schemas.SESSION."""
    flat = flat_events(events, settings)
    return merge_cells(chain_cells(session_cells(flat), settings), session_paths(flat), settings)


def order_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.orderBy("start_time", "source_ip")


def session_window_rollup(events: DataFrame, timeout_seconds: float) -> DataFrame:
    """The same session bounds from the built-in session window; the streaming form uses it too."""
    flat = _flat(external_events(events), timeout_seconds)
    window = F.session_window("ts", f"{_slot_width(timeout_seconds)} microseconds")
    return flat.groupBy("source_ip", window).agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.count("*").alias("event_count"),
        F.count("command").alias("command_count"),
        F.count("url").alias("url_count"),
        *[F.count_if(F.col(flag)).alias(name) for name, flag in _FLAG_COUNTS.items()],
    ).drop("session_window").withColumn("session_id", session_key(F.col("source_ip"), F.col("start_time")))
