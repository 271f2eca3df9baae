"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator of the engine.

All of them read the whole `events` and `customer` tables through the adapter. Times leave as
TIMESTAMP_NTZ and doubles rounded to six places (after a shift of 1e-8, so that exact halves round
the same way everywhere): another engine can be compared by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decoyscope.functions.ip import in_subnet, ipv4_number, is_loopback
from decoyscope.functions.values import config_fingerprint
from decoyscope.operators import analytics as A
from decoyscope.operators import detections as D
from decoyscope.operators import evaluation as E
from decoyscope.operators import experiments as X
from decoyscope.operators import ingest as I
from decoyscope.operators import quality as Q
from decoyscope.operators import sessions as W
from decoyscope.plans.skew import latest_per_key
from decoyscope.plans.tables import materialize, shared_folder
from decoyscope.schemas import RESOURCE_CSV
from decoyscope.settings import Settings, configure
from decoyscope.sources import driver_tables as G
from decoyscope.sources.jsonl import read_sensor_lines, stream_sensor_lines
from decoyscope.sources.store import align, export_csv, export_json, read_resources, write_batch
from decoyscope.streaming import panels

Query = Callable[[SparkSession, str], DataFrame]

# Sources of the test tables act hours apart, so a day-long timeout gives sessions of many events.
SETTINGS = Settings(session_timeout_seconds=86_400, match_slot_seconds=86_400)
AS_OF = datetime(2024, 1, 31)
WINDOW = 43_200  # thirty days: the whole table

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(function(configure(spark), sf_dir))

    QUERIES[function.__name__] = run
    return run


def comparable(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column + 1e-8, 6)
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, "|")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# Inputs ---------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.canonical_events(spark, sf_dir)


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.build_sessions(_events(spark, sf_dir), SETTINGS)


def _seen_later() -> Column:
    """A detection time that depends on the session: its end plus one second per event."""
    return G.plus_micros(F.col("end_time"), F.col("event_count") * 1_000_000)


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.detect(_sessions(spark, sf_dir), _seen_later(), SETTINGS)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.label_events(_events(spark, sf_dir), SETTINGS)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.experiments(spark, sf_dir)


def _external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.analytics_events(_events(spark, sf_dir), AS_OF, WINDOW)


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.match_events(_runs(spark, sf_dir), _events(spark, sf_dir), SETTINGS)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = X.match_events(_runs(spark, sf_dir), _events(spark, sf_dir), SETTINGS, carry=X.LINK_COLUMNS)
    return X.link_sessions(matched, _sessions(spark, sf_dir), SETTINGS)


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.normalize(G.sensor_lines(spark, sf_dir), F.col("ingested"), "observer-01")


def _scored(spark: SparkSession, sf_dir: str, scientific: bool = True) -> DataFrame:
    sessions = materialize(_sessions(spark, sf_dir), "sessions")
    return X.correlate(
        _runs(spark, sf_dir), _events(spark, sf_dir), sessions, D.detect(sessions, _seen_later(), SETTINGS), scientific, SETTINGS,
    )


def _stored_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(_scored(spark, sf_dir), "scored")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    run_events = materialize(X.experiment_events(_matched(spark, sf_dir)), "run-events")
    return X.ingestion_samples(run_events, _events(spark, sf_dir), SETTINGS)


def _eventual(events: DataFrame) -> DataFrame:
    """Canonical events as flat columns."""
    c = F.col
    return events.select(
        c("event.id").alias("event_id"), "ts", c("event.ingested").alias("ingested"),
        c("event.category").alias("category"), c("event.type").alias("type"), c("event.action").alias("action"),
        c("event.outcome").alias("outcome"), c("source.ip").alias("source_ip"), c("source.port").alias("source_port"),
        c("destination.ip").alias("destination_ip"), c("destination.port").alias("destination_port"),
        c("network.protocol").alias("protocol"), c("service.name").alias("service"),
        c("honeypot.id").alias("honeypot"), c("honeypot.type").alias("honeypot_type"),
        c("meta.internal").alias("internal"), c("meta.internal_reason").alias("internal_reason"),
        c("authentication.username").alias("username"), c("authentication.password").alias("password"),
        c("url.path").alias("url"), c("process.command_line").alias("command"),
        c("mqtt.operation").alias("mqtt_operation"), c("mqtt.packet_type").alias("packet_type"), "message", "event_date",
    )


# Sessions -------------------------------------------------------------------------------------


@query
def sessions_gap(spark, sf_dir):
    return _sessions(spark, sf_dir).select("session_id", "source_ip", "start_time", "end_time", "duration", "event_count")


@query
def session_window_sessions(spark, sf_dir):
    return W.session_window_rollup(_events(spark, sf_dir), SETTINGS.session_timeout_seconds)


@query
def session_rollup(spark, sf_dir):
    return _sessions(spark, sf_dir)


@query
def session_members(spark, sf_dir):
    return W.session_events(_labelled(spark, sf_dir))


@query
def session_credentials(spark, sf_dir):
    return W.session_credentials(_labelled(spark, sf_dir))


@query
def session_commands(spark, sf_dir):
    return W.session_commands(_labelled(spark, sf_dir))


@query
def session_urls(spark, sf_dir):
    return W.session_urls(_labelled(spark, sf_dir))


@query
def sessions_ordered(spark, sf_dir):
    return W.order_sessions(_sessions(spark, sf_dir)).select("start_time", "source_ip", "session_id")


@query
def session_top_recent(spark, sf_dir):
    return A.recent_sessions(_sessions(spark, sf_dir)).select("session_id", "source_ip", "start_time", "event_count")


# Detections -----------------------------------------------------------------------------------


def _rule_query(name: str, kind: str) -> None:
    def run(spark, sf_dir):
        return _detections(spark, sf_dir).where(F.col("type") == kind)

    run.__name__ = name
    query(run)


RULE_QUERIES = {
    "detect_brute_force": "BRUTE_FORCE",
    "detect_default_credentials": "DEFAULT_CREDENTIALS",
    "detect_web_enumeration": "WEB_ENUMERATION",
    "detect_command": "COMMAND_INTERACTION",
    "detect_mqtt": "MQTT_PROBING",
    "detect_multi_service": "MULTI_SERVICE_ACTIVITY",
    "detect_multi_stage": "MULTI_STAGE_ATTACK",
    "detect_recon": "RECONNAISSANCE",
}
for _name, _kind in RULE_QUERIES.items():
    _rule_query(_name, _kind)


@query
def detections_by_type(spark, sf_dir):
    return A.top_terms(_detections(spark, sf_dir), "type", 16)


@query
def detections_by_severity(spark, sf_dir):
    return A.top_terms(_detections(spark, sf_dir), "severity", 8)


@query
def detection_evidence(spark, sf_dir):
    return D.detection_evidence(_labelled(spark, sf_dir), _detections(spark, sf_dir), SETTINGS)


@query
def first_seen_kept(spark, sf_dir):
    """A second processing cycle: detections already stored keep their first time."""
    sessions = materialize(_sessions(spark, sf_dir), "sessions")
    stored = D.detect(sessions, F.col("end_time"), SETTINGS).where("severity <> 'high'")
    again = D.detect(sessions, _seen_later(), SETTINGS)
    return D.keep_first_seen(again, stored).select("detection_id", "severity", "detected_at")


@query
def recent_detections(spark, sf_dir):
    return A.recent_detections(_detections(spark, sf_dir)).select("detection_id", "type", "timestamp", "source_ip")


@query
def overview_detections(spark, sf_dir):
    """Newest detections; sources outside the ten newest sessions go blank."""
    sessions = _sessions(spark, sf_dir)
    return A.recent_detections_with_source(_detections(spark, sf_dir), sessions, 8, 10).select("detection_id", "session_id", "source_ip")


@query
def detections_with_source(spark, sf_dir):
    sessions = _sessions(spark, sf_dir)
    return A.recent_detections_with_source(_detections(spark, sf_dir), sessions, 200).select("detection_id", "session_id", "source_ip")


# Dashboards -----------------------------------------------------------------------------------


def _histogram_query(name: str, interval: str) -> None:
    def run(spark, sf_dir):
        return A.time_histogram(_external(spark, sf_dir), interval)

    run.__name__ = name
    query(run)


HISTOGRAM_QUERIES = {
    "events_histogram_1m": "1 minute",
    "events_histogram_10m": "10 minutes",
    "events_histogram_1h": "1 hour",
    "events_histogram_12h": "12 hours",
    "events_histogram_1d": "1 day",
    "events_histogram_7d": "7 days",
}
for _name, _interval in HISTOGRAM_QUERIES.items():
    _histogram_query(_name, _interval)


@query
def histogram_peak(spark, sf_dir):
    return A.peak_bucket(A.time_histogram(_external(spark, sf_dir), A.histogram_interval(WINDOW)))


@query
def unique_sources(spark, sf_dir):
    return A.distinct_sources(_external(spark, sf_dir), exact=True)


def _terms_query(name: str, field: str, size: int) -> None:
    def run(spark, sf_dir):
        return A.top_terms(_external(spark, sf_dir), field, size)

    run.__name__ = name
    query(run)


TERM_QUERIES = {
    "top_honeypots": ("honeypot.id", 10),
    "top_protocols": ("network.protocol", 10),
    "top_categories": ("event.category", 10),
    "top_actions": ("event.action", 10),
    "top_outcomes": ("event.outcome", 10),
    "top_sources": ("source.ip", 8),
}
for _name, (_field, _size) in TERM_QUERIES.items():
    _terms_query(_name, _field, _size)


@query
def auth_outcomes(spark, sf_dir):
    return A.auth_outcomes(_external(spark, sf_dir))


@query
def bar_shares(spark, sf_dir):
    return A.bar_shares(A.top_terms(_external(spark, sf_dir), "event.action", 10))


@query
def source_honeypot_matrix(spark, sf_dir):
    return A.source_honeypot_matrix(_external(spark, sf_dir))


@query
def matrix_intensity(spark, sf_dir):
    return A.dense_matrix(_external(spark, sf_dir))


@query
def totals(spark, sf_dir):
    sessions = materialize(_sessions(spark, sf_dir), "sessions")
    return A.totals(_external(spark, sf_dir), sessions, D.detect(sessions, _seen_later(), SETTINGS))


@query
def table_counts(spark, sf_dir):
    sessions = materialize(_sessions(spark, sf_dir), "sessions")
    return A.table_counts(
        events=_events(spark, sf_dir), sessions=sessions, detections=D.detect(sessions, _seen_later(), SETTINGS),
        experiments=_runs(spark, sf_dir), dead_letters=I.dead_letters(_normalized(spark, sf_dir)),
    )


@query
def fleet_counts(spark, sf_dir):
    return A.fleet_counts(_events(spark, sf_dir))


@query
def event_search(spark, sf_dir):
    found = A.search_events(
        _events(spark, sf_dir), 500, WINDOW, AS_OF, honeypot="cowrie-01", protocol="telnet",
        category="authentication", action="login_attempt", outcome="failure",
    )
    return _eventual(found).select("event_id", "ts", "source_ip", "username")


@query
def recent_events(spark, sf_dir):
    return _eventual(A.search_events(_events(spark, sf_dir))).select("event_id", "ts", "source_ip", "action")


@query
def recent_window_events(spark, sf_dir):
    """Twelve-hourly counts of the last seven days before the fixed clock."""
    return A.time_histogram(A.analytics_events(_events(spark, sf_dir), AS_OF, 10_080), A.histogram_interval(10_080))


@query
def internal_events(spark, sf_dir):
    flagged = _events(spark, sf_dir).select(W.is_internal().alias("internal"), is_loopback(F.col("source.ip")).alias("loopback"))
    return flagged.groupBy("internal", "loopback").agg(F.count("*").alias("count"))


@query
def internal_cleanup(spark, sf_dir):
    """Dry run over derived rows as an older release wrote them, without the internal filter."""
    events = _events(spark, sf_dir)
    legacy = events.groupBy(F.col("source.ip").alias("source_ip"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return A.internal_derived_counts(sessions=legacy, detections=legacy.where("n > 3"))


@query
def cleaned_derived(spark, sf_dir):
    events = _events(spark, sf_dir)
    legacy = events.groupBy(F.col("source.ip").alias("source_ip"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return A.without_internal(legacy)


def _with_gaps(events: DataFrame) -> DataFrame:
    """Some events without a source, honeypot, protocol or action; the adapter's `k` is the source port less 40000."""
    k, c = F.col("source.port") - 40000, F.col
    none = F.lit(None).cast("string")
    return events.withColumns({
        "source": F.when(k == 37, c("source").withField("ip", none)).otherwise(c("source")),
        "honeypot": F.when(k == 31, c("honeypot").withField("id", none)).otherwise(c("honeypot")),
        "network": F.when(k == 41, c("network").withField("protocol", none)).otherwise(c("network")),
        "event": F.when(k == 43, c("event").withField("action", none)).otherwise(c("event")),
    })


def _view_query(name: str) -> None:
    def run(spark, sf_dir):
        return A.saved_view(name, _with_gaps(_events(spark, sf_dir)))

    run.__name__ = f"saved_view_{name}"
    query(run)


VIEW_NAMES = (
    "event_overview", "honeypot_activity", "source_ip_analysis", "protocol_distribution",
    "authentication_attempts", "attack_timeline",
)
for _name in VIEW_NAMES:
    _view_query(_name)


@query
def saved_view_experiments(spark, sf_dir):
    return A.experiment_view(_scored(spark, sf_dir))


@query
def recent_experiments(spark, sf_dir):
    return A.recent_experiments(_runs(spark, sf_dir)).select("experiment_id", "created_at", "status")


@query
def events_by_ids(spark, sf_dir):
    wanted = X.experiment_events(_matched(spark, sf_dir))
    return _eventual(A.by_ids(_events(spark, sf_dir), wanted)).select("event_id", "ts", "service")


@query
def event_lookup(spark, sf_dir):
    return _eventual(A.by_id(_events(spark, sf_dir), "event.id", "77")).select("event_id", "ts", "source_ip")


# Ingest ---------------------------------------------------------------------------------------


@query
def normalize_events(spark, sf_dir):
    """Every line with its verdict."""
    normalized = _normalized(spark, sf_dir)
    return normalized.groupBy("reason", F.col("service.name").alias("service")).agg(F.count("*").alias("count"))


@query
def valid_events(spark, sf_dir):
    return _eventual(I.valid_events(_normalized(spark, sf_dir))).drop("event_date")


@query
def dead_letters(spark, sf_dir):
    letters = I.dead_letters(_normalized(spark, sf_dir))
    return letters.select("seen_at", "tags", "reason", "sensor_id", F.col("event_date").alias("day"))


@query
def dead_letter_reasons(spark, sf_dir):
    return I.dead_letter_counts(I.dead_letters(_normalized(spark, sf_dir)))


@query
def normalize_lenient(spark, sf_dir):
    rows = I.normalize_lenient(G.sensor_lines(spark, sf_dir), F.col("ingested"))
    return rows.groupBy(
        "reason", F.col("event.category").alias("category"), F.col("event.action").alias("action"),
        F.col("event.outcome").alias("outcome"), F.col("network.protocol").alias("protocol"),
    ).agg(F.count("*").alias("count"))


@query
def dedupe_events(spark, sf_dir):
    """Every event delivered twice, the second time an hour later: the later delivery stays."""
    events = _events(spark, sf_dir)
    again = events.withColumn(
        "event", F.col("event").withField("ingested", G.plus_micros(F.col("event.ingested"), F.lit(3_600_000_000)))
    )
    return _eventual(I.dedupe_events(events.unionByName(again))).select("event_id", "ts", "ingested", "category")


@query
def latest_versions(spark, sf_dir):
    """Keyed upsert: the newest state of each source."""
    rows = _events(spark, sf_dir).select(F.col("source.ip").alias("source_ip"), "ts", F.col("event.id").alias("event_id"), F.col("event.action").alias("action"))
    return latest_per_key(rows, ["source_ip"], ["ts"])


@query
def classify_interactions(spark, sf_dir):
    c = F.col
    decoded = G.flat_events(spark, sf_dir).select(
        "event_id", "service", "protocol", "username", "password",
        F.coalesce(c("mqtt_operation"), F.when((c("service") == "iot-service") & c("is_login"), "auth")).alias("operation"),
        F.when(c("url").isNotNull(), "GET").alias("method"),
        (c("k") % 3 != 0).alias("data_received"),
        (c("k") % 7 == 0).alias("malformed"),
    )
    return I.classify_interactions(decoded).select(
        "event_id", "category", "type", "action", "outcome", "honeypot_id", "honeypot_type", "summary"
    )


def _sensor_files(spark, lines):
    """Glob of one folder of files per sensor input, and the table that names each folder's columns."""
    root = f"{shared_folder(spark).rstrip('/')}/inputs-{uuid.uuid4().hex}"
    kind = F.when(F.col("honeypot_id").isNull(), "other").otherwise("cowrie")
    lines.select(kind.alias("input"), "value").write.partitionBy("input").text(root)
    folder = lambda name: F.lit(root.split(":", 1)[-1].replace("///", "/") + f"/input={name}")
    sensors = lines.select(kind.alias("input"), "sensor_id", "sensor_ip", "honeypot_id", "honeypot_type").distinct()
    sensors = sensors.select(F.when(F.col("input") == "cowrie", folder("cowrie")).otherwise(folder("other")).alias("directory"), *sensors.columns[1:])
    return f"{root}/input=*", sensors


@query
def scan_sensor_files(spark, sf_dir):
    """The lines as files, one folder per sensor input, read back with each folder's columns and validated."""
    events = I.valid_events(I.normalize(read_sensor_lines(spark, *_sensor_files(spark, G.sensor_lines(spark, sf_dir))), observer="observer-01"))
    return _eventual(events).select("event_id", "ts", "category", "action", "source_ip", "protocol", "service", "honeypot")


# Experiments ----------------------------------------------------------------------------------


@query
def match_events(spark, sf_dir):
    return _matched(spark, sf_dir)


@query
def overlap_sessions(spark, sf_dir):
    return X.overlapping_sessions(_runs(spark, sf_dir), _sessions(spark, sf_dir), SETTINGS)


@query
def link_sessions(spark, sf_dir):
    return _links(spark, sf_dir)


@query
def link_detections(spark, sf_dir):
    links = materialize(_links(spark, sf_dir), "links")
    return X.link_detections(links, _detections(spark, sf_dir), SETTINGS).select("experiment_id", "session_id", "detection_id", "type")


@query
def step_coverage(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    matched = X.match_events(runs, _events(spark, sf_dir), SETTINGS, carry=X.STEP_COLUMNS)
    return X.step_coverage(matched, runs)


SCORE_COLUMNS = (
    "experiment_id", "result", "result_reason", "observed_detection", "observed_detection_types",
    "unexpected_detection_types", "matched_event_count", "linked_session_count", "linked_detection_count",
    "session_ids", "detection_ids", "first_event_at", "last_event_at", "first_event_ingested_at",
    "last_event_ingested_at", "evidence_latency_seconds", "detection_latency_seconds",
    "processing_latency_seconds", "runner_duration_seconds", "experiment_duration_seconds",
    "observed_event_rate_eps", "ingestion_latency_count", "ingestion_latency_min_seconds",
    "ingestion_latency_mean_seconds", "ingestion_latency_p50_seconds", "ingestion_latency_p95_seconds",
    "ingestion_latency_max_seconds", "runner_step_count", "telemetry_step_count", "telemetry_steps_covered",
    "telemetry_step_coverage", "evaluation_config_fingerprint",
)


@query
def score_experiments(spark, sf_dir):
    return _scored(spark, sf_dir).select(*SCORE_COLUMNS)


@query
def score_unscientific(spark, sf_dir):
    """Plain mode: TP or FN from the links alone."""
    return _scored(spark, sf_dir, scientific=False).select("experiment_id", "result", "observed_detection", "matched_event_count")


@query
def experiment_event_ids(spark, sf_dir):
    return X.experiment_events(_matched(spark, sf_dir))


@query
def overlapping_experiments(spark, sf_dir):
    return X.collision_counts(_runs(spark, sf_dir), SETTINGS)


def _submissions(runs: DataFrame) -> DataFrame:
    """One submitted run per experiment, some of them broken by the experiment's number."""
    number = F.substring_index("experiment_id", "-", -1).cast("int")
    c = F.col
    steps = F.when(number % 23 == 0, F.slice("runner_steps", 1, 2)).otherwise(c("runner_steps"))
    return runs.select(
        F.concat(F.lit("RUN-"), number.cast("string")).alias("run_id"), "experiment_id",
        F.when(number % 19 == 0, "other").otherwise(c("scenario_id")).alias("scenario_id"), "scenario_manifest_sha256",
        F.when(number % 29 == 0, "192.168.50.99").otherwise(c("target_ip")).alias("target"),
        c("attacker_ip").alias("source"), "expected_detection",
        F.when(number % 31 == 0, G.plus_micros(c("start_time"), F.lit(-1_000_000))).otherwise(c("runner_start_time")).alias("start_time"),
        F.when(number % 43 == 0, G.plus_micros(c("end_time"), F.lit(1_000_000))).otherwise(c("runner_end_time")).alias("end_time"),
        c("runner_status").alias("overall_status"), steps.alias("steps"),
    )


@query
def ground_truth_checks(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    status = F.when(F.col("status") == "cancelled", "cancelled").otherwise("running")
    submitted = _submissions(runs)
    number = F.substring_index("experiment_id", "-", -1).cast("int")
    strangers = submitted.where(number % 47 == 0).withColumn("experiment_id", F.concat(F.lit("EXP-none-"), number.cast("string")))
    run = F.struct(*submitted.columns)
    earlier = submitted.where((number % 53 == 0) | (number % 59 == 0)).select(
        "experiment_id", F.when(number % 53 == 0, run.withField("run_id", F.lit("RUN-other"))).otherwise(run).alias("ground_truth")
    )
    contracts = runs.withColumn("status", status).join(earlier, "experiment_id", "left")
    checked = X.check_ground_truth(submitted.unionByName(strangers), contracts)
    return checked.select("experiment_id", "run_id", "accepted", "rejection", "ground_truth_valid", "runner_status")


@query
def run_status_rollup(spark, sf_dir):
    return _runs(spark, sf_dir).select("experiment_id", X.run_status(F.col("runner_steps")).alias("overall_status"))


@query
def cidr_hosts(spark, sf_dir):
    addresses = _events(spark, sf_dir).select(F.col("source.ip").alias("address")).distinct()
    rows = X.lab_hosts(addresses, "address", Settings(lab_subnet="10.0.0.0/26"))
    return rows.select(
        "address", "is_lab_host", in_subnet(F.col("address"), "10.0.0.0/25").alias("in_wide_subnet"),
        ipv4_number(F.col("address")).alias("number"),
    )


@query
def settle_status(spark, sf_dir):
    return X.settle_status(_runs(spark, sf_dir), _events(spark, sf_dir), SETTINGS)


@query
def ingestion_samples(spark, sf_dir):
    return _samples(spark, sf_dir)


# Evaluation -----------------------------------------------------------------------------------


@query
def config_fingerprints(spark, sf_dir):
    return _runs(spark, sf_dir).select(
        "experiment_id", config_fingerprint(F.col("config_snapshot"), F.col("software_revision")).alias("fingerprint")
    )


@query
def latency_stats(spark, sf_dir):
    return E.cohort_measurements(_stored_scored(spark, sf_dir))


@query
def scenario_measurements(spark, sf_dir):
    return E.scenario_measurements(_stored_scored(spark, sf_dir))


@query
def ingestion_stats(spark, sf_dir):
    return E.ingestion_measurements(_stored_scored(spark, sf_dir), _samples(spark, sf_dir), settings=SETTINGS)


@query
def ingestion_stats_by_scenario(spark, sf_dir):
    return E.ingestion_measurements(_stored_scored(spark, sf_dir), _samples(spark, sf_dir), True, SETTINGS)


@query
def confusion_overall(spark, sf_dir):
    return E.cohort_overview(_scored(spark, sf_dir))


@query
def batch_cohorts(spark, sf_dir):
    """The overview of one evaluation batch."""
    return E.cohort_overview(E.filter_runs(_scored(spark, sf_dir), batch="BATCH-1"))


@query
def newest_cohort(spark, sf_dir):
    return E.newest_cohort(_scored(spark, sf_dir))


@query
def per_scenario(spark, sf_dir):
    return E.per_scenario(_scored(spark, sf_dir))


@query
def per_detection_type(spark, sf_dir):
    return E.per_detection_type(_scored(spark, sf_dir))


@query
def excluded_experiments(spark, sf_dir):
    return E.excluded_runs(_scored(spark, sf_dir)).select("experiment_id", "evaluation_exclusion_reason")


@query
def inconclusive_experiments(spark, sf_dir):
    return E.inconclusive_runs(_scored(spark, sf_dir)).select("experiment_id", "result_reason")


@query
def evaluation_counts(spark, sf_dir):
    return E.evaluation_counts(_scored(spark, sf_dir))


@query
def export_rows(spark, sf_dir):
    return E.export_rows(_scored(spark, sf_dir))


def _exported(spark, sf_dir, export, name):
    """Path of the files that an export wrote, and the schema of its rows."""
    scored = _stored_scored(spark, sf_dir)
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    export(scored, path)
    return path, E.export_rows(scored).schema


@query
def exported_csv(spark, sf_dir):
    """The CSV export, read back from its files; the list of unexpected types is never null, and CSV reads an empty text as null."""
    path, schema = _exported(spark, sf_dir, export_csv, "export-csv")
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.withColumn("unexpected_detection_types", F.coalesce("unexpected_detection_types", F.lit("")))


@query
def exported_json(spark, sf_dir):
    """The JSON export, read back from its files."""
    path, schema = _exported(spark, sf_dir, export_json, "export-json")
    return spark.read.schema(schema).json(path)


@query
def measurement_status(spark, sf_dir):
    scored = _stored_scored(spark, sf_dir)
    samples, resources = _samples(spark, sf_dir), _resources(spark, sf_dir)
    ids = Q.sensor_ids(G.sensor_lines(spark, sf_dir), datetime(2024, 1, 5), datetime(2024, 1, 25))
    return E.measurement_status(
        E.cohort_overview(scored), E.cohort_measurements(scored),
        E.ingestion_measurements(scored, samples, settings=SETTINGS), resources=Q.resource_summary(resources),
        completeness=Q.completeness(ids, _stored(spark, sf_dir)), hosts=resources.where("host_label IS NOT NULL").select("host_label").distinct(),
    )


# Quality --------------------------------------------------------------------------------------


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that passed validation are the stored ones."""
    return I.valid_events(_normalized(spark, sf_dir))


@query
def completeness(spark, sf_dir):
    ids = Q.sensor_ids(G.sensor_lines(spark, sf_dir), datetime(2024, 1, 5), datetime(2024, 1, 25))
    return Q.completeness(ids, _stored(spark, sf_dir))


@query
def missing_ids(spark, sf_dir):
    return Q.missing_ids(Q.sensor_ids(G.sensor_lines(spark, sf_dir)), _stored(spark, sf_dir))


@query
def present_ids(spark, sf_dir):
    return Q.present_ids(Q.sensor_ids(G.sensor_lines(spark, sf_dir)), _stored(spark, sf_dir))


def _resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource samples as the CSV scan gives them: text cells, some unreadable, some rows unlabelled."""
    c = F.col
    k = c("k")
    return G.flat_events(spark, sf_dir).select(
        F.when(k == 3, "").otherwise(F.concat(F.lit("host-"), (c("user_id") % 3).cast("string"))).alias("host_label"),
        c("service").alias("container_name"),
        F.when(k == 5, "bad").when(k == 7, "nan").when(k == 11, "inf").otherwise(c("value").cast("string")).alias("cpu_percent"),
        F.when(k == 9, F.lit(None)).otherwise((c("user_id") * 1000 + k).cast("string")).alias("memory_usage_bytes"),
        (k / 4).cast("string").alias("memory_percent"),
    )


@query
def scan_resource_csv(spark, sf_dir):
    """Resource summary over CSV files of the whole samples table."""
    rows = align(_resources(spark, sf_dir), RESOURCE_CSV)
    path = f"{shared_folder(spark).rstrip('/')}/resources-{uuid.uuid4().hex}"
    rows.write.option("header", True).csv(path)
    return Q.resource_summary(read_resources(spark, path))


@query
def resource_summary(spark, sf_dir):
    return Q.resource_summary(_resources(spark, sf_dir))


@query
def invalid_samples(spark, sf_dir):
    return Q.invalid_samples(_resources(spark, sf_dir))


def _stats_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    k = c("k")
    item = F.struct(
        c("service").alias("Name"),
        F.when(k == 0, "--").otherwise(F.concat((k / 2).cast("string"), F.lit("%"))).alias("CPUPerc"),
        F.concat(k, F.lit(".5MiB / 2GiB")).alias("MemUsage"), F.concat(k, F.lit("%")).alias("MemPerc"),
        F.when(k == 7, "n/a").otherwise(F.concat(k, F.lit("kB / 3.25MB"))).alias("NetIO"),
        F.concat(k, F.lit("B / 1GB")).alias("BlockIO"), k.cast("string").alias("PIDs"),
    )
    return G.flat_events(spark, sf_dir).select(
        F.to_json(item).alias("value"), F.lit("host-1").alias("host_label"), c("event_id").alias("timestamp")
    )


@query
def container_stats(spark, sf_dir):
    return Q.decode_container_stats(_stats_lines(spark, sf_dir))


@query
def unreadable_stats(spark, sf_dir):
    return Q.unreadable_container_stats(_stats_lines(spark, sf_dir))


# Streams --------------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream of canonical events."""
    return G.canonical_events(spark, sf_dir, stream=True)


def _run_to_end(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Drain the stream into a table in the shared folder and read it."""
    root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    running = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/table")
        .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table")


@query
def stream_distinct_events(spark, sf_dir):
    from decoyscope.streaming.ingest import distinct_stream

    events = _event_stream(spark, sf_dir)
    return _eventual(_run_to_end(spark, distinct_stream(events.unionByName(events), "1 day"), "distinct")).select("event_id", "ts", "service")


def _processed(spark, sf_dir):
    """The store after the events table went through the incremental processor in two micro-batches, late rows included."""
    from decoyscope.streaming.processor import Store, process_stream

    root = f"{shared_folder(spark).rstrip('/')}/processor-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64("event.id"), F.lit(2))
    store, events = Store(f"{root}/store"), _events(spark, sf_dir)
    schema = events.schema
    for n in range(2):
        events.where(part == n).write.mode("append").parquet(f"{root}/arrivals")
        arrivals = spark.readStream.schema(schema).parquet(f"{root}/arrivals")
        process_stream(arrivals, store, f"{root}/progress", SETTINGS, available_now=True).awaitTermination()
    return store


@query
def stream_rebuild_sessions(spark, sf_dir):
    """Sessions that the processor merged from its cells."""
    from decoyscope.schemas import SESSION
    from decoyscope.sources.store import read_or_empty

    return read_or_empty(spark, _processed(spark, sf_dir).sessions, SESSION)


@query
def stream_rebuild_detections(spark, sf_dir):
    """Detections that the processor keeps beside them; their time of first detection is the clock's."""
    from decoyscope.schemas import DETECTION
    from decoyscope.sources.store import read_or_empty

    return read_or_empty(spark, _processed(spark, sf_dir).detections, DETECTION).drop("detected_at")


@query
def stream_histogram(spark, sf_dir):
    """Closed hourly buckets: those the watermark has passed."""
    return _run_to_end(spark, panels.histogram_stream(_event_stream(spark, sf_dir), "1 hour", "10 minutes"), "histogram")


@query
def stream_sessions(spark, sf_dir):
    """Closed sessions: those whose end plus timeout the watermark has passed."""
    stream = panels.session_stream(_event_stream(spark, sf_dir), "10 minutes", SETTINGS)
    return _run_to_end(spark, stream, "sessions").select("session_id", "source_ip", "start_time", "end_time", "event_count")


@query
def stream_settle_status(spark, sf_dir):
    """Settled or timed-out runs as the timer reports them: runs and events are joined as streams, then watched."""
    root = f"{shared_folder(spark).rstrip('/')}/settle-{uuid.uuid4().hex}"
    runs = _runs(spark, sf_dir).select("experiment_id", "attacker_ip", "target_ip", "target_honeypots", "start_time", "end_time")
    runs.write.parquet(f"{root}/runs")
    ended = spark.readStream.schema(runs.schema).parquet(f"{root}/runs")
    arrivals = panels.run_arrivals(ended, _event_stream(spark, sf_dir), "2 days", "10 minutes", SETTINGS)
    panels.arrival_stream(arrivals, f"{root}/arrivals", f"{root}/joined", SETTINGS, available_now=True).awaitTermination()
    # A heartbeat on each side lets the watermark pass the last run's time limit.
    later = F.max("end_time") + F.expr("INTERVAL 1 DAY")
    beat = runs.agg(later.alias("end_time"), later.alias("ingested"))
    beat.select("end_time").write.mode("append").parquet(f"{root}/runs")
    write_batch(beat.withColumn("event_date", F.to_date("ingested")).withColumn("experiment_id", F.lit(None).cast("string")), f"{root}/arrivals", 0, "heartbeat")
    seen = spark.readStream.schema(arrivals.schema).parquet(f"{root}/arrivals")
    return _run_to_end(spark, panels.settle_stream(panels.settle_marks(seen, ended, "1 minute"), None, SETTINGS), "settle")


def _compacted(spark, sf_dir, rows_of, table, schema, compact):
    """A store's table that got the sensor lines in three batches, the first of them twice where copies count once, after compaction."""
    from decoyscope.sources.store import read_or_empty
    from decoyscope.streaming.processor import Store

    store = Store(f"{shared_folder(spark).rstrip('/')}/compacted-{uuid.uuid4().hex}")
    path = getattr(store, table)
    lines = materialize(_normalized(spark, sf_dir).withColumn("_part", F.pmod(F.xxhash64("raw"), F.lit(3))), "normalized")
    for n, writer in ((0, "north"), (1, "north"), (0, "south"), (0, "again")):
        part = 2 if writer == "south" else n
        if writer != "again" or table == "raw_events":
            write_batch(rows_of(lines.where(F.col("_part") == part).drop("_part")), path, n, writer)
    for _ in range(2):  # the second pass finds nothing to do
        compact(spark, store, F.lit("9999-01-01").cast("date"))
    return read_or_empty(spark, path, schema)


@query
def compacted_events(spark, sf_dir):
    """Stored raw events after compaction, read as they are."""
    from decoyscope.schemas import EVENT
    from decoyscope.streaming.processor import compact_events

    def compact(spark, store, before):
        compact_events(spark, store, before, store.raw_events)

    stored = _compacted(spark, sf_dir, I.valid_events, "raw_events", EVENT, compact)
    return stored.select(F.col("event.id").alias("event_id"), "ts", F.col("source.ip").alias("source_ip"), F.col("service.name").alias("service"))


@query
def compacted_letters(spark, sf_dir):
    """Stored dead letters after compaction."""
    from decoyscope.schemas import DEAD_LETTER
    from decoyscope.streaming.processor import compact_letters

    stored = _compacted(spark, sf_dir, I.dead_letters, "dead_letters", DEAD_LETTER, compact_letters)
    return stored.select("seen_at", "reason", "sensor_id", F.col("event_date").alias("day"))


def _rolled_up(spark, sf_dir):
    """Rollups of the events table from two micro-batches, the second with late rows and an older copy of all of the first."""
    from decoyscope.streaming.rollups import Rollups, compact_rollups, rollup_stream

    root = f"{shared_folder(spark).rstrip('/')}/rollups-{uuid.uuid4().hex}"
    rollups, events = Rollups(f"{root}/store"), _events(spark, sf_dir)
    part = F.pmod(F.xxhash64("event.id"), F.lit(2))
    earlier = F.col("event").withField("ingested", F.col("event.ingested") - F.expr("INTERVAL 1 HOUR"))
    moved = events.where(part == 0).withColumns({"event": earlier, "ts": F.date_trunc("day", "ts")})
    for arrivals in (moved, events):
        arrivals.write.mode("append").parquet(f"{root}/arrivals")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/arrivals")
        rollup_stream(stream, rollups, f"{root}/progress", available_now=True).awaitTermination()
    compact_rollups(spark, rollups, F.lit("2024-01-15").cast("date"))
    return rollups


@query
def rollup_histograms(spark, sf_dir):
    """All six histograms summed from stored minutes."""
    from decoyscope.streaming.rollups import minute_counts, rolled_histogram

    minutes = materialize(minute_counts(spark, _rolled_up(spark, sf_dir)), "minutes")
    parts = [rolled_histogram(minutes, interval).withColumn("width", F.lit(interval)) for interval in HISTOGRAM_QUERIES.values()]
    return reduce(DataFrame.unionByName, parts)


@query
def rollup_unique_sources(spark, sf_dir):
    """Exact distinct sources of each week, and whether the week's merged sketch is within 3 % of them."""
    from decoyscope.streaming.rollups import source_windows

    estimated = source_windows(spark, _rolled_up(spark, sf_dir), 7).withColumnRenamed("unique_sources", "estimate")
    days = _external(spark, sf_dir).select(F.to_date("ts").alias("day"), F.col("source.ip").alias("ip")).distinct()
    exact = days.select("ip", F.explode(F.sequence("day", F.date_add("day", 6))).alias("last_day")).groupBy("last_day").agg(F.count_distinct("ip").alias("unique_sources"))
    close = F.abs(F.col("estimate") - F.col("unique_sources")) <= F.col("unique_sources") * 0.03
    return exact.join(estimated, "last_day", "full").select("last_day", "unique_sources", close.alias("within_error"))


def _ingested(spark, sf_dir):
    """A store that the ingest stream filled from sensor files in which some lines come twice, and the path of what it observed."""
    from decoyscope.streaming.ingest import ingest_stream
    from decoyscope.streaming.processor import Store

    lines = G.sensor_lines(spark, sf_dir)
    again = F.explode(F.array_repeat("value", F.when(F.second("ingested") % 7 == 0, 2).otherwise(1)))
    paths, sensors = _sensor_files(spark, lines.withColumn("value", again))
    root = f"{shared_folder(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    store, metrics = Store(f"{root}/store"), f"{root}/store/ingest_metrics"
    stream = stream_sensor_lines(spark, paths, materialize(sensors, "sensors"), 100)
    ingest_stream(stream, store.raw_events, store.dead_letters, f"{root}/progress", "observer-01", True, metrics).awaitTermination()
    return store, metrics


@query
def stream_ingest_tables(spark, sf_dir):
    """Rows of the two tables that the ingest stream routes to: id of an event or reason of a letter, and its day."""
    from decoyscope.schemas import DEAD_LETTER, EVENT
    from decoyscope.sources.store import read_or_empty

    store, _ = _ingested(spark, sf_dir)
    events = read_or_empty(spark, store.raw_events, EVENT).select(F.lit("raw_events").alias("table_name"), F.col("event.id").alias("item"), F.to_date("ts").alias("day"))
    failed = F.col("reason") == "json_parse_failure"  # such a line has no time of its own: its day is the day it was read
    day = F.when(~failed, F.col("event_date"))
    letters = read_or_empty(spark, store.dead_letters, DEAD_LETTER).select(F.lit("dead_letters").alias("table_name"), F.col("reason").alias("item"), day.alias("day"))
    return events.unionByName(letters.select("table_name", "item", "day"))


@query
def stream_ingest_metrics(spark, sf_dir):
    """What the ingest stream observed, summed over its batches: lines by fate, rejected ones by reason, and rows of its tables."""
    from decoyscope.schemas import DEAD_LETTER, EVENT
    from decoyscope.sources.store import read_or_empty
    from decoyscope.streaming.ingest import metric_totals, read_metrics, reason_totals

    store, path = _ingested(spark, sf_dir)
    metrics = materialize(read_metrics(spark, path), "metrics")
    names = ("lines", "valid", "rejected", "stored", "repeated")
    fates = metric_totals(metrics).select(F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).alias("count")) for name in names])))
    reasons = reason_totals(metrics).select(F.concat(F.lit("reason "), "reason").alias("metric"), "count")
    held = A.table_counts(raw_events=read_or_empty(spark, store.raw_events, EVENT), dead_letters=read_or_empty(spark, store.dead_letters, DEAD_LETTER))
    return fates.unionByName(reasons).unionByName(held.select(F.concat(F.lit("table "), "table_name").alias("metric"), F.col("rows").alias("count")))


def _cleaned(spark, sf_dir):
    """A store with derived rows as an older release wrote them, without the internal filter, after its cleanup; and the counts before and after."""
    from decoyscope.schemas import DETECTION, SESSION
    from decoyscope.streaming.cleanup import clean_store, internal_rows
    from decoyscope.streaming.processor import Store

    store = Store(f"{shared_folder(spark).rstrip('/')}/legacy-{uuid.uuid4().hex}")
    day = F.to_date("ts").alias("day")
    counted = _events(spark, sf_dir).groupBy(F.col("source.ip").alias("source_ip"), day).agg(F.count("*").alias("n"))
    name = F.concat_ws(" ", "source_ip", "day")
    counted = materialize(counted.select("*", name.alias("session_id"), F.col("day").cast("timestamp").alias("start_time")), "legacy")
    sessions = align(counted.withColumn("event_count", F.col("n")), SESSION).select(*SESSION.fieldNames(), "day")
    found = counted.where("n > 3").withColumns({"detection_id": F.col("session_id"), "session_start": F.col("start_time"), "evidence_count": F.col("n")})
    sessions.write.partitionBy("day").parquet(store.sessions)
    align(found, DETECTION).select(*DETECTION.fieldNames(), "day").write.partitionBy("day").parquet(store.detections)
    before = materialize(internal_rows(spark, store), "dry-run")
    clean_store(spark, store)
    after = materialize(internal_rows(spark, store), "dry-run")
    clean_store(spark, store)  # finds nothing to do
    return store, before, after


@query
def stored_cleanup(spark, sf_dir):
    """Rows that the dry run finds before and after the cleanup of stored tables."""
    _, before, after = _cleaned(spark, sf_dir)
    return before.withColumn("run", F.lit("before")).unionByName(after.withColumn("run", F.lit("after"))).select("run", "table_name", "rows")


@query
def stored_cleanup_rows(spark, sf_dir):
    """Rows that stay in the stored tables."""
    from decoyscope.schemas import DETECTION, SESSION
    from decoyscope.sources.store import read_days

    store, _, _ = _cleaned(spark, sf_dir)
    sessions = read_days(spark, store.sessions, SESSION).select(F.lit("sessions").alias("table_name"), "source_ip", "day", F.col("event_count").alias("n"))
    detections = read_days(spark, store.detections, DETECTION).select(F.lit("detections").alias("table_name"), "source_ip", "day", F.col("evidence_count").alias("n"))
    return sessions.unionByName(detections)


@query
def rollup_quantiles(spark, sf_dir):
    """Samples of every week's merged sketches, and whether their median and 95th percentile are within 2 % of the wanted ranks.

    Runs come in two micro-batches; the second repeats all runs of the first, which count once.
    """
    from decoyscope.streaming import quantiles as K

    root = f"{shared_folder(spark).rstrip('/')}/quantiles-{uuid.uuid4().hex}"
    store = K.QuantileStore(f"{root}/store")
    samples = materialize(E.run_samples(_stored_scored(spark, sf_dir), _samples(spark, sf_dir), SETTINGS), "samples")
    for arrivals in (samples.where(F.pmod(F.xxhash64("experiment_id"), F.lit(2)) == 0), samples):
        arrivals.write.mode("append").parquet(f"{root}/arrivals")
        stream = spark.readStream.schema(samples.schema).parquet(f"{root}/arrivals")
        K.quantile_stream(stream, store, f"{root}/progress", available_now=True).awaitTermination()
    K.compact_quantiles(spark, store, F.lit("2024-01-15").cast("date"))
    merged = materialize(K.window_quantiles(spark, store, 7), "windows")
    keys = ["last_day", *K.KEYS]
    weekly = samples.where("sample IS NOT NULL").withColumn("last_day", F.explode(F.sequence("event_date", F.date_add("event_date", 6))))
    errors = K.rank_errors(weekly, merged, keys)
    return merged.join(errors, keys, "full").select(*keys, "count", ((F.col("rank_error") <= 0.02) & (F.col("samples") == F.col("count"))).alias("within_error"))


@query
def running_top_sources(spark, sf_dir):
    """The ten most active sources after each of two micro-batches: even days first, then all days, so that the first come twice."""
    from decoyscope.streaming.toplists import TopLists, compact_top_lists, top_names, top_stream

    root = f"{shared_folder(spark).rstrip('/')}/toplists-{uuid.uuid4().hex}"
    lists, events, shown = TopLists(f"{root}/store"), _events(spark, sf_dir), []
    for number, arrivals in enumerate((events.where(F.dayofmonth("ts") % 2 == 0), events), 1):
        arrivals.write.mode("append").parquet(f"{root}/arrivals")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/arrivals")
        top_stream(stream, lists, f"{root}/progress", available_now=True).awaitTermination()
        shown.append(materialize(top_names(spark, lists, 10).withColumn("batches", F.lit(number)), "top"))
        compact_top_lists(spark, lists, F.lit("2024-01-15").cast("date"))
    return shown[0].unionByName(shown[1])
