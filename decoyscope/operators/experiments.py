"""Correlation of controlled runs with events, sessions and detections, and their scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decoyscope.functions.ip import is_usable_lab_host
from decoyscope.functions.values import config_fingerprint, micros, nonnegative_seconds, seconds_between
from decoyscope.plans.skew import (
    exact_percentiles,
    interval_join,
    running_counts,
    spread_lookup,
)
from decoyscope.plans.tables import materialize
from decoyscope.operators.sessions import is_internal
from decoyscope.schemas import RUN_STATUSES, SERVICE_TO_HONEYPOT, STEP_STATUSES
from decoyscope.settings import DEFAULTS, Settings

_NO_TEXT = "array<string>"


def honeypot_of(service: Column) -> Column:
    lookup = F.create_map(*[F.lit(item) for pair in SERVICE_TO_HONEYPOT.items() for item in pair])
    return F.try_element_at(lookup, service)


def is_control() -> Column:
    return F.coalesce(F.col("trial_kind"), F.lit("attack")) == "control"


def event_points(events: DataFrame) -> DataFrame:
    """The flat columns of external events that matching needs."""
    return events.where(~is_internal()).select(
        F.col("source.ip").alias("attacker_ip"),
        F.col("destination.ip").alias("target_ip"),
        F.col("service.name").alias("service"),
        F.col("event.id").alias("event_id"),
        F.col("ts"),
        F.col("event.ingested").alias("ingested"),
    )


def match_events(
    experiments: DataFrame, events: DataFrame, settings: Settings = DEFAULTS, carry: Sequence[str] = ()
) -> DataFrame:
    """(experiment_id, event) for every event on the run's route, inside its window, at a targeted service.

    `carry` names run columns to keep on every row, which saves joining a hot run to its events again.
    """
    windows = experiments.select(
        "experiment_id", "attacker_ip", "target_ip", "target_honeypots",
        *[F.col(name).alias(f"_run_{name}") for name in carry], "start_time", "end_time",
    )
    joined = interval_join(
        event_points(events), windows, ["attacker_ip", "target_ip"], "ts", "start_time", "end_time",
        settings.match_slot_seconds, settings.spread, ["event_id"], few_intervals=True,
    )
    targets = F.coalesce("target_honeypots", F.array().cast(_NO_TEXT))
    return joined.where((F.size(targets) == 0) | F.array_contains(targets, F.col("service"))).select(
        "experiment_id", "event_id", "ts", "ingested", "service",
        *[F.col(f"_run_{name}").alias(f"run_{name}") for name in carry],
    )


def overlapping_sessions(experiments: DataFrame, sessions: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(experiment_id, session_id) where a session of the run's source overlaps the run's window.

    A session overlaps if it contains the window's start, or starts inside the window; each case
    is one point-in-interval join, so neither side is compared with all rows of a source.
    """
    runs = experiments.select("experiment_id", F.col("attacker_ip").alias("source_ip"), "start_time", "end_time").where(
        F.col("start_time") <= F.col("end_time")
    )
    spans = sessions.select(
        "session_id", "source_ip", F.col("start_time").alias("session_start"), F.col("end_time").alias("session_end")
    )
    width = settings.match_slot_seconds
    starts_inside = interval_join(
        spans, runs, ["source_ip"], "session_start", "start_time", "end_time", width, settings.spread, ["session_id"]
    ).select("experiment_id", "session_id")
    covers_start = interval_join(
        runs, spans, ["source_ip"], "start_time", "session_start", "session_end", width, settings.spread, ["experiment_id"]
    ).where(F.col("session_start") < F.col("start_time")).select("experiment_id", "session_id")
    return starts_inside.unionByName(covers_start)


# Run column that link_sessions expects on matched rows.
LINK_COLUMNS = ("attacker_ip",)


def link_sessions(matched: DataFrame, sessions: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Distinct (experiment_id, session_id) whose sessions hold a matched event.

    Sessions of a source do not overlap, so a matched event lies in the one that spans its time; no
    event has to be labelled with its session, and ids may repeat. `matched` carries LINK_COLUMNS.
    """
    instants = matched.select("experiment_id", F.col("run_attacker_ip").alias("source_ip"), "ts").distinct()
    spans = sessions.select("session_id", "source_ip", "start_time", "end_time")
    linked = interval_join(
        instants, spans, ["source_ip"], "ts", "start_time", "end_time", settings.match_slot_seconds, settings.spread, ["experiment_id", "ts"]
    )
    return linked.select("experiment_id", "session_id").distinct()


def link_detections(links: DataFrame, detections: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Detections of linked sessions, one row per (experiment_id, detection)."""
    packed = detections.groupBy("session_id").agg(  # at most eight rules per session
        F.collect_list(
            F.struct("detection_id", "type", "timestamp", "evidence_end_time", "detected_at")
        ).alias("_detections")
    )
    joined = spread_lookup(links, packed, ["session_id"], ["experiment_id"], settings.spread)
    return joined.select("experiment_id", "session_id", F.inline("_detections"))


# Run columns that step_coverage expects on matched rows.
STEP_COLUMNS = ("runner_steps", "ground_truth_valid", "evaluation_step_time_tolerance_seconds")


def step_coverage(matched: DataFrame, experiments: DataFrame) -> DataFrame:
    """Per run: steps, whether their times are usable, and how many have a matching event.

    `matched` carries STEP_COLUMNS. Runs hold a handful of steps, so each event is tested against
    its run's step array and only distinct (run, step) pairs are shuffled.
    """
    tolerance = F.coalesce(F.col("run_evaluation_step_time_tolerance_seconds"), F.lit(DEFAULTS.step_tolerance_seconds))
    margin = (tolerance * 1e6).cast("bigint")

    def covers(step: Column) -> Column:
        return (
            (honeypot_of(step["service"]) == F.col("service"))
            & (micros(F.col("ts")) >= micros(step["started_at"]) - margin)
            & (micros(F.col("ts")) <= micros(step["ended_at"]) + margin)
        )

    numbered = F.transform("run_runner_steps", lambda step, i: F.struct(i.alias("position"), step.alias("step")))
    hit = F.transform(F.filter(numbered, lambda s: covers(s["step"])), lambda s: s["position"])
    covered = (
        matched.where("run_ground_truth_valid")
        .select("experiment_id", F.explode(hit).alias("_position"))
        .distinct()
        .groupBy("experiment_id")
        .agg(F.count("*").alias("_covered"))
    )
    steps = F.col("runner_steps")
    usable = F.forall(steps, lambda s: F.coalesce(s["ended_at"] >= s["started_at"], F.lit(False)))
    count = F.when(steps.isNull(), 0).otherwise(F.size(steps))
    available = F.coalesce(F.col("ground_truth_valid") & (count > 0) & usable, F.lit(False))
    hits = F.coalesce("_covered", F.lit(0))
    return experiments.select("experiment_id", "runner_steps", "ground_truth_valid").join(covered, "experiment_id", "left").select(
        "experiment_id",
        count.cast("bigint").alias("runner_step_count"),
        F.when(available, count).cast("bigint").alias("telemetry_step_count"),
        F.when(available, hits).cast("bigint").alias("telemetry_steps_covered"),
        F.when(available, hits / count).alias("telemetry_step_coverage"),
    )


def experiment_events(matched: DataFrame) -> DataFrame:
    """The run's event ids in long form, distinct."""
    return matched.select("experiment_id", "event_id").where("event_id IS NOT NULL").distinct()


def _event_metrics(matched: DataFrame) -> DataFrame:
    latency = matched.withColumn("_latency", nonnegative_seconds(F.col("ts"), F.col("ingested")))
    facts = latency.groupBy("experiment_id").agg(
        F.count("*").alias("matched_event_count"),
        F.min("ts").alias("first_event_at"),
        F.max("ts").alias("last_event_at"),
        F.min("ingested").alias("first_event_ingested_at"),
        F.max("ingested").alias("last_event_ingested_at"),
        F.count("_latency").alias("ingestion_latency_count"),
        F.min("_latency").alias("ingestion_latency_min_seconds"),
        F.avg("_latency").alias("ingestion_latency_mean_seconds"),
        F.max("_latency").alias("ingestion_latency_max_seconds"),
    )
    ranks = exact_percentiles(
        latency, ["experiment_id"], "_latency",
        {"ingestion_latency_p50_seconds": 0.5, "ingestion_latency_p95_seconds": 0.95},
    )
    return facts.join(ranks, "experiment_id", "left")


def _detection_metrics(found: DataFrame, experiments: DataFrame) -> DataFrame:
    expected = experiments.select("experiment_id", "expected_detection")
    rows = found.join(expected, "experiment_id")
    key = F.coalesce("detected_at", "timestamp")
    first = F.min(
        F.when(
            F.col("type") == F.col("expected_detection"),
            F.struct(key.alias("_key"), "timestamp", "detection_id", "evidence_end_time", "detected_at"),
        )
    )
    return rows.groupBy("experiment_id").agg(
        F.count("*").alias("linked_detection_count"),
        F.array_sort(F.collect_list("detection_id")).alias("detection_ids"),
        F.array_sort(F.collect_set("type")).alias("observed_detection_types"),
        first.alias("_first"),
    )


def correlate(
    experiments: DataFrame,
    events: DataFrame,
    sessions: DataFrame,
    detections: DataFrame,
    scientific: bool = True,
    settings: Settings = DEFAULTS,
    schema_version_key: str = "schema_version",
) -> DataFrame:
    """Score every run at once: links, latencies, coverage, result and reason.

    The matched events and the session links feed several aggregates each, so both are written to
    the shared folder once.

    A run links at most window/timeout sessions and eight detections per session, so those ids stay
    arrays; the unbounded event ids are the long-form `experiment_events`.
    """
    settled = F.coalesce(F.col("telemetry_settled"), F.lit(True)) if scientific else F.lit(True)
    matched = materialize(match_events(experiments.where(settled), events, settings, carry=(*STEP_COLUMNS, *LINK_COLUMNS)), "matched")
    links = materialize(link_sessions(matched, sessions, settings), "links")
    found = link_detections(links, detections, settings)
    linked = links.groupBy("experiment_id").agg(
        F.count("*").alias("linked_session_count"), F.array_sort(F.collect_list("session_id")).alias("session_ids")
    )
    joined = experiments
    for part in (_event_metrics(matched), linked, _detection_metrics(found, experiments), step_coverage(matched, experiments)):
        joined = joined.join(part, "experiment_id", "left")

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint")

    types = F.coalesce("observed_detection_types", F.array().cast(_NO_TEXT))
    control = is_control()
    observed = F.when(control, count("linked_detection_count") > 0).otherwise(F.col("_first").isNotNull())
    evidence = F.coalesce(F.col("_first.evidence_end_time"), F.col("_first.timestamp"))
    span = seconds_between(F.col("first_event_at"), F.col("last_event_at"))
    c = F.col
    measured = joined.withColumns(
        {
            "matched_event_count": count("matched_event_count"),
            "linked_session_count": count("linked_session_count"),
            "linked_detection_count": count("linked_detection_count"),
            "ingestion_latency_count": count("ingestion_latency_count"),
            "session_ids": F.coalesce("session_ids", F.array().cast(_NO_TEXT)),
            "detection_ids": F.coalesce("detection_ids", F.array().cast(_NO_TEXT)),
            "observed_detection_types": types,
            "unexpected_detection_types": F.when(c("expected_detection").isNull(), types).otherwise(
                F.array_sort(F.array_except(types, F.array("expected_detection")))
            ),
            "observed_detection": observed,
            "evidence_latency_seconds": nonnegative_seconds(c("start_time"), evidence),
            "detection_latency_seconds": nonnegative_seconds(c("start_time"), c("_first.detected_at")),
            "processing_latency_seconds": nonnegative_seconds(evidence, c("_first.detected_at")),
            "runner_duration_seconds": nonnegative_seconds(c("runner_start_time"), c("runner_end_time")),
            "experiment_duration_seconds": nonnegative_seconds(c("start_time"), c("end_time")),
            "observed_event_rate_eps": F.when(
                (c("matched_event_count") >= 2) & (span > 0), F.try_divide(c("matched_event_count"), span)
            ),
            "evaluation_config_fingerprint": config_fingerprint(
                c("config_snapshot"), c("software_revision"), schema_version_key
            ),
        }
    ).drop("_first")
    return _score(measured, scientific, settled)


def _score(measured: DataFrame, scientific: bool, settled: Column) -> DataFrame:
    observed = F.col("observed_detection")
    if not scientific:
        return measured.withColumn("result", F.when(observed, "TP").otherwise("FN"))
    proven = F.coalesce(F.col("ground_truth_valid"), F.lit(False))
    failed = F.coalesce(F.col("runner_status").isin("failed", "partial"), F.lit(False))
    reason = (
        F.when(~settled, "SETTLE_TIMEOUT")
        .when(~proven & failed, "RUNNER_FAILED")
        .when(~proven, "NO_GROUND_TRUTH")
        .when(F.col("matched_event_count") == 0, "NO_TELEMETRY")
    )
    outcome = (
        F.when(F.col("result_reason").isNotNull(), "INCONCLUSIVE")
        .when(is_control(), F.when(observed, "FP").otherwise("TN"))
        .otherwise(F.when(observed, "TP").otherwise("FN"))
    )
    return (
        measured.withColumn("result_reason", reason)
        .withColumn("result", outcome)
        .withColumn("observed_detection", F.when(settled, observed))
    )


def settle_status(experiments: DataFrame, events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Whether matching telemetry went quiet in time after each run's end, and after how long.

    A run is settled at the first instant, no later than the timeout, at which it has matching
    events and none arrived for the quiet period. Arrivals are first reduced to quiet-period slots
    (their inner gaps are always shorter), so a run keeps at most timeout/quiet + 2 rows.
    """
    quiet, limit = settings.settle_quiet_seconds, settings.settle_timeout_seconds
    arrivals = match_events(experiments, events, settings, carry=["end_time"])
    after = F.greatest(seconds_between(F.col("run_end_time"), F.col("ingested")), F.lit(0.0))
    reduced = (
        arrivals.where(F.col("ingested").isNotNull())
        .withColumn("_after", after)
        .where(F.col("_after") <= limit)
        .groupBy("experiment_id", F.floor(F.col("_after") / quiet).alias("_slot"))
        .agg(F.min("_after").alias("_first"), F.max("_after").alias("_last"), F.count("*").alias("_n"))
    )
    spans = reduced.groupBy("experiment_id").agg(
        F.array_sort(F.collect_list(F.struct("_first", "_last"))).alias("_spans"), F.sum("_n").alias("matched_event_count")
    )
    # The first span that is followed by more than the quiet period without arrivals.
    following = F.get(F.col("_spans"), F.col("_i") + 1)["_first"]
    ends = spans.select("experiment_id", "matched_event_count", "_spans", F.posexplode("_spans").alias("_i", "_span")).where(
        F.coalesce(following - F.col("_span._last") > quiet, F.lit(True))
    )
    settled = ends.groupBy("experiment_id").agg(
        F.max("matched_event_count").alias("matched_event_count"), (F.min("_span._last") + quiet).alias("_at")
    )
    in_time = F.coalesce(F.col("_at") <= limit, F.lit(False))
    return experiments.select("experiment_id").join(settled, "experiment_id", "left").select(
        "experiment_id",
        in_time.alias("telemetry_settled"),
        F.when(in_time, F.col("_at")).otherwise(F.lit(float(limit))).alias("settle_wait_seconds"),
        F.coalesce("matched_event_count", F.lit(0)).cast("bigint").alias("matched_event_count"),
    )


def collision_counts(experiments: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """How many other runs on the same route overlap each run in time, without forming pairs.

    others = runs started by my end - runs ended before my start - myself, from two running counts.
    """
    keys = ["attacker_ip", "target_ip"]
    far = F.timestamp_seconds(F.lit(4_102_444_800))  # an unfinished run stays open
    runs = experiments.where("start_time IS NOT NULL").select(
        "experiment_id", *keys, "start_time", F.coalesce("end_time", far).alias("end_time")
    ).where(F.col("start_time") <= F.col("end_time"))
    zero, one = F.lit(0), F.lit(1)
    before_start = F.timestamp_micros(F.unix_micros("start_time") - 1)
    marks = runs.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.col("start_time").alias("ts"), one.alias("started"), zero.alias("ended")),
                F.struct(F.col("end_time").alias("ts"), zero.alias("started"), one.alias("ended")),
                F.struct(before_start.alias("ts"), zero.alias("started"), zero.alias("ended")),
            )
        ),
    )
    known = running_counts(marks, keys, "ts", ["started", "ended"], settings.match_slot_seconds)
    at_end = known.select(*keys, F.col("ts").alias("end_time"), "started_to_date")
    at_start = known.select(*keys, F.col("ts").alias("_before_start"), "ended_to_date")
    salted = runs.withColumn("_before_start", before_start)
    with_end = spread_lookup(salted, at_end, [*keys, "end_time"], ["experiment_id"], settings.spread)
    both = spread_lookup(with_end, at_start, [*keys, "_before_start"], ["experiment_id"], settings.spread)
    return both.select(
        "experiment_id", (F.col("started_to_date") - F.col("ended_to_date") - 1).cast("bigint").alias("overlapping_runs")
    )


def check_ground_truth(runs: DataFrame, experiments: DataFrame) -> DataFrame:
    """Accept or reject submitted runs against their experiment's contract; first failed check wins.

    `experiments` may carry `ground_truth`, the run accepted earlier (same struct as a run row).
    """
    steps_named = F.transform("run.steps", lambda s: F.struct(s["step"].alias("step"), s["service"].alias("service")))
    services = F.coalesce(F.col("scenario_step_services"), F.array().cast(_NO_TEXT))
    contract = F.transform(services, lambda s, i: F.struct((i + 1).cast("int").alias("step"), s.alias("service")))
    submitted = runs.select("experiment_id", F.col("run_id").alias("_run_id"), F.struct(*runs.columns).alias("run"))
    known = experiments.withColumn("_known", F.lit(True))
    joined = spread_lookup(submitted, known, ["experiment_id"], ["_run_id"], DEFAULTS.spread, how="left")
    run = F.col("run")
    malformed = (
        ~F.coalesce(run["overall_status"].isin(*RUN_STATUSES), F.lit(False))
        | F.coalesce(run["end_time"] < run["start_time"], F.lit(True))
        | ~F.coalesce(
            F.forall(
                run["steps"],
                lambda s: (s["step"] >= 1) & s["status"].isin(*STEP_STATUSES) & (s["ended_at"] >= s["started_at"]),
            ),
            F.lit(False),
        )
    )

    def differs(left: Column, right: str) -> Column:
        return ~left.eqNullSafe(F.col(right))

    checks = [
        F.when(F.col("_known").isNull(), "unknown_experiment"),
        F.when(malformed, "malformed_submission"),
        F.when(~F.coalesce(F.col("status").isin("running", "correlating"), F.lit(False)), "not_accepting"),
        F.when(differs(run["scenario_id"], "scenario_id") | differs(run["scenario_manifest_sha256"], "scenario_manifest_sha256"), "scenario_mismatch"),
        F.when(differs(run["target"], "target_ip") | differs(run["expected_detection"], "expected_detection"), "target_mismatch"),
        F.when(run["start_time"] < F.col("start_time"), "outside_window"),
        F.when(F.col("end_time").isNotNull() & (run["end_time"] > F.col("end_time")), "ends_after_experiment"),
    ]
    if "ground_truth" in experiments.columns:
        earlier = F.col("ground_truth")
        checks.append(F.when(earlier.isNotNull() & (F.to_json(earlier) != F.to_json(run)), "conflicting_run"))
    checks.append(F.when((F.size(services) == 0) | (steps_named != contract), "step_contract_mismatch"))
    reason = F.coalesce(*checks)
    allowed = F.coalesce(F.col("scenario_step_allowed_statuses"), F.array().cast(_NO_TEXT))
    proven = F.zip_with(
        run["steps"], allowed, lambda s, a: F.coalesce(F.array_contains(F.split(a, "[|]"), s["status"]), F.lit(False))
    )
    intent = (F.size(allowed) == F.size(run["steps"])) & F.forall(proven, lambda ok: ok)
    return joined.select(
        "experiment_id",
        run["run_id"].alias("run_id"),
        reason.isNull().alias("accepted"),
        reason.alias("rejection"),
        F.when(reason.isNull(), (run["overall_status"] == "completed") & intent).alias("ground_truth_valid"),
        run["overall_status"].alias("runner_status"),
        run["start_time"].alias("runner_start_time"),
        run["end_time"].alias("runner_end_time"),
        run["steps"].alias("runner_steps"),
    )


def run_status(steps: Column) -> Column:
    """Roll-up of step results: completed, failed when every step failed, else partial."""
    failures = F.size(F.filter(steps, lambda s: s["status"] == "failed"))
    return F.when(failures == 0, "completed").when(failures == F.size(steps), "failed").otherwise("partial")


def lab_hosts(addresses: DataFrame, column: str, settings: Settings = DEFAULTS) -> DataFrame:
    return addresses.withColumn("is_lab_host", is_usable_lab_host(F.col(column), settings.lab_subnet))


def ingestion_samples(run_events: DataFrame, events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One latency sample per (experiment_id, event_id); null when the event is missing or the delay negative."""
    wanted = run_events.select("event_id").distinct()
    stored = (
        events.select(F.col("event.id").alias("event_id"), F.struct("ts", F.col("event.ingested").alias("ingested")).alias("_t"))
        .join(wanted, "event_id", "left_semi")
        .groupBy("event_id")
        .agg(F.max("_t").alias("_e"))
    )
    joined = spread_lookup(run_events, stored, ["event_id"], ["experiment_id"], settings.spread, how="left")
    return joined.select(
        "experiment_id", "event_id", nonnegative_seconds(F.col("_e.ts"), F.col("_e.ingested")).alias("sample")
    )
