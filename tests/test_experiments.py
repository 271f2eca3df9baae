from __future__ import annotations

from datetime import timedelta

import pytest
from conftest import T0, make_events
from pyspark.sql import functions as F

from decoyscope.operators import evaluation as E
from decoyscope.operators import experiments as X
from decoyscope.schemas import DETECTION, DETECTION_TYPES, EXPERIMENT, GROUND_TRUTH

ROUTER, MQTT = "203.0.113.40", "203.0.113.41"


def t(minutes: float):
    return T0 + timedelta(minutes=minutes)


def attacker(n: int) -> str:
    return f"198.51.100.{n}"


def trial(n: int, **changes):
    """Run n: source 198.51.100.n against the router from minute 10n to 10n + 6, one MQTT step in minutes 1 to 2."""
    start = 10 * n
    values = {
        "experiment_id": f"T{n:02d}", "name": f"trial {n}", "scenario_id": f"sweep-{n % 2}", "trial_kind": "attack", "expected_detection": "MQTT_PROBING",
        "status": "completed", "attacker_ip": attacker(n), "target_ip": ROUTER, "target_honeypots": ["mqtt", "router"], "created_at": t(start - 3),
        "start_time": t(start), "end_time": t(start + 6), "runner_start_time": t(start + 0.5), "runner_end_time": t(start + 4.5), "ground_truth_valid": True,
        "telemetry_settled": True, "runner_status": "completed", "runner_steps": [(1, "mqtt", t(start + 1), t(start + 2), "completed")],
        "config_snapshot": (600, 7, 3, 2, "set-9", "1"), "detector_ruleset_version": "set-9", "software_revision": "5f3d", "scenario_manifest_sha256": "m",
    }
    return {**values, **changes}


def frame(spark, *trials):
    return spark.createDataFrame([tuple(x.get(name) for name in EXPERIMENT.fieldNames()) for x in trials], EXPERIMENT)


def hit(n: int, name: str, minute: float, delay: float = 0.25, **changes):
    """An MQTT event of run n's source, `minute` after its start, stored `delay` minutes later."""
    at = 60 * (10 * n + minute)
    return {"id": name, "at": at, "seen": at + 60 * delay, "ip": attacker(n), "target": ROUTER, "service": "mqtt", "protocol": "mqtt", **changes}


def span(n: int, name: str, low: float, high: float):
    return (name, attacker(n), t(10 * n + low), t(10 * n + high))


def alarm(n: int, name: str, session: str, kind: str, evidence: float, seen: float | None):
    values = {"detection_id": name, "session_id": session, "type": kind, "timestamp": t(10 * n + evidence), "evidence_end_time": t(10 * n + evidence),
              "detected_at": None if seen is None else t(10 * n + seen)}
    return tuple(values.get(field) for field in DETECTION.fieldNames())


def correlate(spark, trials, events, spans, alarms, scientific=True):
    sessions = spark.createDataFrame(spans, "session_id string, source_ip string, start_time timestamp, end_time timestamp")
    scored = X.correlate(frame(spark, *trials), make_events(spark, events), sessions, spark.createDataFrame(alarms, DETECTION), scientific)
    return {row.experiment_id: row for row in scored.collect()}


CONTROL = {"trial_kind": "control", "expected_detection": None}


@pytest.fixture(scope="module")
def scored(spark):
    trials = [
        trial(1), trial(2), trial(3, **CONTROL), trial(4, **CONTROL), trial(5, telemetry_settled=False), trial(6, ground_truth_valid=None, runner_status="failed"),
        trial(7, ground_truth_valid=False), trial(8), trial(9, runner_steps=[(1, "mqtt", t(95), t(91), "completed"), (2, "http", t(92), t(93), "completed")]),
    ]
    events = [hit(1, "1a", 1.5), hit(1, "1b", 3.5, 0.75), hit(1, "after", 6.5), hit(1, "other", 2, service="camera"), hit(1, "elsewhere", 2, target=MQTT)]
    events += [hit(n, f"{n}a", 2) for n in (2, 3, 4, 5, 6, 7)] + [hit(9, "9a", 2, -0.5)]
    spans = [span(1, "first", -2, 3), span(1, "second", 3.4, 9)] + [span(n, f"s{n}", 1, 4) for n in (2, 3, 4, 5, 6, 7, 9)]
    alarms = [
        alarm(1, "d1", "second", "MQTT_PROBING", 4, 5.5), alarm(1, "d1x", "first", "WEB_ENUMERATION", 2, 2.5), alarm(2, "d2", "s2", "RECONNAISSANCE", 3, 3),
        alarm(4, "d4", "s4", "BRUTE_FORCE", 3, None), alarm(9, "d9", "s9", "MQTT_PROBING", 3, None),
    ]
    return correlate(spark, trials, events, spans, alarms)


@pytest.mark.parametrize("name, result, reason", [
    ("T01", "TP", None), ("T02", "FN", None), ("T03", "TN", None), ("T04", "FP", None), ("T05", "INCONCLUSIVE", "SETTLE_TIMEOUT"),
    ("T06", "INCONCLUSIVE", "RUNNER_FAILED"), ("T07", "INCONCLUSIVE", "NO_GROUND_TRUTH"), ("T08", "INCONCLUSIVE", "NO_TELEMETRY"), ("T09", "TP", None),
])
def test_outcome_and_reason(scored, name, result, reason):
    assert (scored[name].result, scored[name].result_reason) == (result, reason)
    assert (scored[name].observed_detection is None) == (reason == "SETTLE_TIMEOUT")


def test_links_and_latencies_of_a_run_over_two_sessions(scored):
    row = scored["T01"]
    assert (row.matched_event_count, row.session_ids, row.detection_ids) == (2, ["first", "second"], ["d1", "d1x"])
    assert row.unexpected_detection_types == ["WEB_ENUMERATION"]
    assert (row.evidence_latency_seconds, row.detection_latency_seconds, row.processing_latency_seconds) == (240.0, 330.0, 90.0)
    assert (row.ingestion_latency_min_seconds, row.ingestion_latency_mean_seconds, row.ingestion_latency_max_seconds) == (15.0, 30.0, 45.0)
    assert row.observed_event_rate_eps == pytest.approx(2 / 120)
    assert (row.telemetry_step_count, row.telemetry_steps_covered, row.runner_duration_seconds, row.experiment_duration_seconds) == (1, 1, 240.0, 360.0)


def test_unusable_steps_and_times(scored):
    row = scored["T09"]
    assert (row.runner_step_count, row.telemetry_step_count, row.telemetry_step_coverage) == (2, None, None)
    assert (row.ingestion_latency_count, row.ingestion_latency_mean_seconds, row.detection_latency_seconds) == (0, None, None)


def test_an_id_that_repeats_on_another_day_links_one_session(spark):
    events = [hit(1, "twin", 2), hit(1, "twin", 2 + 24 * 60)]
    spans = [span(1, "today", 1, 3), span(1, "tomorrow", 24 * 60 + 1, 24 * 60 + 3)]
    row = correlate(spark, [trial(1)], events, spans, [alarm(1, "later", "tomorrow", "MQTT_PROBING", 1442, 1442)])["T01"]
    assert (row.session_ids, row.detection_ids, row.result) == (["today"], [], "FN")


def test_plain_mode_needs_no_ground_truth(spark):
    trials = [trial(1, target_honeypots=None, ground_truth_valid=None, telemetry_settled=False)]
    rows = correlate(spark, trials, [hit(1, "x", 1, service="camera")], [span(1, "s", 0, 2)], [alarm(1, "d", "s", "MQTT_PROBING", 1, 1)], scientific=False)
    assert (rows["T01"].result, rows["T01"].matched_event_count) == ("TP", 1)


def test_events_outside_all_runs_are_left_out_before_the_join(spark):
    runs = frame(spark, trial(1), trial(2))
    matched = X.match_events(runs, make_events(spark, [hit(1, "a", 1), hit(2, "b", 1), hit(3, "c", 1)]))
    assert "LeftSemi" in matched._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.event_id for r in matched.collect()) == ["a", "b"]


def cohort_frame(spark, scored, *names):
    empty = spark.createDataFrame([], "session_id string, source_ip string, start_time timestamp, end_time timestamp")
    schema = X.correlate(frame(spark), make_events(spark, [hit(1, "x", 1)]).limit(0), empty, spark.createDataFrame([], DETECTION)).schema
    return spark.createDataFrame([scored[name] for name in names], schema=schema)


def test_cohort_counts_and_ratios(spark, scored):
    rows = cohort_frame(spark, scored, *sorted(scored))
    overview = E.cohort_overview(rows).first()
    assert [overview[name] for name in ("tp", "fn", "fp", "tn", "inconclusive_experiments")] == [2, 1, 1, 1, 4]
    assert (overview.precision, overview.recall, overview.specificity, overview.accuracy) == (pytest.approx(2 / 3), pytest.approx(2 / 3), 0.5, 0.6)
    by_type = {r.detection_type: (r.tp, r.fn, r.fp, r.tn) for r in E.per_detection_type(rows).collect()}
    assert set(by_type) == set(DETECTION_TYPES)
    assert by_type["MQTT_PROBING"] == (2, 1, 0, 2) and by_type["BRUTE_FORCE"] == (0, 0, 1, 1)


def test_runs_without_a_cohort_have_a_reason(spark, scored):
    rows = cohort_frame(spark, scored, "T01", "T03")
    no_revision = rows.withColumns({"software_revision": F.lit("unknown"), E.COHORT: F.lit(None).cast("string")})
    no_types = rows.withColumn("observed_detection_types", F.lit(None).cast("array<string>"))
    for broken, reason in ((no_revision, "MISSING_SOFTWARE_REVISION"), (no_types, "LEGACY_INCOMPLETE")):
        assert E.cohort_overview(broken).count() == 0
        assert {r.evaluation_exclusion_reason for r in E.excluded_runs(broken).collect()} == {reason}


def test_fingerprints_under_another_schema_version_key(spark, scored):
    rows = cohort_frame(spark, scored, "T01").withColumn(E.COHORT, F.lit(None).cast("string"))
    default, other = (E.with_fingerprints(rows, key).first()[E.COHORT] for key in ("schema_version", "event_schema_version"))
    assert default != other and E.filter_runs(rows, fingerprint=other, schema_version_key="event_schema_version").count() == 1
    assert E.cohort_overview(E.with_fingerprints(rows, "event_schema_version")).first()[E.COHORT] == other


def test_exports_are_written_and_read_back(spark, scored, tmp_path):
    from decoyscope.sources import store

    rows = cohort_frame(spark, scored, "T01", "T02")
    store.export_csv(rows, str(tmp_path / "csv"))
    store.export_json(rows, str(tmp_path / "json"))
    want = E.export_rows(rows)
    csv = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert csv.columns == want.columns and {r.experiment_id: r.result for r in csv.collect()} == {"T01": "TP", "T02": "FN"}
    json_rows = spark.read.schema(want.schema).json(str(tmp_path / "json"))
    assert sorted(r.experiment_id for r in json_rows.collect()) == ["T01", "T02"]
    assert not any("password" in name or "username" in name for name in want.columns)


def test_cohorts_without_samples_keep_a_row(spark, scored):
    rows = cohort_frame(spark, scored, "T01", "T02")
    samples = spark.createDataFrame([("T01", "1a", 15.0), ("T01", "gone", None)], "experiment_id string, event_id string, sample double")
    found = {r.scenario_id: (r.sample_count, r.missing_or_invalid_count, r.mean) for r in E.ingestion_measurements(rows, samples, True).collect()}
    assert found == {"sweep-1": (1, 1, 15.0), "sweep-0": (0, 0, None)}


def test_ratios_are_null_where_nothing_was_counted(spark):
    counts = spark.createDataFrame([(3, 1, 2, 4), (0, 0, 0, 0), (0, 2, 0, 5)], "tp int, fn int, fp int, tn int")
    full, empty, missed = E.add_ratios(counts).collect()
    assert full.f1 == pytest.approx(6 / 9) and full.false_positive_rate == pytest.approx(1 / 3) and full.accuracy == 0.7
    assert {empty[name] for name in ("precision", "recall", "specificity", "accuracy", "f1")} == {None}
    assert (missed.precision, missed.recall, missed.f1, missed.specificity) == (None, 0.0, None, 1.0)


def test_ingestion_samples_of_stored_missing_and_early_events(spark):
    ids = spark.createDataFrame([("T01", name) for name in ("slow", "early", "gone")], "experiment_id string, event_id string")
    stored = make_events(spark, [hit(1, "slow", 1, 2), hit(1, "early", 1, -1)])
    assert {r.event_id: r.sample for r in X.ingestion_samples(ids, stored).collect()} == {"slow": 120.0, "early": None, "gone": None}


def test_settling_equals_a_walk_over_the_arrivals(spark):
    waits = {1: [], 2: [0.5], 3: [1, 3.9, 6.8, 12], 4: [x * 2.5 for x in range(12)], 5: [-40, 24.5], 6: [22], 7: [2, 5.0]}
    events = [hit(n, f"{n}-{i}", 5, 1 + x / 60) for n, xs in waits.items() for i, x in enumerate(xs)]

    def walk(xs):
        last = None
        for x in sorted(max(x, 0) for x in xs if x <= 25):
            if last is not None and x - last > 3:
                break
            last = x
        return (True, last + 3) if last is not None and last + 3 <= 25 else (False, 25.0)

    rows = X.settle_status(frame(spark, *(trial(n) for n in waits)), make_events(spark, events)).collect()
    assert {int(r.experiment_id[1:]): (r.telemetry_settled, pytest.approx(r.settle_wait_seconds)) for r in rows} == {n: walk(xs) for n, xs in waits.items()}


def test_collisions_equal_pairwise_counting(spark):
    windows = [(0, 4), (4, 9), (5, 5), (8, 30), (31, 40), (3000, 3001), (2, 3000)]
    trials = [trial(1, experiment_id=f"W{i}", start_time=t(a), end_time=t(b)) for i, (a, b) in enumerate(windows)] + [trial(2, start_time=t(0), end_time=t(99))]
    want = {f"W{i}": sum(a <= d and c <= b for j, (c, d) in enumerate(windows) if j != i) for i, (a, b) in enumerate(windows)}
    assert {r.experiment_id: r.overlapping_runs for r in X.collision_counts(frame(spark, *trials)).collect()} == {**want, "T02": 0}


def test_overlapping_sessions_equal_comparing_all(spark):
    spans = [(-30, -1), (-9, 0), (1, 2), (5, 70), (6, 6), (6.5, 8), (-5000, 5000)]
    sessions = spark.createDataFrame([span(1, f"s{i}", a, b) for i, (a, b) in enumerate(spans)], "session_id string, source_ip string, start_time timestamp, end_time timestamp")
    found = sorted(r.session_id for r in X.overlapping_sessions(frame(spark, trial(1)), sessions).collect())
    assert found == [f"s{i}" for i, (a, b) in enumerate(spans) if a <= 6 and b >= 0]


CONTRACT = [("mqtt", "completed"), ("http", "completed|rejected")]
GOOD = [(1, "mqtt", "completed"), (2, "http", "rejected")]


@pytest.mark.parametrize("changes, steps, rejection, valid", [
    ({}, GOOD, None, True),
    ({}, [GOOD[0], (2, "http", "failed")], None, False),
    ({"overall_status": "failed"}, GOOD, None, False),
    ({}, GOOD[:1], "step_contract_mismatch", None),
    ({}, GOOD[::-1], "step_contract_mismatch", None),
    ({}, [*GOOD, (3, "mqtt", "completed")], "step_contract_mismatch", None),
    ({"scenario_id": "another"}, GOOD, "scenario_mismatch", None),
    ({"scenario_manifest_sha256": "z"}, GOOD, "scenario_mismatch", None),
    ({"target": MQTT}, GOOD, "target_mismatch", None),
    ({"start_time": t(9)}, GOOD, "outside_window", None),
    ({"end_time": t(17)}, GOOD, "ends_after_experiment", None),
    ({"end_time": t(10)}, GOOD, "malformed_submission", None),
    ({"overall_status": "odd"}, GOOD, "malformed_submission", None),
    ({"experiment_id": "nobody"}, GOOD, "unknown_experiment", None),
    ({"run_id": "second"}, GOOD, "conflicting_run", None),
    ({"run_id": "again"}, GOOD, None, True),
])
def test_submissions_against_their_contract(spark, changes, steps, rejection, valid):
    run = {"run_id": "one", "experiment_id": "T01", "scenario_id": "sweep-1", "scenario_manifest_sha256": "m", "target": ROUTER, "source": "lab",
           "expected_detection": "MQTT_PROBING", "start_time": t(11), "end_time": t(15), "overall_status": "completed",
           "steps": [(n, service, t(12), t(13), status) for n, service, status in steps], **changes}
    submitted = spark.createDataFrame([tuple(run[name] for name in GROUND_TRUTH.fieldNames())], GROUND_TRUTH)
    contract = trial(1, status="running", scenario_step_services=[s for s, _ in CONTRACT], scenario_step_allowed_statuses=[a for _, a in CONTRACT])
    contracts = frame(spark, contract)
    if run["run_id"] != "one":  # a run was accepted before: the same one, or another
        earlier = F.struct(*[(F.lit("first") if name == "run_id" and run["run_id"] == "second" else F.col(name)).alias(name) for name in GROUND_TRUTH.fieldNames()])
        contracts = contracts.join(submitted.select("experiment_id", earlier.alias("ground_truth")), "experiment_id")
    row = X.check_ground_truth(submitted, contracts).first()
    assert (row.accepted, row.rejection, row.ground_truth_valid) == (rejection is None, rejection, valid)


def test_a_finished_run_takes_no_submission(spark):
    run = ("one", "T01", "sweep-1", "m", ROUTER, "lab", "MQTT_PROBING", t(11), t(15), "completed", [(1, "mqtt", t(12), t(13), "completed")])
    row = X.check_ground_truth(spark.createDataFrame([run], GROUND_TRUTH), frame(spark, trial(1))).first()
    assert row.rejection == "not_accepting"


@pytest.mark.parametrize("minute, covered", [(2, 1), (2 + 2 / 60, 1), (2 + 2.5 / 60, 0), (1 - 2 / 60, 1), (1 - 3 / 60, 0)])
def test_steps_are_covered_within_the_tolerance(spark, minute, covered):
    runs = frame(spark, trial(1))
    matched = X.match_events(runs, make_events(spark, [hit(1, "x", minute)]), carry=X.STEP_COLUMNS)
    assert X.step_coverage(matched, runs).first().telemetry_steps_covered == covered
