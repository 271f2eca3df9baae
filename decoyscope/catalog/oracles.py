"""The registered queries as SQL text for an independent engine (DuckDB dialect).

Written from the rules of the data model, not from the Spark plans: sessions here are plain
`lag` windows, matches plain range joins, percentiles `quantile_cont`. Doubles are rounded like in
`queries.comparable`: to six places after a shift of 1e-8, so exact halves agree between engines.
"""

from __future__ import annotations

from decoyscope.catalog.queries import (
    HISTOGRAM_QUERIES,
    RULE_QUERIES,
    SCORE_COLUMNS,
    TERM_QUERIES,
)
from decoyscope.schemas import DETECTION_TYPES, EXPORT_COLUMNS

ORACLES: dict[str, str] = {}

# Shared table expressions ---------------------------------------------------------------------

EV = """
base AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
served AS (
  SELECT *, ['cowrie','camera','iot-service','mqtt','router'][k % 5 + 1] AS service,
         event_type IN ('error','signup') AS is_login
  FROM base),
ev AS (
  SELECT event_id, ts, user_id, value, k, service, is_login,
         ts + to_microseconds(CAST(floor(value * 1000000) AS BIGINT) - 1000000) AS ingested,
         CASE WHEN user_id % 50 = 0 THEN '127.0.' ELSE '10.0.' END || (user_id // 250) || '.' || (user_id % 250 + 1) AS source_ip,
         '192.168.50.10' AS destination_ip,
         service || '-01' AS honeypot,
         CASE WHEN service = 'cowrie' THEN CASE WHEN k % 10 = 0 THEN 'ssh' ELSE 'telnet' END
              WHEN service IN ('camera','router') THEN 'http'
              WHEN service = 'iot-service' THEN 'tcp' ELSE 'mqtt' END AS protocol,
         CASE WHEN is_login THEN 'authentication'
              WHEN event_type = 'purchase' AND service = 'cowrie' THEN 'process'
              WHEN event_type = 'view' AND service IN ('camera','router') THEN 'web' ELSE 'network' END AS category,
         CASE WHEN is_login THEN 'login_attempt'
              WHEN event_type = 'purchase' AND service = 'cowrie' THEN 'command'
              WHEN event_type = 'view' AND service IN ('camera','router') THEN 'request' ELSE 'observe' END AS action,
         CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'success' ELSE 'unknown' END AS outcome,
         CASE WHEN is_login THEN CASE WHEN k < 25 THEN 'admin' WHEN k < 40 THEN 'root' ELSE 'user' || k END END AS username,
         CASE WHEN is_login THEN CASE WHEN k < 25 THEN 'admin' WHEN k < 40 THEN 'root' ELSE 'pw' || k END END AS password,
         CASE WHEN event_type = 'view' AND service IN ('camera','router') THEN '/p' || ((k // 5) % 8) END AS url,
         CASE WHEN event_type = 'purchase' AND service = 'cowrie' THEN 'cmd' || k END AS command,
         CASE WHEN service = 'mqtt' THEN ['connect','subscribe','publish','ping'][(k // 5) % 4 + 1] END AS mqtt_operation
  FROM served),
ext AS (SELECT * FROM ev WHERE source_ip NOT LIKE '127.%')"""

LABELLED = """
marked AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 THEN 1 ELSE 0 END AS opens
  FROM ext WINDOW w AS (PARTITION BY source_ip ORDER BY ts, event_id)),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY source_ip ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM marked),
started AS (SELECT *, min(ts) OVER (PARTITION BY source_ip, session_no) AS session_start FROM numbered),
lab AS (
  SELECT *, 'SES-' || substr(sha256(source_ip || '|' || strftime(session_start, '%Y-%m-%dT%H:%M:%S.%fZ')), 1, 16) AS session_id
  FROM started)"""

SESSIONS = """
sess AS (
  SELECT session_id, source_ip, min(ts) AS start_time, max(ts) AS end_time,
         round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 + 1e-8, 6) AS duration,
         array_to_string(list_sort(list(DISTINCT honeypot)), '|') AS honeypots_touched,
         array_to_string(list_sort(list(DISTINCT service)), '|') AS services_touched,
         array_to_string(list_sort(list(DISTINCT protocol)), '|') AS protocols,
         count(DISTINCT service) AS service_count, count(DISTINCT honeypot) AS honeypot_count,
         array_to_string(list_sort(list(DISTINCT service)), ', ') AS service_text,
         count(*) AS event_count,
         count(*) FILTER (category = 'authentication') AS authentication_attempts,
         count(*) FILTER (category = 'authentication' AND outcome = 'failure') AS failed_authentication_attempts,
         count(*) FILTER (category = 'authentication' AND username IS NOT NULL) AS credential_count,
         count(command) AS command_count, count(url) AS url_count, count(DISTINCT url) AS distinct_url_count,
         count(*) FILTER ((username, password) IN (('admin','admin'),('admin','password'),('root','root'),('admin','1234'))) AS weak_credential_count,
         count(*) FILTER (protocol = 'mqtt') AS mqtt_event_count,
         count(*) FILTER (protocol = 'mqtt' AND mqtt_operation IN ('subscribe','publish','unsubscribe','ping')) AS mqtt_active_count,
         count(*) FILTER (service = 'iot-service' AND protocol = 'tcp') AS iot_probe_count,
         '1' AS schema_version
  FROM lab GROUP BY session_id, source_ip)"""

_RULES = (
    ("failed_authentication_attempts >= 5", "BRUTE_FORCE", "high", "auth-failures-v1", "failed_authentication_attempts",
     "failed_authentication_attempts || ' authentication failures occurred in one session (threshold 5).'"),
    ("weak_credential_count >= 1", "DEFAULT_CREDENTIALS", "high", "default-credentials-v1", "weak_credential_count",
     "weak_credential_count || ' known default credential pair(s) attempted.'"),
    ("distinct_url_count >= 4", "WEB_ENUMERATION", "medium", "web-paths-v1", "event_count",
     "distinct_url_count || ' distinct web paths requested (threshold 4).'"),
    ("command_count >= 1", "COMMAND_INTERACTION", "high", "command-v1", "event_count",
     "command_count || ' command interaction(s) recorded.'"),
    ("mqtt_event_count >= 2 OR mqtt_active_count >= 1", "MQTT_PROBING", "medium", "mqtt-v2", "mqtt_event_count",
     "mqtt_event_count || ' MQTT operation(s) observed.'"),
    ("service_count >= 3", "MULTI_SERVICE_ACTIVITY", "high", "multi-service-v1", "event_count",
     "'Source touched ' || service_count || ' services: ' || service_text || '.'"),
    ("failed_authentication_attempts >= 1 AND (url_count >= 1 OR command_count >= 1) AND service_count >= 2",
     "MULTI_STAGE_ATTACK", "critical", "multi-stage-v1", "event_count",
     "'Authentication activity was followed by interaction across multiple services.'"),
    ("iot_probe_count >= 3", "RECONNAISSANCE", "low", "recon-v2", "iot_probe_count",
     "iot_probe_count || ' IoT probe interactions occurred.'"),
)
FOUND = "found AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT session_id, source_ip, start_time AS session_start, end_time, event_count AS events_in_session, "
    f"'{kind}' AS type, '{severity}' AS severity, '{rule}' AS rule_id, {evidence} AS evidence_count, {reason} AS reason "
    f"FROM sess WHERE {fires}"
    for fires, kind, severity, rule, evidence, reason in _RULES
) + ")"
DETECTIONS = FOUND + """,
det AS (
  SELECT 'DET-' || substr(sha256(session_id || ':' || rule_id), 1, 16) AS detection_id, session_id, source_ip, type, severity,
         end_time AS "timestamp", end_time AS evidence_end_time, end_time + to_seconds(events_in_session) AS detected_at,
         reason, rule_id, CAST(evidence_count AS BIGINT) AS evidence_count, session_start, '1' AS schema_version
  FROM found)"""

_TYPES = ",".join(f"'{t}'" for t in DETECTION_TYPES)
RUNS = f"""
runs AS (
  SELECT c_custkey AS n, 'EXP-' || c_custkey AS experiment_id, c_name AS name, 'scenario-' || (c_custkey % 8) AS scenario_id,
         CASE WHEN c_custkey % 5 = 0 THEN 'control' ELSE 'attack' END AS trial_kind,
         CASE WHEN c_custkey % 5 <> 0 THEN [{_TYPES}][c_custkey % 8 + 1] END AS expected_detection,
         CASE WHEN c_custkey % 17 = 0 THEN 'cancelled' ELSE 'completed' END AS status,
         CASE WHEN c_custkey // 10 % 50 = 0 THEN '127.0.' ELSE '10.0.' END || (c_custkey // 10 // 250) || '.' || (c_custkey // 10 % 250 + 1) AS attacker_ip,
         '192.168.50.10' AS target_ip, c_custkey % 3 = 0 AS any_service,
         TIMESTAMP '2024-01-01' + to_seconds(c_custkey % 29 * 86400) AS start_time,
         TIMESTAMP '2024-01-01' + to_seconds(c_custkey % 29 * 86400 + 86400) AS end_time,
         TIMESTAMP '2024-01-01' + to_seconds(c_custkey % 29 * 86400 - c_custkey) AS created_at,
         CAST(c_custkey % 600 AS DOUBLE) AS runner_duration_seconds,
         c_custkey % 11 <> 0 AS ground_truth_valid, c_custkey % 13 <> 0 AS telemetry_settled,
         CAST(3 + c_custkey % 7 AS DOUBLE) AS settle_wait_seconds,
         CASE WHEN c_custkey % 11 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'failed' ELSE 'partial' END ELSE 'completed' END AS runner_status,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unknown' ELSE c_mktsegment END AS software_revision,
         'BATCH-' || (c_custkey % 3) AS evaluation_batch_id, CAST(c_custkey % 4 + 1 AS INTEGER) AS replicate,
         sha256('scenario-' || (c_custkey % 8)) AS scenario_manifest_sha256,
         CASE WHEN c_custkey % 41 <> 0 AND c_mktsegment <> 'MACHINERY' THEN sha256(
           '{{"brute_force_threshold":5,"detector_ruleset_version":"2","multi_service_threshold":3,"schema_version":"1",'
           || '"session_timeout_seconds":300,"software_revision":"' || c_mktsegment || '","web_enumeration_threshold":4}}') END AS fingerprint
  FROM customer)"""

MATCHED = """
matched AS (
  SELECT r.experiment_id, e.event_id, e.ts, e.ingested, e.service
  FROM runs r JOIN ext e ON e.source_ip = r.attacker_ip AND e.destination_ip = r.target_ip
   AND e.ts BETWEEN r.start_time AND r.end_time
  WHERE r.any_service OR e.service IN ('cowrie','camera','mqtt'))"""

LINKS = """
member AS (SELECT DISTINCT event_id, session_id FROM lab),
links AS (SELECT DISTINCT m.experiment_id, l.session_id FROM matched m JOIN member l USING (event_id)),
linked AS (SELECT k.experiment_id, d.* FROM links k JOIN det d USING (session_id))"""

COVERAGE = """
steps AS (
  SELECT experiment_id, s.step, s.honeypot,
         start_time + to_seconds(s.step * 14400) AS started_at,
         start_time + to_seconds(s.step * 14400 + CASE WHEN n % 37 = 0 THEN -1 ELSE 7200 END) AS ended_at
  FROM runs, (VALUES (1, 'cowrie'), (2, 'camera'), (3, 'mqtt')) AS s(step, honeypot)),
covered AS (
  SELECT experiment_id, count(*) AS hits FROM steps s WHERE EXISTS (
    SELECT 1 FROM matched m WHERE m.experiment_id = s.experiment_id AND m.service = s.honeypot
     AND m.ts BETWEEN s.started_at - INTERVAL 2 SECOND AND s.ended_at + INTERVAL 2 SECOND)
  GROUP BY experiment_id),
coverage AS (
  SELECT experiment_id, CAST(3 AS BIGINT) AS runner_step_count,
         CASE WHEN ground_truth_valid AND n % 37 <> 0 THEN CAST(3 AS BIGINT) END AS telemetry_step_count,
         CASE WHEN ground_truth_valid AND n % 37 <> 0 THEN coalesce(hits, 0) END AS telemetry_steps_covered,
         CASE WHEN ground_truth_valid AND n % 37 <> 0 THEN round(coalesce(hits, 0) / 3.0 + 1e-8, 6) END AS telemetry_step_coverage
  FROM runs LEFT JOIN covered USING (experiment_id))"""


def _scored(scientific: bool) -> str:
    settled = "(SELECT * FROM matched WHERE experiment_id IN (SELECT experiment_id FROM runs WHERE telemetry_settled))"
    matched = settled if scientific else "matched"
    return f"""
used AS (SELECT *, (epoch_us(ingested) - epoch_us(ts)) / 1000000.0 AS delay FROM {matched}),
used_links AS (SELECT DISTINCT m.experiment_id, l.session_id FROM used m JOIN member l USING (event_id)),
used_found AS (SELECT k.experiment_id, d.* FROM used_links k JOIN det d USING (session_id)),
facts AS (
  SELECT experiment_id, count(*) AS matched_event_count, min(ts) AS first_event_at, max(ts) AS last_event_at,
         min(ingested) AS first_event_ingested_at, max(ingested) AS last_event_ingested_at,
         count(*) FILTER (delay >= 0) AS ingestion_latency_count,
         min(delay) FILTER (delay >= 0) AS lat_min, avg(delay) FILTER (delay >= 0) AS lat_mean,
         quantile_cont(delay, 0.5) FILTER (delay >= 0) AS lat_p50, quantile_cont(delay, 0.95) FILTER (delay >= 0) AS lat_p95,
         max(delay) FILTER (delay >= 0) AS lat_max
  FROM used GROUP BY experiment_id),
link_facts AS (
  SELECT experiment_id, count(*) AS linked_session_count, array_to_string(list_sort(list(session_id)), '|') AS session_ids
  FROM used_links GROUP BY experiment_id),
det_facts AS (
  SELECT f.experiment_id, count(*) AS linked_detection_count,
         array_to_string(list_sort(list(detection_id)), '|') AS detection_ids,
         list_sort(list(DISTINCT type)) AS observed,
         list_sort(coalesce(list(DISTINCT type) FILTER (type IS DISTINCT FROM r.expected_detection), [])) AS unexpected,
         arg_min(evidence_end_time, (detected_at, detection_id)) FILTER (type = r.expected_detection) AS evidence_at,
         arg_min(detected_at, (detected_at, detection_id)) FILTER (type = r.expected_detection) AS seen_at
  FROM used_found f JOIN runs r USING (experiment_id) GROUP BY f.experiment_id),
joined AS (
  SELECT r.*, c.runner_step_count,
         {"CASE WHEN r.telemetry_settled OR c.telemetry_step_count IS NULL THEN c.telemetry_steps_covered ELSE 0 END" if scientific else "c.telemetry_steps_covered"} AS telemetry_steps_covered,
         c.telemetry_step_count,
         {"CASE WHEN r.telemetry_settled OR c.telemetry_step_count IS NULL THEN c.telemetry_step_coverage ELSE 0 END" if scientific else "c.telemetry_step_coverage"} AS telemetry_step_coverage,
         coalesce(f.matched_event_count, 0) AS matched_event_count, f.first_event_at, f.last_event_at,
         f.first_event_ingested_at, f.last_event_ingested_at, coalesce(f.ingestion_latency_count, 0) AS ingestion_latency_count,
         f.lat_min, f.lat_mean, f.lat_p50, f.lat_p95, f.lat_max,
         coalesce(l.linked_session_count, 0) AS linked_session_count, coalesce(l.session_ids, '') AS session_ids,
         coalesce(d.linked_detection_count, 0) AS linked_detection_count, coalesce(d.detection_ids, '') AS detection_ids,
         coalesce(d.observed, []) AS observed, coalesce(d.unexpected, []) AS unexpected,
         (epoch_us(d.evidence_at) - epoch_us(r.start_time)) / 1000000.0 AS evidence_s,
         (epoch_us(d.seen_at) - epoch_us(r.start_time)) / 1000000.0 AS seen_s,
         (epoch_us(d.seen_at) - epoch_us(d.evidence_at)) / 1000000.0 AS processing_s,
         (epoch_us(f.last_event_at) - epoch_us(f.first_event_at)) / 1000000.0 AS span_s,
         CASE WHEN r.trial_kind = 'control' THEN coalesce(d.linked_detection_count, 0) > 0 ELSE d.evidence_at IS NOT NULL END AS is_observed
  FROM runs r JOIN coverage c USING (experiment_id) LEFT JOIN facts f USING (experiment_id)
  LEFT JOIN link_facts l USING (experiment_id) LEFT JOIN det_facts d USING (experiment_id)),
reasoned AS (
  SELECT *, CASE WHEN NOT telemetry_settled THEN 'SETTLE_TIMEOUT'
                 WHEN NOT ground_truth_valid AND runner_status IN ('failed','partial') THEN 'RUNNER_FAILED'
                 WHEN NOT ground_truth_valid THEN 'NO_GROUND_TRUTH'
                 WHEN matched_event_count = 0 THEN 'NO_TELEMETRY' END AS result_reason
  FROM joined),
scored AS (
  SELECT *, CASE WHEN result_reason IS NOT NULL THEN 'INCONCLUSIVE'
                 WHEN trial_kind = 'control' THEN CASE WHEN is_observed THEN 'FP' ELSE 'TN' END
                 ELSE CASE WHEN is_observed THEN 'TP' ELSE 'FN' END END AS result,
         CASE WHEN telemetry_settled THEN is_observed END AS observed_detection,
         array_to_string(observed, '|') AS observed_detection_types, array_to_string(unexpected, '|') AS unexpected_detection_types,
         round(CASE WHEN evidence_s >= 0 THEN evidence_s END + 1e-8, 6) AS evidence_latency_seconds,
         round(CASE WHEN seen_s >= 0 THEN seen_s END + 1e-8, 6) AS detection_latency_seconds,
         round(CASE WHEN processing_s >= 0 THEN processing_s END + 1e-8, 6) AS processing_latency_seconds,
         CAST(86400 AS DOUBLE) AS experiment_duration_seconds,
         round(CASE WHEN matched_event_count >= 2 AND span_s > 0 THEN matched_event_count / span_s END + 1e-8, 6) AS observed_event_rate_eps,
         CASE WHEN matched_event_count >= 2 AND span_s > 0 THEN matched_event_count / span_s END AS rate,
         round(lat_min + 1e-8, 6) AS ingestion_latency_min_seconds, round(lat_mean + 1e-8, 6) AS ingestion_latency_mean_seconds,
         round(lat_p50 + 1e-8, 6) AS ingestion_latency_p50_seconds, round(lat_p95 + 1e-8, 6) AS ingestion_latency_p95_seconds,
         round(lat_max + 1e-8, 6) AS ingestion_latency_max_seconds, '2' AS detector_ruleset_version,
         fingerprint AS evaluation_config_fingerprint
  FROM reasoned)"""


SCORED = ",".join([EV, LABELLED, SESSIONS, DETECTIONS, RUNS, MATCHED, LINKS, COVERAGE, _scored(True)])
COHORT = """
cohort AS (SELECT * FROM scored WHERE status = 'completed' AND fingerprint IS NOT NULL)"""
IN_SESSIONS = ",".join([EV, LABELLED, SESSIONS])
IN_DETECTIONS = ",".join([IN_SESSIONS, DETECTIONS])
IN_MATCHES = ",".join([EV, RUNS, MATCHED])


def oracle(name: str, tables: str, select: str) -> None:
    ORACLES[name] = f"WITH {tables}\n{select}"


# Sessions and detections ----------------------------------------------------------------------

oracle("sessions_gap", IN_SESSIONS, "SELECT session_id, source_ip, start_time, end_time, duration, event_count FROM sess")
_FLAGS = "authentication_attempts, failed_authentication_attempts, credential_count, weak_credential_count, mqtt_event_count, mqtt_active_count, iot_probe_count"
oracle("session_window_sessions", IN_SESSIONS,
       f"SELECT session_id, source_ip, start_time, end_time, event_count, command_count, url_count, {_FLAGS} FROM sess")
oracle("session_rollup", IN_SESSIONS, "SELECT * EXCLUDE (service_count, honeypot_count, service_text) FROM sess")
oracle("session_members", ",".join([EV, LABELLED]), "SELECT session_id, source_ip, ts, event_id FROM lab")
oracle("session_credentials", ",".join([EV, LABELLED]),
       "SELECT session_id, ts, event_id, username, password FROM lab WHERE category = 'authentication' AND username IS NOT NULL")
oracle("session_commands", ",".join([EV, LABELLED]), "SELECT session_id, ts, event_id, command FROM lab WHERE command IS NOT NULL")
oracle("session_urls", ",".join([EV, LABELLED]), "SELECT session_id, ts, event_id, url FROM lab WHERE url IS NOT NULL")
oracle("sessions_ordered", IN_SESSIONS, "SELECT start_time, source_ip, session_id FROM sess ORDER BY start_time, source_ip")
oracle("session_top_recent", IN_SESSIONS,
       "SELECT session_id, source_ip, start_time, event_count FROM sess ORDER BY start_time DESC, session_id LIMIT 200")
for _name, _kind in RULE_QUERIES.items():
    oracle(_name, IN_DETECTIONS, f"SELECT * FROM det WHERE type = '{_kind}'")
for _name, _column, _size in (("detections_by_type", "type", 16), ("detections_by_severity", "severity", 8)):
    oracle(_name, IN_DETECTIONS,
           f"SELECT {_column} AS name, count(*) AS count FROM det GROUP BY 1 ORDER BY count DESC, name LIMIT {_size}")
oracle("detection_evidence", IN_DETECTIONS, """
SELECT d.detection_id, d.session_id, d.rule_id, e.event_id, e.ts FROM det d JOIN lab e USING (session_id)
WHERE CASE d.rule_id
  WHEN 'auth-failures-v1' THEN e.category = 'authentication' AND e.outcome = 'failure'
  WHEN 'default-credentials-v1' THEN (e.username, e.password) IN (('admin','admin'),('admin','password'),('root','root'),('admin','1234'))
  WHEN 'mqtt-v2' THEN e.protocol = 'mqtt'
  WHEN 'recon-v2' THEN e.service = 'iot-service' AND e.protocol = 'tcp'
  ELSE true END""")
oracle("first_seen_kept", IN_DETECTIONS,
       "SELECT detection_id, severity, CASE WHEN severity <> 'high' THEN evidence_end_time ELSE detected_at END AS detected_at FROM det")
oracle("recent_detections", IN_DETECTIONS,
       'SELECT detection_id, type, "timestamp", source_ip FROM det ORDER BY "timestamp" DESC, detection_id LIMIT 200')
_SHOWN = 'shown AS (SELECT * FROM det ORDER BY "timestamp" DESC, detection_id LIMIT {n})'
oracle("overview_detections", ",".join([
    IN_DETECTIONS, _SHOWN.format(n=8), "newest AS (SELECT session_id, source_ip FROM sess ORDER BY start_time DESC, session_id LIMIT 10)"]),
    "SELECT d.detection_id, d.session_id, s.source_ip FROM shown d LEFT JOIN newest s USING (session_id)")
oracle("detections_with_source", ",".join([IN_DETECTIONS, _SHOWN.format(n=200)]),
       "SELECT d.detection_id, d.session_id, s.source_ip FROM shown d LEFT JOIN sess s USING (session_id)")

# Dashboards -----------------------------------------------------------------------------------

for _name, _interval in HISTOGRAM_QUERIES.items():
    oracle(_name, EV, f"SELECT time_bucket(INTERVAL '{_interval}', ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS count FROM ext GROUP BY 1")
oracle("histogram_peak", EV, "SELECT max(n) AS peak FROM (SELECT count(*) AS n FROM ext GROUP BY time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01'))")
oracle("recent_window_events", EV, """
SELECT time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS count
FROM ext WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1""")
oracle("unique_sources", EV, "SELECT count(DISTINCT source_ip) AS unique_sources FROM ext")
_FLAT = {"honeypot.id": "honeypot", "network.protocol": "protocol", "event.category": "category", "event.action": "action",
         "event.outcome": "outcome", "source.ip": "source_ip"}
for _name, (_field, _size) in TERM_QUERIES.items():
    oracle(_name, EV, f"SELECT {_FLAT[_field]} AS name, count(*) AS count FROM ext GROUP BY 1 ORDER BY count DESC, name LIMIT {_size}")
oracle("auth_outcomes", EV,
       "SELECT outcome AS name, count(*) AS count FROM ext WHERE category = 'authentication' GROUP BY 1 ORDER BY count DESC, name LIMIT 5")
oracle("bar_shares", EV, """
SELECT name, count, round(count / max(count) OVER () + 1e-8, 6) AS share
FROM (SELECT action AS name, count(*) AS count FROM ext GROUP BY 1 ORDER BY count DESC, name LIMIT 10)""")
MATRIX = """
leaders AS (SELECT source_ip FROM ext GROUP BY 1 ORDER BY count(*) DESC, source_ip LIMIT 8),
cells AS (SELECT source_ip AS source, honeypot, count(*) AS count FROM ext WHERE source_ip IN (SELECT source_ip FROM leaders) GROUP BY 1, 2)"""
oracle("source_honeypot_matrix", ",".join([EV, MATRIX]), "SELECT source, honeypot, count FROM cells")
oracle("matrix_intensity", ",".join([EV, MATRIX]), """
SELECT s.source, h.honeypot, coalesce(c.count, 0) AS count,
       round(coalesce(c.count, 0) / greatest((SELECT max(count) FROM cells), 1) + 1e-8, 6) AS intensity
FROM (SELECT DISTINCT source FROM cells) s
CROSS JOIN (SELECT honeypot FROM ext GROUP BY 1 ORDER BY count(*) DESC, honeypot LIMIT 10) h
LEFT JOIN cells c ON c.source = s.source AND c.honeypot = h.honeypot""")
oracle("totals", IN_DETECTIONS, """
SELECT 'events' AS name, count(*) AS total FROM ext
UNION ALL SELECT 'unique_sources', count(DISTINCT source_ip) FROM ext
UNION ALL SELECT 'sessions', count(*) FROM sess
UNION ALL SELECT 'failed_auth_attempts', CAST(sum(failed_authentication_attempts) AS BIGINT) FROM sess
UNION ALL SELECT 'multi_honeypot_sessions', count(*) FROM sess WHERE honeypot_count > 1
UNION ALL SELECT 'detections', count(*) FROM det""")
REASONED = """
verdicts AS (
  SELECT *, CASE WHEN k = 13 THEN 'json_parse_failure'
                 WHEN k = 19 AND service <> 'cowrie' THEN 'unresolved_interpolation'
                 WHEN k = 17 THEN 'invalid_source_ip'
                 WHEN k = 29 AND service <> 'cowrie' THEN 'invalid_event_category_'
                 WHEN k = 23 THEN 'invalid_port' END AS reason,
         CASE WHEN service = 'cowrie' AND category NOT IN ('authentication','process') THEN 'session' ELSE category END AS kept_category,
         CASE WHEN service = 'cowrie' AND category NOT IN ('authentication','process') THEN 'cowrie.session.connect' ELSE action END AS kept_action,
         CASE WHEN service <> 'cowrie' THEN event_id ELSE
           CASE WHEN is_login THEN CASE WHEN outcome = 'failure' THEN 'cowrie.login.failed' ELSE 'cowrie.login.success' END
                WHEN category = 'process' THEN 'cowrie.command.input' ELSE 'cowrie.session.connect' END
           || '-' || event_id || '-' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS kept_id
  FROM ev)"""
oracle("table_counts", ",".join([IN_DETECTIONS, RUNS, REASONED]), """
SELECT 'events' AS table_name, count(*) AS rows FROM ev UNION ALL SELECT 'sessions', count(*) FROM sess
UNION ALL SELECT 'detections', count(*) FROM det UNION ALL SELECT 'experiments', count(*) FROM runs
UNION ALL SELECT 'dead_letters', count(*) FROM verdicts WHERE reason IS NOT NULL""")
oracle("fleet_counts", EV, """
SELECT f.honeypot, f.display_name, coalesce(c.n, 0) AS event_count, round(coalesce(c.n, 0) / max(c.n) OVER () + 1e-8, 6) AS share
FROM (VALUES ('cowrie','Cowrie SSH/Telnet'),('camera','IP Camera'),('iot-service','IoT TCP Device'),('mqtt','MQTT Broker'),('router','Router Admin')) f(honeypot, display_name)
LEFT JOIN (SELECT honeypot, count(*) AS n FROM ev GROUP BY 1) c ON c.honeypot = f.honeypot || '-01'""")
oracle("event_search", EV, """
SELECT event_id, ts, source_ip, username FROM ev
WHERE honeypot = 'cowrie-01' AND protocol = 'telnet' AND category = 'authentication' AND outcome = 'failure' AND ts >= TIMESTAMP '2024-01-01'
ORDER BY ts DESC, event_id LIMIT 500""")
oracle("recent_events", EV, "SELECT event_id, ts, source_ip, action FROM ev ORDER BY ts DESC, event_id LIMIT 100")
oracle("internal_events", EV,
       "SELECT source_ip LIKE '127.%' AS internal, source_ip LIKE '127.%' AS loopback, count(*) AS count FROM ev GROUP BY 1, 2")
LEGACY = "legacy AS (SELECT source_ip, CAST(ts AS DATE) AS day, count(*) AS n FROM ev GROUP BY 1, 2)"
oracle("internal_cleanup", ",".join([EV, LEGACY]), """
SELECT 'sessions' AS table_name, count(*) AS rows FROM legacy WHERE source_ip LIKE '127.%'
UNION ALL SELECT 'detections', count(*) FROM legacy WHERE source_ip LIKE '127.%' AND n > 3""")
oracle("cleaned_derived", ",".join([EV, LEGACY]), "SELECT source_ip, day, n FROM legacy WHERE source_ip NOT LIKE '127.%'")
_VIEW = """SELECT * EXCLUDE (category) FROM (
  SELECT ts, CASE WHEN k <> 37 THEN source_ip END AS source_ip, CASE WHEN k <> 31 THEN honeypot END AS honeypot_id,
         CASE WHEN k <> 41 THEN protocol END AS network_protocol, CASE WHEN k <> 43 THEN action END AS event_action,
         outcome AS event_outcome, service || ' ' || action AS message, category FROM ev) WHERE """
for _name, _where in {
    "event_overview": "true", "honeypot_activity": "honeypot_id IS NOT NULL", "source_ip_analysis": "source_ip IS NOT NULL",
    "protocol_distribution": "network_protocol IS NOT NULL", "attack_timeline": "event_action IS NOT NULL",
    "authentication_attempts": "category = 'authentication'",
}.items():
    oracle(f"saved_view_{_name}", EV, _VIEW + _where)
oracle("saved_view_experiments", SCORED, "SELECT experiment_id, name, scenario_id, status, result FROM scored")
oracle("recent_experiments", RUNS, "SELECT experiment_id, created_at, status FROM runs ORDER BY created_at DESC, experiment_id LIMIT 200")
oracle("events_by_ids", IN_MATCHES, "SELECT event_id, ts, service FROM ev WHERE event_id IN (SELECT event_id FROM matched)")
oracle("event_lookup", EV, "SELECT event_id, ts, source_ip FROM ev WHERE event_id = '77'")

# Ingest ---------------------------------------------------------------------------------------

oracle("normalize_events", ",".join([EV, REASONED]),
       "SELECT reason, CASE WHEN reason = 'json_parse_failure' AND service <> 'cowrie' THEN NULL ELSE service END AS service, count(*) AS count FROM verdicts GROUP BY 1, 2")
oracle("valid_events", ",".join([EV, REASONED]), """
SELECT kept_id AS event_id, ts, ingested, kept_category AS category, 'info' AS type, kept_action AS action, outcome,
       source_ip, CAST(k + 40000 AS INTEGER) AS source_port, destination_ip,
       CASE WHEN service <> 'cowrie' THEN 80 WHEN protocol = 'telnet' THEN 2223 ELSE 2222 END AS destination_port,
       protocol, service, honeypot,
       CASE WHEN service = 'cowrie' THEN 'ssh_telnet' ELSE replace(service, '-', '_') END AS honeypot_type,
       source_ip LIKE '127.%' AS internal, CASE WHEN source_ip LIKE '127.%' THEN 'loopback_source' END AS internal_reason,
       username, password, url, command, mqtt_operation,
       CASE WHEN mqtt_operation IS NOT NULL THEN k % 15 END AS packet_type,
       CASE WHEN service = 'cowrie' THEN 'seen' ELSE service || ' ' || action END AS message
FROM verdicts WHERE reason IS NULL""")
oracle("dead_letters", ",".join([EV, REASONED]), """
SELECT ingested AS seen_at, CASE WHEN reason = 'json_parse_failure' THEN 'parse_failure' ELSE 'validation_failure' END AS tags,
       reason, 'sensor-01' AS sensor_id, CAST(CASE WHEN reason = 'json_parse_failure' THEN ingested ELSE ts END AS DATE) AS day
FROM verdicts WHERE reason IS NOT NULL""")
oracle("scan_sensor_files", ",".join([EV, REASONED]), """
SELECT kept_id AS event_id, ts, kept_category AS category, kept_action AS action, source_ip, protocol, service, honeypot
FROM verdicts WHERE reason IS NULL""")
oracle("dead_letter_reasons", ",".join([EV, REASONED]),
       "SELECT reason, count(*) AS count FROM verdicts WHERE reason IS NOT NULL GROUP BY 1")
oracle("normalize_lenient", EV, """
SELECT CASE WHEN k = 13 THEN 'missing_time_or_address' WHEN k = 17 THEN 'invalid_address' END AS reason,
       CASE WHEN k = 13 THEN CASE WHEN service = 'cowrie' THEN 'session' ELSE 'network' END
            WHEN k = 29 AND service <> 'cowrie' THEN 'bogus'
            WHEN service = 'cowrie' AND category = 'network' THEN 'session' ELSE category END AS category,
       CASE WHEN k = 13 THEN 'observe' ELSE action END AS action,
       CASE WHEN k = 13 THEN 'unknown' ELSE outcome END AS outcome,
       CASE WHEN k = 13 THEN CASE WHEN service = 'cowrie' THEN 'ssh' END
            WHEN k = 19 AND service <> 'cowrie' THEN NULL ELSE protocol END AS protocol,
       count(*) AS count
FROM ev GROUP BY 1, 2, 3, 4, 5""")
oracle("dedupe_events", EV, "SELECT event_id, ts, ingested + INTERVAL 1 HOUR AS ingested, category FROM ev")
oracle("latest_versions", EV, """
SELECT source_ip, ts, event_id, action FROM ev
QUALIFY row_number() OVER (PARTITION BY source_ip ORDER BY ts DESC, event_id DESC, action DESC) = 1""")
oracle("classify_interactions", EV, """
SELECT event_id,
       CASE WHEN is_login THEN 'authentication' WHEN protocol = 'http' THEN 'web' ELSE 'network' END AS category, 'info' AS type,
       CASE WHEN is_login THEN 'login_attempt' WHEN mqtt_operation IS NOT NULL THEN mqtt_operation
            WHEN k % 3 <> 0 THEN 'request' ELSE 'connect' END AS action,
       CASE WHEN is_login AND service = 'iot-service' THEN CASE WHEN k < 25 AND k % 7 <> 0 THEN 'success' ELSE 'failure' END
            WHEN is_login AND service IN ('camera','router') THEN CASE WHEN k < 25 THEN 'success' ELSE 'failure' END
            WHEN is_login THEN 'failure' ELSE 'unknown' END AS outcome,
       honeypot AS honeypot_id, replace(service, '-', '_') AS honeypot_type,
       service || ' ' || coalesce(mqtt_operation, CASE WHEN service = 'iot-service' AND is_login THEN 'auth' END,
                                  CASE WHEN url IS NOT NULL THEN 'GET' END, 'interaction') AS summary
FROM ev""")

# Experiments ----------------------------------------------------------------------------------

oracle("match_events", IN_MATCHES, "SELECT experiment_id, event_id, ts, ingested, service FROM matched")
oracle("experiment_event_ids", IN_MATCHES, "SELECT DISTINCT experiment_id, event_id FROM matched")
oracle("overlap_sessions", ",".join([IN_SESSIONS, RUNS]), """
SELECT r.experiment_id, s.session_id FROM runs r
JOIN sess s ON s.source_ip = r.attacker_ip AND s.start_time <= r.end_time AND s.end_time >= r.start_time""")
_LINKED = ",".join([IN_DETECTIONS, RUNS, MATCHED, LINKS])
oracle("link_sessions", _LINKED, "SELECT experiment_id, session_id FROM links")
oracle("link_detections", _LINKED, "SELECT experiment_id, session_id, detection_id, type FROM linked")
oracle("step_coverage", ",".join([IN_MATCHES, COVERAGE]), "SELECT * FROM coverage")
oracle("score_experiments", SCORED, f"SELECT {', '.join(SCORE_COLUMNS)} FROM scored")
oracle("score_unscientific", ",".join([EV, LABELLED, SESSIONS, DETECTIONS, RUNS, MATCHED, LINKS, COVERAGE, _scored(False)]),
       "SELECT experiment_id, CASE WHEN is_observed THEN 'TP' ELSE 'FN' END AS result, is_observed AS observed_detection, matched_event_count FROM joined")
oracle("overlapping_experiments", RUNS, """
SELECT a.experiment_id, count(b.experiment_id) AS overlapping_runs FROM runs a
LEFT JOIN runs b ON b.attacker_ip = a.attacker_ip AND b.target_ip = a.target_ip AND b.experiment_id <> a.experiment_id
 AND b.start_time <= a.end_time AND b.end_time >= a.start_time
GROUP BY a.experiment_id""")
oracle("ground_truth_checks", RUNS, """
SELECT experiment_id, 'RUN-' || n AS run_id, rejection IS NULL AS accepted, rejection,
       CASE WHEN rejection IS NULL THEN runner_status = 'completed' END AS ground_truth_valid, runner_status
FROM (SELECT *, CASE
        WHEN n % 37 = 0 THEN 'malformed_submission'
        WHEN status = 'cancelled' THEN 'not_accepting'
        WHEN n % 19 = 0 THEN 'scenario_mismatch'
        WHEN n % 29 = 0 THEN 'target_mismatch'
        WHEN n % 31 = 0 THEN 'outside_window'
        WHEN n % 43 = 0 THEN 'ends_after_experiment'
        WHEN n % 53 = 0 THEN 'conflicting_run'
        WHEN n % 23 = 0 THEN 'step_contract_mismatch' END AS rejection
      FROM runs)
UNION ALL SELECT 'EXP-none-' || n, 'RUN-' || n, false, 'unknown_experiment', NULL, runner_status FROM runs WHERE n % 47 = 0""")
oracle("run_status_rollup", RUNS,
       "SELECT experiment_id, CASE WHEN ground_truth_valid THEN 'completed' ELSE 'partial' END AS overall_status FROM runs")
oracle("cidr_hosts", EV + """,
addresses AS (
  SELECT DISTINCT source_ip AS address, list_reduce(list_transform(string_split(source_ip, '.'), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 256 + b) AS number
  FROM ev)""", """
SELECT address, number, number > 167772160 AND number < 167772160 + 63 AS is_lab_host,
       number BETWEEN 167772160 AND 167772160 + 127 AS in_wide_subnet
FROM addresses""")
_SETTLE = IN_MATCHES + """,
arrivals AS (
  SELECT experiment_id, greatest((epoch_us(m.ingested) - epoch_us(r.end_time)) / 1000000.0, 0) AS after
  FROM matched m JOIN runs r USING (experiment_id)),
inside AS (SELECT * FROM arrivals WHERE after <= 25),
gaps AS (SELECT *, lead(after) OVER (PARTITION BY experiment_id ORDER BY after) - after AS wait FROM inside),
quiet AS (
  SELECT experiment_id, count(*) AS n, min(after) FILTER (wait IS NULL OR wait > 3) + 3 AS at_s FROM gaps GROUP BY 1),
settled AS (
  SELECT experiment_id, coalesce(at_s <= 25, false) AS telemetry_settled,
         CAST(round(CASE WHEN at_s <= 25 THEN at_s ELSE 25 END + 1e-8, 6) AS DOUBLE) AS settle_wait_seconds, coalesce(quiet.n, 0) AS matched_event_count
  FROM runs LEFT JOIN quiet USING (experiment_id))"""
oracle("settle_status", _SETTLE, "SELECT * FROM settled")
oracle("stream_settle_status", _SETTLE, "SELECT * EXCLUDE (matched_event_count) FROM settled")
SAMPLES = """
samples AS (
  SELECT DISTINCT experiment_id, event_id,
         CASE WHEN ingested >= ts THEN (epoch_us(ingested) - epoch_us(ts)) / 1000000.0 END AS sample
  FROM matched)"""
oracle("ingestion_samples", ",".join([IN_MATCHES, SAMPLES]), "SELECT experiment_id, event_id, round(sample + 1e-8, 6) AS sample FROM samples")

# Evaluation -----------------------------------------------------------------------------------

oracle("config_fingerprints", RUNS, "SELECT experiment_id, fingerprint FROM runs")


def _stats(value: str, count: str = "count") -> str:
    return (f'count({value}) AS {count}, round(min({value}) + 1e-8, 6) AS min, round(avg({value}) + 1e-8, 6) AS mean, '
            f'round(quantile_cont({value}, 0.5) + 1e-8, 6) AS p50, round(quantile_cont({value}, 0.5) + 1e-8, 6) AS median, '
            f'round(quantile_cont({value}, 0.95) + 1e-8, 6) AS p95, round(max({value}) + 1e-8, 6) AS max, '
            f'round(stddev_samp({value}) + 1e-8, 6) AS standard_deviation')


MEASURED = """
measured AS (
  SELECT fingerprint AS evaluation_config_fingerprint, scenario_id, unnest([
    {'measurement': 'evidence_latency', 'sample': CASE WHEN evidence_s >= 0 THEN evidence_s END},
    {'measurement': 'detection_latency', 'sample': CASE WHEN seen_s >= 0 THEN seen_s END},
    {'measurement': 'processing_latency', 'sample': CASE WHEN processing_s >= 0 THEN processing_s END},
    {'measurement': 'settle_duration', 'sample': settle_wait_seconds},
    {'measurement': 'observed_event_rate', 'sample': rate},
    {'measurement': 'telemetry_step_coverage', 'sample': CASE WHEN telemetry_step_count IS NOT NULL THEN telemetry_steps_covered / 3.0 END}
  ], recursive := true) FROM cohort)"""
oracle("latency_stats", ",".join([SCORED, COHORT, MEASURED]),
       f"SELECT evaluation_config_fingerprint, measurement, {_stats('sample')} FROM measured GROUP BY 1, 2")
oracle("scenario_measurements", ",".join([SCORED, COHORT, MEASURED]),
       f"SELECT evaluation_config_fingerprint, scenario_id, measurement, {_stats('sample')} FROM measured GROUP BY 1, 2, 3")
_JOINED = "FROM cohort c LEFT JOIN samples s USING (experiment_id)"
_MISSING = "count(*) FILTER (event_id IS NOT NULL AND sample IS NULL) AS missing_or_invalid_count"
oracle("ingestion_stats", ",".join([SCORED, COHORT, SAMPLES]),
       f"SELECT fingerprint AS evaluation_config_fingerprint, {_stats('sample', 'sample_count')}, {_MISSING} {_JOINED} GROUP BY 1")
oracle("ingestion_stats_by_scenario", ",".join([SCORED, COHORT, SAMPLES]),
       f"SELECT fingerprint AS evaluation_config_fingerprint, scenario_id, {_stats('sample', 'sample_count')}, {_MISSING} {_JOINED} GROUP BY 1, 2")
_RATIOS = """
round(tp / nullif(tp + fp, 0) + 1e-8, 6) AS "precision", round(tp / nullif(tp + fn, 0) + 1e-8, 6) AS recall,
round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END + 1e-8, 6) AS f1,
round(tn / nullif(tn + fp, 0) + 1e-8, 6) AS specificity, round(fp / nullif(fp + tn, 0) + 1e-8, 6) AS false_positive_rate,
round((tp + tn) / nullif(tp + fn + fp + tn, 0) + 1e-8, 6) AS accuracy"""
_HITS = "count(*) FILTER (result = 'TP') AS tp, count(*) FILTER (result = 'FN') AS fn, count(*) FILTER (result = 'FP') AS fp, count(*) FILTER (result = 'TN') AS tn"
OVERVIEW = f"""
overview AS (
  SELECT fingerprint AS evaluation_config_fingerprint, {_HITS}, count(*) AS total_experiments,
         count(*) FILTER (result <> 'INCONCLUSIVE') AS scored_experiments,
         count(*) FILTER (result = 'INCONCLUSIVE') AS inconclusive_experiments,
         count(*) FILTER (trial_kind = 'control' AND result IN ('TN','FP')) AS control_runs,
         CAST(sum(len(unexpected)) AS BIGINT) AS unexpected_detection_occurrences, max(end_time) AS latest_end_time
  FROM cohort GROUP BY 1)"""
oracle("confusion_overall", ",".join([SCORED, COHORT, OVERVIEW]), f"SELECT *, {_RATIOS} FROM overview")
oracle("batch_cohorts", ",".join([SCORED, COHORT.replace("IS NOT NULL", "IS NOT NULL AND evaluation_batch_id = 'BATCH-1'"), OVERVIEW]),
       f"SELECT *, {_RATIOS} FROM overview")
oracle("newest_cohort", ",".join([SCORED, COHORT]), """
SELECT fingerprint AS evaluation_config_fingerprint, max(end_time) AS latest_end_time FROM cohort
GROUP BY 1 ORDER BY latest_end_time DESC, 1 LIMIT 1""")
oracle("per_scenario", ",".join([SCORED, COHORT]) + f""",
grouped AS (
  SELECT fingerprint AS evaluation_config_fingerprint, scenario_id, arg_min(trial_kind, (created_at, experiment_id)) AS trial_kind,
         (arg_min({{'e': expected_detection}}, (created_at, experiment_id))).e AS expected_detection, count(*) AS run_count,
         count(*) FILTER (result <> 'INCONCLUSIVE') AS scored_count, count(*) FILTER (result = 'INCONCLUSIVE') AS inconclusive_count, {_HITS}
  FROM cohort GROUP BY 1, 2)""", """
SELECT evaluation_config_fingerprint, scenario_id, trial_kind, expected_detection, run_count, scored_count, inconclusive_count,
       CASE WHEN trial_kind <> 'control' THEN tp END AS tp, CASE WHEN trial_kind <> 'control' THEN fn END AS fn,
       CASE WHEN trial_kind <> 'control' THEN round(tp / nullif(tp + fn, 0) + 1e-8, 6) END AS detection_rate,
       CASE WHEN trial_kind = 'control' THEN tn END AS tn, CASE WHEN trial_kind = 'control' THEN fp END AS fp,
       CASE WHEN trial_kind = 'control' THEN round(fp / nullif(tn + fp, 0) + 1e-8, 6) END AS false_positive_rate
FROM grouped""")
oracle("per_detection_type", ",".join([SCORED, COHORT]) + f""",
counted AS (
  SELECT fingerprint AS evaluation_config_fingerprint, t.detection_type,
         count(*) FILTER (trial_kind = 'attack' AND expected_detection = t.detection_type AND result IN ('TP','FN') AND list_contains(observed, t.detection_type)) AS tp,
         count(*) FILTER (trial_kind = 'attack' AND expected_detection = t.detection_type AND result IN ('TP','FN') AND NOT list_contains(observed, t.detection_type)) AS fn,
         count(*) FILTER (trial_kind = 'control' AND result IN ('TN','FP') AND list_contains(observed, t.detection_type)) AS fp,
         count(*) FILTER (trial_kind = 'control' AND result IN ('TN','FP') AND NOT list_contains(observed, t.detection_type)) AS tn
  FROM cohort CROSS JOIN (SELECT unnest([{_TYPES}]) AS detection_type) t GROUP BY 1, 2)""",
       f"SELECT *, {_RATIOS} FROM counted")
oracle("excluded_experiments", SCORED, """
SELECT experiment_id, CASE WHEN software_revision = 'unknown' THEN 'MISSING_SOFTWARE_REVISION' ELSE 'LEGACY_INCOMPLETE' END AS evaluation_exclusion_reason
FROM scored WHERE status = 'completed' AND fingerprint IS NULL""")
oracle("inconclusive_experiments", ",".join([SCORED, COHORT]), "SELECT experiment_id, result_reason FROM cohort WHERE result = 'INCONCLUSIVE'")
oracle("evaluation_counts", SCORED, """
SELECT count(*) FILTER (status = 'cancelled') AS cancelled_experiments,
       count(*) FILTER (status = 'completed' AND fingerprint IS NULL) AS excluded_incomplete_count FROM scored""")
for _name in ("export_rows", "exported_csv", "exported_json"):
    oracle(_name, SCORED, f"SELECT {', '.join(EXPORT_COLUMNS)} FROM scored WHERE status = 'completed'")
# Quality --------------------------------------------------------------------------------------

IDS = """
ids AS (
  SELECT ts, k <> 13 AS mappable, CASE WHEN k <> 13 THEN kept_id END AS event_id, reason IS NULL AS stored,
         k <> 13 AND (ts < TIMESTAMP '2024-01-05' OR ts > TIMESTAMP '2024-01-25') AS outside
  FROM verdicts)"""
oracle("completeness", ",".join([EV, REASONED, IDS]), """
SELECT count(*) AS sensor_events_total, count(*) FILTER (NOT outside) AS sensor_events_in_window,
       count(*) FILTER (outside) AS filtered_out_events, count(*) FILTER (NOT mappable) AS unmappable_events,
       count(*) FILTER (mappable AND NOT outside) AS mappable_events,
       count(*) FILTER (mappable AND NOT outside AND stored) AS matched_events,
       round(count(*) FILTER (mappable AND NOT outside AND stored) / count(*) FILTER (mappable AND NOT outside) * 100 + 1e-8, 6) AS completeness_percent
FROM ids""")
oracle("missing_ids", ",".join([EV, REASONED, IDS]), "SELECT event_id FROM ids WHERE mappable AND NOT stored")
oracle("present_ids", ",".join([EV, REASONED, IDS]), "SELECT event_id FROM ids WHERE mappable AND stored")
RESOURCES = """
resources AS (
  SELECT 'host-' || (user_id % 3) AS host_label, service AS container_name, k,
         k <> 5 AS cpu_read, CASE WHEN k NOT IN (5, 7, 11) THEN value END AS cpu, CASE WHEN k <> 9 THEN CAST(user_id * 1000 + k AS DOUBLE) END AS mem, k / 4 AS memp
  FROM ev WHERE k <> 3)"""


def _resource(column: str, name: str) -> str:
    return (f"count({column}) AS {name}_count, round(avg({column}) + 1e-8, 6) AS {name}_mean, "
            f"round(max({column}) + 1e-8, 6) AS {name}_max, round(quantile_cont({column}, 0.95) + 1e-8, 6) AS {name}_p95")


for _name in ("resource_summary", "scan_resource_csv"):
    oracle(_name, ",".join([EV, RESOURCES]), f"""
SELECT host_label, container_name, {_resource('cpu', 'cpu_percent')}, {_resource('mem', 'memory_usage_bytes')},
       {_resource('memp', 'memory_percent')}, greatest(count(*) FILTER (cpu_read), count(mem), count(memp)) AS sample_count
FROM resources GROUP BY 1, 2""")
oracle("invalid_samples", EV, "SELECT count(*) FILTER (k IN (3, 5, 9)) AS invalid_samples FROM ev")
oracle("container_stats", EV, """
SELECT event_id AS "timestamp", 'host-1' AS host_label, service AS container_name,
       k / 2 AS cpu_percent,
       CAST(round_even((k + 0.5) * 1048576, 0) AS BIGINT) AS memory_usage_bytes, CAST(2147483648 AS BIGINT) AS memory_limit_bytes,
       CAST(k AS DOUBLE) AS memory_percent, CAST(k * 1000 AS BIGINT) AS network_rx_bytes, CAST(3250000 AS BIGINT) AS network_tx_bytes,
       CAST(k AS BIGINT) AS block_read_bytes, CAST(1000000000 AS BIGINT) AS block_write_bytes, CAST(k AS BIGINT) AS pids
FROM ev WHERE k NOT IN (0, 7)""")
oracle("unreadable_stats", EV, "SELECT 'host-1' AS host_label, count(*) AS unreadable FROM ev WHERE k IN (0, 7) HAVING count(*) > 0")
oracle("measurement_status", ",".join([SCORED, COHORT, SAMPLES, RESOURCES]), """
SELECT topic, CASE WHEN n > 0 THEN 'MEASURED' ELSE 'NOT_MEASURED' END AS status FROM (
  SELECT 'detection_evaluation' AS topic, (SELECT count(*) FROM cohort WHERE result IN ('TP', 'FN', 'FP', 'TN')) AS n
  UNION ALL SELECT 'ingestion_latency', (SELECT count(sample) FROM samples JOIN cohort USING (experiment_id))
  UNION ALL SELECT 'observed_event_rate', (SELECT count(rate) FROM cohort)
  UNION ALL SELECT 'resource_utilization', (SELECT count(*) FROM resources)
  UNION ALL SELECT 'host_clock_provenance', (SELECT count(DISTINCT host_label) FROM resources)
  UNION ALL SELECT 'ingestion_completeness', (SELECT count(*) FROM ev WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'))""")

# Streams --------------------------------------------------------------------------------------

oracle("stream_distinct_events", EV, "SELECT event_id, ts, service FROM ev")
oracle("stream_rebuild_sessions", IN_SESSIONS, "SELECT * EXCLUDE (service_count, honeypot_count, service_text) FROM sess")
oracle("stream_rebuild_detections", IN_DETECTIONS, "SELECT * EXCLUDE (detected_at) FROM det")
oracle("stream_histogram", EV, """
SELECT bucket, count(*) AS count FROM (SELECT time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS bucket FROM ext)
WHERE bucket + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM ext) GROUP BY 1""")
oracle("stream_sessions", IN_SESSIONS, """
SELECT session_id, source_ip, start_time, end_time, event_count FROM sess
WHERE end_time + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM ev)""")
oracle("compacted_events", ",".join([EV, REASONED]), "SELECT DISTINCT kept_id AS event_id, ts, source_ip, service FROM verdicts WHERE reason IS NULL")
oracle("compacted_letters", ",".join([EV, REASONED]), """
SELECT ingested AS seen_at, reason, 'sensor-01' AS sensor_id,
       CAST(CASE WHEN reason = 'json_parse_failure' THEN ingested ELSE ts END AS DATE) AS day
FROM verdicts WHERE reason IS NOT NULL""")
oracle("rollup_histograms", EV, "\nUNION ALL\n".join(
    f"SELECT '{interval}' AS width, time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS count FROM ext GROUP BY ALL"
    for interval in ("1 minute", "10 minutes", "1 hour", "12 hours", "1 day", "7 days")))
oracle("rollup_unique_sources", EV, """
SELECT CAST(d.day + n.n AS DATE) AS last_day, count(DISTINCT source_ip) AS unique_sources, true AS within_error
FROM (SELECT DISTINCT CAST(ts AS DATE) AS day, source_ip FROM ext) d CROSS JOIN (SELECT CAST(range AS INTEGER) AS n FROM range(7)) n GROUP BY 1""")
oracle("stored_cleanup", ",".join([EV, LEGACY]), """
SELECT run, table_name, CASE WHEN run = 'after' THEN 0 ELSE count(*) FILTER (source_ip LIKE '127.%' AND n > least_n) END AS rows
FROM (VALUES ('sessions', 0), ('detections', 3), ('session_cells', 1e18), ('session_paths', 1e18)) t(table_name, least_n)
CROSS JOIN (VALUES ('before'), ('after')) r(run) LEFT JOIN legacy ON true GROUP BY 1, 2""")
oracle("stored_cleanup_rows", ",".join([EV, LEGACY]), """
SELECT 'sessions' AS table_name, source_ip, day, n FROM legacy WHERE source_ip NOT LIKE '127.%'
UNION ALL SELECT 'detections', source_ip, day, n FROM legacy WHERE source_ip NOT LIKE '127.%' AND n > 3""")
_DAILY = MEASURED.replace("scenario_id, unnest", "scenario_id, CAST(end_time AS DATE) AS day, unnest")
oracle("rollup_quantiles", ",".join([SCORED, COHORT, SAMPLES, _DAILY]), """
SELECT CAST(day + n AS DATE) AS last_day, evaluation_config_fingerprint, scenario_id, measurement, count(*) AS count, true AS within_error
FROM (SELECT * FROM measured UNION ALL BY NAME
      SELECT fingerprint AS evaluation_config_fingerprint, scenario_id, CAST(end_time AS DATE) AS day, 'ingestion_latency' AS measurement, sample
      FROM cohort JOIN samples USING (experiment_id))
CROSS JOIN (SELECT CAST(range AS INTEGER) AS n FROM range(7)) WHERE sample IS NOT NULL GROUP BY 1, 2, 3, 4""")
_COPIES = """
copies AS (
  SELECT *, CASE WHEN CAST(extract(second FROM ingested) AS INTEGER) % 7 = 0 THEN 2 ELSE 1 END AS copies FROM verdicts)"""
oracle("stream_ingest_tables", ",".join([EV, REASONED, _COPIES]), """
SELECT 'raw_events' AS table_name, kept_id AS item, CAST(ts AS DATE) AS day FROM copies WHERE reason IS NULL
UNION ALL SELECT 'dead_letters', reason, CASE WHEN reason <> 'json_parse_failure' THEN CAST(ts AS DATE) END
FROM copies CROSS JOIN range(2) WHERE reason IS NOT NULL AND range < copies""")
oracle("stream_ingest_metrics", ",".join([EV, REASONED, _COPIES]), """
SELECT 'lines' AS metric, CAST(sum(copies) AS BIGINT) AS count FROM copies
UNION ALL SELECT 'valid', CAST(sum(copies) FILTER (reason IS NULL) AS BIGINT) FROM copies
UNION ALL SELECT 'rejected', CAST(sum(copies) FILTER (reason IS NOT NULL) AS BIGINT) FROM copies
UNION ALL SELECT unnest(['stored', 'table raw_events']), count(*) FILTER (reason IS NULL) FROM copies
UNION ALL SELECT 'repeated', CAST(sum(copies - 1) FILTER (reason IS NULL) AS BIGINT) FROM copies
UNION ALL SELECT 'table dead_letters', CAST(sum(copies) FILTER (reason IS NOT NULL) AS BIGINT) FROM copies
UNION ALL SELECT 'reason ' || reason, CAST(sum(copies) AS BIGINT) FROM copies WHERE reason IS NOT NULL GROUP BY 1""")
oracle("running_top_sources", EV, """
SELECT batches, source_ip AS name, count(*) AS count
FROM ext JOIN (VALUES (1), (2)) b(batches) ON batches = 2 OR extract(day FROM ts) % 2 = 0 GROUP BY 1, 2
QUALIFY row_number() OVER (PARTITION BY batches ORDER BY count(*) DESC, source_ip) <= 10""")
