"""The same results in SQL, from the rules the views are made by."""

from __future__ import annotations

# Shared pieces over the events table (alias-free column names).
_SERVICE = "'svc-' || (user_id % 7)"
_ID = "'evt-' || event_id"
_MESSAGE = "event_type || ' by user ' || user_id"
_FILE = "'app' || (user_id % 3) || '.log'"
_SOURCE = f"""'{{"agent":"fixture","file":"' || {_FILE} || '"}}'"""
_LEVEL = """CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn'
 WHEN 'click' THEN 'debug' WHEN 'view' THEN 'trace' ELSE 'info' END"""
_RAW_LEVEL = """CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN ' WARNING '
 WHEN 'click' THEN 'DEBUG' WHEN 'view' THEN 'trace' ELSE 'info' END"""
_ATTRIBUTES = "replace(props, ' ', '')"
_RULE = """CASE WHEN event_id % 17 = 0 {allowed} THEN 'unknown' WHEN event_id % 19 = 0 THEN 'level'
 WHEN event_id % 23 = 0 {allowed} THEN 'trailing' WHEN event_id % 29 = 0 THEN 'version'
 WHEN event_id % 31 = 0 THEN 'blank' ELSE 'good' END"""

_LOGS = f"""logs AS (
 SELECT CAST(1 AS SMALLINT) AS schema_version, {_ID} AS id, {_SERVICE} AS service, {_LEVEL} AS level,
  {_MESSAGE} AS message, {_ATTRIBUTES} AS attributes, {_SOURCE} AS source, ts AS "timestamp",
  ts + to_seconds(event_id % 90) AS received_at
 FROM events)"""
_TIED = f"""tied AS (
 SELECT * REPLACE (date_trunc('minute', "timestamp") AS "timestamp") FROM logs)"""

_DELIVERIES = f"""deliveries AS (
 SELECT *, {_RULE.format(allowed='')} AS rule, CAST(event_id % 4 AS INTEGER) AS part,
  event_id + again * 10000000 AS pos
 FROM events, (VALUES (0), (1)) AS t(again)
 WHERE again = 0 OR event_id % 10 = 0)"""


def _payload(rule: str = "rule") -> str:
    return f"""'{{"schema_version":' || CASE WHEN {rule} = 'version' THEN '2' ELSE '1' END
  || ',"id":"' || {_ID} || '","service":"' || {_SERVICE}
  || '","level":"' || CASE WHEN {rule} = 'level' THEN 'shouting' ELSE {_RAW_LEVEL} END
  || '","message":"' || CASE WHEN {rule} = 'blank' THEN ' '
     ELSE {_MESSAGE} || CASE WHEN again = 1 THEN ' again' ELSE '' END
      || CASE WHEN event_id % 37 = 0 THEN '\\ud800!' ELSE '' END END
  || '","timestamp":"' || CASE WHEN event_id % 6 = 1
     THEN strftime(ts - INTERVAL 4 HOUR, '%Y-%m-%dT%H:%M:%S.%f') || '-04:00'
     ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END
  || '","attributes":' || props || ',"source":' || {_SOURCE}
  || CASE WHEN {rule} = 'unknown' THEN ',"api_key":"x"' ELSE '' END || '}}'
  || CASE WHEN {rule} = 'trailing' THEN ' {{}}' ELSE '' END"""


# Half a surrogate pair in a payload becomes the replacement character.
_REPAIRED = "CASE WHEN event_id % 37 = 0 THEN chr(65533) || '!' ELSE '' END"
_CODE = """CASE WHEN rule IN ('unknown', 'trailing') THEN 'malformed_event'
 WHEN rule = 'good' THEN 'valid' ELSE 'invalid_event' END"""
_REASON = """CASE WHEN rule IN ('unknown', 'trailing') THEN 'record is not one valid LogEvent JSON object'
 WHEN rule = 'level' THEN 'level is unsupported' WHEN rule = 'version' THEN 'schema_version must be 1'
 WHEN rule = 'blank' THEN 'message is required' ELSE '' END"""

_REQUESTED = f"""requested AS (
 SELECT *, CASE WHEN (event_id // 80) % 6 = 5 THEN 'wide-' || (event_id // 80)
   ELSE 'req-' || (event_id // 40) END AS request_id,
  {_RULE.format(allowed='AND (event_id // 40) % 4 = 0')} AS rule
 FROM events, (VALUES (0), (1)) AS t(again)
 WHERE again = 0 OR event_id % 10 = 0)"""
_RESULTS = f"""{_REQUESTED}, counted AS (
 SELECT request_id, count(*) AS n, count(*) FILTER (rule = 'good') AS good,
  bool_or(rule IN ('unknown', 'trailing')) AS malformed
 FROM requested GROUP BY request_id
 UNION ALL SELECT 'empty-' || event_id, 0, 0, false FROM events WHERE event_id % 360 = 0),
results AS (
 SELECT request_id,
  CASE WHEN malformed THEN 'invalid_json' WHEN n = 0 OR n > 50 THEN 'invalid_request'
   ELSE 'accepted' END AS status,
  CASE WHEN malformed THEN 'request body must be valid JSON' WHEN n = 0 THEN 'events must not be empty'
   WHEN n > 50 THEN 'batch exceeds max size' ELSE '' END AS message,
  CASE WHEN malformed OR n > 50 THEN 0 ELSE good END AS accepted,
  CASE WHEN malformed OR n > 50 THEN 0 ELSE n - good END AS rejected
 FROM counted)"""

_RECENT = "received_at >= TIMESTAMP '2024-01-30 11:59:00'"
_SUMMARY = f"""summary AS (
 SELECT count(*) AS logs_ingested_total, count(*) FILTER ({_RECENT}) AS logs_last_minute,
  count(*) FILTER ({_RECENT} AND level = 'error') AS errors_last_minute,
  count(DISTINCT service) AS active_services
 FROM logs)"""

_INSERTED = f"""{_LOGS}, {_DELIVERIES},
history AS (SELECT * FROM logs WHERE "timestamp" < TIMESTAMP '2024-01-11'),
winners AS (
 SELECT CAST(1 AS SMALLINT) AS schema_version, {_ID} AS id, {_SERVICE} AS service, {_LEVEL} AS level,
  {_MESSAGE} || CASE WHEN again = 1 THEN ' again' ELSE '' END || {_REPAIRED} AS message,
  {_ATTRIBUTES} AS attributes, {_SOURCE} AS source, ts AS "timestamp",
  TIMESTAMP '2024-01-30 12:00:00' AS received_at
 FROM deliveries WHERE rule = 'good'
 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY part, pos) = 1),
stored AS (
 SELECT * FROM history UNION ALL
 SELECT * FROM winners w WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.id = w.id))"""

_LINES = f"""lines AS (
 SELECT *, CASE WHEN event_id % 3 = 0 THEN 'severity' ELSE 'level' END AS lk,
  CASE WHEN event_id % 3 = 0 THEN 'msg' ELSE 'message' END AS mk,
  CASE WHEN event_id % 3 = 0 THEN 'time' ELSE 'timestamp' END AS tk
 FROM events),
texts AS (
 SELECT *, CASE WHEN event_id % 37 = 0 THEN '   ' ELSE
  '{{"' || lk || '":' || CASE WHEN event_id % 7 = 0 THEN '5' ELSE '"' || {_RAW_LEVEL} || '"' END
  || ',"' || mk || '":"' || {_MESSAGE} || '","user_id":' || user_id || ',"' || tk || '":"'
  || CASE WHEN event_id % 13 = 0 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END
  || '"' || CASE WHEN event_id % 11 = 0 THEN '' ELSE '}}' END END AS line
 FROM lines)"""
# A cut-off character before a carriage return: one byte, then one replacement character.
_TURNS = """turns AS (
 SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no,
  conv_id % 5 = 0 AND turn % 2 = 1 AS broken
 FROM conversations)"""

_FOUND = """SELECT schema_version, id, service, level, message, attributes, source, "timestamp", received_at"""
_NEWEST = 'ORDER BY "timestamp" DESC, id DESC'

SQL: dict[str, str] = {
    "scan_logs": f"WITH {_LOGS} SELECT * FROM logs",
    "search_service": f"WITH {_LOGS} {_FOUND} FROM logs WHERE service = 'svc-3'",
    "search_level": f"WITH {_LOGS} {_FOUND} FROM logs WHERE level = 'warn'",
    # The search words are "licensing" and "versions"; these are their inflections.
    "search_text": """SELECT 'doc-' || doc_id AS id, source AS service,
 TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS "timestamp"
FROM documents
WHERE regexp_matches(lower(text), '\\blicens(e|ed|es|ing)\\b')
 AND regexp_matches(lower(text), '\\bversions?\\b')""",
    "search_time_range": f"""WITH {_LOGS} {_FOUND} FROM logs
 WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:30:00'""",
    "search_all_filters": f"""WITH {_LOGS}, {_TIED} {_FOUND} FROM tied
 WHERE service = 'svc-2' AND level = 'error'
  AND regexp_matches(message, '\\berrors?\\b') AND regexp_matches(message, '\\busers?\\b')
  AND "timestamp" >= TIMESTAMP '2024-01-10 06:00:00' AND "timestamp" <= TIMESTAMP '2024-01-12 18:30:00'
  AND ("timestamp", id) < (TIMESTAMP '2024-01-12 18:30:00', 'evt-9')
 {_NEWEST} LIMIT 25""",
    "search_page1": f"WITH {_LOGS}, {_TIED} {_FOUND} FROM tied WHERE level = 'error' {_NEWEST} LIMIT 50",
    "search_page2": f"""WITH {_LOGS}, {_TIED} {_FOUND} FROM tied
 WHERE ("timestamp", id) < (TIMESTAMP '2024-01-20 03:45:00', 'evt-6382') {_NEWEST} LIMIT 50""",
    "cursor_column": f"""WITH {_LOGS} SELECT id, rtrim(translate(to_base64(encode(
  '{{"v":1,"t":"' || regexp_replace(strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '')
  || 'Z","i":"' || id || '"}}')), '+/', '-_'), '=') AS cursor FROM logs""",
    "page_numbers": f"""WITH {_LOGS}, {_TIED}, numbered AS (
 SELECT "timestamp", id, row_number() OVER ({_NEWEST}) AS row_no FROM tied)
SELECT "timestamp", id, row_no, (row_no - 1) // 50 + 1 AS page_no FROM numbered""",
    "append_unique": f"""WITH {_LOGS}
SELECT id, level, message, "timestamp" FROM logs WHERE "timestamp" >= TIMESTAMP '2024-01-20'
UNION ALL
SELECT id, 'later' AS level, message, "timestamp" FROM logs WHERE "timestamp" < TIMESTAMP '2024-01-20'""",
    "services": f"WITH {_LOGS} SELECT DISTINCT service FROM logs ORDER BY service",
    "summary": f"WITH {_LOGS}, {_SUMMARY} SELECT * FROM summary",
    "services_totals": f"WITH {_LOGS} SELECT DISTINCT service FROM logs ORDER BY service",
    "summary_totals": f"WITH {_LOGS}, {_SUMMARY} SELECT * FROM summary",
    "search_stored_terms": f"WITH {_LOGS} {_FOUND} FROM logs WHERE message LIKE 'error by user %'",
    "term_hours": f"""WITH {_LOGS} SELECT DISTINCT strftime("timestamp", '%Y-%m-%d') AS event_date,
 CAST(hour("timestamp") AS INTEGER) AS hour FROM logs WHERE message LIKE 'error by user %'""",
    "parse_plain": f"""WITH {_TURNS}
SELECT CAST(1 AS BIGINT) AS schema_version, conv_id || '-' || turn || '-' || line_no AS id,
 role AS service, 'info' AS level, line || CASE WHEN broken THEN chr(65533) ELSE '' END AS message, TIMESTAMP '2024-01-30 12:00:00' AS "timestamp",
 '{{}}' AS attributes, '{{"agent":"agent-1","file":"' || role || '.log","host":"host-1"}}' AS source
FROM turns WHERE broken OR trim(line) <> ''""",
    "parse_json_lines": f"""WITH {_LINES}
SELECT CAST(1 AS BIGINT) AS schema_version, CAST(event_id AS VARCHAR) AS id, {_SERVICE} AS service,
 CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN 'info' ELSE {_LEVEL} END AS level,
 CASE WHEN event_id % 11 = 0 THEN line ELSE {_MESSAGE} END AS message,
 CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN TIMESTAMP '2024-01-30 12:00:00' ELSE ts END
  AS "timestamp",
 CASE WHEN event_id % 11 = 0 THEN '{{}}'
  WHEN event_id % 7 = 0 AND lk = 'level' THEN '{{"level":5,"user_id":' || user_id || '}}'
  WHEN event_id % 7 = 0 THEN '{{"severity":5,"user_id":' || user_id || '}}'
  ELSE '{{"user_id":' || user_id || '}}' END AS attributes,
 '{{"agent":"agent-1","file":"' || {_FILE} || '","host":"host-1"}}' AS source
FROM texts WHERE event_id % 37 <> 0""",
    "line_quality": f"""WITH {_LINES}, {_TURNS}, every_line AS (
 SELECT line, 0 AS more FROM texts UNION ALL SELECT line, CAST(broken AS INTEGER) FROM turns),
sized AS (SELECT strlen(line) + more > 120 AS big, more = 0 AND trim(line) = '' AS blank FROM every_line)
SELECT count(*) AS lines_read, count(*) FILTER (big) AS oversized_lines_dropped,
 count(*) FILTER (big) AS logs_dropped, count(*) FILTER (NOT big AND blank) AS blank_lines,
 count(*) FILTER (NOT big AND NOT blank) AS events
FROM sized""",
    "parse_timestamps": """SELECT event_id, CASE event_id % 9 WHEN 0 THEN ts
 WHEN 1 THEN ts + INTERVAL 270 MINUTE WHEN 2 THEN ts - INTERVAL 2 HOUR
 WHEN 3 THEN ts WHEN 4 THEN ts END AS "timestamp" FROM events""",
    "level_lenient": f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'info'
 WHEN event_id % 7 = 0 THEN 'fatal' WHEN event_id % 11 = 0 THEN 'info' ELSE {_LEVEL} END AS level
FROM events""",
    "decode_classify": f"""WITH {_DELIVERIES}
SELECT part AS "partition", pos AS "offset", {_CODE} AS class, {_REASON} AS reason FROM deliveries""",
    "normalize_events": f"""WITH {_DELIVERIES}
SELECT pos AS "offset", {_ID} AS id, {_LEVEL} AS level, ts AS "timestamp"
FROM deliveries WHERE rule = 'good'""",
    "dead_letters": f"""WITH {_DELIVERIES}, poison AS (
 SELECT *, {_payload()} AS payload FROM deliveries WHERE rule <> 'good')
SELECT 1 AS schema_version,
 'dlq-' || sha256('logs.raw' || chr(0) || part || chr(0) || pos) AS id,
 'logs.raw' AS original_topic, part AS original_partition, pos AS original_offset,
 ts AS original_timestamp, TIMESTAMP '2024-01-30 12:00:00' AS failed_at,
 sha256(payload) AS payload_sha256, CAST(strlen(payload) AS INTEGER) AS payload_bytes,
 sha256({_ID}) AS key_sha256, {_CODE} AS failure_code, {_REASON} AS failure_message
FROM poison""",
    "dlq_lookup": f"""WITH {_DELIVERIES}, poison AS (
 SELECT *, {_payload()} AS payload FROM deliveries WHERE rule <> 'good')
SELECT 'dlq-' || sha256('logs.raw' || chr(0) || part || chr(0) || pos) AS id,
 pos AS original_offset, sha256(payload) AS payload_sha256,
 CAST(strlen(payload) AS INTEGER) AS payload_bytes
FROM poison WHERE event_id = 17""",
    "route_counts": f"""WITH {_DELIVERIES}
SELECT count(*) AS records, count(*) FILTER (rule = 'good') AS persisted,
 count(*) FILTER (rule <> 'good') AS dead_lettered,
 count(*) FILTER (rule IN ('unknown', 'trailing')) AS malformed,
 count(*) FILTER (rule IN ('level', 'version', 'blank')) AS invalid
FROM deliveries""",
    "validate_events": """SELECT doc_id, CASE WHEN doc_id % 67 = 0 THEN 'schema_version must be 1'
 WHEN doc_id % 41 = 0 THEN 'id is required' WHEN doc_id % 43 = 0 THEN 'id exceeds 128 bytes'
 WHEN doc_id % 47 = 0 OR source = '' THEN 'service is required'
 WHEN doc_id % 49 = 0 THEN 'service exceeds 128 bytes'
 WHEN doc_id % 71 = 0 OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'message is required'
 WHEN lang NOT IN ('en', 'fr', 'de') THEN 'level is unsupported'
 WHEN doc_id % 53 = 0 THEN 'timestamp is required'
 WHEN strlen(text) > 32768 THEN 'message exceeds 32768 bytes'
 WHEN doc_id % 59 = 0 THEN 'attributes must be an object'
 WHEN doc_id % 61 = 0 THEN 'source must be an object'
 WHEN doc_id % 211 = 0 THEN 'event exceeds 262144 bytes' ELSE 'valid' END AS violation
FROM documents""",
    "insert_first_wins": f"WITH {_INSERTED} SELECT * FROM stored",
    "delivery_counts": f"""WITH {_INSERTED}
SELECT count(*) FILTER (id = 'evt-20') AS redelivered, count(*) FILTER (id = 'evt-21') AS barrier
FROM stored""",
    "ingest_explode": f"""WITH {_REQUESTED}, broken AS (
 SELECT DISTINCT request_id FROM requested WHERE rule = 'trailing')
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY event_id, again) - 1 AS pos,
 {_ID} AS id
FROM requested WHERE request_id NOT IN (SELECT request_id FROM broken)""",
    "ingest_batch_result": f"WITH {_RESULTS} SELECT * FROM results",
    "ingest_totals": f"""WITH {_RESULTS}
SELECT CAST(sum(accepted) AS BIGINT) AS ingested_events, CAST(sum(rejected) AS BIGINT) AS rejected_events
FROM results""",
    "publish_rows": f"""WITH {_RESULTS}
SELECT {_ID} AS key, '{{"schema_version":1,"id":"' || {_ID} || '","service":"' || {_SERVICE}
 || '","level":"' || {_LEVEL} || '","message":"' || {_MESSAGE}
 || CASE WHEN again = 1 THEN ' again' ELSE '' END || {_REPAIRED} || '","timestamp":"'
 || regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z","attributes":'
 || {_ATTRIBUTES} || ',"source":' || {_SOURCE} || '}}' AS value, ts AS "timestamp"
FROM requested JOIN results USING (request_id) WHERE status = 'accepted' AND rule = 'good'""",
    "record_contract": f"""SELECT event_id, {_RAW_LEVEL} AS level FROM events
WHERE event_type IN ('purchase', 'click') OR event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0
 OR event_id % 19 = 0 OR event_id % 23 = 0 OR event_id % 29 = 0 OR event_id % 31 = 0""",
    "summary_contract": f"""WITH {_LOGS}, {_SUMMARY}, figures AS (
 SELECT * FROM summary
 UNION ALL SELECT logs_ingested_total, -1, errors_last_minute, NULL FROM summary
 UNION ALL SELECT logs_ingested_total + 9007199254740992, logs_last_minute, errors_last_minute, active_services
 FROM summary),
checked AS (
 SELECT coalesce(logs_ingested_total BETWEEN 0 AND 9007199254740991, false) AS logs_ingested_total,
  coalesce(logs_last_minute BETWEEN 0 AND 9007199254740991, false) AS logs_last_minute,
  coalesce(errors_last_minute BETWEEN 0 AND 9007199254740991, false) AS errors_last_minute,
  coalesce(active_services BETWEEN 0 AND 9007199254740991, false) AS active_services
 FROM figures)
SELECT *, logs_ingested_total AND logs_last_minute AND errors_last_minute AND active_services AS valid
FROM checked""",
    "constraint_violations": f"""WITH {_DELIVERIES}, per_id AS (
 SELECT {_ID} AS id, count(*) AS n, count(*) FILTER (rule = 'version') AS foreign_version
 FROM deliveries WHERE rule NOT IN ('unknown', 'trailing') GROUP BY event_id)
SELECT 'schema_version' AS violated, id, foreign_version AS row_count FROM per_id WHERE foreign_version > 0
UNION ALL SELECT 'unique_id', id, n FROM per_id WHERE n > 1""",
}
