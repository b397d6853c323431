"""DuckDB texts equivalent to the registered queries (same parameters as catalog.py).

Each text starts from the driver's base tables; the shared views of
``timberline.fixtures`` are inlined as CTEs.
"""

from __future__ import annotations

from timberline import fixtures as fx

LOGS = f"logs AS ({fx.LOGS_SQL})"
RANK = ("CASE severity WHEN 'emerg' THEN 0 WHEN 'alert' THEN 1 WHEN 'crit' THEN 2 WHEN 'err' THEN 3 "
        "WHEN 'warning' THEN 4 WHEN 'notice' THEN 5 WHEN 'info' THEN 6 WHEN 'debug' THEN 7 ELSE 99 END")
QCOLS = "id, ts, hostname, source, unit, severity, pid, message"
D30 = "TIMESTAMP '2024-01-01 00:00:00'"
D14 = "TIMESTAMP '2024-01-17 00:00:00'"
D7 = "TIMESTAMP '2024-01-24 00:00:00'"


def _w(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _discover(col: str) -> str:
    return _w(f"SELECT {col} AS value, count(*) AS count FROM logs WHERE ts >= {D30} "
              f"GROUP BY {col} ORDER BY count DESC NULLS LAST, value ASC NULLS LAST LIMIT 100", LOGS)


SPIKES = f"""spikes AS (
  SELECT 'error_spike' AS type, coalesce(unit, '') AS unit, count(*) AS count, 'high' AS severity,
    'High error rate in ' || coalesce(unit, 'None') || ': ' || CAST(count(*) AS VARCHAR) || ' errors' AS description
  FROM logs WHERE ts >= {D30} AND severity IN ('err', 'crit', 'emerg')
  GROUP BY unit HAVING count(*) > 10)"""
VOLUME = f"""volume AS (
  SELECT 'high_volume' AS type, coalesce(source, '') AS source, count(*) AS count, 'medium' AS severity,
    'High log volume from ' || coalesce(source, 'None') || ': ' || CAST(count(*) AS VARCHAR) || ' logs' AS description
  FROM logs WHERE ts >= {D30} GROUP BY source HAVING count(*) > 1000)"""
MISSING = f"""missing AS (
  SELECT 'missing_logs' AS type, e.unit, 'medium' AS severity, 'Missing expected logs from ' || e.unit AS description
  FROM (VALUES ('cron'), ('sshd'), ('systemd')) e(unit)
  WHERE e.unit NOT IN (SELECT unit FROM logs WHERE ts >= {D30} AND unit IN ('systemd', 'sshd', 'cron')))"""
ALL_ANOMALIES = """anomalies AS (
  SELECT 1 AS kind_order, type, unit, CAST(NULL AS VARCHAR) AS source, count, severity, description FROM spikes
  UNION ALL SELECT 2, type, CAST(NULL AS VARCHAR), source, count, severity, description FROM volume
  UNION ALL SELECT 3, type, unit, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), severity, description FROM missing)"""

def ts_str(c: str) -> str:
    return (f"CASE WHEN strftime({c}, '%f') = '000000' THEN strftime({c}, '%Y-%m-%d %H:%M:%S') "
            f"ELSE strftime({c}, '%Y-%m-%d %H:%M:%S.%f') END")


TS_STR = ts_str("ts")
FP = (f"sha256({TS_STR} || '|' || coalesce(hostname, 'None') || '|' || coalesce(unit, 'None') || '|' || "
      "coalesce(severity, 'None') || '|' || coalesce(CAST(pid AS VARCHAR), 'None') || '|' || coalesce(message, 'None'))")


def x2(fp: str) -> str:
    u = f"CAST(('0x' || substr({fp}, 1, 16)) AS UBIGINT)"
    return (f"CAST(CASE WHEN {u} >= 9223372036854775808 THEN CAST({u} AS HUGEINT) - 18446744073709551616 "
            f"ELSE CAST({u} AS HUGEINT) END AS BIGINT)")


BATCH = """batch AS (
  SELECT id, ts, hostname, source AS source_name, unit, severity, pid, message, raw, cursor, id * 2 AS seq FROM logs
  UNION ALL SELECT id, ts, hostname, source, unit, severity, pid, message, raw, cursor || '-dup', id * 2 + 1
    FROM logs WHERE ts >= TIMESTAMP '2024-01-04 00:00:00' AND ts < TIMESTAMP '2024-01-06 00:00:00'
  UNION ALL SELECT id, ts, hostname, source, unit, severity, pid, message || ' (again)', raw, cursor, id * 2 + 1
    FROM logs WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00'
      AND severity = 'notice')"""
FPB = f"fpb AS (SELECT * EXCLUDE (id), {FP} AS fingerprint FROM batch)"
STORED = (f"stored AS (SELECT *, {x2('fingerprint')} AS id FROM (SELECT *, {FP} AS fingerprint FROM logs "
          "WHERE ts < TIMESTAMP '2024-01-05 00:00:00'))")
DEDUP = """d1 AS (SELECT * FROM fpb QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY seq) = 1),
d2 AS (SELECT * FROM d1 QUALIFY cursor IS NULL OR row_number() OVER (PARTITION BY cursor ORDER BY seq) = 1)"""
RANK_LE4 = RANK + " <= 4"

METRICS = f"metrics AS ({fx.METRICS_SQL})"


def jfield(f: str) -> str:
    return f"CASE WHEN json_valid(metric_data) THEN json_extract_string(metric_data, '$.{f}') END"


MVAL = ("CASE metric_type WHEN 'cpu' THEN TRY_CAST(" + jfield("cpu_percent") + " AS DOUBLE) "
        "WHEN 'memory' THEN TRY_CAST(" + jfield("memory_percent") + " AS DOUBLE) "
        "WHEN 'disk' THEN TRY_CAST(" + jfield("percent") + " AS DOUBLE) "
        "WHEN 'uptime' THEN TRY_CAST(" + jfield("uptime_seconds") + " AS DOUBLE) END")
ALERTS_T = f"""alerts_t AS (
  SELECT timestamp, 'high_' || metric_type AS alert_type, 'warning' AS severity,
    CASE metric_type WHEN 'cpu' THEN 'High CPU usage: ' || {jfield('cpu_percent')} || '%'
      WHEN 'memory' THEN 'High memory usage: ' || {jfield('memory_percent')} || '%'
      ELSE 'High disk usage on ' || coalesce({jfield('mountpoint')}, 'None') || ': ' || {jfield('percent')} || '%' END AS message,
    metric_data
  FROM metrics WHERE metric_type IN ('cpu', 'memory', 'disk') AND coalesce(TRY_CAST(CASE metric_type
    WHEN 'cpu' THEN {jfield('cpu_percent')} WHEN 'memory' THEN {jfield('memory_percent')}
    ELSE {jfield('percent')} END AS DOUBLE), 0) > 90)"""
ALERTS_S = f"""svc AS (
  SELECT CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS timestamp,
    regexp_replace({jfield('service_name')}, '\\.service$', '') AS name
  FROM metrics WHERE metric_type IN ('service', 'services') AND json_valid(metric_data)),
alerts_s AS (
  SELECT s.timestamp, 'service_down' AS alert_type, 'critical' AS severity,
    'Critical service ' || c.name || ' is not running' AS message, CAST(json_object('service', c.name) AS VARCHAR) AS metric_data
  FROM (SELECT DISTINCT timestamp FROM svc) s, (VALUES ('sshd'), ('systemd'), ('dbus')) c(name)
  WHERE NOT EXISTS (SELECT 1 FROM svc WHERE svc.timestamp = s.timestamp AND svc.name = c.name))"""


def stored_alerts(src: str) -> str:
    aid = x2(f"sha256({ts_str('timestamp')} || '|' || alert_type || '|' || message)")
    return (f"SELECT {aid} AS id, timestamp, alert_type, severity, message, metric_data, false AS acknowledged, "
            f"CAST(NULL AS TIMESTAMP) AS acknowledged_at FROM {src}")


ALERT_TABLE = f"alert_table AS ({stored_alerts('alerts_t')} UNION ALL {stored_alerts('alerts_s')})"
HEALTH = f"""health AS (
  SELECT CASE WHEN count(*) = 0 THEN 'no_data' ELSE 'ok' END AS status,
    coalesce(round(avg(CASE WHEN metric_type = 'cpu' THEN v END), 2), 0.0) AS cpu_average,
    coalesce(round(avg(CASE WHEN metric_type = 'memory' THEN v END), 2), 0.0) AS memory_average,
    coalesce(round(avg(CASE WHEN metric_type = 'disk' THEN v END), 2), 0.0) AS disk_average,
    (SELECT count(*) FROM alert_table WHERE timestamp >= {D30}) AS active_alerts,
    (SELECT string_agg('[' || severity || '] ' || message, chr(10) ORDER BY timestamp DESC, alert_type, message)
     FROM (SELECT * FROM alert_table WHERE timestamp >= {D30}
           ORDER BY timestamp DESC, alert_type, message LIMIT 5)) AS recent_alerts
  FROM (SELECT *, {MVAL} AS v FROM metrics WHERE timestamp >= {D30}))"""
W30 = f"w AS (SELECT * FROM logs WHERE ts >= {D30})"
LOG_SUMMARY = """sev AS (SELECT severity AS k, count(*) AS c FROM w GROUP BY severity),
unit_top AS (SELECT unit AS k, count(*) AS c FROM w GROUP BY unit ORDER BY c DESC, k ASC NULLS LAST LIMIT 10),
src_top AS (SELECT source AS k, count(*) AS c FROM w GROUP BY source ORDER BY c DESC, k ASC NULLS LAST LIMIT 5),
log_summary AS (
  SELECT t.total_logs, CAST(e.error_count AS BIGINT) AS error_count,
    CASE WHEN t.total_logs > 0 THEN round(CAST(e.error_count AS DOUBLE) / t.total_logs * 100.0, 2) ELSE 0.0 END AS error_rate,
    720 AS period_hours,
    (SELECT string_agg(coalesce(k, 'None') || ': ' || c, ', ' ORDER BY c DESC, k ASC NULLS LAST) FROM sev) AS severity_distribution,
    (SELECT string_agg(coalesce(k, 'None') || ': ' || c, ', ' ORDER BY c DESC, k ASC NULLS LAST) FROM unit_top) AS top_units,
    (SELECT string_agg(coalesce(k, 'None') || ': ' || c, ', ' ORDER BY c DESC, k ASC NULLS LAST) FROM src_top) AS top_sources
  FROM (SELECT count(*) AS total_logs FROM w) t,
       (SELECT coalesce(sum(c), 0) AS error_count FROM sev WHERE k IN ('err', 'crit', 'emerg')) e)"""

DOC = ("CASE WHEN coalesce(hostname, '') <> '' THEN '[' || hostname || '] ' ELSE '' END || "
       "coalesce(unit, 'None') || ': ' || coalesce(message, 'None')")
DIST = ("list_sum(list_transform(generate_series(1, len(embedding)), lambda i: "
        "(CAST(embedding[i] AS DOUBLE) - CAST(qv[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(qv[i] AS DOUBLE))))")


# The default embedding: signed token buckets (MD5 digits), L2-normalised.
def embedding(text: str) -> str:
    codes = (f"list_transform(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda t: t <> ''), lambda t: "
             "(CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64 + 1) * "
             "CASE WHEN CAST(('0x' || substr(md5(t), 9, 1)) AS BIGINT) % 2 = 1 THEN -1 ELSE 1 END)")
    sums = ("(SELECT list_transform(generate_series(1, 64), lambda i: "
            "len(list_filter(cs, lambda c: c = i)) - len(list_filter(cs, lambda c: c = -i))) "
            f"FROM (SELECT {codes} AS cs))")
    return (f"(SELECT list_transform(s, lambda x: CAST(CASE WHEN n > 0 THEN x / n ELSE 0 END AS FLOAT)) FROM "
            f"(SELECT s, sqrt(CAST(list_sum(list_transform(s, lambda x: x * x)) AS DOUBLE)) AS n FROM (SELECT {sums} AS s)))")


INDEX = f"""cand AS (SELECT *, {DOC} AS doc FROM logs WHERE ts >= {D30}
  AND id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT id FROM logs))),
idx AS (SELECT id AS log_id, ts, source, coalesce(message, '') AS document, {embedding('doc')} AS embedding FROM cand)"""
SEARCH_TEXT = f"""hits AS (
  SELECT log_id, round(d, 6) AS distance, round(1 - d, 6) AS similarity,
    CAST(row_number() OVER (ORDER BY d, log_id) AS INTEGER) AS rank
  FROM (SELECT log_id, list_reduce(list_transform(generate_series(1, 64), lambda i:
      (CAST(embedding[i] AS DOUBLE) - CAST(qv[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(qv[i] AS DOUBLE))),
      lambda a, b: a + b) AS d
    FROM idx, (SELECT {embedding("'error by user 12'")} AS qv) q WHERE source = 'journald')
  ORDER BY d, log_id LIMIT 20)"""


def _topk(where: str, k: int) -> str:
    return f"""hits AS (
  SELECT log_id, round(d, 6) AS distance, round(1 - d, 6) AS similarity,
    CAST(row_number() OVER (ORDER BY d, log_id) AS INTEGER) AS rank
  FROM (SELECT e.vec_id AS log_id, {DIST} AS d
        FROM embeddings e JOIN logs l ON l.id = e.vec_id,
             (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0) q
        WHERE {where})
  ORDER BY d, log_id LIMIT {k})"""


HITS_ALL = _topk("TRUE", 10)
HITS_FILTERED = _topk("l.ts >= TIMESTAMP '2024-01-01 00:00:00' AND l.source = 'journald'", 20)
EXPANDED = """expanded AS (
  SELECT l.id, l.ts, l.hostname, l.source, l.unit, l.severity, l.message, h.similarity, h.rank
  FROM hits h JOIN logs l ON l.id = h.log_id)"""

SCAN_LINES = f"sl AS ({fx.SCAN_LINES_SQL})"
_NB = "trim(line) <> ''"
_INF_N = r"coalesce(TRY_CAST(regexp_extract(line, 'Infected files: (\d+)', 1) AS BIGINT), 0)"


def _occ(needle: str) -> str:
    return f"CAST((length(line) - length(replace(line, '{needle}', ''))) // length('{needle}') AS BIGINT)"


AUDIT_FLAGS = f"""fl AS (
  SELECT CAST(scan_date AS TIMESTAMP) AS scan_time, host, tool, line_no, line, trim(line) AS text, is_error AS rc,
    CASE WHEN tool = 'auditd' AND {_NB} THEN 1
         WHEN tool = 'aide' AND {_NB} AND NOT starts_with(line, 'AIDE') THEN 1
         WHEN tool = 'rkhunter' AND (contains(line, 'Warning:') OR contains(line, 'Suspicious:')) THEN 1
         WHEN tool = 'chkrootkit' AND (contains(line, 'INFECTED') OR contains(line, 'Warning:')) THEN 1
         WHEN tool = 'clamav' AND {_NB} AND contains(line, 'Infected files:') AND {_INF_N} > 0 THEN 1
         WHEN tool = 'lynis' AND contains(line, '[WARN]') THEN 1
         WHEN tool = 'lynis' AND contains(line, '[SUGGESTION]') THEN 2 END AS kind,
    {_NB} AS nonblank,
    {_NB} AND regexp_matches(line, '(?:type=EXECVE.*suid=)|(?:type=SYSCALL.*syscall=2)|(?:type=SYSCALL.*syscall=59)|(?:type=LOGIN.*res=failed)') AS suspicious,
    CASE WHEN {_NB} AND NOT contains(line, 'Infected files:') AND contains(line, 'Scanned files:')
         THEN TRY_CAST(regexp_extract(line, 'Scanned files: (\\d+)', 1) AS BIGINT) END AS scanned,
    {_occ('result="pass"')} AS n_pass, {_occ('result="fail"')} AS n_fail, {_occ('result="error"')} AS n_error
  FROM sl)"""
AUDIT_RESULTS = """agg AS (
  SELECT scan_time, host, tool, max(rc) AS rc, count(*) FILTER (WHERE nonblank) AS line_count,
    count(*) FILTER (WHERE suspicious) AS n_susp, count(*) FILTER (WHERE kind = 1) AS n_prim,
    CAST(sum(scanned) AS BIGINT) AS n_scanned, CAST(sum(n_pass) AS BIGINT) AS n_pass,
    CAST(sum(n_fail) AS BIGINT) AS n_fail, CAST(sum(n_error) AS BIGINT) AS n_error
  FROM fl GROUP BY scan_time, host, tool),
samp AS (
  SELECT scan_time, host, tool,
    string_agg(text, chr(10) ORDER BY line_no) FILTER (WHERE kind = 1) AS s1,
    string_agg(text, chr(10) ORDER BY line_no) FILTER (WHERE kind = 2) AS s2
  FROM (SELECT *, row_number() OVER (PARTITION BY scan_time, host, tool, kind ORDER BY line_no) AS rn
        FROM fl WHERE kind IS NOT NULL) WHERE rn <= 10 OR tool IN ('aide', 'clamav') GROUP BY scan_time, host, tool),
res AS (
  SELECT a.scan_time, a.host, a.tool, a.rc,
    CASE a.tool WHEN 'auditd' THEN 'running'
      WHEN 'aide' THEN CASE a.rc WHEN 0 THEN 'clean' WHEN 1 THEN 'violations' ELSE 'error' END
      WHEN 'rkhunter' THEN CASE a.rc WHEN 0 THEN 'clean' WHEN 1 THEN 'warnings' WHEN 2 THEN 'suspicious' ELSE 'error' END
      WHEN 'chkrootkit' THEN CASE a.rc WHEN 0 THEN 'clean' WHEN 1 THEN 'suspicious' ELSE 'error' END
      WHEN 'clamav' THEN CASE WHEN a.n_prim > 0 THEN 'infected' ELSE 'clean' END
      WHEN 'openscap' THEN CASE a.rc WHEN 0 THEN 'completed' ELSE 'error' END
      WHEN 'lynis' THEN CASE a.rc WHEN 0 THEN 'completed' ELSE 'error' END ELSE 'unknown' END AS status,
    CASE a.tool WHEN 'auditd' THEN CASE WHEN a.rc = 0 AND a.n_susp > 0 THEN 'warning' ELSE 'info' END
      WHEN 'aide' THEN CASE a.rc WHEN 0 THEN 'info' WHEN 1 THEN 'critical' ELSE 'error' END
      WHEN 'rkhunter' THEN CASE a.rc WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'critical' ELSE 'error' END
      WHEN 'chkrootkit' THEN CASE a.rc WHEN 0 THEN 'info' WHEN 1 THEN 'critical' ELSE 'error' END
      WHEN 'clamav' THEN CASE WHEN a.n_prim > 0 THEN 'critical' ELSE 'info' END
      WHEN 'openscap' THEN CASE WHEN a.rc <> 0 THEN 'error' WHEN a.n_fail > 0 THEN 'warning' ELSE 'info' END
      WHEN 'lynis' THEN CASE WHEN a.rc <> 0 THEN 'error' WHEN a.n_prim > 0 THEN 'warning' ELSE 'info' END
      ELSE 'info' END AS severity,
    CASE a.tool
      WHEN 'auditd' THEN 'auditd service is active' ||
        CASE WHEN a.rc = 0 AND a.n_susp > 0 THEN ' - ' || a.n_susp || ' suspicious events detected' ELSE '' END
      WHEN 'aide' THEN CASE a.rc WHEN 0 THEN 'No integrity violations detected'
        WHEN 1 THEN 'File integrity violations detected' ELSE 'AIDE check failed: ' END
      WHEN 'rkhunter' THEN CASE a.rc WHEN 0 THEN 'No rootkits detected' WHEN 1 THEN 'Some warnings found'
        WHEN 2 THEN 'Suspicious files detected' ELSE 'rkhunter check failed: ' END
      WHEN 'chkrootkit' THEN CASE a.rc WHEN 0 THEN 'No rootkits detected' WHEN 1 THEN 'Suspicious files detected'
        ELSE 'chkrootkit check failed: ' END
      WHEN 'clamav' THEN CASE WHEN a.n_prim > 0 THEN 'Virus detected in ' || a.n_prim || ' locations'
        ELSE 'No viruses detected in ' || coalesce(a.n_scanned, 0) || ' scanned files' END
      WHEN 'openscap' THEN CASE WHEN a.rc = 0 THEN 'OpenSCAP scan completed' ||
        CASE WHEN a.n_fail > 0 THEN ' - ' || a.n_fail || ' compliance failures' ELSE '' END ELSE 'OpenSCAP scan failed: ' END
      WHEN 'lynis' THEN CASE WHEN a.rc = 0 THEN 'Lynis audit completed' ||
        CASE WHEN a.n_prim > 0 THEN ' - ' || a.n_prim || ' warnings found' ELSE '' END ELSE 'Lynis audit failed: ' END
      ELSE '' END AS summary,
    a.line_count,
    CASE WHEN (a.tool IN ('auditd', 'openscap', 'lynis') AND a.rc <> 0) OR (a.tool = 'aide' AND a.rc <> 1) THEN NULL
      WHEN a.tool = 'auditd' THEN a.n_susp WHEN a.tool = 'openscap' THEN a.n_fail ELSE a.n_prim END AS finding_count,
    CASE WHEN a.tool = 'clamav' THEN coalesce(a.n_scanned, 0) END AS scanned_files,
    CASE WHEN a.tool = 'openscap' AND a.rc = 0 THEN a.n_pass END AS pass_count,
    CASE WHEN a.tool = 'openscap' AND a.rc = 0 THEN a.n_fail END AS fail_count,
    CASE WHEN a.tool = 'openscap' AND a.rc = 0 THEN a.n_error END AS error_count,
    CASE WHEN (a.tool IN ('auditd', 'openscap', 'lynis') AND a.rc <> 0) OR (a.tool = 'aide' AND a.rc <> 1) THEN NULL
      ELSE s.s1 END AS details,
    CASE WHEN a.tool = 'lynis' AND a.rc = 0 THEN coalesce(s.s2, '') END AS details2
  FROM agg a LEFT JOIN samp s ON s.scan_time = a.scan_time AND s.host = a.host AND s.tool = a.tool)"""
AUDIT_RECORDS = ("records AS (SELECT " + x2(f"sha256(tool || '|' || host || '|' || {ts_str('scan_time')})")
                 + " AS id, tool, host, scan_time, status, summary, severity, "
                 "rc, finding_count, scanned_files, details FROM res)")


def _audit(tool: str) -> str:
    return _w(f"SELECT * FROM res WHERE tool = '{tool}'", SCAN_LINES, AUDIT_FLAGS, AUDIT_RESULTS)


def _audit_id(tool: str, host: str, scan_time: str) -> int:
    import hashlib
    return int.from_bytes(hashlib.sha256(f"{tool}|{host}|{scan_time}".encode()).digest()[:8], "big", signed=True)


CHAT = f"chat AS ({fx.CHAT_HISTORY_SQL})"

RECS = """concat_ws(chr(10),
    CASE WHEN l.error_rate > 5 THEN 'High error rate detected: ' || l.error_rate || '%. Review system logs for issues.' END,
    CASE WHEN h.status <> 'no_data' AND h.cpu_average > 80 THEN 'High CPU usage detected. Consider investigating resource-intensive processes.' END,
    CASE WHEN h.status <> 'no_data' AND h.memory_average > 85 THEN 'High memory usage detected. Consider memory optimization or cleanup.' END,
    CASE WHEN h.active_alerts > 0 THEN h.active_alerts || ' active alerts require attention.' END,
    CASE WHEN a.high_severity > 0 THEN a.high_severity || ' high-severity anomalies detected.' END)"""
REPORT_TEXT = f"""report_lines AS (
  SELECT l.*, h.*, a.*, {RECS} AS recs,
    (SELECT string_agg('  ' || coalesce(k, 'None') || ': ' || format('{{:,}}', c), chr(10) ORDER BY c DESC, k ASC NULLS LAST)
     FROM sev) AS sev_lines,
    (SELECT string_agg('  ' || coalesce(k, 'None') || ': ' || format('{{:,}}', c), chr(10) ORDER BY c DESC, k ASC NULLS LAST)
     FROM (SELECT * FROM unit_top ORDER BY c DESC, k ASC NULLS LAST LIMIT 5)) AS unit_lines,
    (SELECT string_agg('  [' || severity || '] ' || description, chr(10) ORDER BY kind_order, count DESC, key)
     FROM (SELECT *, coalesce(unit, source) AS key FROM anomalies WHERE kind_order < 3
           ORDER BY kind_order, count DESC, key LIMIT 5)) AS anomaly_lines
  FROM log_summary l, health h,
    (SELECT count(*) AS total_anomalies, count(*) FILTER (WHERE severity = 'high') AS high_severity
     FROM anomalies WHERE kind_order < 3) a)"""
RULE, DASH = "repeat('=', 80)", "repeat('-', 40)"
REPORT_TEXT_BODY = f"""SELECT 'daily_20240131' AS report_id, concat_ws(chr(10),
  {RULE}, 'DAILY LOG REPORT', {RULE}, 'Generated: 2024-01-31T00:00:00', 'Period: 720 hours', '',
  'LOG ANALYTICS', {DASH}, 'Total logs: ' || format('{{:,}}', total_logs), 'Error rate: ' || error_rate || '%', '',
  'Severity Distribution:', sev_lines, '', 'Top Units by Volume:', unit_lines, '', 'SYSTEM HEALTH', {DASH},
  CASE WHEN status = 'no_data' THEN 'No system metrics available' ELSE concat_ws(chr(10),
    'CPU Average: ' || cpu_average || '%', 'Memory Average: ' || memory_average || '%',
    'Disk Average: ' || disk_average || '%', 'Active Alerts: ' || active_alerts,
    CASE WHEN recent_alerts IS NOT NULL AND recent_alerts <> '' THEN 'Recent Alerts:' || chr(10) ||
      array_to_string(list_transform(string_split(recent_alerts, chr(10)), lambda x: '  ' || x), chr(10)) END) END,
  '', 'ANOMALY DETECTION', {DASH}, 'Total Anomalies: ' || total_anomalies, 'High Severity: ' || high_severity,
  CASE WHEN anomaly_lines IS NOT NULL THEN 'Recent Anomalies:' || chr(10) || anomaly_lines END,
  '',
  CASE WHEN recs <> '' THEN 'RECOMMENDATIONS' || chr(10) || {DASH} || chr(10) ||
    array_to_string(list_transform(generate_series(1, len(string_split(recs, chr(10)))),
      lambda i: i || '. ' || string_split(recs, chr(10))[i]), chr(10)) || chr(10) END,
  {RULE}, 'End of Report', {RULE}) AS report
FROM report_lines"""

_PAIRS = "list({{'key': k, 'count': c}} ORDER BY c DESC, k ASC NULLS LAST)"
REPORT_JSON_BODY = f"""SELECT 'daily_20240131' AS report_id, CAST(json_object(
  'report_id', 'daily_20240131', 'generated_at', '2024-01-31T00:00:00', 'period_hours', 720,
  'summary', json_object(
    'log_analytics', json_object(
      'total_logs', total_logs,
      'severity_distribution', (SELECT {_PAIRS.format()} FROM sev),
      'top_units', (SELECT {_PAIRS.format()} FROM unit_top),
      'top_sources', (SELECT {_PAIRS.format()} FROM src_top),
      'error_count', error_count, 'error_rate', error_rate, 'period_hours', 720),
    'system_health', json_object(
      'status', status, 'cpu_average', cpu_average, 'memory_average', memory_average,
      'disk_average', disk_average, 'active_alerts', active_alerts,
      'alert_summary', (SELECT list({{'severity': severity, 'message': message,
                                       'timestamp': strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f')}}
                                      ORDER BY timestamp DESC, alert_type, message)
                        FROM (SELECT * FROM alert_table WHERE timestamp >= {D30}
                              ORDER BY timestamp DESC, alert_type, message LIMIT 5))),
    'anomalies', json_object(
      'total_anomalies', total_anomalies, 'high_severity', high_severity,
      'medium_severity', (SELECT count(*) FILTER (WHERE severity = 'medium') FROM anomalies WHERE kind_order < 3),
      'error_spike_count', (SELECT count(*) FILTER (WHERE type = 'error_spike') FROM anomalies WHERE kind_order < 3),
      'high_volume_count', (SELECT count(*) FILTER (WHERE type = 'high_volume') FROM anomalies WHERE kind_order < 3),
      'recent', (SELECT list({{'type': type, 'severity': severity, 'description': description}}
                             ORDER BY kind_order, count DESC, key)
                 FROM (SELECT *, coalesce(unit, source) AS key FROM anomalies WHERE kind_order < 3
                       ORDER BY kind_order, count DESC, key LIMIT 5)))),
  'recommendations', list_filter(string_split(recs, chr(10)), lambda x: x <> '')) AS VARCHAR) AS report
FROM report_lines"""

def esc(x: str) -> str:
    """HTML escaping of a SQL string expression (same order as functions.html_escape)."""
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&#x27;')")


def _html_rows(src: str) -> str:
    key = esc("coalesce(k, 'None')")
    return (f"(SELECT coalesce(string_agg('<tr><td>' || {key} || '</td><td>' || "
            f"format('{{:,}}', c) || '</td></tr>', '' ORDER BY c DESC, k ASC NULLS LAST), '') FROM {src})")


REPORT_HTML_BODY = f"""SELECT 'daily_20240131' AS report_id,
  '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head><title>Daily Log Report</title></head>' || chr(10) ||
  '<body>' || chr(10) || '<h1>Daily Log Report</h1>' || chr(10) ||
  '<p>Generated: 2024-01-31T00:00:00 &middot; Period: 720 hours</p>' || chr(10) ||
  '<h2>Log Analytics</h2>' || chr(10) || '<p>Total logs: ' || format('{{:,}}', total_logs) ||
  ' &middot; Error rate: ' || error_rate || '%</p>' || chr(10) ||
  '<h3>Severity Distribution</h3>' || chr(10) || '<table>' || {_html_rows('sev')} || '</table>' || chr(10) ||
  '<h3>Top Units</h3>' || chr(10) || '<table>' || {_html_rows('unit_top')} || '</table>' || chr(10) ||
  '<h2>System Health</h2>' || chr(10) ||
  CASE WHEN status = 'no_data' THEN '<p>No system metrics available</p>' || chr(10) ELSE
    '<p>CPU Average: ' || cpu_average || '% &middot; Memory Average: ' || memory_average ||
    '% &middot; Disk Average: ' || disk_average || '% &middot; Active Alerts: ' || active_alerts || '</p>' || chr(10) ||
    '<ul>' || (SELECT coalesce(string_agg('<li>[' || {esc('severity')} || '] ' || {esc('message')} || '</li>', ''
                                          ORDER BY timestamp DESC, alert_type, message), '')
               FROM (SELECT * FROM alert_table WHERE timestamp >= {D30}
                     ORDER BY timestamp DESC, alert_type, message LIMIT 5)) || '</ul>' || chr(10) END ||
  '<h2>Anomaly Detection</h2>' || chr(10) || '<p>Total Anomalies: ' || total_anomalies ||
  ' &middot; High Severity: ' || high_severity || '</p>' || chr(10) || '<ul>' ||
  (SELECT coalesce(string_agg('<li>[' || {esc('severity')} || '] ' || {esc('description')} || '</li>', ''
                              ORDER BY kind_order, count DESC, key), '')
   FROM (SELECT *, coalesce(unit, source) AS key FROM anomalies WHERE kind_order < 3
         ORDER BY kind_order, count DESC, key LIMIT 5)) || '</ul>' || chr(10) ||
  '<h2>Recommendations</h2>' || chr(10) || '<ol>' ||
  coalesce(array_to_string(list_transform(list_filter(string_split(recs, chr(10)), lambda x: x <> ''),
                                          lambda r: '<li>' || {esc('r')} || '</li>'), ''), '') ||
  '</ol>' || chr(10) || '</body>' || chr(10) || '</html>' AS report
FROM report_lines"""

ORACLE: dict[str, str] = {
    "log_query_min_severity": _w(
        f"SELECT {QCOLS} FROM logs WHERE ts >= {D7} AND {RANK} <= 4 ORDER BY ts DESC, id DESC LIMIT 500", LOGS),
    "log_query_contains": _w(
        f"SELECT {QCOLS} FROM logs WHERE ts >= {D30} AND message ILIKE '%ERROR by user 1%' "
        "ORDER BY ts DESC, id DESC LIMIT 10000", LOGS),
    "log_query_source_unit_host": _w(
        f"SELECT {QCOLS} FROM logs WHERE ts >= {D30} AND source = 'journald' AND unit = 'sshd' "
        "AND hostname = 'host0' ORDER BY ts DESC, id DESC LIMIT 10000", LOGS),
    "log_query_asc": _w(
        f"SELECT {QCOLS} FROM logs WHERE ts >= {D14} AND {RANK} <= 3 ORDER BY ts ASC, id ASC LIMIT 1000", LOGS),
    "discover_unit": _discover("unit"),
    "discover_hostname": _discover("hostname"),
    "discover_source": _discover("source"),
    "discover_severity": _discover("severity"),
    "anomaly_error_spike": _w("SELECT * FROM spikes", LOGS, SPIKES),
    "anomaly_high_volume": _w("SELECT * FROM volume", LOGS, VOLUME),
    "anomaly_missing_logs": _w("SELECT * FROM missing", LOGS, MISSING),
    "anomalies_all": _w("SELECT * FROM anomalies", LOGS, SPIKES, VOLUME, MISSING, ALL_ANOMALIES),
    "anomaly_summary": _w("""
SELECT count(*) AS total_anomalies,
  count(*) FILTER (WHERE severity = 'high') AS high_severity,
  count(*) FILTER (WHERE severity = 'medium') AS medium_severity,
  count(*) FILTER (WHERE type = 'error_spike') AS error_spike_count,
  count(*) FILTER (WHERE type = 'high_volume') AS high_volume_count,
  (SELECT string_agg('[' || severity || '] ' || description, chr(10) ORDER BY kind_order, count DESC, k)
   FROM (SELECT kind_order, severity, description, count, coalesce(unit, source) AS k FROM anomalies
         WHERE kind_order < 3 ORDER BY kind_order, count DESC, k LIMIT 5)) AS recent_anomalies
FROM anomalies WHERE kind_order < 3""", LOGS, SPIKES, VOLUME, MISSING, ALL_ANOMALIES),
    "parse_journald": _w("SELECT ts, hostname, unit, severity, pid, message, cursor FROM logs", LOGS),
    "parse_syslog": _w("SELECT date_trunc('second', ts) AS ts, hostname, coalesce(unit, 'kernel') AS unit, severity, "
                       "CASE WHEN severity = 'warning' THEN NULL ELSE pid END AS pid, message FROM logs", LOGS),
    "parse_container": _w("SELECT ts, 'localhost' AS hostname, hostname AS unit, "
                          f"CASE WHEN {RANK_LE4} THEN 'warning' ELSE 'info' END AS severity, message FROM logs", LOGS),
    "source_exclude_units": _w("SELECT ts, hostname, unit, severity, pid, message, cursor, 'journal' AS source_name "
                               f"FROM logs WHERE ts >= {D30} AND coalesce(unit, '') NOT LIKE 'systemd-%'", LOGS),
    "source_container_globs": _w(
        f"SELECT ts, hostname AS unit, CASE WHEN {RANK_LE4} THEN 'warning' ELSE 'info' END AS severity, message "
        f"FROM logs WHERE ts >= {D30} AND (regexp_full_match(hostname, 'host[0-4]') OR regexp_full_match(hostname, 'h.*7')) "
        "AND NOT regexp_full_match(hostname, 'host[^0-3]')", LOGS),
    "log_fingerprint": _w(f"SELECT id AS event_id, fp AS fingerprint, {x2('fp')} AS id FROM (SELECT *, {FP} AS fp FROM logs)",
                          LOGS),
    "ingest_dedup": _w(f"""SELECT {x2('fingerprint')} AS id, fingerprint, cursor, ts, unit, severity, message FROM d2
WHERE fingerprint NOT IN (SELECT fingerprint FROM stored)
  AND {x2('fingerprint')} NOT IN (SELECT id FROM stored)
  AND (cursor IS NULL OR cursor NOT IN (SELECT cursor FROM stored WHERE cursor IS NOT NULL))""",
                       LOGS, BATCH, FPB, STORED, DEDUP),
    "ingest_cursor_state": _w("""SELECT coalesce(n.source, p.source) AS source, coalesce(n.c, p.c) AS cursor,
  CASE WHEN n.c IS NOT NULL THEN TIMESTAMP '2024-01-31 00:00:00' ELSE p.u END AS updated_at
FROM (SELECT source, arg_max(cursor, id * 2) AS c, TIMESTAMP '2024-01-15 00:00:00' AS u FROM logs
      WHERE ts < TIMESTAMP '2024-01-05 00:00:00' AND cursor IS NOT NULL GROUP BY source) p
FULL OUTER JOIN (SELECT source_name AS source, arg_max(cursor, seq) AS c FROM batch
      WHERE source_name <> 'container' AND cursor IS NOT NULL GROUP BY source_name) n ON n.source = p.source""",
                              LOGS, BATCH),
    "ingest_all_counts": _w("""SELECT source_name, count(*) AS parsed_rows, count(*) AS inserted_rows FROM (
  SELECT 'journal' AS source_name FROM logs WHERE ts >= TIMESTAMP '2024-01-01 00:00:00'
  UNION ALL SELECT 'syslog' FROM logs WHERE source = 'file' AND date_trunc('second', ts) >= TIMESTAMP '2024-01-01 00:00:00'
  UNION ALL SELECT 'apps' FROM logs WHERE source = 'container' AND ts >= TIMESTAMP '2024-01-01 00:00:00')
GROUP BY source_name""", LOGS),
    "migrate_ids": _w(f"SELECT id AS event_id, {x2(FP)} AS id FROM logs", LOGS),
    "log_summary": _w("SELECT * FROM log_summary", LOGS, W30, LOG_SUMMARY),
    "daily_report": _w("""SELECT 'daily_20240131' AS report_id, 720 AS period_hours, l.total_logs, l.error_count,
  l.error_rate, h.status AS health_status, h.cpu_average, h.memory_average, h.disk_average, h.active_alerts,
  a.total_anomalies, a.high_severity,
  concat_ws(chr(10),
    CASE WHEN l.error_rate > 5 THEN 'High error rate detected: ' || l.error_rate || '%. Review system logs for issues.' END,
    CASE WHEN h.status <> 'no_data' AND h.cpu_average > 80 THEN 'High CPU usage detected. Consider investigating resource-intensive processes.' END,
    CASE WHEN h.status <> 'no_data' AND h.memory_average > 85 THEN 'High memory usage detected. Consider memory optimization or cleanup.' END,
    CASE WHEN h.active_alerts > 0 THEN h.active_alerts || ' active alerts require attention.' END,
    CASE WHEN a.high_severity > 0 THEN a.high_severity || ' high-severity anomalies detected.' END) AS recommendations
FROM log_summary l, health h,
  (SELECT count(*) AS total_anomalies, count(*) FILTER (WHERE severity = 'high') AS high_severity
   FROM anomalies WHERE kind_order < 3) a""",
                       LOGS, W30, LOG_SUMMARY, METRICS, ALERTS_T, ALERTS_S, ALERT_TABLE, HEALTH,
                       SPIKES, VOLUME, MISSING, ALL_ANOMALIES),
    "metrics_query": _w("""SELECT timestamp, metric_type, metric_data FROM (
  SELECT * FROM metrics WHERE timestamp >= TIMESTAMP '2024-01-24 00:00:00' AND metric_type = 'service'
  ORDER BY timestamp DESC, metric_type, metric_data LIMIT 1000) WHERE json_valid(metric_data)""", METRICS),
    "metrics_query_latest": _w("""SELECT timestamp, metric_type, metric_data FROM (
  SELECT * FROM metrics WHERE timestamp >= TIMESTAMP '2024-01-28 00:00:00'
  ORDER BY timestamp DESC, metric_type, metric_data LIMIT 200) WHERE json_valid(metric_data)""", METRICS),
    "metric_averages": _w(f"""SELECT metric_type, round(avg(v), 4) AS avg_value, count(*) AS points,
  count(v) AS valued_points, arg_max_null(v, timestamp) AS latest_value, max(timestamp) AS latest_at
FROM (SELECT *, {MVAL} AS v FROM metrics WHERE timestamp >= {D30}) GROUP BY metric_type""", METRICS),
    "threshold_alerts": _w(stored_alerts("alerts_t"), METRICS, ALERTS_T),
    "service_down": _w(stored_alerts("alerts_s"), METRICS, ALERTS_S),
    "alerts_query": _w(f"""SELECT * FROM alert_table WHERE timestamp >= {D7} AND severity = 'warning'
  AND NOT acknowledged AND json_valid(metric_data)""", METRICS, ALERTS_T, ALERTS_S, ALERT_TABLE),
    "health_summary": _w("SELECT * FROM health", METRICS, ALERTS_T, ALERTS_S, ALERT_TABLE, HEALTH),
    "index_candidates": _w(f"SELECT id, ts, {DOC} AS search_text FROM logs WHERE ts >= {D30} "
                           "AND id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT id FROM logs))", LOGS),
    "index_build": _w("""SELECT log_id, document, 64 AS dims, array_to_string(list_transform(embedding, lambda x:
  CAST(CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), ',') AS embedding_micros FROM idx""", LOGS, INDEX),
    "index_ledger_new": _w("SELECT log_id, TIMESTAMP '2024-01-31 00:00:00' AS indexed_at FROM idx", LOGS, INDEX),
    "search_text": _w("SELECT * FROM hits", LOGS, INDEX, SEARCH_TEXT),
    "vector_topk": _w("SELECT * FROM hits", LOGS, HITS_ALL),
    "vector_topk_filtered": _w("SELECT * FROM hits", LOGS, HITS_FILTERED),
    "search_expand": _w("SELECT * FROM expanded", LOGS, HITS_FILTERED, EXPANDED),
    "rag_context": _w(f"""SELECT CASE WHEN count(*) = 0 THEN 'No relevant logs found.' ELSE
  'Relevant log entries:' || chr(10) || string_agg(n || '. [' || {ts_str('ts')} || '] ' || coalesce(unit, 'None') || ' (' ||
    coalesce(severity, 'None') || '): ' || coalesce(message, 'None'), chr(10) ORDER BY n) END AS context,
  CAST(count(*) AS INTEGER) AS n_logs
FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, id) AS n FROM expanded)""", LOGS, HITS_FILTERED, EXPANDED),
    "index_retention": _w("""SELECT count(*) FILTER (WHERE l.ts < TIMESTAMP '2024-01-02 00:00:00') AS deleted,
  count(*) FILTER (WHERE l.ts >= TIMESTAMP '2024-01-02 00:00:00') AS kept
FROM embeddings e JOIN logs l ON l.id = e.vec_id""", LOGS),
    **{f"audit_{t}": _audit(t) for t in ["auditd", "aide", "rkhunter", "chkrootkit", "clamav", "openscap", "lynis"]},
    "index_retention_ledger": _w("""SELECT l.id AS log_id, l.ts AS indexed_at FROM embeddings e JOIN logs l ON l.id = e.vec_id
WHERE l.ts >= TIMESTAMP '2024-01-02 00:00:00'""", LOGS),
    "index_retention_vectors": _w("""SELECT e.vec_id AS log_id FROM embeddings e JOIN logs l ON l.id = e.vec_id
WHERE l.ts >= TIMESTAMP '2024-01-02 00:00:00'""", LOGS),
    **{key: _w("SELECT ts, hostname, unit, severity, pid, message, cursor FROM logs", LOGS) for key in ("ingest_late_rows", "ingest_limited")},
    "clear_table": _w("SELECT count(*) AS rows_before, 0::BIGINT AS rows_after FROM logs", LOGS),
    "parse_raw": _w(f"""SELECT ts, '{{"raw":' || to_json(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '789Z ' ||
  CASE WHEN {RANK_LE4} THEN 'stderr' ELSE 'stdout' END || ' ' || message) || '}}' AS raw FROM logs""", LOGS),
    "parse_pattern": _w("SELECT ts, hostname, coalesce(unit, 'kernel') AS unit, severity, "
                        "CASE WHEN severity = 'warning' THEN NULL ELSE pid END AS pid, message FROM logs", LOGS),
    "vector_neighbours_exact": """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query_id, vec_id AS log_id, round(pow(list_distance(a, embedding::DOUBLE[]), 2), 9) AS d FROM q, embeddings)
SELECT query_id, log_id, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, log_id) AS rank
FROM d QUALIFY rank <= 10""",
    "stream_spike_trailing": _w("""SELECT window_end - INTERVAL '3 days' AS window_start, window_end, unit, CAST(sum(c) AS BIGINT) AS error_count
FROM (SELECT pane_end + k * INTERVAL '1 day' AS window_end, unit, c FROM closed, range(3) AS t(k))
WHERE window_end <= (SELECT max(pane_end) FROM closed) GROUP BY ALL HAVING sum(c) > 5""", LOGS, """closed AS (
  SELECT time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS pane_end, unit, count(*) FILTER (WHERE severity IN ('err', 'crit', 'emerg')) AS c
  FROM logs GROUP BY ALL HAVING pane_end <= (SELECT max(ts) FROM logs) - INTERVAL '2 hours')"""),
    "ingest_resume": _w("SELECT ts, hostname, unit, severity, pid, message, cursor FROM logs", LOGS),
    "audit_findings": _w("SELECT scan_time, host, tool, kind, line_no, text FROM fl WHERE kind IS NOT NULL",
                         SCAN_LINES, AUDIT_FLAGS),
    "audit_rollup": _w("""SELECT host, count(*) AS total_audits, count(*) FILTER (WHERE severity = 'info') AS passed,
  count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'error') AS errors
FROM (SELECT host, tool, arg_max(severity, scan_time) AS severity FROM records GROUP BY host, tool) GROUP BY host""",
                       SCAN_LINES, AUDIT_FLAGS, AUDIT_RESULTS, AUDIT_RECORDS),
    "audit_history": _w("""SELECT id, tool, host, scan_time, status, summary, severity FROM records WHERE tool = 'aide'
ORDER BY scan_time DESC, id LIMIT 50""", SCAN_LINES, AUDIT_FLAGS, AUDIT_RESULTS, AUDIT_RECORDS),
    **{key: _w(f"""SELECT r.id, tool, host, scan_time, status, severity, summary, rc, line_count, finding_count, scanned_files,
  pass_count, fail_count, error_count, details, details2 FROM res JOIN (SELECT id, tool, host, scan_time FROM records) r USING (tool, host, scan_time)
WHERE r.id = {_audit_id(tool, 'host3', '2024-01-15 00:00:00')}""", SCAN_LINES, AUDIT_FLAGS, AUDIT_RESULTS, AUDIT_RECORDS)
       for key, tool in (("audit_details", "clamav"), ("audit_details_openscap", "openscap"), ("audit_details_lynis", "lynis"))},
    "chat_history": _w("SELECT id, timestamp, role, content, session_id FROM chat ORDER BY timestamp DESC, id DESC LIMIT 50",
                       CHAT),
    "chat_stats": _w("""SELECT (SELECT count(*) FROM chat) AS total_messages,
  (SELECT string_agg(coalesce(role, 'None') || ': ' || n, ', ' ORDER BY role NULLS LAST)
   FROM (SELECT role, count(*) AS n FROM chat GROUP BY role)) AS messages_by_role,
  (SELECT count(*) FROM chat WHERE timestamp >= TIMESTAMP '2024-01-30 23:00:00') AS recent_messages_1h""", CHAT),
    "stream_ingest": _w(f"SELECT {x2('fp')} AS id, fp AS fingerprint, ts, unit, severity, message "
                        f"FROM (SELECT *, {FP} AS fp FROM logs)", LOGS),
    "stream_error_spike": _w("""SELECT time_bucket(INTERVAL '1 day', ts) AS window_start,
  time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, unit, count(*) AS error_count
FROM logs WHERE severity IN ('err', 'crit', 'emerg') GROUP BY ALL HAVING count(*) > 10""", LOGS),
    "stream_alerts": _w(stored_alerts("alerts_t"), METRICS, ALERTS_T),
    "stream_error_spike_closed": _w("""SELECT * FROM (SELECT time_bucket(INTERVAL '1 day', ts) AS window_start,
  time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, unit, count(*) AS error_count
  FROM logs WHERE severity IN ('err', 'crit', 'emerg') GROUP BY ALL)
WHERE error_count > 2 AND window_end <= (SELECT max(ts) FROM logs) - INTERVAL '2 hours'""", LOGS),
    "stream_service_down": _w(stored_alerts("""(SELECT * FROM alerts_s WHERE timestamp + INTERVAL '1 hour' <=
  (SELECT max(timestamp) FROM metrics) - INTERVAL '2 hours')"""), METRICS, ALERTS_S),
    "stream_container": _w(f"""SELECT {x2('fp')} AS id, fp AS fingerprint, ts, unit, severity, message FROM (
  SELECT DISTINCT sha256({TS_STR} || '|localhost|' || unit || '|' || severity || '|None|' || message) AS fp,
    ts, unit, severity, message
  FROM (SELECT ts, hostname AS unit, CASE WHEN {RANK_LE4} THEN 'warning' ELSE 'info' END AS severity, message FROM logs))""",
                           LOGS),
    "ingest_isolated": _w(f"""SELECT 'journal' AS source_name, count(*) AS parsed_rows, count(DISTINCT {FP}) AS inserted_rows,
  false AS failed FROM logs WHERE ts >= {D30}
UNION ALL SELECT 'again', count(*), 0, false FROM logs WHERE ts >= {D30}
UNION ALL SELECT 'broken', 0, 0, true
UNION ALL SELECT 'apps', count(*), count(DISTINCT concat_ws('|', ts, hostname, {RANK_LE4}, message)), false
  FROM logs WHERE ts >= {D30}""", LOGS),
    "report_list": _w(f"""SELECT name, CAST(strlen(report) + 1 AS BIGINT) AS size FROM ({REPORT_TEXT_BODY}),
  (VALUES ('report_20240129_000000.txt'), ('report_20240130_000000.txt'), ('report_20240131_000000.txt')) n(name)""",
                      LOGS, W30, LOG_SUMMARY, METRICS, ALERTS_T, ALERTS_S, ALERT_TABLE, HEALTH,
                      SPIKES, VOLUME, MISSING, ALL_ANOMALIES, REPORT_TEXT),
    "file_ingest": _w("""SELECT hostname, count(*) AS rows, min(date_trunc('second', ts)) AS first_ts,
  max(date_trunc('second', ts)) AS last_ts FROM logs GROUP BY hostname""", LOGS),
    "fetch_by_ids": _w("SELECT id, ts, unit, severity, message FROM logs WHERE id IN (SELECT vec_id FROM embeddings)",
                       LOGS),
    "log_ndjson": _w(f"""SELECT CAST(json_object('id', id, 'ts', {ts_str('ts')}, 'hostname', hostname, 'source', source,
  'unit', unit, 'severity', severity, 'pid', pid, 'message', message) AS VARCHAR) AS value
FROM (SELECT {QCOLS} FROM logs WHERE ts >= {D7} AND {RANK} <= 4 ORDER BY ts DESC, id DESC LIMIT 500)""", LOGS),
    "service_status": _w(f"""SELECT CAST(date_trunc('hour', timestamp) AS TIMESTAMP) AS capture,
  epoch_us(timestamp) AS line_no, {jfield('service_name')} AS service_name, 'loaded' AS load_state,
  'active' AS active_state, 'running' AS sub_state
FROM metrics WHERE metric_type = 'service' AND json_valid(metric_data)""", METRICS),
    "source_newest_n": _w(f"""SELECT ts, hostname, unit, severity, pid, message, cursor FROM logs
WHERE ts >= {D30} AND unit IN ('sshd', 'cron') ORDER BY ts DESC, cursor DESC LIMIT 200""", LOGS),
    "uptime_summary": _w("""SELECT timestamp, boot_time, CAST(datediff('second', boot_time, timestamp) AS DOUBLE) AS uptime_seconds,
  CAST(floor(datediff('second', boot_time, timestamp) / 86400) AS BIGINT) AS uptime_days
FROM (SELECT timestamp, timestamp - to_seconds(CAST(json_extract_string(metric_data, '$.uptime_seconds') AS DOUBLE)) AS boot_time
      FROM metrics WHERE metric_type = 'uptime')""", METRICS),
    "report_text": _w(REPORT_TEXT_BODY, LOGS, W30, LOG_SUMMARY, METRICS, ALERTS_T, ALERTS_S, ALERT_TABLE, HEALTH,
                      SPIKES, VOLUME, MISSING, ALL_ANOMALIES, REPORT_TEXT),
    "snapshot_rows": _w("""SELECT timestamp, metric_type, CAST(CASE metric_type
    WHEN 'cpu' THEN json_object('cpu_percent', CAST(json_extract_string(metric_data, '$.cpu_percent') AS DOUBLE))
    WHEN 'memory' THEN json_object('memory_percent', CAST(json_extract_string(metric_data, '$.memory_percent') AS DOUBLE))
    WHEN 'disk' THEN json_object('mountpoint', json_extract_string(metric_data, '$.mountpoint'),
                                 'percent', CAST(json_extract_string(metric_data, '$.percent') AS DOUBLE))
    WHEN 'service' THEN json_object('service_name', json_extract_string(metric_data, '$.service_name'))
    WHEN 'uptime' THEN json_object('uptime_seconds', CAST(json_extract_string(metric_data, '$.uptime_seconds') AS BIGINT))
  END AS VARCHAR) AS metric_data
FROM metrics WHERE json_valid(metric_data)""", METRICS),
    "report_json": _w(REPORT_JSON_BODY, LOGS, W30, LOG_SUMMARY, METRICS, ALERTS_T, ALERTS_S, ALERT_TABLE, HEALTH,
                      SPIKES, VOLUME, MISSING, ALL_ANOMALIES, REPORT_TEXT),
    "report_html": _w(REPORT_HTML_BODY, LOGS, W30, LOG_SUMMARY, METRICS, ALERTS_T, ALERTS_S, ALERT_TABLE, HEALTH,
                      SPIKES, VOLUME, MISSING, ALL_ANOMALIES, REPORT_TEXT),
}
# The same results by other ways of checking and reading.
ORACLE["ingest_keyed"] = ORACLE["ingest_dedup"]
ORACLE["stream_positions"] = ORACLE["stream_ingest"]
ORACLE["log_query_contains_indexed"] = ORACLE["log_query_contains"]
# Rows that came through the journal have that source.
ORACLE["totals_log_summary"] = _w("SELECT * REPLACE ('journald: ' || total_logs AS top_sources) FROM log_summary", LOGS, W30, LOG_SUMMARY)
ORACLE["totals_error_spike"] = ORACLE["anomaly_error_spike"]
