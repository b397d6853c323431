"""Security-scanner output analytics.

Input: captured tool output as lines ``(scan_time, host, tool, line_no, line,
rc)``; one scan is one ``(scan_time, host, tool)`` and its exit code is the max
``rc`` of its lines. Every tool is classified by the same grouped aggregation
(partial aggregation per task before its shuffle). The "first 10 lines"
samples use ``row_number() <= 10``, which Spark plans as a partial per-task
group limit before their shuffle, so a scan holding a third of all lines never
reaches one task whole. Counts and samples (both one row per scan) are then
joined on the scan key. ``findings`` gives every finding as a row of its own; the
AIDE and ClamAV lists are whole in the records too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions import fill, id_from_fingerprint, py_ts_str
from timberline.params import AuditHistoryParams

SCAN_KEYS = ["scan_time", "host", "tool"]
SAMPLE_SIZE = 10
WHOLE_LISTS = ("aide", "clamav")  # tools whose findings are never cut

# --- fixed values (tool output markers the classification keys on) ------------
AUDITD_SUSPICIOUS = [
    r"type=EXECVE.*suid=",
    r"type=SYSCALL.*syscall=2",
    r"type=SYSCALL.*syscall=59",
    r"type=LOGIN.*res=failed",
]
AIDE_HEADER_PREFIX = "AIDE"
RKHUNTER_MARKERS = ["Warning:", "Suspicious:"]
CHKROOTKIT_MARKERS = ["INFECTED", "Warning:"]
CLAMAV_INFECTED = r"Infected files: (\d+)"
CLAMAV_SCANNED = r"Scanned files: (\d+)"
OPENSCAP_PASS, OPENSCAP_FAIL, OPENSCAP_ERROR = 'result="pass"', 'result="fail"', 'result="error"'
LYNIS_WARN = "[WARN]"
LYNIS_SUGGESTION = "[SUGGESTION]"
# Outcome (status, severity, summary) of the tools judged by exit code alone.
RC_OUTCOMES = {
    "aide": {0: ("clean", "info", "No integrity violations detected"),
             1: ("violations", "critical", "File integrity violations detected")},
    "rkhunter": {0: ("clean", "info", "No rootkits detected"),
                 1: ("warnings", "warning", "Some warnings found"),
                 2: ("suspicious", "critical", "Suspicious files detected")},
    "chkrootkit": {0: ("clean", "info", "No rootkits detected"),
                   1: ("suspicious", "critical", "Suspicious files detected")},
}
# Summary of a run whose exit code means failure (status and severity "error").
RC_FAILED = {
    "aide": "AIDE check failed: ",
    "rkhunter": "rkhunter check failed: ",
    "chkrootkit": "chkrootkit check failed: ",
    "openscap": "OpenSCAP scan failed: ",
    "lynis": "Lynis audit failed: ",
}
AUDITD_ACTIVE = "auditd service is active"
AUDITD_SUSPICIOUS_TEXT = " - {n} suspicious events detected"
CLAMAV_INFECTED_TEXT = "Virus detected in {n} locations"
CLAMAV_CLEAN_TEXT = "No viruses detected in {n} scanned files"
OPENSCAP_DONE = "OpenSCAP scan completed"
OPENSCAP_FAILURES_TEXT = " - {n} compliance failures"
LYNIS_DONE = "Lynis audit completed"
LYNIS_WARNINGS_TEXT = " - {n} warnings found"
# -----------------------------------------------------------------------------

RESULT_COLUMNS = ["scan_time", "host", "tool", "rc", "status", "severity", "summary", "line_count",
                  "finding_count", "scanned_files", "pass_count", "fail_count", "error_count",
                  "details", "details2"]


def _contains_any(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def _line_flags(lines: DataFrame) -> DataFrame:
    """Per-line markers (X10); each one is read only for its own tool."""
    raw, tool = F.col("line"), F.col("tool")
    text = F.trim(raw)
    nonblank = text != ""
    infected_n = F.regexp_extract(raw, CLAMAV_INFECTED, 1).try_cast("long")
    has_infected = raw.contains("Infected files:")
    warned = F.when(tool == "rkhunter", _contains_any(raw, RKHUNTER_MARKERS)) \
              .otherwise(_contains_any(raw, CHKROOTKIT_MARKERS))
    suggestion = ~raw.contains(LYNIS_WARN) & raw.contains(LYNIS_SUGGESTION)
    # Sample kind: 1 = the tool's primary list, 2 = lynis suggestions.
    kind = (F.when((tool == "auditd") & nonblank, 1)
            .when((tool == "aide") & nonblank & ~raw.startswith(AIDE_HEADER_PREFIX), 1)
            .when(tool.isin("rkhunter", "chkrootkit") & warned, 1)
            .when((tool == "clamav") & nonblank & has_infected & (F.coalesce(infected_n, F.lit(0)) > 0), 1)
            .when((tool == "lynis") & raw.contains(LYNIS_WARN), 1)
            .when((tool == "lynis") & suggestion, 2))
    return lines.select(
        *SCAN_KEYS, "line_no", text.alias("text"), F.col("rc"), kind.alias("kind"),
        nonblank.alias("nonblank"),
        (nonblank & raw.rlike("|".join(f"(?:{p})" for p in AUDITD_SUSPICIOUS))).alias("suspicious"),
        F.when(nonblank & ~has_infected & raw.contains("Scanned files:"),
               F.regexp_extract(raw, CLAMAV_SCANNED, 1).try_cast("long")).alias("scanned"),
        F.regexp_count(raw, F.lit(OPENSCAP_PASS)).alias("n_pass"),
        F.regexp_count(raw, F.lit(OPENSCAP_FAIL)).alias("n_fail"),
        F.regexp_count(raw, F.lit(OPENSCAP_ERROR)).alias("n_error"))


def _aggregate(flags: DataFrame) -> DataFrame:
    return flags.groupBy(*SCAN_KEYS).agg(
        F.max("rc").alias("rc"),
        F.count_if(F.col("nonblank")).alias("line_count"),
        F.count_if(F.col("suspicious")).alias("n_suspicious"),
        F.count_if(F.col("kind") == 1).alias("n_primary"),
        F.count_if(F.col("kind") == 2).alias("n_secondary"),
        F.sum("scanned").alias("n_scanned"),
        F.sum("n_pass").alias("n_pass"), F.sum("n_fail").alias("n_fail"), F.sum("n_error").alias("n_error"))


def findings(lines: DataFrame) -> DataFrame:
    """Every finding of every scan, one row each: the scan, the list it belongs to (1: the
    tool's own, 2: lynis suggestions), its line and text. A narrow pass without a shuffle."""
    return _line_flags(lines).filter(F.col("kind").isNotNull()).select(*SCAN_KEYS, "kind", "line_no", "text")


def _samples(flags: DataFrame) -> DataFrame:
    """T4: the first ``SAMPLE_SIZE`` lines of each list, in line order, in one pass; a line of
    ``WHOLE_LISTS`` has a number of its own, so each is the first of its group and all are kept."""
    listed = flags.filter(F.col("kind").isNotNull()).withColumn(
        "_own", F.when(F.col("tool").isin(*WHOLE_LISTS), F.monotonically_increasing_id()))
    w = Window.partitionBy(*SCAN_KEYS, "kind", "_own").orderBy("line_no")
    first = listed.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= SAMPLE_SIZE)
    return first.groupBy(*SCAN_KEYS).agg(
        F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY line_no) FILTER (WHERE kind = 1)").alias("_s1"),
        F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY line_no) FILTER (WHERE kind = 2)").alias("_s2"))


def _rc_table(tool: str, field: int, failed: str) -> Column:
    """Field ``field`` of ``RC_OUTCOMES[tool]`` for the scan's exit code, else ``failed``."""
    rc, out = F.col("rc"), None
    for code, outcome in RC_OUTCOMES[tool].items():
        value = F.lit(outcome[field])
        out = F.when(rc == code, value) if out is None else out.when(rc == code, value)
    return out.otherwise(F.lit(failed))


def _suffix(cond: Column, template: str, n: Column) -> Column:
    return F.when(cond, fill(template, n=n)).otherwise(F.lit(""))


def scan_results(lines: DataFrame) -> DataFrame:
    """One normalised result per scan: status, severity, summary, the
    tool's finding count, and the first ten lines of its finding list(s)."""
    flags = _line_flags(lines)
    df = _aggregate(flags).join(_samples(flags), SCAN_KEYS, "left")
    t, rc = F.col("tool"), F.col("rc")
    susp, prim, fail = F.col("n_suspicious"), F.col("n_primary"), F.col("n_fail")
    scanned = F.coalesce(F.col("n_scanned"), F.lit(0))
    status, severity, summary = F.when(t == "auditd", F.lit("running")), \
        F.when(t == "auditd", F.when((rc == 0) & (susp > 0), F.lit("warning")).otherwise(F.lit("info"))), \
        F.when(t == "auditd", F.concat(F.lit(AUDITD_ACTIVE), _suffix((rc == 0) & (susp > 0), AUDITD_SUSPICIOUS_TEXT, susp)))
    for tool in RC_OUTCOMES:
        status = status.when(t == tool, _rc_table(tool, 0, "error"))
        severity = severity.when(t == tool, _rc_table(tool, 1, "error"))
        summary = summary.when(t == tool, _rc_table(tool, 2, RC_FAILED[tool]))
    status = (status.when(t == "clamav", F.when(prim > 0, F.lit("infected")).otherwise(F.lit("clean")))
              .when(t.isin("openscap", "lynis"), F.when(rc == 0, F.lit("completed")).otherwise(F.lit("error")))
              .otherwise(F.lit("unknown")))
    severity = (severity.when(t == "clamav", F.when(prim > 0, F.lit("critical")).otherwise(F.lit("info")))
                .when(t == "openscap", F.when(rc != 0, F.lit("error"))
                      .when(fail > 0, F.lit("warning")).otherwise(F.lit("info")))
                .when(t == "lynis", F.when(rc != 0, F.lit("error"))
                      .when(prim > 0, F.lit("warning")).otherwise(F.lit("info")))
                .otherwise(F.lit("info")))
    summary = (summary.when(t == "clamav", F.when(prim > 0, fill(CLAMAV_INFECTED_TEXT, n=prim))
                             .otherwise(fill(CLAMAV_CLEAN_TEXT, n=scanned)))
               .when(t == "openscap", F.when(rc == 0, F.concat(F.lit(OPENSCAP_DONE), _suffix(
                   fail > 0, OPENSCAP_FAILURES_TEXT, fail))).otherwise(F.lit(RC_FAILED["openscap"])))
               .when(t == "lynis", F.when(rc == 0, F.concat(F.lit(LYNIS_DONE), _suffix(
                   prim > 0, LYNIS_WARNINGS_TEXT, prim))).otherwise(F.lit(RC_FAILED["lynis"])))
               .otherwise(F.lit("")))
    # Which lists the reference parses depends on the exit code.
    parsed = (F.when(t.isin("auditd", "openscap", "lynis"), rc == 0).when(t == "aide", rc == 1)
              .otherwise(F.lit(True)))
    finding = F.when(t == "auditd", susp).when(t == "openscap", fail).otherwise(prim)
    return df.select(
        *SCAN_KEYS, "rc", status.alias("status"), severity.alias("severity"), summary.alias("summary"),
        "line_count",
        F.when(parsed, finding).alias("finding_count"),
        F.when(t == "clamav", scanned).alias("scanned_files"),
        F.when((t == "openscap") & (rc == 0), F.col("n_pass")).alias("pass_count"),
        F.when((t == "openscap") & (rc == 0), fail).alias("fail_count"),
        F.when((t == "openscap") & (rc == 0), F.col("n_error")).alias("error_count"),
        F.when(parsed, F.col("_s1")).alias("details"),
        F.when(parsed & (t == "lynis"), F.coalesce(F.col("_s2"), F.lit(""))).alias("details2"))


def audit_id(tool: Column, host: Column, scan_time: Column) -> Column:
    """Deterministic audit id (D6): first 8 bytes of sha256(tool|host|time)."""
    return id_from_fingerprint(F.sha2(F.concat_ws("|", tool, F.coalesce(host, F.lit("None")),
                                                  py_ts_str(scan_time)), 256))


def audit_records(results: DataFrame) -> DataFrame:
    """K5: rows of ``security_audits`` (schema.SECURITY_AUDITS); defaults
    ``unknown`` / ``''`` / ``info``; tool-specific figures in ``result_data`` JSON."""
    scan_time = F.col("scan_time")
    payload = F.to_json(F.struct(*[c for c in RESULT_COLUMNS if c not in ("scan_time", "host", "tool")]))
    return results.select(
        audit_id(F.col("tool"), F.col("host"), scan_time).alias("id"),
        "tool", "host", scan_time.alias("scan_time"),
        F.coalesce(F.col("status"), F.lit("unknown")).alias("status"),
        payload.alias("result_data"),
        F.coalesce(F.col("summary"), F.lit("")).alias("summary"),
        F.coalesce(F.col("severity"), F.lit("info")).alias("severity"))


def audit_rollup(records: DataFrame) -> DataFrame:
    """A10 per host: the latest audit of each tool, counted by severity
    (passed = info, warnings, critical, errors)."""
    latest = records.groupBy("host", "tool").agg(F.max_by("severity", "scan_time").alias("severity"))
    sev = F.col("severity")
    return latest.groupBy("host").agg(
        F.count(F.lit(1)).alias("total_audits"),
        F.count_if(sev == "info").alias("passed"),
        F.count_if(sev == "warning").alias("warnings"),
        F.count_if(sev == "critical").alias("critical"),
        F.count_if(sev == "error").alias("errors"))


def audit_history(records: DataFrame, p: AuditHistoryParams) -> DataFrame:
    """optional tool filter, newest first (id breaks ties), top ``limit``."""
    df = records if p.tool is None else records.filter(F.col("tool") == p.tool)
    return df.select("id", "tool", "host", "scan_time", "status", "summary", "severity") \
             .orderBy(F.col("scan_time").desc(), F.col("id")).limit(p.limit)


#: The tool-specific figures of an audit, as they are stored and read back.
PAYLOAD = ("rc int, line_count bigint, finding_count bigint, scanned_files bigint, pass_count bigint, "
           "fail_count bigint, error_count bigint, details string, details2 string")


def audit_details(records: DataFrame, audit_id_value: int) -> DataFrame:
    """one audit by id with its whole payload parsed into typed fields."""
    row = records.filter(F.col("id") == F.lit(audit_id_value)).withColumn("p", F.from_json("result_data", PAYLOAD))
    return row.select("id", "tool", "host", "scan_time", "status", "severity", "summary", "p.*")
