"""Table schemas and the fixed vocabularies the operators share."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the reference's for identical results) ---------
# Severity names in rank order; journald PRIORITY / syslog PRI&7 index into it.
SEVERITY_ORDER = ["emerg", "alert", "crit", "err", "warning", "notice", "info", "debug"]
# Rank given to a severity outside the list when filtering by minimum severity.
UNKNOWN_SEVERITY_RANK = 99
# Severities counted as errors by anomaly rules and reports ("alert" is not one).
ERROR_SEVERITIES = ["err", "crit", "emerg"]
# Units whose absence in a window is reported as missing_logs.
EXPECTED_UNITS = ["systemd", "sshd", "cron"]
# Services that raise service_down when absent from a snapshot.
CRITICAL_SERVICES = ["sshd", "systemd", "dbus"]
# Thresholds of the fixed anomaly and alert rules.
ERROR_SPIKE_THRESHOLD = 10
HIGH_VOLUME_THRESHOLD = 1000
CPU_ALERT_PERCENT = 90.0
MEMORY_ALERT_PERCENT = 90.0
DISK_ALERT_PERCENT = 90.0
# Vector dimension of an absent embedding (zeros) in the vector sink.
DEFAULT_EMBED_DIM = 384
# -----------------------------------------------------------------------------

LOGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("hostname", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("facility", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("pid", T.IntegerType()),
    T.StructField("uid", T.IntegerType()),
    T.StructField("gid", T.IntegerType()),
    T.StructField("message", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("cursor", T.StringType()),
])

LOG_COLUMNS = [f.name for f in LOGS.fields]

# Columns a parser produces before fingerprint/id are attached.
PARSED = T.StructType([f for f in LOGS.fields if f.name not in ("id", "fingerprint")])

INGEST_STATE = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("cursor", T.StringType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

LOG_EMBEDDINGS = T.StructType([
    T.StructField("log_id", T.LongType(), False),
    T.StructField("indexed_at", T.TimestampNTZType()),
])

METRICS = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("metric_type", T.StringType(), False),
    T.StructField("metric_data", T.StringType()),
])

ALERTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("timestamp", T.TimestampNTZType(), False),
    T.StructField("alert_type", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("metric_data", T.StringType()),
    T.StructField("acknowledged", T.BooleanType()),
    T.StructField("acknowledged_at", T.TimestampNTZType()),
])

SECURITY_AUDITS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("tool", T.StringType(), False),
    T.StructField("host", T.StringType()),
    T.StructField("scan_time", T.TimestampNTZType(), False),
    T.StructField("status", T.StringType()),
    T.StructField("result_data", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("severity", T.StringType()),
])

CHAT_HISTORY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("session_id", T.StringType()),
])

# journald export fields, all read as strings (journald writes numbers as text).
JOURNALD_FIELDS = [
    "__REALTIME_TIMESTAMP", "__CURSOR", "_HOSTNAME", "_SYSTEMD_UNIT", "SYSLOG_IDENTIFIER",
    "SYSLOG_FACILITY", "PRIORITY", "_PID", "_UID", "_GID", "MESSAGE",
]
JOURNALD = T.StructType([T.StructField(n, T.StringType()) for n in JOURNALD_FIELDS])
