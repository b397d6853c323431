"""Views over the driver's test tables that give the operators their input.

The SQL texts below run unchanged on Spark and DuckDB, so the Spark queries and
their DuckDB oracles see identical input. They only shape rows into the schemas
the operators expect; all operator work happens in the library.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"

LOGS_SQL = """
SELECT event_id AS id, ts, concat('host', user_id % 8) AS hostname,
  CASE event_id % 3 WHEN 0 THEN 'journald' WHEN 1 THEN 'file' ELSE 'container' END AS source,
  CASE user_id % 6 WHEN 0 THEN 'sshd' WHEN 1 THEN 'cron' WHEN 2 THEN 'nginx.service'
    WHEN 3 THEN 'systemd-networkd.service' WHEN 4 THEN 'app_1' END AS unit,
  CASE event_type WHEN 'error' THEN CASE event_id % 5 WHEN 0 THEN 'emerg' WHEN 1 THEN 'alert' WHEN 2 THEN 'crit' ELSE 'err' END
    WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'notice' WHEN 'view' THEN 'info' ELSE 'debug' END AS severity,
  CAST(user_id AS INT) AS pid,
  concat(event_type, ' by user ', user_id, ' ', props) AS message, props AS raw,
  concat('c-', event_id) AS cursor
FROM events
"""

METRICS_SQL = """
SELECT ts AS timestamp,
  CASE event_type WHEN 'view' THEN 'cpu' WHEN 'click' THEN 'memory' WHEN 'purchase' THEN 'disk'
    WHEN 'signup' THEN 'uptime' ELSE 'service' END AS metric_type,
  CASE event_type WHEN 'view' THEN concat('{"cpu_percent": ', least(value, CAST(100 AS DOUBLE)), '}')
    WHEN 'click' THEN concat('{"memory_percent": ', least(value, CAST(100 AS DOUBLE)), '}')
    WHEN 'purchase' THEN concat('{"mountpoint": "/m', user_id % 4, '", "percent": ', least(value, CAST(100 AS DOUBLE)), '}')
    WHEN 'signup' THEN concat('{"uptime_seconds": ', event_id * 60, '}')
    ELSE CASE event_id % 10 WHEN 0 THEN '{broken' ELSE concat('{"service_name": "', CASE user_id % 3 WHEN 0 THEN 'sshd' WHEN 1 THEN 'dbus' ELSE 'nginx' END, '.service"}') END
  END AS metric_data
FROM events
"""

SCAN_LINES_SQL = """
SELECT CAST(ts AS DATE) AS scan_date, concat('host', user_id % 8) AS host,
  CASE event_id % 7 WHEN 0 THEN 'auditd' WHEN 1 THEN 'aide' WHEN 2 THEN 'rkhunter' WHEN 3 THEN 'chkrootkit'
    WHEN 4 THEN 'clamav' WHEN 5 THEN 'openscap' ELSE 'lynis' END AS tool,
  event_id AS line_no,
  CASE event_id % 7
    WHEN 0 THEN CASE event_type WHEN 'error' THEN 'type=LOGIN msg=audit res=failed' WHEN 'click' THEN 'type=SYSCALL syscall=59' ELSE 'type=PATH msg=audit' END
    WHEN 1 THEN CASE event_type WHEN 'view' THEN 'AIDE found differences' ELSE concat('changed: /etc/f', user_id) END
    WHEN 2 THEN CASE event_type WHEN 'error' THEN 'Warning: hidden file' WHEN 'click' THEN 'warning: lower case' ELSE 'ok' END
    WHEN 3 THEN CASE event_type WHEN 'error' THEN 'ps INFECTED' ELSE 'not found' END
    WHEN 4 THEN CASE event_type WHEN 'error' THEN concat('Infected files: ', user_id % 3) ELSE concat('Scanned files: ', user_id) END
    WHEN 5 THEN CASE event_type WHEN 'error' THEN '<r result="fail"/><r result="pass"/>' ELSE '<r result="pass"/>' END
    ELSE CASE event_type WHEN 'error' THEN '[WARN] x' WHEN 'click' THEN '[SUGGESTION] y' ELSE 'ok' END END AS line,
  CASE event_type WHEN 'error' THEN 1 ELSE 0 END AS is_error
FROM events
"""

CHAT_HISTORY_SQL = f"""
SELECT conv_id * 1000 + turn AS id,
  CAST(TIMESTAMP '{AS_OF}' - (conv_id * 60 + turn) * INTERVAL '1' SECOND AS TIMESTAMP) AS timestamp,
  role, text AS content, CAST(conv_id AS STRING) AS session_id
FROM conversations
"""

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, base: str) -> DataFrame:
    # A per-call view name keeps concurrent fixtures (different sf dirs) apart; the
    # returned DataFrame is analysed immediately so the view can be replaced later.
    name = f"_tl_{base}_{zlib.crc32(sf_dir.encode())}"
    table(spark, sf_dir, base).createOrReplaceTempView(name)
    return spark.sql(sql.replace(f"FROM {base}", f"FROM {name}"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``logs`` table (schema.LOGS minus facility/uid/gid/fingerprint)."""
    return _view(spark, sf_dir, LOGS_SQL, "events")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``system_metrics`` table (timestamp, metric_type, metric_data)."""
    return _view(spark, sf_dir, METRICS_SQL, "events")


def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured security-tool output lines (scan_date, host, tool, line_no, line, is_error)."""
    return _view(spark, sf_dir, SCAN_LINES_SQL, "events")


def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, CHAT_HISTORY_SQL, "conversations")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector rows (log_id, embedding) from ``embeddings``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("log_id"), F.col("embedding"))


def index_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log_embeddings`` ledger: every vector id is indexed at its log's ts."""
    lg = logs(spark, sf_dir).select(F.col("id"), F.col("ts"))
    return (vectors(spark, sf_dir).select("log_id")
            .join(lg, F.col("log_id") == F.col("id"), "inner")
            .select("log_id", F.col("ts").alias("indexed_at")))


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search query vector: the row with vec_id 0 (one row)."""
    return vectors(spark, sf_dir).filter(F.col("log_id") == 0).select("embedding")


# --- rendered raw lines ---------------------------------------------------------
# These rebuild the text a host would have produced for each ``logs`` row so the
# parsers can be checked against the row they came from. They only render text;
# all parsing happens in timberline.sources. Raw lines arrive as files: the
# rendered lines are written once into the shared checkpoint folder, spread over
# the session's cores, so the parsers read a plain column like a landing folder
# (and the optimizer cannot push parser predicates into the rendering).


def _as_landed(df: DataFrame) -> DataFrame:
    from timberline.session import materialize
    return materialize(df.repartition(df.sparkSession.sparkContext.defaultParallelism))

def _sev_index() -> "F.Column":
    from timberline.schema import SEVERITY_ORDER
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity")) - 1


def journald_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """journald ``-o json`` lines for every log row (``.service`` units in
    _SYSTEMD_UNIT, others in SYSLOG_IDENTIFIER), plus one truncated (invalid
    JSON) line per error row and one line with an invalid timestamp per notice
    row. Columns: value, seq."""
    lg = logs(spark, sf_dir)
    is_service = F.col("unit").endswith(".service")
    obj = F.struct(
        F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("__REALTIME_TIMESTAMP"),
        F.col("cursor").alias("__CURSOR"),
        F.col("hostname").alias("_HOSTNAME"),
        F.when(is_service, F.col("unit")).alias("_SYSTEMD_UNIT"),
        F.when(~is_service, F.col("unit")).alias("SYSLOG_IDENTIFIER"),
        _sev_index().cast("string").alias("PRIORITY"),
        F.col("pid").cast("string").alias("_PID"),
        F.col("message").alias("MESSAGE"))
    good = lg.select(F.to_json(obj).alias("value"), (F.col("id") * 3).alias("seq"))
    truncated = lg.filter(F.col("severity").isin("err", "crit", "emerg", "alert")).select(
        F.substring(F.to_json(obj), 1, 30).alias("value"), (F.col("id") * 3 + 1).alias("seq"))
    bad_ts = lg.filter(F.col("severity") == "notice").select(
        F.to_json(obj.withField("__REALTIME_TIMESTAMP", F.lit("not-a-time"))).alias("value"),
        (F.col("id") * 3 + 2).alias("seq"))
    return _as_landed(good.unionByName(truncated).unionByName(bad_ts))


def syslog_lines(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """RFC 3164 lines ``<pri>Mon dd HH:MM:SS host prog[pid]: msg`` (facility 1,
    day space-padded, ``[pid]`` left out on warning rows, NULL unit rendered as
    ``kernel``), plus one unparseable line per error row. Columns: value, seq."""
    lg = logs(spark, sf_dir)
    if where:
        lg = lg.filter(where)
    ts = F.col("ts")
    pid_part = F.when(F.col("severity") == "warning", F.lit("")).otherwise(
        F.concat(F.lit("["), F.col("pid").cast("string"), F.lit("]")))
    line = F.concat(F.lit("<"), (F.lit(8) + _sev_index()).cast("string"), F.lit(">"),
                    F.date_format(ts, "MMM"), F.lit(" "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "),
                    F.lit(" "), F.date_format(ts, "HH:mm:ss"), F.lit(" "), F.col("hostname"), F.lit(" "),
                    F.coalesce(F.col("unit"), F.lit("kernel")), pid_part, F.lit(": "), F.col("message"))
    good = lg.select(line.alias("value"), (F.col("id") * 2).alias("seq"))
    junk = lg.filter(F.col("severity") == "err").select(
        F.concat(F.lit("garbage line "), F.col("message")).alias("value"), (F.col("id") * 2 + 1).alias("seq"))
    return _as_landed(good.unionByName(junk))


def application_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a format of an application's own: ``<ISO time>Z host LEVEL unit[pid]: message`` (``[pid]``
    left out on warning rows, NULL unit as ``kernel``), plus one line without a time per error row.
    Columns: value, seq."""
    lg = logs(spark, sf_dir)
    pid = F.when(F.col("severity") == "warning", F.lit("")).otherwise(F.concat(F.lit("["), F.col("pid").cast("string"), F.lit("]")))
    tail = F.concat(F.lit(" "), "hostname", F.lit(" "), F.upper("severity"), F.lit(" "), F.coalesce("unit", F.lit("kernel")), pid,
                    F.lit(": "), "message")
    good = lg.select(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), tail).alias("value"), (F.col("id") * 2).alias("seq"))
    junk = lg.filter(F.col("severity") == "err").select(F.concat(F.lit("soon"), tail).alias("value"), (F.col("id") * 2 + 1).alias("seq"))
    return _as_landed(good.unionByName(junk))


def container_lines(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """Container runtime lines ``<ts with 9-digit fraction>Z stdout|stderr msg``;
    stderr for warning-or-worse rows; the container is named after the host.
    Columns: container, value, seq."""
    lg = logs(spark, sf_dir)
    if where:
        lg = lg.filter(where)
    from timberline.functions import severity_rank
    stream = F.when(severity_rank(F.col("severity")) <= 4, F.lit("stderr")).otherwise(F.lit("stdout"))
    line = F.concat(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z "),
                    stream, F.lit(" "), F.col("message"))
    return _as_landed(lg.select(F.col("hostname").alias("container"), line.alias("value"), F.col("id").alias("seq")))


# Time windows that shape the ingest fixtures (fixed values of the test setup).
STORED_BEFORE = "2024-01-05 00:00:00"     # an earlier ingest already stored these days
RESENT_FROM, RESENT_TO = "2024-01-04 00:00:00", "2024-01-06 00:00:00"   # overlapping re-send
REPLAYED_FROM, REPLAYED_TO = "2024-01-10 00:00:00", "2024-01-11 00:00:00"  # same cursor, new text


def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with duplicates: every log row (seq = 2·id); the rows of an
    overlapping window re-sent under new cursors (same content); and the
    notice rows of another day re-sent with changed text under the same
    cursor (seq = 2·id + 1)."""
    lg = logs(spark, sf_dir)
    ts = F.col("ts")
    base = lg.withColumn("seq", F.col("id") * 2)
    resent = lg.filter((ts >= F.lit(RESENT_FROM).cast("timestamp_ntz")) & (ts < F.lit(RESENT_TO).cast("timestamp_ntz"))) \
        .withColumn("cursor", F.concat("cursor", F.lit("-dup"))).withColumn("seq", F.col("id") * 2 + 1)
    replayed = lg.filter((ts >= F.lit(REPLAYED_FROM).cast("timestamp_ntz")) & (ts < F.lit(REPLAYED_TO).cast("timestamp_ntz"))
                         & (F.col("severity") == "notice")) \
        .withColumn("message", F.concat("message", F.lit(" (again)"))).withColumn("seq", F.col("id") * 2 + 1)
    return base.unionByName(resent).unionByName(replayed).withColumnRenamed("source", "source_name")


def stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows an earlier ingest already stored: the log rows before
    ``STORED_BEFORE`` (as parsed rows, seq = 2·id)."""
    return logs(spark, sf_dir).filter(F.col("ts") < F.lit(STORED_BEFORE).cast("timestamp_ntz")) \
        .withColumn("seq", F.col("id") * 2).withColumnRenamed("source", "source_name")


def service_capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``systemctl list-units`` captures, one per hour of metric rows: a header
    line (line_no 0) and one line per service row; a payload that is not JSON
    renders as a one-word line. Columns: capture, line_no, value."""
    m = metrics(spark, sf_dir).filter(F.col("metric_type") == "service")
    capture = F.date_trunc("hour", F.col("timestamp")).cast("timestamp_ntz")
    name = F.get_json_object(F.col("metric_data"), "$.service_name")
    rows = m.select(capture.alias("capture"),
                    F.unix_micros(F.col("timestamp").cast("timestamp")).alias("line_no"),
                    F.when(name.isNotNull(), F.concat(name, F.lit("   loaded active running  Some service")))
                     .otherwise(F.lit("broken")).alias("value"))
    header = rows.select("capture").distinct().select(
        "capture", F.lit(0).cast("long").alias("line_no"),
        F.lit("  UNIT   LOAD   ACTIVE SUB     DESCRIPTION").alias("value"))
    return header.unionByName(rows)


def metric_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected snapshots as the host probe hands them over: one record per
    metric row, its typed payload in the slot of its kind (cpu / memory /
    uptime structs; disk / services lists). Rows whose payload is not JSON are
    not collected. Columns: timestamp, cpu, memory, disk, services, uptime."""
    m = metrics(spark, sf_dir).filter(F.try_parse_json(F.col("metric_data")).isNotNull())
    t, d = F.col("metric_type"), F.col("metric_data")
    return m.select(
        "timestamp",
        F.when(t == "cpu", F.from_json(d, "cpu_percent double")).alias("cpu"),
        F.when(t == "memory", F.from_json(d, "memory_percent double")).alias("memory"),
        F.when(t == "disk", F.array(F.from_json(d, "mountpoint string, percent double"))).alias("disk"),
        F.when(t == "service", F.array(F.from_json(d, "service_name string"))).alias("services"),
        F.when(t == "uptime", F.from_json(d, "uptime_seconds long")).alias("uptime"))
