"""Registered queries: one callable per operator key, each ``(spark, sf_dir) -> DataFrame``.

Inputs are the shared views of ``timberline.fixtures`` over the driver tables;
parameters are fixed here so the DuckDB texts in ``oracle.py`` can mirror them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline import fixtures as fx
from timberline.functions import with_fingerprint
from timberline.operators import alerts, anomaly, audit, chat, ingest, metrics, neighbours, query, report, totals, trigrams, vectors
from timberline.operators.cursor_keys import CursorKeys
from timberline.params import (AlertQuery, AnomalyParams, AuditHistoryParams, Discover, IndexParams, LogQuery,
                               MetricQuery, SearchParams)
from timberline.schema import ALERTS as ALERTS_SCHEMA
from timberline.schema import LOGS as LOGS_SCHEMA
from timberline.schema import METRICS as METRICS_SCHEMA
from timberline.session import land, materialize, prepare, scratch_path
from timberline.sources import files as file_sources
from timberline.sources import parsers
from timberline.sources.patterns import pattern_parser
from timberline.sources.registry import LogSource, ingest_all, read_all, read_source
from timberline.streaming import ingest as stream_ingest_mod
from timberline.streaming import monitor, spikes
from timberline.streaming.sinks import compact, read_table, vacuum

AS_OF = fx.AS_OF
DAY = 86400

# Fixed parameters of the registered queries (mirrored in oracle.py).
Q_MIN_SEV = LogQuery(since=7 * DAY, min_severity="warning", limit=500, order="desc")
Q_CONTAINS = LogQuery(since=30 * DAY, contains="ERROR by user 1", limit=10000, order="desc")
Q_SRC_UNIT_HOST = LogQuery(since=30 * DAY, source="journald", unit="sshd", hostname="host0",
                           limit=10000, order="desc")
Q_ASC = LogQuery(since=14 * DAY, min_severity="ERR", limit=1000, order="asc")
ANOMALY = AnomalyParams(since=30 * DAY)


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    prepare(spark)
    return fx.logs(spark, sf)


def _log_query(q: LogQuery) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: query.query_logs(_logs(spark, sf), q, AS_OF)


def log_query_contains_indexed(spark, sf):
    """The same search over the stored table, by the trigram filters of its files."""
    base = _scratch(spark, "trigrams")
    ingest.append(_logs(spark, sf), f"{base}/logs")
    trigrams.build(spark, f"{base}/logs", f"{base}/index")
    return trigrams.search(spark, f"{base}/logs", f"{base}/index", Q_CONTAINS, AS_OF)


def _discover(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: query.discover(_logs(spark, sf), Discover(kind=kind, since=30 * DAY), AS_OF)


def _anomaly(fn) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: fn(_logs(spark, sf), ANOMALY, AS_OF)


PARSED_COLS = ["ts", "hostname", "unit", "severity", "pid", "message"]


def parse_journald(spark, sf):
    prepare(spark)
    return parsers.parse_journald(fx.journald_lines(spark, sf)).select(*PARSED_COLS, "cursor")


def parse_syslog(spark, sf):
    prepare(spark)
    return parsers.parse_syslog(fx.syslog_lines(spark, sf), year=2024).select(*PARSED_COLS)


def parse_container(spark, sf):
    prepare(spark)
    return parsers.parse_container(fx.container_lines(spark, sf)).select(
        "ts", "hostname", "unit", "severity", "message")


def source_exclude_units(spark, sf):
    prepare(spark)
    src = LogSource("journal", "journald", config={"lines": fx.journald_lines(spark, sf),
                                                   "exclude_units": ["systemd-*"]})
    return read_source(spark, src, AS_OF, since_seconds=30 * DAY).select(*PARSED_COLS, "cursor", "source_name")


def source_container_globs(spark, sf):
    prepare(spark)
    src = LogSource("apps", "container", config={"lines": fx.container_lines(spark, sf),
                                                 "include_patterns": ["host[0-4]", "h*7"],
                                                 "exclude_patterns": ["host[!0-3]"]})
    return read_source(spark, src, AS_OF, since_seconds=30 * DAY).select("ts", "unit", "severity", "message")


def log_fingerprint(spark, sf):
    return with_fingerprint(_logs(spark, sf).withColumnRenamed("id", "event_id")).select(
        "event_id", "fingerprint", "id")


INGEST_COLS = ["id", "fingerprint", "cursor", "ts", "unit", "severity", "message"]


def _stored(spark, sf):
    return ingest.prepare_batch(fx.stored_rows(spark, sf))


def ingest_dedup(spark, sf):
    prepare(spark)
    out = ingest.ingest_rows(fx.ingest_batch(spark, sf), _stored(spark, sf))
    return out.select(*INGEST_COLS)


def ingest_cursor_state(spark, sf):
    prepare(spark)
    prior = ingest.cursor_state(fx.stored_rows(spark, sf), None, "2024-01-15 00:00:00")
    batch = fx.ingest_batch(spark, sf).filter(F.col("source_name") != "container")
    return ingest.cursor_state(batch, prior, AS_OF)


def ingest_all_counts(spark, sf):
    prepare(spark)
    sources = [
        LogSource("journal", "journald", config={"lines": fx.journald_lines(spark, sf)}),
        LogSource("syslog", "file", config={"lines": fx.syslog_lines(spark, sf, "source = 'file'"),
                                            "year": 2024}),
        LogSource("apps", "container", config={"lines": fx.container_lines(spark, sf, "source = 'container'")}),
        LogSource("broken", "no-such-type"),
        LogSource("disabled", "journald", enabled=False),
    ]
    parsed, _errors = read_all(spark, sources, AS_OF, since_seconds=30 * DAY, limit=None)
    order = F.when(F.col("source_name") == "journal", 0).when(F.col("source_name") == "syslog", 1).otherwise(2)
    parsed = parsed.withColumn("seq", order * F.lit(10 ** 12) + F.col("seq"))
    # The real write path: one job dedups, appends to a fresh log table and
    # observes the per-source counts on the way.
    base = _scratch(spark, "ingest-all")
    counts = ingest.ingest_into(parsed, f"{base}/logs", f"{base}/state", AS_OF, ["journal", "syslog", "apps"])
    return spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in counts.items()],
                                 "source_name string, parsed_rows long, inserted_rows long")


def ingest_isolated(spark, sf):
    """Four sources into one table, one after the other: the second repeats the first and adds
    nothing, the third fails while it is read and does not stop the fourth."""
    prepare(spark)
    journal = fx.journald_lines(spark, sf)
    broken = journal.select(
        F.when(F.col("seq") >= 0, F.raise_error(F.lit("input lost"))).cast("string").alias("value"))
    sources = [LogSource("journal", "journald", config={"lines": journal}),
               LogSource("again", "journald", config={"lines": journal}),
               LogSource("broken", "journald", config={"lines": broken}),
               LogSource("apps", "container", config={"lines": fx.container_lines(spark, sf)})]
    base = _scratch(spark, "ingest-isolated")
    counts, errors = ingest_all(spark, sources, f"{base}/logs", f"{base}/state", AS_OF, since_seconds=30 * DAY)
    rows = [(k, int(a), int(b), False) for k, (a, b) in counts.items()] + [(k, 0, 0, True) for k in errors]
    return spark.createDataFrame(rows, "source_name string, parsed_rows long, inserted_rows long, failed boolean")


def ingest_resume(spark, sf):
    """Two ingests of one journal: the first ends in the middle of the month, the second looks
    back one minute only and resumes after the stored cursor."""
    prepare(spark)
    lines = fx.journald_lines(spark, sf)
    base = _scratch(spark, "ingest-resume")
    middle = F.get_json_object("value", "$.__REALTIME_TIMESTAMP").try_cast("long") < 1705363200 * 10 ** 6
    for part, since in ((lines.filter(middle), 400 * DAY), (lines, 60)):
        state = ingest.read_state(spark, f"{base}/state")
        parsed, _errors = read_all(spark, [LogSource("journal", "journald", config={"lines": part})], AS_OF,
                                   since_seconds=since, state=state)
        ingest.ingest_into(parsed, f"{base}/logs", f"{base}/state", AS_OF, ["journal"])
    return spark.read.parquet(f"{base}/logs").select(*PARSED_COLS, "cursor")


def ingest_late_rows(spark, sf):
    """Journal files resumed by byte position: between two runs, files appear with rows older than
    the stored cursor; the second run looks back one minute and reads them and nothing again."""
    prepare(spark)
    base = _scratch(spark, "ingest-late")
    lines = fx.journald_lines(spark, sf)
    sources = [LogSource("journal", "journald", config={"paths": [f"{base}/journal"], "patterns": ["*.txt"], "by_position": True})]
    for part, since in ((F.col("seq") % 2 == 0, 400 * DAY), (F.col("seq") % 2 == 1, 60)):
        lines.filter(part).select("value").write.mode("append").text(f"{base}/journal")
        ingest_all(spark, sources, f"{base}/logs", f"{base}/state", AS_OF, since_seconds=since)
    return spark.read.parquet(f"{base}/logs").select(*PARSED_COLS, "cursor")


def ingest_limited(spark, sf):
    """Two runs that may store half of the journal's rows each: together they store them all."""
    prepare(spark)
    base = _scratch(spark, "ingest-limited")
    lines = fx.journald_lines(spark, sf)
    half = -(-_logs(spark, sf).count() // 2)
    for _ in range(2):
        ingest_all(spark, [LogSource("journal", "journald", config={"lines": lines})], f"{base}/logs", f"{base}/state", AS_OF,
                   since_seconds=400 * DAY, limit=half)
    return spark.read.parquet(f"{base}/logs").select(*PARSED_COLS, "cursor")


def ingest_keyed(spark, sf):
    """The rows that an ingest adds to a table, its cursors checked by the key table."""
    prepare(spark)
    base = _scratch(spark, "ingest-keyed")
    ingest.append(_stored(spark, sf), f"{base}/logs")
    old = spark.read.parquet(f"{base}/logs").select("fingerprint").distinct()
    old = land(old, f"{base}/old")
    ingest.ingest_into(fx.ingest_batch(spark, sf), f"{base}/logs", None, AS_OF, [], keys=CursorKeys(spark, f"{base}/keys", 16))
    return spark.read.parquet(f"{base}/logs").join(old, "fingerprint", "left_anti").select(*INGEST_COLS)


def clear_table(spark, sf):
    """Rows of a stored log table before and after it is cleared."""
    prepare(spark)
    path = f"{_scratch(spark, 'clear')}/logs"
    before = land(ingest.ensure_columns(_logs(spark, sf), LOGS_SCHEMA).select(*LOGS_SCHEMA.fieldNames()), path).count()
    ingest.clear_table(spark, path, LOGS_SCHEMA)
    after = spark.read.parquet(path).select(*LOGS_SCHEMA.fieldNames())
    return after.agg(F.lit(before).cast("long").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"))


def parse_raw(spark, sf):
    """The stored raw line (X6) of container rows: JSON around the line as it came."""
    prepare(spark)
    return parsers.parse_container(fx.container_lines(spark, sf)).select("ts", "raw")


def parse_pattern(spark, sf):
    """A format of an application's own, parsed by a named-field pattern."""
    prepare(spark)
    parser = pattern_parser("{ts:iso} {hostname} {severity:level} {unit}[[[{pid:int}]]]: {message:text}")
    return parser(fx.application_lines(spark, sf), {}).select(*PARSED_COLS)


def migrate_ids(spark, sf):
    lg = _logs(spark, sf).withColumnRenamed("id", "event_id")
    with_fp = with_fingerprint(lg).withColumn("id", F.lit(None).cast("long"))
    # Rows of older versions may lack the fingerprint as well as the id.
    pre = with_fp.withColumn("fingerprint", F.when(F.col("severity").isin("info", "debug"), F.col("fingerprint")))
    return ingest.backfill_ids(pre).select("event_id", "id")


def _metrics(spark, sf):
    prepare(spark)
    return fx.metrics(spark, sf)


def _alerts(spark, sf):
    """The alerts of the monitor: threshold rules and hourly service snapshots over the metric rows."""
    m = _metrics(spark, sf)
    return alerts.store_alerts(alerts.threshold_alerts(m).unionByName(alerts.service_down(m, "hour")))


def _alert_table(spark, sf):
    """The alerts as the stored Parquet table that reports and summaries read, written once per call."""
    return land(_alerts(spark, sf), _scratch(spark, "alerts"))


def log_summary(spark, sf):
    return report.log_summary(_logs(spark, sf), AS_OF, 30 * DAY)


def _daily_report(spark, sf):
    return report.daily_report(_logs(spark, sf), _metrics(spark, sf), _alert_table(spark, sf), AS_OF, 30 * DAY)


def daily_report(spark, sf):
    return report.report_scalars(_daily_report(spark, sf))


def report_text(spark, sf):
    return report.format_text(_daily_report(spark, sf))


def report_html(spark, sf):
    return report.format_html(_daily_report(spark, sf))


def report_json(spark, sf):
    return report.format_json(_daily_report(spark, sf))


def metrics_query(spark, sf):
    return metrics.query_metrics(_metrics(spark, sf), MetricQuery(metric_type="service", since=7 * DAY,
                                                                  limit=1000), AS_OF)


def metrics_query_latest(spark, sf):
    return metrics.query_metrics(_metrics(spark, sf), MetricQuery(since=3 * DAY, limit=200), AS_OF)


def metric_averages(spark, sf):
    return metrics.metric_averages(_metrics(spark, sf), AS_OF, 30 * DAY)


def threshold_alerts(spark, sf):
    return alerts.store_alerts(alerts.threshold_alerts(_metrics(spark, sf)))


def service_down(spark, sf):
    return alerts.store_alerts(alerts.service_down(_metrics(spark, sf), "hour"))


def alerts_query(spark, sf):
    return alerts.query_alerts(_alerts(spark, sf), AlertQuery(since=7 * DAY, severity="warning",
                                                                   acknowledged=False), AS_OF)


def health_summary(spark, sf):
    return metrics.health_summary(_metrics(spark, sf), _alert_table(spark, sf), AS_OF, 30 * DAY)


SEARCH_ALL = SearchParams(n_results=10)
SEARCH_FILTERED = SearchParams(n_results=20, since=30 * DAY, source="journald")


def _vector_table(spark, sf):
    return vectors.vector_rows(fx.vectors(spark, sf), _logs(spark, sf))


def _query_vector(spark, sf) -> list[float]:
    """The one query vector (a single row of ``dim`` floats) fetched to the driver."""
    rows = fx.query_vector(spark, sf).take(2)
    if len(rows) != 1:
        raise ValueError("expected exactly one query vector")
    return list(rows[0]["embedding"])


def index_candidates(spark, sf):
    led = fx.index_ledger(spark, sf)
    return vectors.index_candidates(_logs(spark, sf), led, AS_OF, IndexParams(since=30 * DAY, limit=None)) \
        .select("id", "ts", "search_text")


def index_build(spark, sf):
    vec, led = vectors.index_logs(_logs(spark, sf), fx.index_ledger(spark, sf), AS_OF,
                                  IndexParams(since=30 * DAY, limit=None))
    return vec.select("log_id", "document", F.size("embedding").alias("dims"), _micros("embedding"))


def _micros(embedding: str):
    """An embedding as text: its values in millionths, rounded down."""
    values = F.transform(embedding, lambda x: F.floor(x.cast("double") * 1000000).cast("string"))
    return F.array_join(values, ",").alias("embedding_micros")


SEARCH_TEXT = "error by user 12"
SEARCH_BY_TEXT = SearchParams(n_results=20, since=30 * DAY, source="journald")


def search_text(spark, sf):
    """Query text to hits: the index of the logs is built and stored, the text embedded by the
    same model and its nearest rows returned."""
    vec, _ledger = vectors.index_logs(_logs(spark, sf), fx.index_ledger(spark, sf), AS_OF,
                                      IndexParams(since=30 * DAY, limit=None))
    index = land(vec, _scratch(spark, "index"))
    return vectors.search_by_text(index, SEARCH_TEXT, SEARCH_BY_TEXT, AS_OF)


def index_ledger_new(spark, sf):
    """The ledger rows of an index build."""
    return vectors.index_logs(_logs(spark, sf), fx.index_ledger(spark, sf), AS_OF,
                              IndexParams(since=30 * DAY, limit=None))[1]


def vector_topk(spark, sf):
    return vectors.search(_vector_table(spark, sf), _query_vector(spark, sf), SEARCH_ALL, AS_OF)


def vector_topk_filtered(spark, sf):
    return vectors.search(_vector_table(spark, sf), _query_vector(spark, sf), SEARCH_FILTERED, AS_OF)


def _neighbour_queries(spark, sf):
    """The stated query set: every vector whose id is divisible by 20."""
    return fx.vectors(spark, sf).filter("log_id % 20 = 0").select(F.col("log_id").alias("query_id"), "embedding")


def vector_neighbours_exact(spark, sf):
    """The ten nearest of all vectors for every query of the set, exactly."""
    prepare(spark)
    found = neighbours.exact_many(_neighbour_queries(spark, sf), fx.vectors(spark, sf), 10)
    return found.select("query_id", "log_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def vector_neighbours(spark, sf):
    """The same by the calibrated index: only the nearest cells of a query are read for it."""
    prepare(spark)
    index = neighbours.build(fx.vectors(spark, sf), _scratch(spark, "ann"))
    found = neighbours.search_many(spark, index, _neighbour_queries(spark, sf), 10)
    return found.select("query_id", "log_id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def search_expand(spark, sf):
    return vectors.expand_hits(vector_topk_filtered(spark, sf), _logs(spark, sf))


def rag_context(spark, sf):
    return vectors.rag_context(search_expand(spark, sf))


def index_retention_ledger(spark, sf):
    prepare(spark)
    kept, _, _ = vectors.retention(fx.index_ledger(spark, sf), fx.vectors(spark, sf), AS_OF, days=29)
    return kept.select("log_id", "indexed_at")


def index_retention_vectors(spark, sf):
    prepare(spark)
    ledger = fx.index_ledger(spark, sf)
    rows = fx.vectors(spark, sf).join(ledger.select("log_id"), "log_id", "left_semi")
    return vectors.retention(ledger, rows, AS_OF, days=29)[1].select("log_id")


def index_retention(spark, sf):
    prepare(spark)
    _, _, counts = vectors.retention(fx.index_ledger(spark, sf), fx.vectors(spark, sf), AS_OF, days=29)
    return counts


AUDIT_TOOLS = ["auditd", "aide", "rkhunter", "chkrootkit", "clamav", "openscap", "lynis"]


def _scan_lines(spark, sf):
    prepare(spark)
    return (fx.scan_lines(spark, sf).withColumnRenamed("is_error", "rc")
            .withColumn("scan_time", F.col("scan_date").cast("timestamp_ntz")).drop("scan_date"))


def _audit_tool(tool: str):
    def run(spark, sf):
        lines = _scan_lines(spark, sf).filter(F.col("tool") == tool)
        return audit.scan_results(lines)
    return run


def _audit_records(spark, sf):
    return audit.audit_records(audit.scan_results(_scan_lines(spark, sf)))


def audit_findings(spark, sf):
    return audit.findings(_scan_lines(spark, sf))


def audit_rollup(spark, sf):
    return audit.audit_rollup(_audit_records(spark, sf))


def audit_history(spark, sf):
    return audit.audit_history(_audit_records(spark, sf), AuditHistoryParams(tool="aide", limit=50))


def _audit_id_param(tool: str, host: str, scan_time: str) -> int:
    """The id of one audit, for a point lookup (same rule as audit.audit_id)."""
    digest = hashlib.sha256(f"{tool}|{host}|{scan_time}".encode()).digest()
    return int.from_bytes(digest[:8], "big", signed=True)


def _audit_details(tool: str):
    def run(spark, sf):
        return audit.audit_details(_audit_records(spark, sf), _audit_id_param(tool, "host3", "2024-01-15 00:00:00"))
    return run


def _chat(spark, sf):
    prepare(spark)
    return fx.chat_history(spark, sf)


def chat_history(spark, sf):
    return chat.chat_history(_chat(spark, sf))


def chat_stats(spark, sf):
    return chat.chat_stats(_chat(spark, sf), AS_OF)


def _scratch(spark, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint dir."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


STREAM_COLS = ["id", "fingerprint", "ts", "unit", "severity", "message"]


def stream_ingest(spark, sf):
    """journald lines land as text files (every info line twice, in later
    files); the ingest stream stores each entry once."""
    prepare(spark)
    base = _scratch(spark, "stream-ingest")
    lines = fx.journald_lines(spark, sf).select("value")
    lines.write.text(f"{base}/landing")
    lines.filter(F.col("value").contains('"PRIORITY":"6"')).write.mode("append").text(f"{base}/landing")
    q = stream_ingest_mod.start_ingest(spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint",
                                       max_files_per_trigger=16)
    q.awaitTermination()
    return read_table(spark, f"{base}/table", LOGS_SCHEMA).select(*STREAM_COLS)


def stream_positions(spark, sf):
    """Journal files read by position while they come, cursors checked by the key table, the small
    files compacted and deleted between two runs; every info line comes twice, in later files."""
    prepare(spark)
    base = _scratch(spark, "stream-positions")
    lines = fx.journald_lines(spark, sf).select("value", "seq")
    keys = CursorKeys(spark, f"{base}/keys", 16)
    parts = [lines.filter("seq % 2 = 0"), lines.filter("seq % 2 = 1"), lines.filter(F.col("value").contains('"PRIORITY":"6"'))]
    for part in parts:
        part.select("value").write.mode("append").text(f"{base}/landing")
        stream_ingest_mod.start_ingest(spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint", keys=keys,
                                       by_position=True, patterns=["*.txt"]).awaitTermination()
        compact(spark, f"{base}/table")
        vacuum(spark, f"{base}/table")
    return read_table(spark, f"{base}/table", LOGS_SCHEMA).select(*STREAM_COLS)


def _stream_totals(spark, sf) -> DataFrame:
    """The totals of the report's window, as the ingest stream kept them."""
    prepare(spark)
    base = _scratch(spark, "stream-totals")
    fx.journald_lines(spark, sf).select("value").write.text(f"{base}/landing")
    stream_ingest_mod.start_ingest(spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint", max_files_per_trigger=16,
                                   totals_table=f"{base}/totals").awaitTermination()
    return totals.window_totals(read_table(spark, f"{base}/totals", totals.SCHEMA), read_table(spark, f"{base}/table", LOGS_SCHEMA),
                                AS_OF, 30 * DAY)


def totals_log_summary(spark, sf):
    return totals.log_summary(_stream_totals(spark, sf), AS_OF, 30 * DAY)


def totals_error_spike(spark, sf):
    return totals.error_spikes(_stream_totals(spark, sf), ANOMALY)


def stream_spike_trailing(spark, sf):
    """Error spikes of the three days before every day's end, from panes of one day."""
    prepare(spark)
    base = _scratch(spark, "stream-trailing")
    fx.journald_lines(spark, sf).select("value").write.text(f"{base}/landing")
    q = spikes.start_trailing_spikes(stream_ingest_mod.parsed_stream(spark, f"{base}/landing"), f"{base}/panes", f"{base}/table",
                                     f"{base}/checkpoint", pane_seconds=DAY, window_seconds=3 * DAY, threshold=5, lateness="2 hours")
    q.awaitTermination()
    return read_table(spark, f"{base}/table", spikes.TRAILING_SCHEMA)


def stream_error_spike(spark, sf):
    prepare(spark)
    base = _scratch(spark, "stream-spikes")
    fx.journald_lines(spark, sf).select("value").write.text(f"{base}/landing")
    parsed = stream_ingest_mod.parsed_stream(spark, f"{base}/landing", max_files_per_trigger=16)
    q = spikes.start_error_spikes(parsed, f"{base}/table", f"{base}/checkpoint", window="1 day", threshold=10,
                                  mode="complete")
    q.awaitTermination()
    return read_table(spark, f"{base}/table", spikes.SPIKE_SCHEMA)


def stream_error_spike_closed(spark, sf):
    """Spikes of the windows that the event-time watermark has closed (append mode)."""
    prepare(spark)
    base = _scratch(spark, "stream-spikes-closed")
    fx.journald_lines(spark, sf).select("value").write.text(f"{base}/landing")
    q = spikes.start_error_spikes(stream_ingest_mod.parsed_stream(spark, f"{base}/landing"), f"{base}/table",
                                  f"{base}/checkpoint", window="1 day", threshold=2, lateness="2 hours")
    q.awaitTermination()
    return read_table(spark, f"{base}/table", spikes.SPIKE_SCHEMA)


def stream_service_down(spark, sf):
    """Critical services missing from the hourly snapshots that the watermark has closed."""
    prepare(spark)
    base = _scratch(spark, "stream-services")
    fx.metrics(spark, sf).write.parquet(f"{base}/landing")
    stream = spark.readStream.schema(METRICS_SCHEMA).parquet(f"{base}/landing")
    q = monitor.start_service_watch(stream, f"{base}/alerts", f"{base}/checkpoint", snapshot="1 hour",
                                    delay="2 hours", available_now=True)
    q.awaitTermination()
    return read_table(spark, f"{base}/alerts", ALERTS_SCHEMA).select(*ALERTS_SCHEMA.fieldNames())


def stream_container(spark, sf):
    """Container lines land in one folder a container; the ingest stream names each row's
    container by its file's path."""
    prepare(spark)
    base = _scratch(spark, "stream-container")
    fx.container_lines(spark, sf).select("value", F.col("container").alias("name")) \
        .write.partitionBy("name").text(f"{base}/landing")
    q = stream_ingest_mod.start_ingest(spark, f"{base}/landing", f"{base}/table", f"{base}/checkpoint",
                                       source_type="container", container_pattern=r"name=([^/]+)/")
    q.awaitTermination()
    return read_table(spark, f"{base}/table", LOGS_SCHEMA).select(*STREAM_COLS)


def stream_alerts(spark, sf):
    prepare(spark)
    base = _scratch(spark, "stream-monitor")
    fx.metrics(spark, sf).write.parquet(f"{base}/landing")
    stream = spark.readStream.schema(METRICS_SCHEMA).option("maxFilesPerTrigger", 4).parquet(f"{base}/landing")
    q = monitor.start_monitor(stream, f"{base}/metrics", f"{base}/alerts", f"{base}/checkpoint", available_now=True)
    q.awaitTermination()
    return read_table(spark, f"{base}/alerts", ALERTS_SCHEMA).select(*ALERTS_SCHEMA.fieldNames())


def file_ingest(spark, sf):
    """Syslog files per host are discovered by glob under a folder tree, pruned
    by size, read line by line and parsed; rows per host."""
    prepare(spark)
    base = _scratch(spark, "files")
    fx.syslog_lines(spark, sf).join(fx.logs(spark, sf).select(F.col("id"), "hostname"),
                                    F.col("seq") == F.col("id") * 2, "left") \
        .select("value", "hostname").write.partitionBy("hostname").text(f"{base}/logs")
    fx.metrics(spark, sf).write.parquet(f"{base}/logs/not-logs")
    lines = file_sources.read_lines(spark, f"{base}/logs", patterns=["*.txt"], max_size_mb=100, recursive=True)
    parsed = parsers.parse_syslog(lines, year=2024)
    return parsed.groupBy("hostname").agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"),
                                          F.max("ts").alias("last_ts"))


def report_list(spark, sf):
    prepare(spark)
    base = _scratch(spark, "reports")
    rep = report.daily_report(_logs(spark, sf), _metrics(spark, sf), _alert_table(spark, sf), AS_OF, 30 * DAY)
    text = materialize(report.format_text(rep))  # one row, rendered once
    for stamp in ("2024-01-29 00:00:00", "2024-01-30 00:00:00", AS_OF):
        report.save_report(text, base, stamp)
    return report.list_reports(spark, base, limit=10).select("name", "size")


def fetch_by_ids(spark, sf):
    ids = fx.vectors(spark, sf).select(F.col("log_id").alias("id"))
    return query.fetch_logs_by_ids(_logs(spark, sf), ids).select("id", "ts", "unit", "severity", "message")


def log_ndjson(spark, sf):
    return ingest.to_ndjson(query.query_logs(_logs(spark, sf), Q_MIN_SEV, AS_OF))


def service_status(spark, sf):
    prepare(spark)
    return parsers.parse_service_status(fx.service_capture_lines(spark, sf), ["capture"])


def source_newest_n(spark, sf):
    """journald source limited to two units, newest 200 entries."""
    prepare(spark)
    src = LogSource("journal", "journald", config={"lines": fx.journald_lines(spark, sf), "units": ["sshd", "cron"]})
    return read_source(spark, src, AS_OF, since_seconds=30 * DAY, limit=200).select(*PARSED_COLS, "cursor")


def uptime_summary(spark, sf):
    return metrics.uptime_rows(_metrics(spark, sf))


def snapshot_rows(spark, sf):
    prepare(spark)
    return metrics.flatten_snapshot(fx.metric_snapshots(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # step 1: log search
    "log_query_min_severity": _log_query(Q_MIN_SEV),
    "log_query_contains": _log_query(Q_CONTAINS),
    "log_query_contains_indexed": log_query_contains_indexed,
    "log_query_source_unit_host": _log_query(Q_SRC_UNIT_HOST),
    "log_query_asc": _log_query(Q_ASC),
    # step 2: discovery
    "discover_unit": _discover("unit"),
    "discover_hostname": _discover("hostnames"),
    "discover_source": _discover("source"),
    "discover_severity": _discover("severity"),
    # step 3: anomaly rules
    "anomaly_error_spike": _anomaly(anomaly.error_spikes),
    "anomaly_high_volume": _anomaly(anomaly.high_volume),
    "anomaly_missing_logs": _anomaly(anomaly.missing_logs),
    "anomalies_all": _anomaly(anomaly.detect_anomalies),
    "anomaly_summary": _anomaly(anomaly.anomaly_summary),
    # step 4: parsing and sources
    "parse_journald": parse_journald,
    "parse_syslog": parse_syslog,
    "parse_container": parse_container,
    "source_exclude_units": source_exclude_units,
    "source_container_globs": source_container_globs,
    "log_fingerprint": log_fingerprint,
    # step 5: ingest
    "ingest_dedup": ingest_dedup,
    "ingest_cursor_state": ingest_cursor_state,
    "ingest_all_counts": ingest_all_counts,
    "migrate_ids": migrate_ids,
    "ingest_late_rows": ingest_late_rows,
    "ingest_limited": ingest_limited,
    "ingest_keyed": ingest_keyed,
    "clear_table": clear_table,
    "parse_raw": parse_raw,
    "parse_pattern": parse_pattern,
    # step 6: reports
    "log_summary": log_summary,
    "daily_report": daily_report,
    "report_text": report_text,
    "report_html": report_html,
    "report_json": report_json,
    # step 7: metrics and alerts
    "metrics_query": metrics_query,
    "metrics_query_latest": metrics_query_latest,
    "metric_averages": metric_averages,
    "threshold_alerts": threshold_alerts,
    "service_down": service_down,
    "alerts_query": alerts_query,
    "health_summary": health_summary,
    # step 8: vector index and retrieval
    "index_candidates": index_candidates,
    "index_build": index_build,
    "index_retention_ledger": index_retention_ledger,
    "index_retention_vectors": index_retention_vectors,
    "ingest_resume": ingest_resume,
    "ingest_isolated": ingest_isolated,
    "search_text": search_text,
    "index_ledger_new": index_ledger_new,
    "audit_findings": audit_findings,
    "vector_topk": vector_topk,
    "vector_neighbours": vector_neighbours,
    "vector_neighbours_exact": vector_neighbours_exact,
    "vector_topk_filtered": vector_topk_filtered,
    "search_expand": search_expand,
    "rag_context": rag_context,
    "index_retention": index_retention,
    # step 9: security scan analytics
    **{f"audit_{t}": _audit_tool(t) for t in AUDIT_TOOLS},
    "audit_rollup": audit_rollup,
    "audit_history": audit_history,
    "audit_details": _audit_details("clamav"),
    "audit_details_openscap": _audit_details("openscap"),
    "audit_details_lynis": _audit_details("lynis"),
    # step 10: chat
    "chat_history": chat_history,
    "chat_stats": chat_stats,
    # step 11: streaming
    "stream_ingest": stream_ingest,
    "stream_error_spike": stream_error_spike,
    "stream_error_spike_closed": stream_error_spike_closed,
    "stream_alerts": stream_alerts,
    "stream_service_down": stream_service_down,
    "stream_container": stream_container,
    "stream_positions": stream_positions,
    "totals_log_summary": totals_log_summary,
    "totals_error_spike": totals_error_spike,
    "stream_spike_trailing": stream_spike_trailing,
    # step 12: files
    "file_ingest": file_ingest,
    "report_list": report_list,
    # more sources / sinks
    "fetch_by_ids": fetch_by_ids,
    "log_ndjson": log_ndjson,
    "service_status": service_status,
    "source_newest_n": source_newest_n,
    "uptime_summary": uptime_summary,
    "snapshot_rows": snapshot_rows,
}
