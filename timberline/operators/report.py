"""Log summary, daily report and its text / HTML / JSON renderings
(A6, A9, R1–R3, K8, F11, X13, X16, X17).

The report is a one-row DataFrame of nested structs and bounded arrays (top
10 units, top 5 sources, 5 alerts, 5 anomalies); it is assembled without joins
by unioning one-row parts and folding them with a global ``max``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions import fill, html_escape, is_error_severity, percent, thousands
from timberline.operators.anomaly import anomaly_summary_parts
from timberline.operators.metrics import health_parts
from timberline.operators.window import in_window
from timberline.params import AnomalyParams, ReportParams, as_timestamp
from timberline.session import materialize

TOP_UNITS = 10
TOP_SOURCES = 5
TEXT_UNITS_SHOWN = 5

# --- fixed values: recommendation rules of the daily report ---------------------
ERROR_RATE_LIMIT = 5
CPU_AVERAGE_LIMIT = 80
MEMORY_AVERAGE_LIMIT = 85
REC_ERROR_RATE = "High error rate detected: {}%. Review system logs for issues."
REC_CPU = "High CPU usage detected. Consider investigating resource-intensive processes."
REC_MEMORY = "High memory usage detected. Consider memory optimization or cleanup."
REC_ALERTS = "{} active alerts require attention."
REC_ANOMALIES = "{} high-severity anomalies detected."
# -----------------------------------------------------------------------------

# --- fixed values: text report layout ---------------------------------------------
TEXT_RULE = "=" * 80
TEXT_DASH = "-" * 40
TEXT_GENERATED = "Generated: {v}"
TEXT_PERIOD = "Period: {v} hours"
TEXT_LOG_ANALYTICS = "LOG ANALYTICS"
TEXT_TOTAL_LOGS = "Total logs: {v}"
TEXT_ERROR_RATE = "Error rate: {v}%"
TEXT_SEVERITIES = "Severity Distribution:"
TEXT_UNITS = "Top Units by Volume:"
TEXT_PAIR = "  {key}: {count}"
TEXT_SYSTEM_HEALTH = "SYSTEM HEALTH"
TEXT_NO_METRICS = "No system metrics available"
TEXT_CPU = "CPU Average: {v}%"
TEXT_MEMORY = "Memory Average: {v}%"
TEXT_DISK = "Disk Average: {v}%"
TEXT_ACTIVE_ALERTS = "Active Alerts: {v}"
TEXT_RECENT_ALERTS = "Recent Alerts:"
TEXT_ITEM = "  [{severity}] {text}"
TEXT_ANOMALY_DETECTION = "ANOMALY DETECTION"
TEXT_TOTAL_ANOMALIES = "Total Anomalies: {v}"
TEXT_HIGH_SEVERITY = "High Severity: {v}"
TEXT_RECENT_ANOMALIES = "Recent Anomalies:"
TEXT_RECOMMENDATIONS = "RECOMMENDATIONS"
TEXT_NUMBERED = "{i}. {text}"
TEXT_END = "End of Report"
# -----------------------------------------------------------------------------

REPORT_TITLE = "DAILY LOG REPORT"


def _fill(template: str, value: Column) -> Column:
    """``template`` with its ``{}`` replaced by the text of ``value``."""
    head, tail = template.split("{}")
    return F.concat(F.lit(head), value.cast("string"), F.lit(tail))


def _fold(parts: list[DataFrame]) -> DataFrame:
    """Union one-row frames with disjoint columns and fold them into one row."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return u.agg(*[F.max(c).alias(c) for c in u.columns])


def _ranked_list(counts: DataFrame, key: str, limit: int | None, name: str) -> DataFrame:
    """Count rows ordered by count desc, key asc (NULLS LAST) as one ordered
    array of ``struct(key, count)``; ``limit`` makes it a top-k."""
    ordered = counts.orderBy(F.col("count").desc(), F.col(key).asc_nulls_last())
    if limit is not None:
        ordered = ordered.limit(limit)
    items = ordered.select(F.struct((F.lit(0) - F.col("count")).alias("_o"),
                                    F.col(key).isNull().alias("_n"), F.col(key).alias("key"),
                                    F.col("count")).alias("_i"))
    return items.agg(F.collect_list("_i").alias(name))


def _strip_order(c: Column) -> Column:
    return F.transform(F.sort_array(F.coalesce(c, F.array())),
                       lambda x: F.struct(x["key"].alias("key"), x["count"].alias("count")))


def log_counts(logs: DataFrame, as_of, since_seconds: int) -> DataFrame:
    """Row and error counts of the window by severity, by unit, by source and in
    total: one ``GROUPING SETS`` aggregation over a single scan (``Expand`` +
    partial aggregation, so each task ships at most one row per group).
    ``gid`` tells the sets apart (bit order severity, unit, source; 1 = rolled up).

    The result (one row per distinct severity, unit and source) is checkpointed:
    the summary reads it from several branches, and a filter on ``gid`` would
    otherwise be pushed into each branch's own scan of the window.
    """
    w = in_window(logs, as_of, since_seconds).select("severity", "unit", "source")
    g = (w.groupingSets([["severity"], ["unit"], ["source"], []], "severity", "unit", "source")
         .agg(F.count(F.lit(1)).alias("count"),
              F.count_if(is_error_severity(F.col("severity"))).alias("errors"),
              F.grouping_id().alias("gid")))
    return materialize(g)


def log_summary_parts(logs: DataFrame, as_of, since_seconds: int = 86400,
                      counts: DataFrame | None = None) -> DataFrame:
    """A6 as one row: total, severity distribution, top units and sources (as
    ordered arrays of (key, count); NULL is a key), error count and rate.

    Built on ``log_counts`` (pass ``counts`` to reuse an existing one); the
    top-k lists are TakeOrderedAndProject over that small result.
    """
    g = counts if counts is not None else log_counts(logs, as_of, since_seconds)
    sev = g.filter(F.col("gid") == 3).select(F.col("severity").alias("k"), "count")
    unit = g.filter(F.col("gid") == 5).select(F.col("unit").alias("k"), "count")
    src = g.filter(F.col("gid") == 6).select(F.col("source").alias("k"), "count")
    tot = g.filter(F.col("gid") == 7).select(F.col("count").alias("total_logs"))
    err = sev.filter(is_error_severity(F.col("k"))).agg(F.sum("count").alias("error_count"))
    row = _fold([tot, err, _ranked_list(sev, "k", None, "_sev"),
                 _ranked_list(unit, "k", TOP_UNITS, "_unit"), _ranked_list(src, "k", TOP_SOURCES, "_src")])
    total = F.coalesce(F.col("total_logs"), F.lit(0))
    errors = F.coalesce(F.col("error_count"), F.lit(0))
    return row.select(
        total.alias("total_logs"),
        _strip_order(F.col("_sev")).alias("severity_distribution"),
        _strip_order(F.col("_unit")).alias("top_units"),
        _strip_order(F.col("_src")).alias("top_sources"),
        errors.alias("error_count"),
        percent(errors, total).alias("error_rate"),
        F.lit(since_seconds // 3600).alias("period_hours"))


def _render_pairs(c: Column, sep: str = ", ") -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat(
        F.coalesce(x["key"], F.lit("None")), F.lit(": "), x["count"].cast("string"))), sep)


def log_summary(logs: DataFrame | None, as_of, since_seconds: int = 86400, counts: DataFrame | None = None) -> DataFrame:
    """A6 flattened: the three lists rendered ``key: count`` joined by ``, `` (from ``counts`` if given)."""
    s = log_summary_parts(logs, as_of, since_seconds, counts)
    return s.select("total_logs", "error_count", "error_rate", "period_hours",
                    _render_pairs(F.col("severity_distribution")).alias("severity_distribution"),
                    _render_pairs(F.col("top_units")).alias("top_units"),
                    _render_pairs(F.col("top_sources")).alias("top_sources"))


def daily_report(logs: DataFrame, metrics: DataFrame, alerts: DataFrame, as_of,
                 since_seconds: int = 86400) -> DataFrame:
    """One row ``report_id, generated_at, period_hours, summary{log_analytics,
    system_health, anomalies}, recommendations[]``. ``as_of`` plays the role of
    the generation time."""
    ts = as_timestamp(as_of)
    # One scan of the log window feeds both the log summary and the anomaly rules.
    g = log_counts(logs, as_of, since_seconds)
    unit_errors = g.filter(F.col("gid") == 5).select("unit", F.col("errors").alias("count"))
    source_rows = g.filter(F.col("gid") == 6).select("source", "count")
    la = log_summary_parts(logs, as_of, since_seconds, counts=g)
    sh = health_parts(metrics, alerts, as_of, since_seconds)
    an = anomaly_summary_parts(logs, AnomalyParams(since=min(since_seconds, 30 * 86400)), as_of,
                               counts=(unit_errors, source_rows))
    row = _fold([la.select(F.struct(*la.columns).alias("log_analytics")),
                 sh.select(F.struct(*sh.columns).alias("system_health")),
                 an.select(F.struct(*an.columns).alias("anomalies"))])
    rate = F.col("log_analytics.error_rate")
    health = F.col("system_health")
    recs = F.filter(F.array(
        F.when(rate > ERROR_RATE_LIMIT, _fill(REC_ERROR_RATE, rate)),
        F.when((health["status"] != "no_data") & (health["cpu_average"] > CPU_AVERAGE_LIMIT), F.lit(REC_CPU)),
        F.when((health["status"] != "no_data") & (health["memory_average"] > MEMORY_AVERAGE_LIMIT), F.lit(REC_MEMORY)),
        F.when(health["active_alerts"] > 0,
               _fill(REC_ALERTS, health["active_alerts"])),
        F.when(F.col("anomalies.high_severity") > 0,
               _fill(REC_ANOMALIES, F.col("anomalies.high_severity"))),
    ), lambda x: x.isNotNull())
    return row.select(
        F.lit(f"daily_{ts:%Y%m%d}").alias("report_id"),
        F.lit(ts.isoformat()).alias("generated_at"),
        F.lit(since_seconds // 3600).alias("period_hours"),
        F.struct(F.col("log_analytics"), F.col("system_health"), F.col("anomalies")).alias("summary"),
        recs.alias("recommendations"))


def report_scalars(report: DataFrame) -> DataFrame:
    """The report's scalar figures as flat columns (for checks and dashboards)."""
    s = "summary."
    return report.select(
        "report_id", "period_hours",
        F.col(s + "log_analytics.total_logs").alias("total_logs"),
        F.col(s + "log_analytics.error_count").alias("error_count"),
        F.col(s + "log_analytics.error_rate").alias("error_rate"),
        F.col(s + "system_health.status").alias("health_status"),
        F.col(s + "system_health.cpu_average").alias("cpu_average"),
        F.col(s + "system_health.memory_average").alias("memory_average"),
        F.col(s + "system_health.disk_average").alias("disk_average"),
        F.col(s + "system_health.active_alerts").alias("active_alerts"),
        F.col(s + "anomalies.total_anomalies").alias("total_anomalies"),
        F.col(s + "anomalies.high_severity").alias("high_severity"),
        F.array_join("recommendations", "\n").alias("recommendations"))


def format_text(report: DataFrame) -> DataFrame:
    """The report as plain text in a ``report`` column (fixed section order)."""
    la, sh, an = (F.col("summary.log_analytics"), F.col("summary.system_health"), F.col("summary.anomalies"))
    rule, dash, blank = F.lit(TEXT_RULE), F.lit(TEXT_DASH), F.lit("")
    no_lines = F.array().cast("array<string>")

    def arr(*cols: Column) -> Column:
        return F.array(*cols)

    def pairs(c: Column) -> Column:
        return F.transform(c, lambda x: fill(TEXT_PAIR, key=F.coalesce(x["key"], F.lit("None")),
                                             count=thousands(x["count"])))

    def items(c: Column, text_field: str) -> Column:
        return F.transform(c, lambda a: fill(TEXT_ITEM, severity=a["severity"], text=a[text_field]))

    health_lines = F.when(sh["status"] == "no_data", arr(F.lit(TEXT_NO_METRICS))).otherwise(F.concat(
        arr(fill(TEXT_CPU, v=sh["cpu_average"]), fill(TEXT_MEMORY, v=sh["memory_average"]),
            fill(TEXT_DISK, v=sh["disk_average"]), fill(TEXT_ACTIVE_ALERTS, v=sh["active_alerts"])),
        F.when(F.size(sh["alert_summary"]) > 0, F.concat(
            arr(F.lit(TEXT_RECENT_ALERTS)), items(sh["alert_summary"], "message"))).otherwise(no_lines)))
    anomaly_lines = F.concat(
        arr(fill(TEXT_TOTAL_ANOMALIES, v=an["total_anomalies"]), fill(TEXT_HIGH_SEVERITY, v=an["high_severity"])),
        F.when(F.size(an["recent"]) > 0, F.concat(
            arr(F.lit(TEXT_RECENT_ANOMALIES)), items(an["recent"], "description"))).otherwise(no_lines))
    recs = F.col("recommendations")
    rec_lines = F.when(F.size(recs) > 0, F.concat(
        arr(F.lit(TEXT_RECOMMENDATIONS), dash),
        F.transform(recs, lambda r, i: fill(TEXT_NUMBERED, i=i + 1, text=r)),
        arr(blank))).otherwise(no_lines)
    lines = F.concat(
        arr(rule, F.lit(REPORT_TITLE), rule,
            fill(TEXT_GENERATED, v=F.col("generated_at")), fill(TEXT_PERIOD, v=F.col("period_hours")), blank,
            F.lit(TEXT_LOG_ANALYTICS), dash,
            fill(TEXT_TOTAL_LOGS, v=thousands(la["total_logs"])), fill(TEXT_ERROR_RATE, v=la["error_rate"]), blank,
            F.lit(TEXT_SEVERITIES)),
        pairs(la["severity_distribution"]),
        arr(blank, F.lit(TEXT_UNITS)),
        pairs(F.slice(la["top_units"], 1, TEXT_UNITS_SHOWN)),
        arr(blank, F.lit(TEXT_SYSTEM_HEALTH), dash),
        health_lines,
        arr(blank, F.lit(TEXT_ANOMALY_DETECTION), dash),
        anomaly_lines,
        arr(blank),
        rec_lines,
        arr(rule, F.lit(TEXT_END), rule))
    return report.select("report_id", F.array_join(lines, "\n").alias("report"))


def format_html(report: DataFrame) -> DataFrame:
    """R2: the report as an HTML page (values HTML-escaped)."""
    la, sh, an = (F.col("summary.log_analytics"), F.col("summary.system_health"), F.col("summary.anomalies"))

    def rows(c: Column) -> Column:
        return F.array_join(F.transform(c, lambda x: F.concat(
            F.lit("<tr><td>"), html_escape(F.coalesce(x["key"], F.lit("None"))), F.lit("</td><td>"),
            thousands(x["count"]), F.lit("</td></tr>"))), "")

    def items(c: Column, a: str, b: str) -> Column:
        return F.array_join(F.transform(c, lambda x: F.concat(
            F.lit("<li>["), html_escape(x[a]), F.lit("] "), html_escape(x[b]), F.lit("</li>"))), "")

    recs = F.array_join(F.transform("recommendations", lambda r: F.concat(
        F.lit("<li>"), html_escape(r), F.lit("</li>"))), "")
    html = F.concat(
        F.lit("<!DOCTYPE html>\n<html>\n<head><title>Daily Log Report</title></head>\n<body>\n"),
        F.lit("<h1>Daily Log Report</h1>\n<p>Generated: "), html_escape(F.col("generated_at")),
        F.lit(" &middot; Period: "), F.col("period_hours").cast("string"), F.lit(" hours</p>\n"),
        F.lit("<h2>Log Analytics</h2>\n<p>Total logs: "), thousands(la["total_logs"]),
        F.lit(" &middot; Error rate: "), la["error_rate"].cast("string"), F.lit("%</p>\n"),
        F.lit("<h3>Severity Distribution</h3>\n<table>"), rows(la["severity_distribution"]), F.lit("</table>\n"),
        F.lit("<h3>Top Units</h3>\n<table>"), rows(la["top_units"]), F.lit("</table>\n"),
        F.lit("<h2>System Health</h2>\n"),
        F.when(sh["status"] == "no_data", F.lit("<p>No system metrics available</p>\n")).otherwise(F.concat(
            F.lit("<p>CPU Average: "), sh["cpu_average"].cast("string"), F.lit("% &middot; Memory Average: "),
            sh["memory_average"].cast("string"), F.lit("% &middot; Disk Average: "),
            sh["disk_average"].cast("string"), F.lit("% &middot; Active Alerts: "),
            sh["active_alerts"].cast("string"), F.lit("</p>\n<ul>"),
            items(sh["alert_summary"], "severity", "message"), F.lit("</ul>\n"))),
        F.lit("<h2>Anomaly Detection</h2>\n<p>Total Anomalies: "), an["total_anomalies"].cast("string"),
        F.lit(" &middot; High Severity: "), an["high_severity"].cast("string"), F.lit("</p>\n<ul>"),
        items(an["recent"], "severity", "description"), F.lit("</ul>\n"),
        F.lit("<h2>Recommendations</h2>\n<ol>"), recs, F.lit("</ol>\n</body>\n</html>"))
    return report.select("report_id", html.alias("report"))


def format_json(report: DataFrame) -> DataFrame:
    """The report as one JSON document (NULL fields kept, times with µs)."""
    opts = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
            "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return report.select("report_id", F.to_json(F.struct(*report.columns), opts).alias("report"))


def generate(logs: DataFrame, metrics: DataFrame, alerts: DataFrame, as_of, p: ReportParams) -> DataFrame:
    """REPORT GENERATE: the daily report in the format asked for, within the contract's bounds."""
    made = daily_report(logs, metrics, alerts, as_of, p.since)
    return {"text": format_text, "html": format_html, "json": format_json}[p.fmt](made)


def save_report(rendered: DataFrame, directory: str, as_of, extension: str = "txt") -> str:
    """K8: write a rendered report (one row, ``report`` column) as
    ``report_<YYYYmmdd_HHMMSS>.<ext>`` under ``directory``; returns the path.

    The single row is written by one task; a Spark text "file" is a folder
    holding one part file.
    """
    ts = as_timestamp(as_of)
    path = f"{directory.rstrip('/')}/report_{ts:%Y%m%d_%H%M%S}.{extension}"
    rendered.select("report").coalesce(1).write.mode("overwrite").text(path)
    return path


def list_reports(spark: SparkSession, directory: str, limit: int = 10) -> DataFrame:
    """stored text reports (name, size, modified time), newest first."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "part-*").load(directory)
             .select(F.regexp_extract("path", r"/(report_[^/]+)/part-[^/]*$", 1).alias("name"),
                     F.col("length").alias("size"), F.col("modificationTime").alias("modified")))
    reports = files.filter(F.col("name").rlike(r"^report_.*\.txt$")).groupBy("name").agg(
        F.sum("size").alias("size"), F.max("modified").alias("modified"))
    return reports.orderBy(F.col("modified").desc(), F.col("name").desc()).limit(limit)
