"""Threshold and service alerts, the alert sink and alert queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import fill, id_from_fingerprint, py_ts_str
from timberline.operators.metrics import is_valid_json
from timberline.operators.window import in_window
from timberline.params import AlertQuery
from timberline.schema import CPU_ALERT_PERCENT, CRITICAL_SERVICES, DISK_ALERT_PERCENT, MEMORY_ALERT_PERCENT

ALERT_COLUMNS = ["timestamp", "alert_type", "severity", "message", "metric_data"]

# --- fixed values: alert messages --------------------------------------------
HIGH_CPU_TEXT = "High CPU usage: {value}%"
HIGH_MEMORY_TEXT = "High memory usage: {value}%"
HIGH_DISK_TEXT = "High disk usage on {mountpoint}: {value}%"
SERVICE_DOWN_TEXT = "Critical service {service} is not running"
# -----------------------------------------------------------------------------


def _field(name: str) -> Column:
    return F.get_json_object(F.col("metric_data"), f"$.{name}")


def threshold_alerts(metrics: DataFrame) -> DataFrame:
    """M1: a ``warning`` alert for every cpu / memory / disk row whose percentage
    is strictly above its threshold (a missing value counts as 0). The message
    shows the number as written in the payload. Alert time = metric time.

    A narrow projection and filter over the metric rows; no shuffle.
    """
    pct = {"cpu": _field("cpu_percent"), "memory": _field("memory_percent"), "disk": _field("percent")}
    limit = {"cpu": CPU_ALERT_PERCENT, "memory": MEMORY_ALERT_PERCENT, "disk": DISK_ALERT_PERCENT}
    t = F.col("metric_type")
    value = F.when(t == "cpu", pct["cpu"]).when(t == "memory", pct["memory"]).when(t == "disk", pct["disk"])
    over = reduce(lambda a, b: a | b, [
        (t == k) & (F.coalesce(pct[k].try_cast("double"), F.lit(0.0)) > F.lit(v)) for k, v in limit.items()])
    df = metrics.filter(t.isin("cpu", "memory", "disk") & over).withColumn("_v", value)
    message = (F.when(t == "cpu", fill(HIGH_CPU_TEXT, value=F.col("_v")))
               .when(t == "memory", fill(HIGH_MEMORY_TEXT, value=F.col("_v")))
               .otherwise(fill(HIGH_DISK_TEXT, mountpoint=F.coalesce(_field("mountpoint"), F.lit("None")),
                               value=F.col("_v"))))
    return df.select(
        F.col("timestamp"),
        F.concat(F.lit("high_"), t).alias("alert_type"),
        F.lit("warning").alias("severity"),
        message.alias("message"),
        F.col("metric_data"))


def is_service_row() -> Column:
    """A service metric row whose payload is valid JSON."""
    return F.col("metric_type").isin("service", "services") & is_valid_json(F.col("metric_data"))


def service_name() -> Column:
    """The reported service, compared without a ``.service`` suffix."""
    return F.regexp_replace(_field("service_name"), r"\.service$", "")


def service_rows(metrics: DataFrame) -> DataFrame:
    """Valid service metric rows with their normalised name in ``_service``."""
    return metrics.filter(is_service_row()).withColumn("_service", service_name())


def seen_critical(name: Column, critical: list[str]) -> Column:
    """Aggregate: the set of critical services among ``name`` (at most len(critical))."""
    return F.collect_set(F.when(name.isin(*critical), name))


def missing_service_alerts(snapshots: DataFrame, critical: list[str]) -> DataFrame:
    """``(timestamp, _seen)`` per snapshot -> one ``critical`` alert per missing service."""
    missing = snapshots.select("timestamp", F.explode(
        F.array_except(F.array(*[F.lit(s) for s in critical]), F.col("_seen"))).alias("service"))
    return missing.select(
        "timestamp",
        F.lit("service_down").alias("alert_type"),
        F.lit("critical").alias("severity"),
        fill(SERVICE_DOWN_TEXT, service=F.col("service")).alias("message"),
        F.to_json(F.struct(F.col("service"))).alias("metric_data"))


def service_down(metrics: DataFrame, snapshot: str = "minute",
                 critical: list[str] | None = None) -> DataFrame:
    """For every snapshot (metric time truncated to ``snapshot``) that has
    service rows, a ``critical`` alert per critical service not among them.

    Names are compared without a ``.service`` suffix (D4). The set difference is
    a grouped aggregate whose state per snapshot is the set of *critical*
    services seen (bounded by the critical list), then ``array_except``.
    """
    critical = list(critical or CRITICAL_SERVICES)
    seen = (service_rows(metrics)
            .groupBy(F.date_trunc(snapshot, F.col("timestamp")).cast("timestamp_ntz").alias("timestamp"))
            .agg(seen_critical(F.col("_service"), critical).alias("_seen")))
    return missing_service_alerts(seen, critical)


def alert_id(timestamp: Column, alert_type: Column, message: Column) -> Column:
    """Deterministic id (D5): first 8 bytes of sha256(ts|type|message)."""
    return id_from_fingerprint(F.sha2(F.concat_ws("|", py_ts_str(timestamp), alert_type, message), 256))


def store_alerts(alerts: DataFrame) -> DataFrame:
    """K4: rows of the alert table (schema.ALERTS): id, not acknowledged."""
    return alerts.select(
        alert_id(F.col("timestamp"), F.col("alert_type"), F.col("message")).alias("id"),
        *ALERT_COLUMNS,
        F.lit(False).alias("acknowledged"),
        F.lit(None).cast("timestamp_ntz").alias("acknowledged_at"))


def query_alerts(alerts: DataFrame, q: AlertQuery, as_of) -> DataFrame:
    """F8: window, optional severity and acknowledged state, newest first.

    A NULL payload reads as ``{}``, a payload that is not JSON drops the row,
    a NULL acknowledged flag reads as false.
    """
    df = in_window(alerts, as_of, q.since, ts_col="timestamp")
    if q.severity is not None:
        df = df.filter(F.col("severity") == q.severity)
    ack = F.coalesce(F.col("acknowledged"), F.lit(False))
    if q.acknowledged is not None:
        df = df.filter(ack == F.lit(bool(q.acknowledged)))
    data = F.coalesce(F.col("metric_data"), F.lit("{}"))
    return (df.withColumn("metric_data", data).filter(is_valid_json(F.col("metric_data")))
            .select("id", *ALERT_COLUMNS, ack.alias("acknowledged"), "acknowledged_at")
            .orderBy(F.col("timestamp").desc(), F.col("alert_type"), F.col("message")))
