"""Host metrics: snapshot flattening, queries, averages and health summary
(K3, F7, A7, A13, X14, X15).

Metric rows are ``(timestamp, metric_type, metric_data)`` with a schemaless
JSON payload, read with ``get_json_object`` (the payload differs per type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.window import in_window
from timberline.params import MetricQuery

# --- fixed values: numeric payload field of each metric type -------------------
METRIC_VALUE_FIELDS = {
    "cpu": "cpu_percent",
    "memory": "memory_percent",
    "disk": "percent",
    "uptime": "uptime_seconds",
}
# -----------------------------------------------------------------------------

ISO_TS = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


def is_valid_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def metric_value(metric_type: Column, data: Column) -> Column:
    """The numeric field of the row's type as DOUBLE (NULL if absent/not a number)."""
    out = F.lit(None).cast("double")
    for t, field in METRIC_VALUE_FIELDS.items():
        out = F.when(metric_type == t, F.get_json_object(data, f"$.{field}").try_cast("double")).otherwise(out)
    return out


def flatten_snapshot(snapshots: DataFrame) -> DataFrame:
    """K3: one row per metric of a collected snapshot.

    Input columns: ``timestamp`` and any of ``cpu``, ``memory``, ``uptime``
    (structs) and ``disk``, ``network``, ``services`` (arrays of structs). Each
    struct becomes a row whose payload is its JSON (timestamps inside as ISO
    text, X14); list-valued kinds give one row per element. Service rows are
    stored under ``service`` (D8b).
    """
    opts = {"timestampFormat": ISO_TS, "timestampNTZFormat": ISO_TS}
    items = []
    for name in ("cpu", "memory", "uptime"):
        if name in snapshots.columns:
            # A kind the snapshot does not carry (NULL struct) contributes no row.
            items.append(F.filter(F.array(F.struct(F.lit(name).alias("metric_type"),
                                                   F.to_json(F.col(name), opts).alias("metric_data"))),
                                  lambda x: x["metric_data"].isNotNull()))
    def as_row(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("metric_type"), F.to_json(x, opts).alias("metric_data"))

    for name, stored in (("disk", "disk"), ("network", "network"), ("services", "service")):
        if name in snapshots.columns:
            # A NULL list contributes no rows (an empty list of its own type).
            listed = F.coalesce(F.col(name), F.array().cast(snapshots.schema[name].dataType))
            items.append(F.transform(listed, as_row(stored)))
    rows = snapshots.select("timestamp", F.explode(F.flatten(F.array(*items))).alias("m"))
    return rows.select("timestamp", "m.metric_type", "m.metric_data")


def uptime_fields(boot: Column, at: Column) -> tuple[Column, Column]:
    """(uptime_seconds, uptime_days) between boot time and ``at``."""
    secs = F.timestamp_diff("SECOND", boot, at)
    return secs.cast("double"), F.floor(secs / 86400).cast("long")


def uptime_rows(metrics: DataFrame) -> DataFrame:
    """X15 over stored uptime metrics: boot time (metric time minus the uptime
    in the payload) and the uptime again in seconds and whole days from it."""
    up = metrics.filter(F.col("metric_type") == "uptime").select(
        "timestamp", F.get_json_object("metric_data", "$.uptime_seconds").try_cast("double").alias("_s"))
    up = up.filter(F.col("_s").isNotNull()).withColumn(
        "boot_time", (F.col("timestamp").cast("timestamp") - F.make_interval(secs=F.col("_s")))
        .cast("timestamp_ntz"))
    secs, days = uptime_fields(F.col("boot_time"), F.col("timestamp"))
    return up.select("timestamp", "boot_time", secs.alias("uptime_seconds"), days.alias("uptime_days"))


def query_metrics(metrics: DataFrame, q: MetricQuery, as_of) -> DataFrame:
    """newest first, optional type, limit; rows whose payload is not valid
    JSON are dropped after the limit, as the reference does."""
    df = in_window(metrics, as_of, q.since, ts_col="timestamp")
    if q.metric_type is not None:
        df = df.filter(F.col("metric_type") == q.metric_type)
    top = df.orderBy(F.col("timestamp").desc(), F.col("metric_type"), F.col("metric_data")).limit(q.limit)
    return top.filter(is_valid_json(F.col("metric_data"))) \
              .select("timestamp", "metric_type", "metric_data")


def metric_averages(metrics: DataFrame, as_of, since_seconds: int | None) -> DataFrame:
    """Per metric type: average of its numeric field, number of points,
    the latest value and its time. Partial aggregation per type."""
    df = in_window(metrics, as_of, since_seconds, ts_col="timestamp") \
        .withColumn("value", metric_value(F.col("metric_type"), F.col("metric_data")))
    return df.groupBy("metric_type").agg(
        F.round(F.avg("value"), 4).alias("avg_value"),
        F.count(F.lit(1)).alias("points"),
        F.count("value").alias("valued_points"),
        F.max_by("value", "timestamp").alias("latest_value"),
        F.max("timestamp").alias("latest_at"))


def newest_first_key(ts: Column) -> Column:
    """Ascending sort key that orders timestamps newest first."""
    return F.lit(0) - F.unix_micros(ts.cast("timestamp"))


def health_parts(metrics: DataFrame, alerts: DataFrame, as_of, since_seconds: int,
                 recent: int = 5) -> DataFrame:
    """A7 as one row with the newest ``recent`` alerts as an ordered array.

    Averages are over the rows of that type that carry the value (D8). Built
    without joins: the metric aggregates, the alert count and the top-k alerts
    are unioned in long form and folded by one global aggregate.
    """
    m = in_window(metrics, as_of, since_seconds, ts_col="timestamp")
    v = metric_value(F.col("metric_type"), F.col("metric_data"))
    agg_m = m.agg(
        F.count(F.lit(1)).alias("metric_rows"),
        F.round(F.avg(F.when(F.col("metric_type") == "cpu", v)), 2).alias("cpu_average"),
        F.round(F.avg(F.when(F.col("metric_type") == "memory", v)), 2).alias("memory_average"),
        F.round(F.avg(F.when(F.col("metric_type") == "disk", v)), 2).alias("disk_average"))
    active = in_window(alerts, as_of, since_seconds, ts_col="timestamp") \
        .filter(~F.coalesce(F.col("acknowledged"), F.lit(False)))
    agg_a = active.agg(F.count(F.lit(1)).alias("active_alerts"))
    top = (active.orderBy(F.col("timestamp").desc(), F.col("alert_type"), F.col("message")).limit(recent)
           .select(F.struct(newest_first_key(F.col("timestamp")).alias("_o"), F.col("alert_type").alias("_k"),
                            F.col("message").alias("_m"), F.col("severity"),
                            F.col("timestamp").alias("_t")).alias("_a")))
    top = top.agg(F.collect_list("_a").alias("_alerts"))
    parts = agg_m.unionByName(agg_a, allowMissingColumns=True).unionByName(top, allowMissingColumns=True)
    row = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    alerts_sorted = F.sort_array(F.coalesce(F.col("_alerts"), F.array()))
    return row.select(
        F.when(F.coalesce(F.col("metric_rows"), F.lit(0)) == 0, F.lit("no_data")).otherwise(F.lit("ok")).alias("status"),
        F.coalesce("cpu_average", F.lit(0.0)).alias("cpu_average"),
        F.coalesce("memory_average", F.lit(0.0)).alias("memory_average"),
        F.coalesce("disk_average", F.lit(0.0)).alias("disk_average"),
        F.coalesce("active_alerts", F.lit(0)).alias("active_alerts"),
        F.transform(alerts_sorted, lambda a: F.struct(a["severity"].alias("severity"), a["_m"].alias("message"),
                                                      a["_t"].alias("timestamp"))).alias("alert_summary"))


def health_summary(metrics: DataFrame, alerts: DataFrame, as_of, since_seconds: int) -> DataFrame:
    """A7 flattened: the recent alerts rendered ``[severity] message``, one per line."""
    h = health_parts(metrics, alerts, as_of, since_seconds)
    return h.select("status", "cpu_average", "memory_average", "disk_average", "active_alerts",
                    F.array_join(F.transform("alert_summary", lambda a: F.concat(
                        F.lit("["), a["severity"], F.lit("] "), a["message"])), "\n").alias("recent_alerts"))
