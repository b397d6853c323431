"""Running totals: hourly counts that the ingest stream keeps.

Every micro-batch adds its own counts by hour, unit, host, source and severity. Counts are merged by
summing, so a late row is one more count for its old hour, and a replayed batch replaces its own.
A window is answered from the whole hours in it, and from the log rows of the part of an hour it
begins with: a month of logs costs its hours' groups and less than an hour of rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions import is_error_severity
from timberline.operators import anomaly, report
from timberline.operators.window import PARTITION_COLUMN, since_start, ts_lit
from timberline.params import AnomalyParams, Discover
from timberline.session import materialize

KEYS = ["unit", "hostname", "source", "severity"]
SCHEMA = "hour timestamp_ntz, unit string, hostname string, source string, severity string, n long, day date"


def hourly(rows: DataFrame) -> DataFrame:
    """The counts of log rows, as they are stored (``day`` partitions the table)."""
    counts = rows.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), *KEYS).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(PARTITION_COLUMN, F.to_date("hour"))


def window_totals(totals: DataFrame, logs: DataFrame, as_of, since_seconds: int) -> DataFrame:
    """``unit, hostname, source, severity, n`` of the rows with ``ts >= as_of - since``; groups may come in
    several rows."""
    start = since_start(as_of, since_seconds)
    edge = start.replace(minute=0, second=0, microsecond=0)
    edge = edge if edge == start else edge + dt.timedelta(hours=1)
    whole = totals.filter((F.col("hour") >= ts_lit(edge)) & (F.col(PARTITION_COLUMN) >= F.lit(edge.date())))
    begun = logs.filter((F.col("ts") >= ts_lit(start)) & (F.col("ts") < ts_lit(edge)))
    if PARTITION_COLUMN in logs.columns:
        begun = begun.filter(F.col(PARTITION_COLUMN).between(F.lit(start.date()), F.lit(edge.date())))
    return whole.select(*KEYS, "n").unionByName(hourly(begun).select(*KEYS, "n"))


def discover(counts: DataFrame, d: Discover) -> DataFrame:
    """A1 from the window's totals."""
    found = counts.groupBy(F.col(d.column).alias("value")).agg(F.sum("n").alias("count"))
    return found.orderBy(F.col("count").desc_nulls_last(), F.col("value").asc_nulls_last()).limit(d.limit)


def error_spikes(counts: DataFrame, p: AnomalyParams) -> DataFrame:
    """A2 from the window's totals."""
    errors = counts.filter(is_error_severity(F.col("severity"))).groupBy("unit").agg(F.sum("n").alias("count"))
    return anomaly.spikes_from_counts(errors, p)


def high_volume(counts: DataFrame, p: AnomalyParams) -> DataFrame:
    """A3 from the window's totals."""
    return anomaly.volume_from_counts(counts.groupBy("source").agg(F.sum("n").alias("count")), p)


def log_counts(counts: DataFrame) -> DataFrame:
    """What ``report.log_counts`` gives, from the window's totals."""
    errors = F.sum(F.when(is_error_severity(F.col("severity")), F.col("n")).otherwise(0))
    grouped = counts.groupingSets([["severity"], ["unit"], ["source"], []], "severity", "unit", "source").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.coalesce(errors, F.lit(0)).alias("errors"), F.grouping_id().alias("gid"))
    return materialize(grouped)


def log_summary(counts: DataFrame, as_of, since_seconds: int) -> DataFrame:
    """A6 from the window's totals."""
    return report.log_summary(None, as_of, since_seconds, log_counts(counts))
