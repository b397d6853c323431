"""Continuous host monitoring (M3): metric rows stream in, are stored, checked
against the threshold rules and the resulting alerts stored (K3, M1, K4).

One ``foreachBatch`` per trigger (``processingTime`` = the monitor interval);
a failing batch is retried by Spark from the checkpoint and, being written
per epoch with overwrite, never duplicates rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pyspark.sql import functions as F

from timberline.operators import alerts
from timberline.schema import CRITICAL_SERVICES
from timberline.streaming.sinks import write_epoch


def start_monitor(metrics_stream: DataFrame, metrics_table: str, alerts_table: str, checkpoint: str,
                  interval: str = "60 seconds", available_now: bool = False) -> StreamingQuery:
    def sink(batch: DataFrame, epoch_id: int) -> None:
        # Written twice (metrics, alerts) but read once; one trigger's worth.
        batch = batch.select("timestamp", "metric_type", "metric_data").persist()
        try:
            write_epoch(batch, metrics_table, epoch_id)
            write_epoch(alerts.store_alerts(alerts.threshold_alerts(batch)), alerts_table, epoch_id)
        finally:
            batch.unpersist()

    writer = metrics_stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def start_service_watch(metrics_stream: DataFrame, alerts_table: str, checkpoint: str,
                        snapshot: str = "1 minute", delay: str = "2 minutes",
                        critical: list[str] | None = None, available_now: bool = False,
                        interval: str = "60 seconds") -> StreamingQuery:
    """M2 on a stream: per snapshot window, the critical services that did not
    report. A snapshot is judged once it is complete, i.e. when the event-time
    watermark (``delay`` behind the newest metric) passes the window's end, so
    the query runs in ``append`` mode and keeps state only for open windows
    (one small set per window). Service rows arriving after their window was
    judged do not reopen it; they are still stored by ``start_monitor``.
    """
    critical = list(critical or CRITICAL_SERVICES)
    # Every metric row goes through the watermark and the aggregate (a filter
    # on metric_type would be pushed below the watermark), so time moves on even
    # while no service reports; windows without service rows are dropped after.
    timed = metrics_stream.withColumn("_t", F.col("timestamp").cast("timestamp")).withWatermark("_t", delay)
    is_svc = alerts.is_service_row()
    seen = timed.groupBy(F.window("_t", snapshot).alias("_w")).agg(
        alerts.seen_critical(F.when(is_svc, alerts.service_name()), critical).alias("_seen"),
        F.max(is_svc.cast("int")).alias("_has_services"))
    snapshots = seen.filter(F.col("_has_services") == 1) \
        .select(F.col("_w.start").cast("timestamp_ntz").alias("timestamp"), "_seen")
    found = alerts.missing_service_alerts(snapshots, critical)

    def sink(batch: DataFrame, epoch_id: int) -> None:
        write_epoch(alerts.store_alerts(batch), alerts_table, epoch_id)

    writer = found.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
