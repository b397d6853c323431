"""Streaming error-spike detection (W2): error rows per (time window, unit).

Two output modes through ``foreachBatch`` (see ``start_error_spikes``):
``append`` (the default) bounds the state with an event-time watermark;
``complete`` emits every window with its final count and drops nothing, at the
price of state that grows with history. The state is one counter per open (window, unit).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timberline import versions
from timberline.functions import is_error_severity
from timberline.streaming.sinks import read_other_epochs, write_epoch

SPIKE_SCHEMA = "window_start timestamp_ntz, window_end timestamp_ntz, unit string, error_count long"


def windowed_errors(parsed: DataFrame, window: str = "1 hour", prefilter: bool = True) -> DataFrame:
    """Error rows per tumbling ``window`` and unit (batch or streaming input).

    ``prefilter=False`` counts with ``count_if`` over every row instead of
    filtering first: under an event-time watermark, a severity filter would be
    pushed below the watermark and only error rows could move event time on.
    """
    # Window on the column itself when it is already a timestamp, so an
    # event-time watermark declared on it is seen by the aggregation.
    ts = F.col("ts") if dict(parsed.dtypes)["ts"] == "timestamp" else F.col("ts").cast("timestamp")
    w = F.window(ts, window)
    if prefilter:
        counts = parsed.filter(is_error_severity(F.col("severity"))).groupBy(w.alias("w"), F.col("unit")) \
            .agg(F.count(F.lit(1)).alias("error_count"))
    else:
        counts = parsed.groupBy(w.alias("w"), F.col("unit")) \
            .agg(F.count_if(is_error_severity(F.col("severity"))).alias("error_count"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                         F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                         "unit", "error_count")


def start_error_spikes(parsed_stream: DataFrame, table: str, checkpoint: str, window: str = "1 hour",
                       threshold: int = 10, available_now: bool = True, mode: str = "append",
                       lateness: str = "2 hours") -> StreamingQuery:
    """Keep in ``table`` the (window, unit) groups with more than ``threshold`` errors.

    ``mode="complete"``: every micro-batch rewrites the table from the complete
    result; no row is ever dropped, but the state holds every window seen, so
    it grows with the stream's history (right for bounded replays and checks).
    ``mode="append"``: for long-running streams. An event-time watermark
    ``lateness`` behind the newest row closes windows; each closed window is
    emitted once into its own epoch partition and its state is dropped, so the
    state is bounded by the open windows. Error rows later than the watermark
    are not counted (they are still stored by the ingest stream).
    """
    if mode not in ("complete", "append"):
        raise ValueError("mode must be complete or append")
    src = parsed_stream
    if mode == "append":
        src = src.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    counts = windowed_errors(src, window, prefilter=(mode == "complete"))

    def sink(batch: DataFrame, epoch_id: int) -> None:
        spikes_only = batch.filter(F.col("error_count") > threshold)
        # complete: the whole result replaces the previous one (epoch 0);
        # append: closed windows accumulate, one epoch partition per batch.
        write_epoch(spikes_only, table, 0 if mode == "complete" else epoch_id)

    writer = counts.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


# --- trailing windows from panes ---------------------------------------------------

PANE_SCHEMA = "pane_end timestamp_ntz, unit string, error_count long"
TRAILING_SCHEMA = SPIKE_SCHEMA


def trailing(panes: DataFrame, pane_seconds: int, window_seconds: int) -> DataFrame:
    """Errors of the trailing window at every pane edge, per unit, from the panes' counts: a pane
    counts at its own end and at each later edge whose window still holds it."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(pane_seconds).cast("decimal(18,6)"))
    last = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(window_seconds - pane_seconds).cast("decimal(18,6)"))
    whole = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(window_seconds).cast("decimal(18,6)"))
    edges = F.explode(F.sequence("pane_end", F.col("pane_end") + last, step)).alias("window_end")
    counts = panes.select(edges, "unit", "error_count").groupBy("window_end", "unit").agg(F.sum("error_count").alias("error_count"))
    return counts.select((F.col("window_end") - whole).alias("window_start"), "window_end", "unit", "error_count")


def _judged(spark: SparkSession, path: str, epoch_id: int, upto: dt.datetime) -> dt.datetime | None:
    """The last edge judged before this epoch (None: none yet); ``upto`` is noted as the last of this one. A
    replayed epoch gets the same answer again."""
    before: list[dt.datetime | None] = []

    def make(newest: str | None) -> DataFrame:
        row = None if newest is None else spark.read.schema(_MARK).parquet(newest).first()
        before.append(None if row is None else row["before"] if row["epoch"] == epoch_id else row["upto"])
        return spark.createDataFrame([(epoch_id, before[-1], upto)], _MARK).coalesce(1)

    versions.publish(spark, path, make)
    return before[-1]


_MARK = "epoch long, before timestamp_ntz, upto timestamp_ntz"


def start_trailing_spikes(parsed_stream: DataFrame, pane_table: str, table: str, checkpoint: str, pane_seconds: int = 600,
                          window_seconds: int = 3600, threshold: int = 10, lateness: str = "2 hours",
                          available_now: bool = True) -> StreamingQuery:
    """W2 with trailing windows: at every pane edge, the units with more than ``threshold`` errors in
    the ``window_seconds`` before it. A spike across the edge of an hour is seen, which tumbling windows miss.

    The stream's state is one counter for each open (pane, unit), whatever the window's length: rows are
    counted once, not once a window. A pane that the watermark has closed is written to ``pane_table``;
    an edge is judged once, when all panes up to it are closed, from the panes of its own window: a
    micro-batch reads back no more than one window's panes. Each batch has its own partition in
    both tables, so a replay replaces its rows."""
    if pane_seconds < 1 or window_seconds % pane_seconds:
        raise ValueError("the window must be a whole number of panes")
    src = parsed_stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    counts = windowed_errors(src, f"{pane_seconds} seconds", prefilter=False) \
        .select(F.col("window_end").alias("pane_end"), "unit", "error_count")

    def sink(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        closed = batch.select("pane_end", "unit", "error_count").persist()  # one trigger's closed panes
        try:
            write_epoch(closed.withColumn("day", F.to_date("pane_end")), pane_table, epoch_id, ["day"])
            upto = closed.agg(F.max("pane_end").alias("t")).first()["t"]
            if upto is None:
                return
            judged = _judged(spark, f"{pane_table.rstrip('/')}_judged", epoch_id, upto)
            panes = closed
            if judged is not None:
                oldest = judged - dt.timedelta(seconds=window_seconds)
                days = [oldest.date() + dt.timedelta(days=i) for i in range((judged.date() - oldest.date()).days + 1)]
                back = read_other_epochs(spark, pane_table, epoch_id, days)
                if back is not None:
                    panes = closed.unionByName(back.filter(F.col("pane_end") > F.lit(oldest)).select(*closed.columns))
            found = trailing(panes, pane_seconds, window_seconds).filter((F.col("window_end") <= F.lit(upto)) & (F.col("error_count") > threshold))
            if judged is not None:
                found = found.filter(F.col("window_end") > F.lit(judged))
            write_epoch(found, table, epoch_id)
        finally:
            closed.unpersist()

    writer = counts.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
