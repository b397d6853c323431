"""Life cycle of alerts on a stream (M3, K4, F8): raise once, acknowledge, close.

Alerts of one type and subject (mount point, service) that follow each other within ``quiet``
are one incident: it is raised by its first alert, may be acknowledged while it is open, and is closed
when event time has passed its last alert by ``quiet``. Nothing is raised again while one is open.

Each micro-batch reduces its alerts to sessions by a partially aggregated session window, so a
rule that fires on a third of all rows is a few rows before the shuffle, and joins them to the open
incidents. Those are a small versioned table: every version holds the incidents before and after its
epoch, so a replayed epoch starts from the same state and replaces its own events.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timberline import versions
from timberline.operators import alerts
from timberline.session import stored
from timberline.streaming.sinks import write_epoch

KEY = ["alert_type", "subject"]
EVENT_SCHEMA = ("alert_type string, subject string, opened_at timestamp_ntz, event string, at timestamp_ntz, severity string, "
                "message string, alerts long")
STATE_SCHEMA = ("alert_type string, subject string, opened_at timestamp_ntz, last_seen timestamp_ntz, severity string, message string, "
                "alerts long, acknowledged_at timestamp_ntz, side string, epoch long, now timestamp_ntz")
_OPEN = ["alert_type", "subject", "opened_at", "last_seen", "severity", "message", "alerts", "acknowledged_at"]


def with_subject(found: DataFrame) -> DataFrame:
    """What an alert is about beside its type: the mount point or service in its payload, else ``''``."""
    data = F.col("metric_data")
    named = F.coalesce(F.get_json_object(data, "$.mountpoint"), F.get_json_object(data, "$.service"), F.lit(""))
    return found.withColumn("subject", named)


def sessions(found: DataFrame, open_: DataFrame, quiet_seconds: int) -> DataFrame:
    """The incidents that the open ones and new alerts make together; ``was_open`` marks those raised before."""
    new = found.select(*KEY, F.col("timestamp").alias("opened_at"), F.col("timestamp").alias("last_seen"), "severity", "message",
                       F.lit(1).cast("long").alias("alerts"), F.lit(None).cast("timestamp_ntz").alias("acknowledged_at"), F.lit(False).alias("was_open"))
    both = new.unionByName(open_.select(*_OPEN, F.lit(True).alias("was_open"))).withColumn("_t", F.col("last_seen").cast("timestamp"))
    first = F.struct("opened_at", "severity", "message")
    merged = both.groupBy(*KEY, F.session_window("_t", f"{quiet_seconds} seconds")).agg(
        F.min(first).alias("f"), F.max("last_seen").alias("last_seen"), F.sum("alerts").alias("alerts"),
        F.min("acknowledged_at").alias("acknowledged_at"), F.max("was_open").alias("was_open"))
    return merged.select(*KEY, "f.opened_at", "last_seen", "f.severity", "f.message", "alerts", "acknowledged_at", "was_open")


def step(found: DataFrame, open_: DataFrame, acks: DataFrame | None, now: dt.datetime, quiet_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(events, incidents still open) of one micro-batch: ``found`` alerts with ``subject``, ``acks``
    (``alert_type, subject, at``), event time ``now``. An incident's acknowledgement is the first
    between its opening and its closing."""
    made = sessions(found, open_, quiet_seconds)
    ends = F.col("last_seen") + F.make_dt_interval(secs=F.lit(quiet_seconds).cast("decimal(18,6)"))
    made = made.withColumn("ends", ends)
    given = F.lit(None).cast("timestamp_ntz")
    if acks is not None:
        a = acks.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("at").alias("_at"))
        own = (F.col("alert_type") == F.col("_alert_type")) & (F.col("subject") == F.col("_subject")) & F.col("_at").between(
            F.col("opened_at"), F.col("ends"))
        made = made.join(a, own, "left").groupBy(*[c for c in made.columns]).agg(F.min("_at").alias("given"))
        given = F.col("given")
    at = F.coalesce("acknowledged_at", given)
    closed = F.col("ends") <= F.lit(now)

    def event(name: str, when: Column, time: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("event"), time.alias("at")))

    events = F.filter(F.array(event("raised", ~F.col("was_open"), F.col("opened_at")),
                              event("acknowledged", F.col("acknowledged_at").isNull() & given.isNotNull(), given),
                              event("closed", closed, F.col("ends"))), lambda e: e.isNotNull())
    out = made.select(*KEY, "opened_at", F.explode(events).alias("e"), "severity", "message", "alerts")
    out = out.select(*KEY, "opened_at", "e.event", "e.at", "severity", "message", "alerts")
    return out, made.filter(~closed).withColumn("acknowledged_at", at).select(*_OPEN)


def open_incidents(spark: SparkSession, state: str) -> DataFrame:
    """F8: the incidents that are open now, newest first."""
    newest = versions.latest(spark, state)
    if newest is None:
        return spark.createDataFrame([], STATE_SCHEMA).select(*_OPEN)
    rows = spark.read.schema(STATE_SCHEMA).parquet(newest).filter("side = 'after'").select(*_OPEN)
    return rows.orderBy(F.col("opened_at").desc(), *KEY)


def apply(found: DataFrame, now: dt.datetime | None, state: str, events: str, epoch_id: int, quiet_seconds: int,
          acks: DataFrame | None = None) -> None:
    """One epoch: write its events and publish the incidents open after it."""
    spark = found.sparkSession

    def make(newest: str | None) -> DataFrame:
        held = spark.createDataFrame([], STATE_SCHEMA) if newest is None else spark.read.schema(STATE_SCHEMA).parquet(newest)
        mark = held.filter("side = 'mark'").first()  # one row
        again = mark is not None and mark["epoch"] == epoch_id
        before = held.filter(F.col("side") == ("before" if again else "after")).select(*_OPEN)
        times = [t for t in (now, None if mark is None else mark["now"]) if t is not None]
        at = max(times, default=dt.datetime(1970, 1, 1))
        found_events, after = step(found, before, acks, at, quiet_seconds)
        write_epoch(found_events, events, epoch_id)
        sides = [before.withColumn("side", F.lit("before")), after.withColumn("side", F.lit("after"))]
        rows = sides[0].unionByName(sides[1]).withColumn("epoch", F.lit(epoch_id).cast("long")).withColumn("now", F.lit(at).cast("timestamp_ntz"))
        marked = spark.createDataFrame([(*[None] * len(_OPEN), "mark", epoch_id, at)], STATE_SCHEMA)
        return rows.select(*marked.columns).unionByName(marked).coalesce(1)

    versions.publish(spark, state, make)


def start_incidents(metrics_stream: DataFrame, events: str, state: str, checkpoint: str, quiet_seconds: int = 900,
                    acks: str | None = None, available_now: bool = False, interval: str = "60 seconds") -> StreamingQuery:
    """Threshold alerts of a metric stream as incidents: events into the table ``events``, the open
    ones under ``state``. ``acks`` is a Parquet table of acknowledgements, read in every batch. Event
    time is the newest metric of any type, so incidents close while no alert comes."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.select("timestamp", "metric_type", "metric_data").persist()  # one trigger's worth
        try:
            now = batch.agg(F.max("timestamp").alias("t")).first()["t"]
            given = None if acks is None else stored(batch.sparkSession, acks)
            apply(with_subject(alerts.threshold_alerts(batch)), now, state, events, epoch_id, quiet_seconds, given)
        finally:
            batch.unpersist()

    writer = metrics_stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
