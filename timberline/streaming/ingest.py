"""Streaming log ingest with duplicate removal.

``readStream.text`` over a landing folder -> the batch parsers -> fingerprint
-> ``dropDuplicatesWithinWatermark`` -> ``foreachBatch`` into the log table
with the table anti join of the batch ingest as the backstop.

The watermark is on the arrival time of a line, not on the log timestamp: an
event-time watermark would drop log rows that arrive late, losing data.
Duplicates arriving within ``dedup_window`` of each other are removed from the
stream state; older ones are removed by the anti join against the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timberline.operators import ingest, totals
from timberline.operators.cursor_keys import CursorKeys
from timberline.session import file_system
from timberline.sources import positions
from timberline.sources.registry import CONTAINER_FILE, parser_for
from timberline.streaming.sinks import EPOCH, read_other_epochs, write_epoch


def parsed_stream(spark: SparkSession, landing: str, source_type: str = "journald",
                  year: int | None = None, max_files_per_trigger: int | None = None,
                  config: dict | None = None, container_pattern: str = CONTAINER_FILE,
                  by_position: bool = False, patterns=("*",)) -> DataFrame:
    """A streaming DataFrame of parsed log rows from text files landing in
    ``landing`` (or, ``by_position``, from files there that go on growing: each line once, by
    file and byte), by the parser registered for ``source_type`` with its ``config`` (units,
    patterns; ``year`` for syslog). A container is named by group 1 of ``container_pattern``
    in the path of its file."""
    if by_position:
        lines = positions.stream(spark, landing, patterns).select("value", F.col("file_path").alias("_path"))
    else:
        reader = spark.readStream.format("text")
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        lines = reader.load(landing).select("value", F.col("_metadata.file_path").alias("_path"))
    if source_type == "container":
        lines = lines.withColumn("container", F.regexp_extract("_path", container_pattern, 1))
    config = dict(config or {}, **({} if year is None else {"year": year}))
    return parser_for(source_type)(lines.drop("_path"), config)


def dedup_stream(parsed: DataFrame, dedup_window: str = "1 hour") -> DataFrame:
    """Fingerprint rows and drop repeats seen within ``dedup_window`` of arrival."""
    rows = ingest.prepare_batch(parsed).withColumn("_arrived", F.current_timestamp())
    return rows.withWatermark("_arrived", dedup_window).dropDuplicatesWithinWatermark(["fingerprint"]) \
               .drop("_arrived")


def start_ingest(spark: SparkSession, landing: str, table: str, checkpoint: str,
                 source_type: str = "journald", available_now: bool = True,
                 processing_time: str | None = None, dedup_window: str = "1 hour",
                 max_files_per_trigger: int | None = None, year: int | None = None,
                 config: dict | None = None, container_pattern: str = CONTAINER_FILE,
                 keys: CursorKeys | None = None, by_position: bool = False, patterns=("*",),
                 totals_table: str | None = None) -> StreamingQuery:
    """Run the ingest stream into ``table`` (Parquet partitioned by ``day``
    and micro-batch ``epoch``). Each batch keeps its first row per cursor and
    loses rows whose id / fingerprint / cursor is already in an earlier batch.

    The content check lists and reads the batch's own days. With ``keys`` (the table's cursor key
    table) cursors are checked against the buckets that may hold them, so a micro-batch touches
    nothing that grows with history; without it the cursor column of the whole table is read. ``totals_table``
    gets each batch's hourly counts (``operators.totals``). ``sinks.compact`` may run beside the stream."""
    stream = dedup_stream(parsed_stream(spark, landing, source_type, year=year,
                                        max_files_per_trigger=max_files_per_trigger, config=config,
                                        container_pattern=container_pattern, by_position=by_position,
                                        patterns=patterns), dedup_window)

    def sink(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        # Arrival order inside the micro-batch (the batch is a static DataFrame
        # here). It is read several times (rows, their places, the days that prune the
        # table), so it is kept for the length of this call; its size is one trigger's worth.
        batch = batch.withColumn("seq", F.monotonically_increasing_id()).withColumn(ingest.ROW, F.col("seq")).persist()
        fresh = None
        try:
            days = None
            if keys is not None:
                keys.sync_epochs(epoch_id)
                days = [r["d"] for r in batch.select(F.to_date("ts").alias("d")).distinct().collect()]  # one trigger's days
            existing = read_other_epochs(session, table, epoch_id, days)
            fresh = ingest.fresh_places(batch, existing, "seq", "source", keys).persist()
            rows = ingest.to_table_rows(ingest.pick(batch, fresh, fresh.count(), batch.count()))
            rows = rows.repartitionByRange("day", "ts")  # a task writes few days, so files are few
            if totals_table is not None:
                rows = rows.persist()  # written and counted; one trigger's new rows
            write_epoch(rows, table, epoch_id, partition_by=["day"])
            if totals_table is not None:
                write_epoch(totals.hourly(rows).repartition("day"), totals_table, epoch_id, partition_by=["day"])
                rows.unpersist()
            if keys is not None:
                folders = [f"{table.rstrip('/')}/day={d}/{EPOCH}={epoch_id}" for d in days if d is not None]
                keys.note_epoch(epoch_id, [f for f in folders if (at := file_system(session, f))[0].exists(at[1])])
        finally:
            batch.unpersist()
            if fresh is not None:
                fresh.unpersist()

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else \
        writer.trigger(processingTime=processing_time or "1 minute")
    return writer.start()
