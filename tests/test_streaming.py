"""Streaming operators: idempotent replay and restart from the checkpoint."""

import json
import uuid

from pyspark.sql import functions as F

from timberline.session import scratch_path
from timberline.streaming import ingest as stream_ingest
from timberline.streaming.sinks import read_table, write_epoch


def _journald(i, cursor=None):
    return json.dumps({"__REALTIME_TIMESTAMP": str(1_704_067_200_000_000 + i * 1_000_000), "_HOSTNAME": "h",
                       "_SYSTEMD_UNIT": "u.service", "PRIORITY": "3", "MESSAGE": f"m{i}",
                       "__CURSOR": cursor or f"c{i}"})


def test_replayed_epoch_is_not_duplicated(spark):
    path = scratch_path(spark, f"test-epoch-{uuid.uuid4().hex[:8]}")
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    write_epoch(df, path, 0)
    write_epoch(df, path, 1)
    write_epoch(df, path, 1)  # the same micro-batch handed over again after a failure
    assert read_table(spark, path).count() == 10


def test_stream_ingest_dedups_across_batches_and_restarts(spark, tmp_path):
    base = scratch_path(spark, f"test-stream-{uuid.uuid4().hex[:8]}")
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.log").write_text("\n".join(_journald(i) for i in range(5)) + "\n")
    # Later file: two repeats of earlier entries (one under a new cursor), one new entry, one bad line.
    (landing / "b.log").write_text("\n".join([_journald(1), _journald(2, cursor="other"), _journald(9), "{bad"]) + "\n")
    for _ in range(2):  # the second run restarts from the checkpoint and finds nothing new
        q = stream_ingest.start_ingest(spark, str(landing), f"{base}/table", f"{base}/ckpt", max_files_per_trigger=1)
        q.awaitTermination()
        rows = read_table(spark, f"{base}/table").collect()
        assert sorted(r.message for r in rows) == ["m0", "m1", "m2", "m3", "m4", "m9"]


def test_service_watch_judges_closed_snapshots(spark, tmp_path):
    import datetime as dt
    from timberline.schema import METRICS
    from timberline.streaming import monitor
    t0 = dt.datetime(2024, 1, 1, 12, 0, 10)
    land = tmp_path / "metrics"
    batches = [
        [(t0, "service", '{"service_name": "sshd.service"}'), (t0, "service", '{"service_name": "dbus.service"}')],
        [(t0 + dt.timedelta(minutes=1), "service", f'{{"service_name": "{s}.service"}}') for s in ("sshd", "dbus", "systemd")],
        [(t0 + dt.timedelta(minutes=10), "cpu", '{"cpu_percent": 5}')],  # moves the watermark past both snapshots
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, METRICS).write.parquet(str(land / f"b{i}"))
    base = scratch_path(spark, f"test-watch-{uuid.uuid4().hex[:8]}")
    stream = spark.readStream.schema(METRICS) \
        .option("recursiveFileLookup", "true").parquet(str(land))
    q = monitor.start_service_watch(stream, f"{base}/alerts", f"{base}/ckpt", snapshot="1 minute",
                                    delay="1 minute", available_now=True)
    q.awaitTermination()
    got = sorted((r.timestamp, r.message) for r in read_table(spark, f"{base}/alerts").collect())
    assert got == [(dt.datetime(2024, 1, 1, 12, 0), "Critical service systemd is not running")]


def test_error_spikes_append_mode_emits_closed_windows(spark, tmp_path):
    from timberline.streaming import spikes
    land = tmp_path / "landing"
    land.mkdir()
    hour = 3_600_000_000
    base_us = 1_704_067_200_000_000  # 2024-01-01 00:00:00

    def line(i, offset_us, prio="3"):
        return json.dumps({"__REALTIME_TIMESTAMP": str(base_us + offset_us), "_SYSTEMD_UNIT": "u.service",
                           "PRIORITY": prio, "MESSAGE": f"m{i}", "__CURSOR": f"c{i}"})

    rows = [line(i, i * 1000) for i in range(12)]          # 12 errors in the first hour
    rows += [line(100 + i, hour + i) for i in range(3)]     # 3 errors in the second hour
    rows += [line(200, 5 * hour, prio="6")]                 # an info row moves the watermark on
    (land / "a.log").write_text("\n".join(rows) + "\n")
    base = scratch_path(spark, f"test-spikes-{uuid.uuid4().hex[:8]}")
    parsed = stream_ingest.parsed_stream(spark, str(land))
    q = spikes.start_error_spikes(parsed, f"{base}/table", f"{base}/ckpt", window="1 hour", threshold=10,
                                  mode="append", lateness="1 hour")
    q.awaitTermination()
    got = [(r.unit, r.error_count) for r in read_table(spark, f"{base}/table", spikes.SPIKE_SCHEMA).collect()]
    assert got == [("u.service", 12)]


def test_container_stream_names_rows_by_their_file(spark, tmp_path):
    land = tmp_path / "containers"
    land.mkdir()
    (land / "web-json.log").write_text("2024-01-01T00:00:00.5Z stdout up\n")
    (land / "db.log").write_text("2024-01-01T00:00:01.0Z stderr slow\nnot a container line\n")
    base = scratch_path(spark, f"test-containers-{uuid.uuid4().hex[:8]}")
    for patterns, units in ((["*"], ["db", "web"]), (["w*"], ["web"])):
        out = f"{base}/{len(units)}"
        stream_ingest.start_ingest(spark, str(land), f"{out}/table", f"{out}/ckpt", source_type="container",
                                   config={"include_patterns": patterns}).awaitTermination()
        assert sorted(r.unit for r in read_table(spark, f"{out}/table").collect()) == units
