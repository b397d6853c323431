"""Operators on literal rows, replaying the reference's pinned figures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from timberline.functions import with_fingerprint
from timberline.operators import alerts, anomaly, audit, ingest, metrics, query, report, vectors
from timberline.params import AnomalyParams, Discover, LogQuery, MetricQuery, SearchParams

AS_OF = dt.datetime(2024, 1, 31)
LOG_DDL = ("id long, ts timestamp_ntz, hostname string, source string, unit string, severity string, "
           "pid int, message string, raw string, cursor string")


def _logs(spark, rows):
    return spark.createDataFrame(rows, LOG_DDL)


def _row(i, sev="info", unit="u", source="src1", msg="m", minutes=1):
    return (i, AS_OF - dt.timedelta(minutes=minutes), "h", source, unit, sev, 1, msg, "{}", f"c-{i}")


def test_fingerprint_matches_python(spark):
    import hashlib
    ts = dt.datetime(2024, 1, 1, 0, 0, 7, 180000)
    df = with_fingerprint(_logs(spark, [(0, ts, "h", "s", None, "info", None, "hello", None, None)]))
    r = df.first()
    src = f"{ts}|h|None|info|None|hello".encode()
    assert r.fingerprint == hashlib.sha256(src).hexdigest()
    assert r.id == int.from_bytes(hashlib.sha256(src).digest()[:8], "big", signed=True)


def test_query_filters_and_order(spark):
    rows = [_row(1, "err", msg="Disk 100% full"), _row(2, "info", msg="disk ok", minutes=2),
            _row(3, "debug", minutes=3), (4, AS_OF - dt.timedelta(days=2), "h", "s", "u", "crit", 1, "old", "{}", "c")]
    df = _logs(spark, rows)
    out = query.query_logs(df, LogQuery(since=3600, min_severity="INFO", contains="disk", order="asc"), AS_OF).collect()
    assert [r.id for r in out] == [2, 1]
    bogus = query.query_logs(df, LogQuery(since=3600, min_severity="nonsense"), AS_OF).collect()
    assert [r.id for r in bogus] == [1, 2, 3]  # unknown threshold: filter ignored
    literal = query.query_logs(df, LogQuery(since=3600, contains="100%", literal_contains=True), AS_OF).collect()
    assert [r.id for r in literal] == [1]


def test_param_bounds():
    with pytest.raises(ValueError):
        LogQuery(limit=0)
    with pytest.raises(ValueError):
        LogQuery(since=366 * 86400)
    with pytest.raises(ValueError):
        MetricQuery(metric_type="x" * 51)
    with pytest.raises(ValueError):
        Discover(kind="")
    assert LogQuery(order="sideways").order == "desc"


def test_discover_null_group(spark):
    df = _logs(spark, [_row(1, unit=None), _row(2, unit=None), _row(3, unit="a")])
    out = query.discover(df, Discover(kind="units"), AS_OF).collect()
    assert [(r.value, r["count"]) for r in out] == [(None, 2), ("a", 1)]


def test_log_summary_figures(spark):
    rows = ([_row(i, "info", "unitA", "src1") for i in range(25)] + [_row(25 + i, "info", "unitB", "src1") for i in range(5)]
            + [_row(30 + i, "err", "unitB", "src1" if i < 10 else "src2") for i in range(12)])
    s = report.log_summary_parts(_logs(spark, rows), AS_OF, 86400).first()
    assert s.total_logs == 42 and s.error_count == 12 and s.error_rate == 28.57 and s.period_hours == 24
    assert [(x.key, x["count"]) for x in s.severity_distribution] == [("info", 30), ("err", 12)]
    assert [(x.key, x["count"]) for x in s.top_sources] == [("src1", 40), ("src2", 2)]


def test_anomaly_summary_figures(spark):
    rows = ([_row(i, "err", "unit1") for i in range(12)] + [_row(100 + i, "crit", "unit2") for i in range(11)]
            + [_row(1000 + i, "info", "x", "source1") for i in range(1500)])
    s = anomaly.anomaly_summary_parts(_logs(spark, rows), AnomalyParams(), AS_OF).first()
    assert (s.total_anomalies, s.high_severity, s.medium_severity) == (3, 2, 1)
    assert [a.description for a in s.recent] == ["High error rate in unit1: 12 errors",
                                                 "High error rate in unit2: 11 errors",
                                                 "High log volume from source1: 1500 logs"]
    missing = anomaly.missing_logs(_logs(spark, rows), AnomalyParams(), AS_OF).collect()
    assert [r.unit for r in missing] == ["cron", "sshd", "systemd"]


def _metrics(spark, rows):
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, metric_type string, metric_data string")


def test_health_averages(spark):
    t = AS_OF - dt.timedelta(minutes=5)
    m = _metrics(spark, [(t, "cpu", '{"cpu_percent": 10}'), (t, "cpu", '{"cpu_percent": 30}'),
                         (t, "memory", '{"memory_percent": 50}'), (t, "memory", '{"memory_percent": 70}'),
                         (t, "disk", '{"mountpoint": "/", "percent": 40}'), (t, "disk", '{"percent": 60}')])
    no_alerts = alerts.store_alerts(alerts.threshold_alerts(m))
    h = metrics.health_parts(m, no_alerts, AS_OF, 86400).first()
    assert (h.cpu_average, h.memory_average, h.disk_average, h.active_alerts) == (20.0, 60.0, 50.0, 0)
    empty = metrics.health_parts(m.limit(0), no_alerts, AS_OF, 86400).first()
    assert empty.status == "no_data"


def test_snapshot_flatten_and_broken_json(spark):
    snap = spark.createDataFrame([(AS_OF,)], "timestamp timestamp_ntz").select(
        "timestamp",
        F.struct(F.lit(12.5).alias("cpu_percent")).alias("cpu"),
        F.struct(F.lit(40.0).alias("memory_percent")).alias("memory"),
        F.array(F.struct(F.lit("/").alias("mountpoint"), F.lit(91.0).alias("percent"))).alias("disk"),
        F.array(F.struct(F.lit("eth0").alias("interface"))).alias("network"),
        F.array(F.struct(F.lit("sshd.service").alias("service_name"))).alias("services"),
        F.struct(F.lit(AS_OF).alias("boot_time")).alias("uptime"))
    rows = metrics.flatten_snapshot(snap)
    assert rows.count() == 6
    assert sorted(r.metric_type for r in rows.collect()) == ["cpu", "disk", "memory", "network", "service", "uptime"]
    broken = rows.unionByName(_metrics(spark, [(AS_OF, "cpu", "{invalid json")]))
    out = metrics.query_metrics(broken, MetricQuery(since=60), AS_OF)
    assert out.count() == 6


def test_threshold_and_service_alerts(spark):
    t = AS_OF
    m = _metrics(spark, [(t, "cpu", '{"cpu_percent": 95}'), (t, "memory", '{"memory_percent": 10}'),
                         (t, "disk", '{"mountpoint": "/", "percent": 91}'),
                         (t, "service", '{"service_name": "nginx.service"}')])
    th = sorted((r.alert_type, r.message) for r in alerts.threshold_alerts(m).collect())
    assert th == [("high_cpu", "High CPU usage: 95%"), ("high_disk", "High disk usage on /: 91%")]
    down = sorted(r.message for r in alerts.service_down(m).collect())
    assert down == ["Critical service dbus is not running", "Critical service sshd is not running",
                    "Critical service systemd is not running"]
    running = _metrics(spark, [(t, "service", f'{{"service_name": "{s}.service"}}') for s in ("sshd", "dbus", "systemd")])
    assert alerts.service_down(running).count() == 0  # ".service" suffix is ignored (D4)


def test_ingest_dedup_against_table(spark):
    rows = [_row(1, msg="a"), _row(2, msg="b"), _row(1, msg="a"), _row(3, msg="c")]
    batch = _logs(spark, rows).withColumn("seq", F.monotonically_increasing_id())
    stored = ingest.prepare_batch(_logs(spark, [_row(3, msg="c")]))
    out = ingest.ingest_rows(batch, stored).collect()
    assert sorted(r.message for r in out) == ["a", "b"]


def test_audit_examples(spark):
    lines = spark.createDataFrame([
        (AS_OF, "h", "auditd", 1, "type=EXECVE msg=audit suid=0", 0),
        (AS_OF, "h", "aide", 1, "AIDE found differences", 1),
        (AS_OF, "h", "aide", 2, "VIOLATION: /etc/passwd changed", 1),
        (AS_OF, "h", "rkhunter", 1, "warning: something", 1)],
        "scan_time timestamp_ntz, host string, tool string, line_no long, line string, rc int")
    res = {r.tool: r for r in audit.scan_results(lines).collect()}
    assert (res["auditd"].severity, res["auditd"].finding_count) == ("warning", 1)
    assert (res["aide"].status, res["aide"].severity, res["aide"].finding_count) == ("violations", "critical", 1)
    assert res["aide"].details == "VIOLATION: /etc/passwd changed"
    assert (res["rkhunter"].status, res["rkhunter"].finding_count) == ("warnings", 0)


def test_vector_search_and_context(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "log_id long, embedding array<float>")
    logs = _logs(spark, [_row(1, unit="a"), _row(2, unit="b", minutes=2), _row(3, unit=None, minutes=3)])
    table = vectors.vector_rows(vec, logs, dim=2)
    hits = vectors.search(table, [1.0, 0.0], SearchParams(n_results=2), AS_OF).collect()
    assert [h.log_id for h in hits] == [1, 3] and hits[0].distance == 0.0
    ctx = vectors.rag_context(vectors.expand_hits(spark.createDataFrame(hits), logs)).first().context
    assert ctx.splitlines()[0] == "Relevant log entries:"
    assert ctx.splitlines()[2].endswith("None (info): m")
    empty = vectors.rag_context(vectors.expand_hits(spark.createDataFrame(hits).limit(0), logs)).first()
    assert empty.context == "No relevant logs found."
    emb = vectors.with_embedding(spark.createDataFrame([("disk full on sda",), (None,)], "t string"),
                                 "t", "e").collect()
    assert len(emb[0].e) == 64 and emb[1].e is None
    assert abs(sum(x * x for x in emb[0].e) - 1.0) < 1e-5

    class Halves:
        def embed(self, texts):
            import numpy as np
            return np.array([[0.5, 0.5] if t else [np.nan, np.nan] for t in texts])

    custom = vectors.with_embedding(spark.createDataFrame([("a",), ("",)], "t string"), "t", "e",
                                    model=Halves()).collect()
    assert custom[0].e == [0.5, 0.5] and custom[1].e is None


def test_ingest_into_table_twice(spark, tmp_path):
    batch = _logs(spark, [_row(1, msg="a"), _row(2, msg="b"), _row(1, msg="a")]) \
        .withColumnRenamed("source", "source_name").withColumn("seq", F.monotonically_increasing_id())
    table, state = str(tmp_path / "logs"), str(tmp_path / "state")
    first = ingest.ingest_into(batch, table, state, AS_OF, ["src1"])
    again = ingest.ingest_into(batch, table, state, AS_OF, ["src1"])
    assert first == {"src1": (3, 2)} and again == {"src1": (3, 0)}
    stored = spark.read.parquet(table)
    assert stored.count() == 2 and "day" in stored.columns
    assert ingest.read_state(spark, state).first().source == "src1"


def test_clear_table_keeps_schema(spark, tmp_path):
    from timberline.schema import CHAT_HISTORY
    path = str(tmp_path / "chat")
    spark.createDataFrame([(1, AS_OF, "user", "hi", "s")], CHAT_HISTORY).write.parquet(path)
    ingest.clear_table(spark, path, CHAT_HISTORY)
    cleared = spark.read.parquet(path)
    assert cleared.count() == 0 and cleared.columns == [f.name for f in CHAT_HISTORY.fields]
