"""Source parsers and filters on literal lines (the reference's pinned examples)."""

import datetime as dt
import json


from timberline.sources import filters, parsers
from timberline.sources.registry import LogSource, python_line_parser, read_all, register_parser


def _lines(spark, values, **extra):
    rows = [{"value": v, "seq": i, **{k: (vs[i] if isinstance(vs, list) else vs) for k, vs in extra.items()}}
            for i, v in enumerate(values)]
    return spark.createDataFrame(rows)


def _journald(unit, prio, i):
    return json.dumps({"__REALTIME_TIMESTAMP": str(1_700_000_000_000_000 + i), "_HOSTNAME": "h",
                       "_SYSTEMD_UNIT": unit, "PRIORITY": prio, "_PID": "123", "MESSAGE": f"m{i}",
                       "__CURSOR": f"cursor-{i}"})


def test_journald_three_rows(spark):
    out = parsers.parse_journald(_lines(spark, [_journald("u.service", "4", i) for i in range(3)])) \
        .orderBy("ts").collect()
    assert [r.cursor for r in out] == ["cursor-0", "cursor-1", "cursor-2"]
    assert out[0].severity == "warning" and out[0].pid == 123 and out[0].source == "journald"
    assert out[1].ts - out[0].ts == dt.timedelta(microseconds=1)


def test_journald_bad_lines_dropped_and_unit_fallback(spark):
    good = json.dumps({"__REALTIME_TIMESTAMP": "1700000000000000", "SYSLOG_IDENTIFIER": "cron",
                       "_SYSTEMD_UNIT": "", "PRIORITY": 9, "MESSAGE": "x", "_PID": ""})
    bad_ts = json.dumps({"__REALTIME_TIMESTAMP": "soon", "MESSAGE": "y"})
    out = parsers.parse_journald(_lines(spark, [good, bad_ts, "{not json"])).collect()
    assert len(out) == 1
    assert out[0].unit == "cron" and out[0].severity == "9" and out[0].pid is None


def test_unit_exclusion(spark):
    lines = _lines(spark, [_journald("nginx.service", "6", 0), _journald("systemd-networkd.service", "6", 1)])
    kept = filters.exclude_units(parsers.parse_journald(lines), ["systemd-*"]).collect()
    assert [r.unit for r in kept] == ["nginx.service"]


def test_syslog_lines(spark):
    lines = _lines(spark, ["<14>Jan 01 12:00:00 host app[123]: message one",
                           "<11>Jan  1 12:00:01 host app: message two", "garbage"])
    out = parsers.parse_syslog(lines, year=2024).orderBy("ts").collect()
    assert [(r.unit, r.pid, r.severity, r.message) for r in out] == [
        ("app", 123, "info", "message one"), ("app", None, "err", "message two")]
    assert out[0].ts == dt.datetime(2024, 1, 1, 12, 0, 0)
    compat = parsers.parse_syslog(lines, year=2024, strict_compat=True).orderBy("ts").collect()
    assert compat[0].unit == "app[123]" and compat[0].pid is None  # the reference's greedy pattern


def test_syslog_impossible_date_dropped(spark):
    out = parsers.parse_syslog(_lines(spark, ["<14>Feb 30 12:00:00 h a: x"]), year=2023).collect()
    assert out == []


def test_container_lines_and_globs(spark):
    lines = _lines(spark, ["2024-06-01T10:20:30.123456789Z stdout hello",
                           "2024-06-01T10:20:31.5Z stderr warn", "2024-06-01T10:20:32.1Z stdout skipped"],
                   container=["c1", "c1", "sidecar-xyz"])
    kept = filters.container_glob_filter(lines, ["*"], ["sidecar-*"])
    out = parsers.parse_container(kept).orderBy("ts").collect()
    assert [(r.unit, r.severity, r.message) for r in out] == [("c1", "info", "hello"), ("c1", "warning", "warn")]
    assert out[0].ts == dt.datetime(2024, 6, 1, 10, 20, 30, 123456)


def test_glob_brackets(spark):
    df = spark.createDataFrame([(n,) for n in ["host0", "host3", "host7", "hostx"]], "container string")
    out = filters.container_glob_filter(df, ["host[0-4]", "h*7"], ["host[!0-2]"]).collect()
    assert sorted(r.container for r in out) == ["host0"]


def test_service_status_text(spark):
    text = ["UNIT LOAD ACTIVE SUB DESCRIPTION", "sshd.service loaded active running OpenSSH",
            "dbus.service loaded active running D-Bus", "", "cron.service loaded active running Cron", "short line"]
    df = spark.createDataFrame([("cap", i, t) for i, t in enumerate(text)], "capture string, line_no int, value string")
    out = parsers.parse_service_status(df, ["capture"]).orderBy("line_no").collect()
    assert [r.service_name for r in out] == ["sshd.service", "dbus.service", "cron.service"]


def test_registry_isolates_failures_and_custom_parser(spark):
    register_parser("kv", python_line_parser(
        lambda line: {"ts": dt.datetime(2024, 1, 1), "message": line.split("=", 1)[1], "source": "kv"}
        if "=" in line else None))
    good = LogSource("kv-src", "kv", config={"lines": _lines(spark, ["a=1", "nope", "b=2"])})
    broken = LogSource("broken", "no-such-type")
    off = LogSource("off", "kv", enabled=False, config={"lines": _lines(spark, ["c=3"])})
    df, errors = read_all(spark, [good, broken, off], "2024-01-02 00:00:00", since_seconds=86400 * 2, limit=None)
    assert set(errors) == {"broken"}
    rows = sorted(df.collect(), key=lambda r: r.message)
    assert [r.message for r in rows] == ["1", "2"]
    assert [json.loads(r.raw) for r in rows] == [{"raw": "a=1"}, {"raw": "b=2"}]  # X6 applied to P1 output


def test_file_pruning_by_size(spark, tmp_path):
    (tmp_path / "small.log").write_text("<14>Jan 01 12:00:00 h a: x\n")
    (tmp_path / "big.log").write_text("<14>Jan 01 12:00:00 h a: y\n" * (2 * 1024 * 1024 // 26 + 1))
    (tmp_path / "other.txt").write_text("<14>Jan 01 12:00:00 h a: z\n")
    from timberline.sources.files import list_files, read_lines
    names = sorted(r.file_path.rsplit("/", 1)[1] for r in list_files(spark, str(tmp_path), max_size_mb=1).collect())
    assert names == ["small.log"]
    assert read_lines(spark, str(tmp_path), max_size_mb=1).count() == 1


def test_file_pruning_by_age_and_first_n(spark, tmp_path):
    import os
    import time
    from timberline.sources.registry import read_source
    old, new = tmp_path / "old.log", tmp_path / "new.log"
    old.write_text("<14>Jan 01 12:00:00 h a: stale\n")
    new.write_text("".join(f"<14>Jan 01 12:00:{i:02d} h a: line {i}\n" for i in range(5)))
    week_ago = time.time() - 7 * 86400
    os.utime(old, (week_ago, week_ago))
    from timberline.sources.files import list_files
    cutoff = dt.datetime.fromtimestamp(time.time() - 86400, dt.timezone.utc)
    kept = [r.file_path.rsplit("/", 1)[1] for r in list_files(spark, str(tmp_path), modified_since=cutoff).collect()]
    assert kept == ["new.log"]
    src = LogSource("files", "file", config={"paths": [str(tmp_path)], "year": 2024, "modified_since": cutoff})
    first = read_source(spark, src, "2024-01-02 00:00:00", since_seconds=86400 * 2, limit=3).collect()
    assert [r.message for r in first] == ["line 0", "line 1", "line 2"]
