"""Named-field patterns: formats without a Python worker."""

import datetime as dt

import pytest

from timberline.sources import registry
from timberline.sources.patterns import pattern_parser
from timberline.sources.registry import LogSource, read_source


def parse(spark, pattern, lines, **kw):
    df = pattern_parser(pattern, **kw)(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, seq long"), {})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    return df.orderBy("seq").collect()


def test_access_log(spark):
    rows = parse(spark, '{hostname} - {_} [{ts:time(dd/MMM/yyyy:HH:mm:ss Z)}] "{message:text}" {pid:int} {_:int}', [
        '10.0.0.1 - bob [10/Jan/2024:13:55:36 +0200] "GET /a?x="1" HTTP/1.1" 200 12',
        '10.0.0.1 - bob [10/Bad/2024:13:55:36 +0200] "GET /" 200 12', "noise", ""], source="web")
    assert [(r.ts, r.hostname, r.message, r.pid, r.source, r.seq) for r in rows] == [
        (dt.datetime(2024, 1, 10, 11, 55, 36), "10.0.0.1", 'GET /a?x="1" HTTP/1.1', 200, "web", 0)]
    assert rows[0].raw == '{"raw":"10.0.0.1 - bob [10/Jan/2024:13:55:36 +0200] \\"GET /a?x=\\"1\\" HTTP/1.1\\" 200 12"}'


def test_application_log_with_levels_and_optional_pid(spark):
    rows = parse(spark, "{ts:iso} {severity:level} {unit}[[[{pid:int}]]]: {message:text}", [
        "2024-01-10T12:00:00.5Z WARN app[42]: slow", "2024-01-10 12:00:01,250 Critical app: [x]: y ", "2024-01-10 12:00 FATAL a: x",
        "2024-01-10T12:00:00+01:30 notice app[]: odd", "2024-13-10T12:00:00Z info app: bad month"])
    got = [(r.ts.isoformat(), r.severity, r.unit, r.pid, r.message) for r in rows]
    assert got[:3] == [("2024-01-10T12:00:00.500000", "warning", "app", 42, "slow"),
                       ("2024-01-10T12:00:01.250000", "crit", "app", None, "[x]: y"), ("2024-01-10T12:00:00", "crit", "a", None, "x")]
    assert got[3][:3] == ("2024-01-10T10:30:00", "notice", "app[]") and len(got) == 4


def test_epoch_priority_and_registration(spark):
    registry.register_parser("kv", pattern_parser("<{severity:pri}> t={ts:epoch} host={hostname} cursor={cursor} {message:text}"))
    lines = spark.createDataFrame([("<14> t=1704888000.25 host=h1   cursor=c1 it's   fine",)], "value string")
    row = read_source(spark, LogSource("k", "kv", config={"lines": lines}), "2024-01-10 13:00:00").first()
    assert (row.ts, row.severity, row.hostname, row.cursor, row.message) == (dt.datetime(2024, 1, 10, 12, 0, 0, 250000), "info", "h1", "c1", "it's   fine")


@pytest.mark.parametrize("bad", ["{message}", "{ts:iso} {ts:epoch}", "{ts:time}", "{ts:iso} {nothing}", "{ts:iso} [[{pid:int}", "{ts:iso(x)}", "{ts:day}", "{ts:iso} {1}"])
def test_bad_patterns_are_errors(bad):
    with pytest.raises(ValueError):
        pattern_parser(bad)
