"""Incidents: raised once, acknowledged, closed; equal to plain rules over any cut into batches."""

import datetime as dt
import random

import pytest

from timberline.schema import METRICS
from timberline.streaming import incidents
from timberline.streaming.sinks import read_table

T0 = dt.datetime(2024, 1, 10, 12)
QUIET = 600


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def frame(spark, rows):
    return spark.createDataFrame([(at(t), "high_disk", "warning", f"m{t}", "{}", s) for t, s in rows],
                                 "timestamp timestamp_ntz, alert_type string, severity string, message string, metric_data string, subject string")


def brute(rows, now, acks=()):
    out = set()
    for subject in {s for _, s in rows}:
        times = sorted(t for t, s in rows if s == subject)
        groups = [[times[0]]]
        for t in times[1:]:
            if t < groups[-1][-1] + QUIET:
                groups[-1].append(t)
            else:
                groups.append([t])
        for g in groups:
            end = g[-1] + QUIET
            out.add((subject, g[0], "raised", g[0]))
            mine = [a for a, s in acks if s == subject and g[0] <= a <= end]
            if mine:
                out.add((subject, g[0], "acknowledged", min(mine)))
            if end <= now:
                out.add((subject, g[0], "closed", end))
    return out


def events(spark, path):
    rows = read_table(spark, path, incidents.EVENT_SCHEMA).collect()
    return [(r.subject, int((r.opened_at - T0).total_seconds()), r.event, int((r.at - T0).total_seconds())) for r in rows]


@pytest.mark.parametrize("batches", [1, 4])
def test_equal_to_plain_rules_and_replays(spark, tmp_path, batches):
    rng = random.Random(batches)
    rows = sorted((rng.randrange(20_000), rng.choice(["/", "/home"])) for _ in range(60))
    acks_rows = [(rng.randrange(20_000), "/") for _ in range(4)]
    acks = spark.createDataFrame([("high_disk", s, at(a)) for a, s in acks_rows], "alert_type string, subject string, at timestamp_ntz")
    state, out = str(tmp_path / "state"), str(tmp_path / "events")
    size = -(-len(rows) // batches)
    for e in range(batches):
        part = rows[e * size : (e + 1) * size]
        for _ in range(2 if e == 2 or batches == 1 else 1):  # a replayed epoch
            incidents.apply(frame(spark, part), at(part[-1][0]), state, out, e, QUIET, acks)
    got = events(spark, out)
    assert len(got) == len(set(got)) and set(got) == brute(rows, rows[-1][0], acks_rows)
    still = {(r.subject, int((r.opened_at - T0).total_seconds())) for r in incidents.open_incidents(spark, state).collect()}
    assert still == {(s, o) for s, o, e, _ in got if e == "raised"} - {(s, o) for s, o, e, _ in got if e == "closed"}


def test_nothing_is_raised_while_one_is_open_over_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(METRICS).parquet(str(tmp_path / "in"))
    acks = str(tmp_path / "acks")

    def run(rows):
        data = [(at(t), "cpu", f'{{"cpu_percent": {p}}}') for t, p in rows]
        spark.createDataFrame(data, METRICS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incidents.start_incidents(stream, str(tmp_path / "events"), str(tmp_path / "state"), str(tmp_path / "check"), QUIET, acks,
                                  available_now=True).awaitTermination()
        return sorted(events(spark, str(tmp_path / "events")))

    assert run([(0, 95), (60, 96)]) == [("", 0, "raised", 0)]
    spark.createDataFrame([("high_cpu", "", at(100))], "alert_type string, subject string, at timestamp_ntz").write.parquet(acks)
    assert run([(300, 99)]) == [("", 0, "acknowledged", 100), ("", 0, "raised", 0)]
    assert incidents.open_incidents(spark, str(tmp_path / "state")).first().alerts == 3
    assert run([(2000, 10)]) == [("", 0, "acknowledged", 100), ("", 0, "closed", 900), ("", 0, "raised", 0)]
    assert incidents.open_incidents(spark, str(tmp_path / "state")).count() == 0
    assert run([(2100, 91)])[-1] == ("", 2100, "raised", 2100)
