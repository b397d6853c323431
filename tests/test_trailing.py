"""Trailing windows from panes: equal to counting the window at every pane edge."""

import datetime as dt
import random
from collections import Counter

import pytest

from timberline.streaming import spikes
from timberline.streaming.sinks import read_table

START = dt.datetime(2024, 1, 10, 22)
PANE, WINDOW = 600, 3600


def brute(rows, upto, threshold):
    out, edge = set(), START
    while edge <= upto:
        n = Counter(u for t, u, sev in rows if edge - dt.timedelta(seconds=WINDOW) <= t < edge and sev in ("err", "crit", "emerg"))
        out |= {(edge - dt.timedelta(seconds=WINDOW), edge, u, c) for u, c in n.items() if c > threshold}
        edge += dt.timedelta(seconds=PANE)
    return out


def run(spark, tmp_path, files):
    schema = "ts timestamp_ntz, unit string, severity string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = spikes.start_trailing_spikes(stream, str(tmp_path / "panes"), str(tmp_path / "spikes"), str(tmp_path / "check"),
                                         PANE, WINDOW, threshold=3, lateness="30 minutes")
        q.awaitTermination()
    panes = read_table(spark, str(tmp_path / "panes"), spikes.PANE_SCHEMA)
    upto = max(r.pane_end for r in panes.collect())
    rows = [tuple(r)[:4] for r in read_table(spark, str(tmp_path / "spikes"), spikes.TRAILING_SCHEMA).select(
        "window_start", "window_end", "unit", "error_count").collect()]
    return rows, upto


def test_every_pane_edge_over_several_runs(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted(((START + dt.timedelta(seconds=rng.randrange(6 * 3600)), rng.choice(["a", "b", None]), rng.choice(["err", "info", "crit"]))
                   for _ in range(400)), key=lambda r: r[0])
    cut = [rows[:130], rows[130:260], rows[260:]]
    cut[1].append(cut[0].pop())  # a late row within the watermark
    got, upto = run(spark, tmp_path, cut)
    want = brute(rows, upto, 3)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_a_spike_across_the_edge_of_an_hour(spark, tmp_path):
    near = [(dt.datetime(2024, 1, 10, 22, 55) + dt.timedelta(minutes=2 * i), "a", "err") for i in range(5)]  # 22:55 to 23:03
    got, upto = run(spark, tmp_path, [near + [(dt.datetime(2024, 1, 11, 3), "z", "info")]])
    assert {r[2] for r in got} == {"a"} and max(r[3] for r in got) == 5  # three before the hour, two after
    assert set(got) == brute(near, upto, 3)


def test_a_replayed_epoch_judges_the_same_edges(spark, tmp_path):
    path = str(tmp_path / "marks")
    first, second = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    assert spikes._judged(spark, path, 0, first) is None
    assert spikes._judged(spark, path, 0, first) is None
    assert spikes._judged(spark, path, 1, second) == first
    assert spikes._judged(spark, path, 1, second) == first


def test_window_of_whole_panes(spark):
    with pytest.raises(ValueError):
        spikes.start_trailing_spikes(None, "", "", "", pane_seconds=700)
