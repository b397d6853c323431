"""Running totals equal counting the rows, with late rows, replays and windows that begin inside an hour."""

import datetime as dt
import random

import pytest

from timberline.operators import anomaly, ingest, query, report, totals
from timberline.params import AnomalyParams, Discover
from timberline.schema import LOGS
from timberline.streaming.sinks import compact, read_table, write_epoch

AS_OF = dt.datetime(2024, 1, 10, 12)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("totals"))
    rng = random.Random(2)
    rows = [(i, AS_OF - dt.timedelta(seconds=rng.randrange(3 * 86400)), rng.choice(["h1", "h2", None]), rng.choice(["s1", "s2", None]),
             rng.choice(["u1", "u2", "u3", None]), rng.choice(["err", "info", "crit", None]), f"m{i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "id long, ts timestamp_ntz, hostname string, source string, unit string, severity string, message string")
    for epoch, part in enumerate(("id % 3 = 0", "id % 3 = 1", "id % 3 = 2", "id % 3 = 2")):  # old hours come again; the last epoch is replayed
        stored = ingest.to_table_rows(frame.filter(part))
        write_epoch(stored, f"{base}/logs", min(epoch, 2), ["day"])
        write_epoch(totals.hourly(stored), f"{base}/totals", min(epoch, 2), ["day"])
    compact(spark, f"{base}/totals", sort_by="hour")
    return frame, read_table(spark, f"{base}/totals", totals.SCHEMA), read_table(spark, f"{base}/logs", LOGS)


@pytest.mark.parametrize("since", [7200, 86400, 86400 + 1234, 59, 4 * 86400])
def test_equal_to_the_raw_rows(spark, tables, since):
    frame, kept, stored = tables
    counts = totals.window_totals(kept, stored, AS_OF, since)
    p = AnomalyParams(since=since, error_spike_threshold=5, high_volume_threshold=100)

    def rows(df):
        return sorted(map(repr, df.collect()))

    for kind in ("unit", "hostname", "source", "severity"):
        d = Discover(kind=kind, since=since)
        assert [tuple(r) for r in totals.discover(counts, d).collect()] == [tuple(r) for r in query.discover(frame, d, AS_OF).collect()]
    assert rows(totals.error_spikes(counts, p)) == rows(anomaly.error_spikes(frame, p, AS_OF))
    assert rows(totals.high_volume(counts, p)) == rows(anomaly.high_volume(frame, p, AS_OF))
    assert rows(totals.log_summary(counts, AS_OF, since)) == rows(report.log_summary(frame, AS_OF, since))


def test_empty_window(spark, tables):
    frame, kept, stored = tables
    empty = totals.window_totals(kept.limit(0), stored.limit(0), AS_OF, 3600)
    assert totals.log_summary(empty, AS_OF, 3600).collect() == report.log_summary(frame.limit(0), AS_OF, 3600).collect()
