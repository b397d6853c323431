"""Ingest at scale: places of rows instead of whole rows are shuffled, a limit is found by ranges."""

import random

import pytest

from timberline.functions import with_fingerprint
from timberline.operators import ingest
from timberline.sources import parsers

ROWS = "seq long, ts timestamp_ntz, hostname string, unit string, severity string, pid int, message string, cursor string, source_name string"


def _batch(spark, rows):
    import datetime as dt
    day = dt.datetime(2024, 1, 10)
    return spark.createDataFrame([(s, day + dt.timedelta(hours=7 * m), "h", "u", "info", 1, f"m{m}", c, "j") for s, m, c in rows], ROWS)


def _stored(spark, path):
    return sorted((r.message, r.cursor) for r in spark.read.parquet(path).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stores_what_the_whole_rows_give(spark, tmp_path, seed, monkeypatch):
    """Repeated contents and cursors, rows without a cursor, a stored table: as ``dedup_batch`` and ``new_rows``."""
    if seed > 1:
        monkeypatch.setattr(ingest, "BROADCAST_ROWS", 0)
    rnd = random.Random(seed)
    rows = [[(s, rnd.randrange(25), rnd.choice([None, *(f"c{i}" for i in range(20))])) for s in range(40)] for _ in range(2)]
    t, want = str(tmp_path / "t"), []
    for part in rows:
        batch = _batch(spark, part)
        old = spark.read.parquet(t) if want else None
        want = sorted(want + [(r.message, r.cursor) for r in ingest.ingest_rows(batch, old).collect()])
        counts = ingest.ingest_into(batch, t, None, "2024-01-31 00:00:00", ["j"])
        assert _stored(spark, t) == want and counts["j"][0] == 40


def test_limit_takes_the_first_rows_in_every_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "RANGE_ROWS", 5)
    batch = _batch(spark, [(i // 2 * 3, i, f"c{i}") for i in range(60)]).repartition(4)  # pairs share their place in order
    for limit in (0, 1, 7, 30, 59, 60, 61):
        t = str(tmp_path / f"t{limit}")
        assert ingest.ingest_into(batch, t, None, "2024-01-31 00:00:00", ["j"], limit=limit) == {"j": (60, min(limit, 60))}
        got = [] if limit == 0 else [int(m[1:]) // 2 for m, _ in _stored(spark, t)]
        assert sorted(got) == [i // 2 for i in range(60)][:limit]


def test_limit_is_not_taken_by_one_task(spark, tmp_path, monkeypatch):
    """No plan of a limited ingest has a limit over the whole batch, and no text or raw line is grouped."""
    plans = []
    land = ingest.land

    def note(df, path, *args):
        plans.append((path.rsplit("/", 1)[1], df._jdf.queryExecution().optimizedPlan().toString()))
        return land(df, path, *args)

    monkeypatch.setattr(ingest, "land", note)
    ingest.ingest_into(_batch(spark, [(i, i, None) for i in range(20)]), str(tmp_path / "t"), None, "2024-01-31 00:00:00", ["j"], limit=7)
    assert [n for n, _ in plans] == ["batch", "fresh", "order"]
    assert not any("Limit" in p for _, p in plans)
    assert not any("message" in line for line in dict(plans)["fresh"].splitlines() if "Aggregate" in line)


def test_journal_lines_are_read_as_json_twice(spark):
    lines = spark.createDataFrame([('{"__REALTIME_TIMESTAMP": "1", "MESSAGE": "m"}', 1), ("{", 2), ("[]", 3), (None, 4)], "value string, seq long")
    parsed = with_fingerprint(parsers.parse_journald(lines.repartition(2), keep=["seq"]))
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2
    assert [r.seq for r in parsed.collect()] == [1]


def test_stream_writes_few_files(spark, tmp_path):
    """A trigger's rows are written by day and time, its totals one file a day."""
    from timberline.streaming.ingest import start_ingest
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("".join(
        f'{{"__REALTIME_TIMESTAMP": "{(1704067200 + 3600 * (i % 72)) * 10**6 + i}", "__CURSOR": "c{i}", "_SYSTEMD_UNIT": "u{i % 9}", "MESSAGE": "m{i}"}}\n'
        for i in range(2000)))
    start_ingest(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), totals_table=str(tmp_path / "n")).awaitTermination()
    assert len(list((tmp_path / "n").rglob("*.parquet"))) == 3
    assert len(list((tmp_path / "t").rglob("*.parquet"))) <= 12  # 24 from the tasks of the shuffle
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2000
