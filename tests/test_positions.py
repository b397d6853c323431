"""Lines by position: every line once, whatever grows, shrinks, appears or restarts."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from timberline.operators import ingest
from timberline.schema import LOGS
from timberline.sources import positions
from timberline.sources.registry import LogSource, ingest_all, read_all
from timberline.streaming.ingest import start_ingest
from timberline.streaming.sinks import read_table

NOON = dt.datetime(2024, 1, 10, 12, tzinfo=dt.timezone.utc)
AS_OF = "2024-01-10 13:00:00"


def line(cursor, seconds, message=None):
    return (f'{{"__REALTIME_TIMESTAMP": "{int(NOON.timestamp() + seconds) * 10**6}", "__CURSOR": "{cursor}", '
            f'"MESSAGE": "{message or cursor}", "PRIORITY": "6"}}\n')


def read(spark, start, end):
    return [(os.path.basename(r.file_path), r.value) for r in positions.read_between(spark, start, end).orderBy("file_path", "line_at").collect()]


def test_every_complete_line_once_at_any_split(spark, tmp_path, monkeypatch):
    lines = [f"line {i} " + "x" * (i * 37 % 300) for i in range(400)] + ["é日 🙂", "", "  ", "last\r"]
    path = tmp_path / "a.log"
    path.write_bytes("\n".join(lines).encode() + b"\nhalf a li")
    end = positions.ends(str(tmp_path))
    want = [x.removesuffix("\r") for x in lines if x.strip()]
    for split, block in ((64 << 20, 4 << 20), (1000, 333), (97, 50), (5000, 100)):
        monkeypatch.setattr(positions, "SPLIT_BYTES", split)
        monkeypatch.setattr(positions, "BLOCK_BYTES", block)
        got = [v.as_py() for part in positions._ranges({}, end) for b in positions._lines(part) for v in b.column(3)]
        assert [x for x in got if x.strip()] == want
    assert [v for _, v in read(spark, {}, end)] == want
    batch = next(positions._lines(positions._ranges({}, end)[0]))
    data = path.read_bytes()
    assert all(data[a:b].decode().rstrip("\r\n") == v for a, b, v in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True))


def test_growing_replaced_and_new_files(spark, tmp_path):
    a, b = tmp_path / "a.log", tmp_path / "sub" / "b.log"
    a.write_text("one\ntwo\nthr")
    first = positions.ends(str(tmp_path))
    assert read(spark, {}, first) == [("a.log", "one"), ("a.log", "two")]
    with a.open("a") as f:
        f.write("ee\n")
    b.parent.mkdir()
    b.write_text("new\n")
    (tmp_path / "c.txt").write_text("no log\n")
    second = positions.ends(str(tmp_path), first)
    assert read(spark, first, second) == [("a.log", "three"), ("b.log", "new")]
    a.write_text("again\n")  # replaced by a shorter file
    third = {**second, **positions.ends(str(tmp_path), second)}
    assert read(spark, second, third) == [("a.log", "again")]
    assert read(spark, third, {**third, **positions.ends(str(tmp_path), third)}) == []
    with pytest.raises(FileNotFoundError):
        positions.ends(str(tmp_path / "missing"))


def _source(path, **config):
    return [LogSource("j", "journald", config={"paths": [str(path)], "by_position": True, **config})]


def _stored(spark, table):
    return sorted(r.cursor for r in spark.read.parquet(table).collect())


def test_late_rows_after_the_cursor_are_stored(spark, tmp_path):
    logs, table, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "s")
    logs.mkdir()
    (logs / "j.log").write_text(line("c1", 100) + line("c2", 200))
    assert ingest_all(spark, _source(logs), table, state, AS_OF)[0] == {"j": (2, 2)}
    with (logs / "j.log").open("a") as f:
        f.write(line("c3", 150) + line("c4", -90000) + line("c5", 300))  # a clock step, a merged journal
    counts, errors = ingest_all(spark, _source(logs), table, state, AS_OF)
    assert counts == {"j": (3, 3)} and not errors  # nothing read again
    assert _stored(spark, table) == ["c1", "c2", "c3", "c4", "c5"]
    assert ingest_all(spark, _source(logs), table, state, AS_OF)[0] == {"j": (0, 0)}


@pytest.mark.parametrize("by_position", [True, False])
def test_limited_runs_store_everything(spark, tmp_path, by_position):
    logs, table, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "s")
    logs.mkdir()
    want = []
    for name in ("a", "b"):
        rows = [(f"{name}{i:02d}", 100 - i) for i in range(25)]  # newest first: time is not the order
        (logs / f"{name}.log").write_text("no json\n" + "".join(line(*r) for r in rows))
        want += [c for c, _ in rows]
    if by_position:
        sources = _source(logs)
    else:
        sources = [LogSource("j", "journald", config={"paths": [str(logs)]})]
    seen = []
    for _ in range(4):
        counts, _ = ingest_all(spark, sources, table, state, AS_OF, limit=20)
        seen.append(counts["j"][1])
    assert seen == [20, 20, 10, 0] and _stored(spark, table) == sorted(want)


def test_resume_by_input_order_not_by_time(spark, tmp_path):
    table, state = str(tmp_path / "t"), str(tmp_path / "s")

    def frame(rows):
        return spark.createDataFrame([(line(c, t).strip(), i) for i, (c, t) in enumerate(rows)], "value string, seq long")

    rows = [("c1", 100), ("c2", 200)]
    for more in ([], [("c3", 150), ("c4", 300)]):
        rows = rows + more
        parsed, _ = read_all(spark, [LogSource("j", "journald", config={"lines": frame(rows)})], AS_OF, state=ingest.read_state(spark, state))
        ingest.ingest_into(parsed, table, state, AS_OF, ["j"])
    assert _stored(spark, table) == ["c1", "c2", "c3", "c4"]


def test_a_crash_before_the_state_repeats_nothing(spark, tmp_path, monkeypatch):
    logs, table, state = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "s")
    logs.mkdir()
    (logs / "j.log").write_text(line("c1", 1) + line("c2", 2))
    with monkeypatch.context() as m:
        m.setattr(ingest, "update_state", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ingest_all(spark, _source(logs), table, state, AS_OF)
    assert ingest_all(spark, _source(logs), table, state, AS_OF)[0] == {"j": (2, 0)}
    assert _stored(spark, table) == ["c1", "c2"]


def test_missing_folder_does_not_stop_other_sources(spark, tmp_path):
    logs = tmp_path / "in"
    logs.mkdir()
    (logs / "j.log").write_text(line("c1", 1))
    broken = LogSource("gone", "journald", config={"paths": [str(tmp_path / "none")], "by_position": True})
    counts, errors = ingest_all(spark, [broken, *_source(logs)], str(tmp_path / "t"), str(tmp_path / "s"), AS_OF)
    assert counts == {"j": (1, 1)} and list(errors) == ["gone"]


def test_stream_resumes_by_position(spark, tmp_path):
    logs, table, check = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    logs.mkdir()
    (logs / "j.log").write_text(line("c1", 100) + line("c2", 200) + line("c3", 300)[:20])

    def run():
        start_ingest(spark, str(logs), table, check, by_position=True, patterns=["*.log"]).awaitTermination()
        return [r.cursor for r in read_table(spark, table, LOGS).orderBy("cursor").collect()]

    assert run() == ["c1", "c2"]
    with (logs / "j.log").open("a") as f:
        f.write(line("c3", 300)[20:] + line("c4", 50))
    (logs / "k.log").write_text(line("k1", -80000))
    assert run() == ["c1", "c2", "c3", "c4", "k1"]
    assert run() == ["c1", "c2", "c3", "c4", "k1"]
    epochs = spark.read.parquet(table).groupBy("epoch").agg(F.count(F.lit(1)).alias("n")).orderBy("epoch").collect()
    assert [r.n for r in epochs] == [2, 3]  # the second run read new lines alone
