"""Rows are not lost, and failures are not read as empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from timberline.operators import audit, ingest, query, vectors
from timberline.params import LogQuery, SearchParams
from timberline.schema import INGEST_STATE
from timberline.session import stored
from timberline.sources import parsers
from timberline.sources.files import list_files, read_lines, skipped_files
from timberline.sources.registry import LogSource, read_all
from timberline.streaming.sinks import read_table

NOON = dt.datetime(2024, 1, 10, 12)
PARSED = "ts timestamp_ntz, hostname string, source string, unit string, severity string, pid long, message string, cursor string, source_name string, seq long"


def _rows(spark, rows):
    return spark.createDataFrame([(ts, "h", "journald", "u", "info", 1, m, c, "j", i) for i, (ts, m, c) in enumerate(rows)], PARSED)


def _journal(spark, n, start=0):
    line = '{{"__REALTIME_TIMESTAMP": "{}", "__CURSOR": "c{:05d}", "MESSAGE": "m{}", "PRIORITY": "6"}}'
    base = int(NOON.replace(tzinfo=dt.timezone.utc).timestamp()) * 10**6
    return spark.createDataFrame([(line.format(base + i * 10**6, i, i), i) for i in range(start, n)], "value string, seq long")


def test_resume_after_cursor_beyond_the_look_back(spark, tmp_path):
    table, state = str(tmp_path / "logs"), str(tmp_path / "state")
    for lines, since, limit in ((_journal(spark, 1500), 400 * 86400, None), (_journal(spark, 3200), 1, 1200), (_journal(spark, 3200), 1, None)):
        parsed, errors = read_all(spark, [LogSource("j", "journald", config={"lines": lines})], NOON + dt.timedelta(days=9),
                                  since_seconds=since, limit=limit, state=ingest.read_state(spark, state))
        assert not errors
        ingest.ingest_into(parsed, table, state, NOON, ["j"])
    assert spark.read.parquet(table).count() == 3200
    assert ingest.read_state(spark, state).first()["cursor"] == "c03199"


def test_unknown_cursor_reads_everything(spark):
    state = spark.createDataFrame([("j", "rotated-away", NOON)], INGEST_STATE)
    parsed, _ = read_all(spark, [LogSource("j", "journald", config={"lines": _journal(spark, 20)})], NOON, since_seconds=1, state=state)
    assert parsed.count() == 20


def test_defaults_do_not_cut(spark):
    parsed, _ = read_all(spark, [LogSource("j", "journald", config={"lines": _journal(spark, 3000)})], NOON + dt.timedelta(seconds=3000))
    assert parsed.count() == 3000


def test_large_files_are_read_and_skipped_ones_listed(spark, tmp_path):
    (tmp_path / "big.log").write_bytes(b"x" * 999 + b"\n" + (b"y" * 999 + b"\n") * 106_000)
    (tmp_path / "small.log").write_text("one\n")
    assert read_lines(spark, str(tmp_path)).count() == 106_002
    assert list_files(spark, str(tmp_path)).count() == 2
    assert [r.file_path.rsplit("/", 1)[1] for r in skipped_files(spark, str(tmp_path), max_size_mb=100).collect()] == ["big.log"]
    assert read_lines(spark, str(tmp_path), max_size_mb=100).count() == 1


def test_cursor_stored_on_another_day_is_a_conflict(spark, tmp_path):
    table = str(tmp_path / "logs")
    ingest.ingest_into(_rows(spark, [(NOON, "a", "CUR"), (NOON, "n", None)]), table, None, NOON, ["j"])
    counts = ingest.ingest_into(_rows(spark, [(NOON + dt.timedelta(days=8), "b", "CUR"), (NOON + dt.timedelta(days=8), "c", None),
                                              (NOON, "n", None)]), table, None, NOON, ["j"])
    assert counts == {"j": (3, 1)}
    assert sorted(r.message for r in spark.read.parquet(table).collect()) == ["a", "c", "n"]


def test_a_large_day_is_several_files(spark, tmp_path):
    table = str(tmp_path / "logs")
    rows = spark.range(40_000).select(*[c.alias(n) for n, c in {
        "ts": (F.lit(NOON) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 30_000).cast("decimal(18,6)"))).cast("timestamp_ntz"),
        "hostname": F.lit("h"), "source": F.lit("s"), "unit": F.lit("u"), "severity": F.lit("info"), "pid": F.lit(1),
        "message": F.md5(F.col("id").cast("string")), "cursor": F.lit(None).cast("string"), "source_name": F.lit("j"), "seq": F.col("id")}.items()])
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        assert ingest.ingest_into(rows, table, None, NOON, ["j"]) == {"j": (40_000, 40_000)}
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes") if old is None else spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(spark.read.parquet(table).inputFiles()) > 1


def test_corrupt_table_raises_and_missing_is_empty(spark, tmp_path):
    assert stored(spark, str(tmp_path / "none")) is None
    assert read_table(spark, str(tmp_path / "none")) is None
    bad = tmp_path / "logs" / "day=2024-01-10"
    bad.mkdir(parents=True)
    (bad / "part-0.parquet").write_bytes(b"this is not parquet")
    with pytest.raises(Exception):
        ingest.ingest_into(_rows(spark, [(NOON, "a", "x")]), str(tmp_path / "logs"), None, NOON, ["j"])


def test_failed_state_write_keeps_the_old_cursors(spark, tmp_path):
    path = str(tmp_path / "state")
    for c in ("one", "two", "three"):
        ingest.write_state(spark.createDataFrame([("j", c, NOON)], INGEST_STATE), path)
    broken = spark.createDataFrame([("j", "four", NOON)], INGEST_STATE).withColumn("cursor", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        ingest.write_state(broken, path)
    assert ingest.read_state(spark, path).first()["cursor"] == "three"


def test_backslash_is_an_ordinary_character(spark):
    logs = spark.createDataFrame([(1, NOON, "h", "s", "u", "info", 1, m) for m in ("C:\\temp\\x", "C:temp", "50% off")],
                                 "id long, ts timestamp_ntz, hostname string, source string, unit string, severity string, pid long, message string")
    for text, n in (("C:\\temp", 1), ("temp\\", 1), ("0%o", 1), ("c:", 2)):
        q = LogQuery(since=86400, contains=text)
        assert query.log_filter(logs, q, NOON + dt.timedelta(hours=1)).count() == n, text


def test_journald_lines_with_more_after_the_object_are_dropped(spark):
    good = '{"__REALTIME_TIMESTAMP": "1704880800000000", "MESSAGE": "m"}'
    lines = spark.createDataFrame([(x,) for x in (good, good + " junk", good + good, good + "] x", good + "} x}", good + "," + good, good + "  ")], "value string")
    assert parsers.parse_journald(lines).count() == 2


def test_vectors_without_a_distance_are_no_hits(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0] * 5), (3, [0.0, None]), (4, [0.5, 0.0])]
    table = spark.createDataFrame([(i, v, NOON, "s", "u", "info") for i, v in rows],
                                  "log_id long, embedding array<float>, ts timestamp_ntz, source string, unit string, severity string")
    assert [r.log_id for r in vectors.search(table, [1.0, 0.0], SearchParams(), NOON).orderBy("rank").collect()] == [1, 4]


def test_long_finding_lists_are_whole(spark):
    lines = spark.createDataFrame([(NOON, "h", tool, i, f"changed: /etc/f{i} Warning:", 1) for tool in ("aide", "rkhunter") for i in range(40)],
                                  "scan_time timestamp_ntz, host string, tool string, line_no long, line string, rc int")
    assert {r.tool: r["count"] for r in audit.findings(lines).groupBy("tool").count().collect()} == {"aide": 40, "rkhunter": 40}
    records = {r.tool: r.details for r in audit.scan_results(lines).collect()}
    assert len(records["aide"].split("\n")) == 40 and len(records["rkhunter"].split("\n")) == 10


def test_prompt_needs_a_template(spark):
    context = spark.createDataFrame([("lines",)], "context string")
    assert vectors.rag_prompt(context, "why?", "<{context}|{question}>").first()[0] == "<lines|why?>"


def test_a_source_that_fails_while_read_does_not_stop_the_others(spark, tmp_path):
    import gzip
    from timberline.sources.registry import LogSource, ingest_all
    line = "<14>Jan  5 10:00:00 h cron[1]: ran"
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.mkdir()
    bad.mkdir()
    (good / "a.log").write_text(line + "\n")
    whole = gzip.compress("\n".join(f"{line} {i}" for i in range(5000)).encode())
    (bad / "b.log.gz").write_bytes(whole[:len(whole) // 2])
    table = str(tmp_path / "logs")
    sources = [LogSource("bad", "file", config={"paths": str(bad), "patterns": ["*.gz"], "year": 2024}),
               LogSource("good", "file", config={"paths": str(good), "year": 2024}),
               LogSource("unknown", "no-such-type")]
    counts, errors = ingest_all(spark, sources, table, str(tmp_path / "state"), "2024-01-06 00:00:00",
                                since_seconds=7 * 86400)
    assert counts == {"good": (1, 1)} and sorted(errors) == ["bad", "unknown"]
    assert [r.message for r in spark.read.parquet(table).collect()] == ["ran"]
