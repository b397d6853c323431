"""Versioned tables, the cursor key table and compaction: whole after crashes and races."""

import datetime as dt
import re
import threading

import pytest
from pyspark.sql import functions as F

from timberline import versions
from timberline.operators import cursor_keys, ingest
from timberline.operators.cursor_keys import CursorKeys
from timberline.schema import INGEST_STATE, LOGS
from timberline.streaming import sinks
from timberline.streaming.ingest import start_ingest

NOON = dt.datetime(2024, 1, 10, 12)
PARSED = "ts timestamp_ntz, hostname string, source string, unit string, severity string, pid long, message string, cursor string, source_name string, seq long"


def rows(spark, items):
    return spark.createDataFrame([(NOON + dt.timedelta(days=d), "h", "journald", "u", "info", 1, m, c, "j", i)
                                  for i, (d, m, c) in enumerate(items)], PARSED)


# --- versions


def test_two_writers_lose_no_update(spark, tmp_path):
    path = str(tmp_path / "state")
    failed = []

    def add(name):
        def merge(prior):
            new = spark.createDataFrame([(name, name, NOON)], INGEST_STATE)
            return new if prior is None else prior.unionByName(new)
        try:
            ingest.update_state(spark, path, merge)
        except Exception as exc:  # noqa: BLE001
            failed.append(exc)

    threads = [threading.Thread(target=add, args=(f"w{i}",)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and sorted(r.source for r in ingest.read_state(spark, path).collect()) == ["w0", "w1", "w2", "w3"]


def test_an_existing_version_is_refused(spark, tmp_path):
    base = str(tmp_path / "state")
    state = spark.createDataFrame([("j", "one", NOON)], INGEST_STATE)

    def make(newest):
        state.write.parquet(f"{base}/v-000000000001")  # a writer that took no claim
        return spark.createDataFrame([("j", "two", NOON)], INGEST_STATE)

    with pytest.raises(OSError):
        versions.publish(spark, base, make)
    assert ingest.read_state(spark, base).first().cursor == "one"
    ingest.write_state(spark.createDataFrame([("j", "three", NOON)], INGEST_STATE), base)
    assert ingest.read_state(spark, base).first().cursor == "three"


def test_a_left_claim_holds_others_until_it_is_stale(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "state")
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "_claim-000000000001").touch()
    state = spark.createDataFrame([("j", "one", NOON)], INGEST_STATE)
    with pytest.raises(TimeoutError):
        versions.publish(spark, base, lambda newest: state, wait=0.3)
    monkeypatch.setattr(versions, "STALE_SECONDS", 0.0)
    assert versions.publish(spark, base, lambda newest: state).endswith("v-000000000002")


# --- cursor keys


def test_filters_have_no_false_negative_and_few_false_positives(spark, tmp_path):
    keys = CursorKeys(spark, str(tmp_path / "k"), buckets=8)
    old = spark.range(20_000).select(F.concat(F.lit("c"), "id").alias("cursor"))
    old.write.parquet(str(tmp_path / "t"))
    assert keys.sync(spark.read.parquet(str(tmp_path / "t"))) > 0 and keys.sync(spark.read.parquet(str(tmp_path / "t"))) == 0
    batch = spark.range(19_000, 40_000).select(F.concat(F.lit("c"), "id").alias("cursor"))
    assert keys.held(batch).count() == 1000
    assert 1000 <= keys.candidates(batch).count() < 1000 + 20_000 * 0.02
    keys.merge()
    assert keys.held(batch).count() == 1000 and keys.sync(spark.read.parquet(str(tmp_path / "t"))) == 0


def test_only_the_buckets_of_candidates_are_read(spark, tmp_path):
    keys = CursorKeys(spark, str(tmp_path / "k"), buckets=16)
    spark.range(2000).select(F.concat(F.lit("c"), "id").alias("cursor")).write.parquet(str(tmp_path / "t"))
    keys.sync(spark.read.parquet(str(tmp_path / "t")))
    found = keys.held(spark.createDataFrame([("c7",), (None,)], "cursor string"))
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().executedPlan().toString()
    buckets = re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN \(\d+(,\d+)*\)|= \d+)", plan)
    assert buckets and buckets.group(1).count(",") <= 1, plan
    assert [r.cursor for r in found.collect()] == ["c7"]


def test_ingest_with_keys_finds_conflicts_of_other_days(spark, tmp_path):
    table, keys = str(tmp_path / "logs"), CursorKeys(spark, str(tmp_path / "keys"), buckets=4)
    first = [(0, "a", "A"), (1, "b", "B"), (2, "n", None)]
    assert ingest.ingest_into(rows(spark, first), table, None, NOON, ["j"], keys=keys) == {"j": (3, 3)}
    second = [(9, "x", "A"), (9, "y", "Y"), (2, "n", None), (9, "z", None), (9, "y2", "Y")]
    assert ingest.ingest_into(rows(spark, second), table, None, NOON, ["j"], keys=keys) == {"j": (5, 2)}
    ingest.append(ingest.prepare_batch(rows(spark, [(3, "other writer", "W")])), table)
    assert ingest.ingest_into(rows(spark, [(9, "late", "W")]), table, None, NOON, ["j"], keys=keys) == {"j": (1, 0)}
    assert sorted(r.message for r in spark.read.parquet(table).collect()) == ["a", "b", "n", "other writer", "y", "z"]


def test_a_crash_while_keys_are_added_is_made_good(spark, tmp_path, monkeypatch):
    keys = CursorKeys(spark, str(tmp_path / "k"), buckets=2)
    spark.createDataFrame([("A",), ("B",)], "cursor string").write.parquet(str(tmp_path / "t"))
    with monkeypatch.context() as m:
        m.setattr(CursorKeys, "cover", lambda self, files: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            keys.sync(spark.read.parquet(str(tmp_path / "t")))
    assert keys.sync(spark.read.parquet(str(tmp_path / "t"))) > 0
    assert keys.held(spark.createDataFrame([("B",), ("C",)], "cursor string")).count() == 1


def journal(items):
    base = int(NOON.replace(tzinfo=dt.timezone.utc).timestamp())
    return "".join(f'{{"__REALTIME_TIMESTAMP": "{(base + d * 86400) * 10**6}", "__CURSOR": "{c}", "MESSAGE": "{m}"}}\n' for d, m, c in items)


def test_stream_with_keys_lists_its_own_days(spark, tmp_path, monkeypatch):
    landing, table, check = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    landing.mkdir()
    keys = CursorKeys(spark, str(tmp_path / "keys"), buckets=4)
    listed = []
    old = sinks._folders
    monkeypatch.setattr(sinks, "_folders", lambda s, base, days: listed.append(days) or old(s, base, days))
    monkeypatch.setattr(CursorKeys, "sync", lambda *a: pytest.fail("the table was listed"))
    for n, items in enumerate(([(0, "a", "A"), (1, "b", "B")], [(5, "x", "A"), (5, "y", "Y"), (5, "y", "Y")], [(5, "y", "Y2"), (6, "v", "B"), (6, "w", "W")])):
        (landing / f"{n}.log").write_text(journal(items))
        start_ingest(spark, str(landing), table, check, keys=keys, dedup_window="1 second").awaitTermination()
    assert sorted((r.message, r.cursor) for r in sinks.read_table(spark, table, LOGS).collect()) == [("a", "A"), ("b", "B"), ("w", "W"), ("y", "Y")]
    days = [sorted(str(d) for d in ds) for ds in listed[:-1] if ds]
    assert days == [["2024-01-10", "2024-01-11"], ["2024-01-15"], ["2024-01-16"]]
    assert cursor_keys.BUCKETS  # default kept


# --- compaction


def epochs(spark, table, count, start=0):
    for e in range(start, start + count):
        items = [(d, f"m{e}-{d}", f"c{e}-{d}") for d in range(3)]
        sinks.write_epoch(ingest.to_table_rows(ingest.prepare_batch(rows(spark, items))), table, e, partition_by=["day"])


def contents(spark, table):
    return sorted((r.message, r.cursor, r.ts, r.id) for r in sinks.read_table(spark, table, LOGS).collect())


def test_compaction_keeps_rows_and_lowers_files(spark, tmp_path):
    table = str(tmp_path / "t")
    epochs(spark, table, 5)
    want, files = contents(spark, table), len(spark.read.parquet(table).inputFiles())
    assert sinks.compact(spark, table) == 3 and contents(spark, table) == want
    assert sinks.compact(spark, table) == 3  # nothing new to do
    assert sinks.vacuum(spark, table) == 12 and contents(spark, table) == want
    assert len(sinks.live(spark, table).inputFiles()) < files
    epochs(spark, table, 1, start=4)  # the newest epoch is replayed
    assert contents(spark, table) == want
    other = sinks.read_other_epochs(spark, table, 4)
    assert other.count() == 12 and sinks.read_other_epochs(spark, table, 4, [dt.date(2024, 1, 11)]).count() == 4


def test_many_compactions_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FAN_IN", 3)
    table = str(tmp_path / "t")
    for n in range(4):
        epochs(spark, table, 2, start=2 * n)
        sinks.compact(spark, table)
        assert len(sinks.manifest(spark, table)[1]) < 3
    want = contents(spark, table)
    sinks.vacuum(spark, table)
    assert contents(spark, table) == want and len(want) == 24


@pytest.mark.parametrize("step", ["rows", "manifest"])
def test_a_crash_between_steps_changes_no_row(spark, tmp_path, monkeypatch, step):
    table = str(tmp_path / "t")
    epochs(spark, table, 4)
    want = contents(spark, table)
    with monkeypatch.context() as m:
        if step == "rows":  # the compacted rows are written, the manifest isn't
            m.setattr(spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        else:  # the manifest is written, its rename isn't done
            m.setattr(versions, "_names", lambda s, b, p, real=versions._names: ["_claim-999999999999"] if p == "_claim-" and real(s, b, "_next-") else real(s, b, p))
        with pytest.raises(OSError):
            sinks.compact(spark, table)
    assert contents(spark, table) == want
    assert sinks.compact(spark, table) == 2 and contents(spark, table) == want
    sinks.vacuum(spark, table)
    assert contents(spark, table) == want


def test_tables_without_days_and_empty_tables(spark, tmp_path):
    table = str(tmp_path / "t")
    assert sinks.compact(spark, table) == -1 and sinks.vacuum(spark, table) == 0 and sinks.live(spark, table) is None
    for e in range(3):
        sinks.write_epoch(spark.createDataFrame([(e,)], "x int"), table, e)
    assert sinks.compact(spark, table) == 1
    sinks.vacuum(spark, table)
    assert sorted(r.x for r in sinks.read_table(spark, table).collect()) == [0, 1, 2]
