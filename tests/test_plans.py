"""The physical-plan properties the design relies on at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from timberline import fixtures as fx
from timberline.operators import audit, ingest

SF = "/root/testdata/sf0.001"
NO_PAIR_JOINS = ["log_query_contains", "discover_unit", "anomalies_all", "log_summary", "threshold_alerts",
                 "service_down", "vector_topk_filtered", "search_expand", "audit_rollup", "ingest_dedup",
                 "index_candidates", "chat_stats", "health_summary"]


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()  # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_filter_reaches_the_scan_and_columns_are_pruned(spark):
    plan = _plan(E.queries()["discover_unit"](spark, SF))
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "GreaterThanOrEqual(ts," in scan
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>", scan)


@pytest.mark.parametrize("key", NO_PAIR_JOINS)
def test_no_pair_producing_joins(spark, key):
    plan = _plan(E.queries()[key](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_dedup_aggregates_partially_before_the_shuffle(spark):
    batch = ingest.prepare_batch(fx.ingest_batch(spark, SF))
    plan = _plan(ingest.dedup_batch(batch))
    assert re.search(r"SortAggregate\(key=\[fingerprint#\d+\], functions=\[partial_min_by", plan)


def test_scan_samples_use_a_partial_group_limit(spark):
    lines = fx.scan_lines(spark, SF).withColumnRenamed("is_error", "rc") \
        .withColumn("scan_time", F.col("scan_date").cast("timestamp_ntz"))
    plan = _plan(audit.scan_results(lines))
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_table_conflict_check_prunes_partitions(spark, tmp_path):
    table = str(tmp_path / "logs")
    ingest.append(ingest.prepare_batch(fx.stored_rows(spark, SF)), table)
    batch = ingest.prepare_batch(fx.logs(spark, SF).withColumn("seq", F.col("id")))
    plan = _plan(ingest.new_rows(batch, spark.read.parquet(table)))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and str(tmp_path) in line or "prun" in line]
    # Content is checked against the batch's days; cursors against the one column of all days.
    by_content = next(s for s in scans if "ReadSchema: struct<fingerprint:string>" in s)
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ IN", by_content), by_content
    assert any("ReadSchema: struct<cursor:string>" in s for s in scans) and not any("struct<id" in s and "prun" in s for s in scans)


def test_all_anomaly_rules_read_the_window_once(spark):
    plan = _plan(E.queries()["anomalies_all"](spark, SF)).split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and "BatchEvalPython" not in plan


def test_default_embedding_runs_without_python(spark):
    assert "ArrowEvalPython" not in _plan(E.queries()["index_build"](spark, SF))
