"""Text search by trigram filters: the rows of the full scan, without the files that cannot match."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from timberline.operators import query, trigrams
from timberline.params import LogQuery

NOON = dt.datetime(2024, 1, 10, 12)
AS_OF = "2024-01-20 00:00:00"
TEXTS = ["Disk full on /dev/sda1", "100% done_now", "a\\b path", "Kelvin K sign", "É accent", None, "", "ab", "xy", "needle IN the hay", "İstanbul"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("trigrams")
    rows = [(i, NOON + dt.timedelta(days=i % 5), "h", "s", "u", "info", 1, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, NOON + dt.timedelta(days=i % 5), "h", "s", "u", "info", 1, f"filler number {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, hostname string, source string, unit string, severity string, pid int, message string")
    df.withColumn("day", F.to_date("ts")).repartition(20, "id").write.partitionBy("day").parquet(f"{base}/logs")
    assert trigrams.build(spark, f"{base}/logs", f"{base}/index") > 20 and trigrams.build(spark, f"{base}/logs", f"{base}/index") == 0
    return str(base), df


@pytest.mark.parametrize("text", ["disk FULL", "100%", "100% done_NOW", "done_now", "a\\b", "kelvin k", "k sign", "é acc", "acc", "ab", "nee%hay", "filler", "none such", "istanbul", "i̇sta", "%", "x_", "number 3"])
@pytest.mark.parametrize("literal", [False, True])
def test_same_rows_as_the_full_scan(spark, table, text, literal):
    base, df = table
    q = LogQuery(since=30 * 86400, contains=text, literal_contains=literal, limit=1000)
    found = trigrams.search(spark, f"{base}/logs", f"{base}/index", q, AS_OF)
    assert [r.id for r in found.collect()] == [r.id for r in query.query_logs(df, q, AS_OF).collect()]


def test_files_are_skipped(spark, table):
    base, _ = table
    every = len(spark.read.parquet(f"{base}/logs").inputFiles())
    q = LogQuery(since=30 * 86400, contains="needle in", limit=10)
    found = trigrams.search(spark, f"{base}/logs", f"{base}/index", q, AS_OF)
    assert len(found.inputFiles()) == 1 < every and found.count() == 1
    assert trigrams.search(spark, f"{base}/logs", f"{base}/index", LogQuery(since=30 * 86400, contains="zzzqqq"), AS_OF).count() == 0


def test_new_files_are_found_before_they_are_covered(spark, table, tmp_path):
    base, df = table
    df.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(f"{tmp_path}/logs")
    q = LogQuery(since=30 * 86400, contains="brand new", limit=10)
    assert trigrams.search(spark, f"{tmp_path}/logs", f"{tmp_path}/index", q, AS_OF).count() == 0
    trigrams.build(spark, f"{tmp_path}/logs", f"{tmp_path}/index")
    df.limit(1).withColumn("message", F.lit("a Brand New line")).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(f"{tmp_path}/logs")
    assert trigrams.search(spark, f"{tmp_path}/logs", f"{tmp_path}/index", q, AS_OF).count() == 1
