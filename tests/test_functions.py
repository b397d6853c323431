"""Scalar helpers against Python's own behaviour."""

import datetime as dt
import fnmatch
import re

from pyspark.sql import functions as F

from timberline.functions import (escape_like, glob_to_regex, html_escape, percent, priority_to_severity,
                                  py_ts_str, severity_rank, thousands, unit_glob_to_regex)


def test_glob_to_regex_matches_fnmatch():
    names = ["host0", "host12", "h7", "web-1", "a[b", "x.y", "cache", "c?x", "db_2"]
    pats = ["host?", "host*", "h*7", "web-[0-9]", "[!h]*", "x.y", "c?x", "*[_-]*", "a[b"]
    for p in pats:
        rx = re.compile(glob_to_regex(p).replace("(?s)", ""), re.S)
        for n in names:
            assert bool(rx.match(n)) == fnmatch.fnmatchcase(n, p), (p, n)


def test_unit_glob_only_star_is_special():
    rx = re.compile(unit_glob_to_regex("systemd-*.serv?ce"))
    assert rx.match("systemd-*.serv?ce") and rx.match("systemd-x.serv?ce")
    assert not rx.match("systemd-x.service")


def test_like_escape_and_text_helpers(spark):
    df = spark.createDataFrame([("50% off_now", dt.datetime(2024, 1, 1, 0, 0, 7), dt.datetime(2024, 1, 1, 0, 0, 7, 180000))],
                               "m string, t0 timestamp_ntz, t1 timestamp_ntz")
    r = df.select(
        F.col("m").like(f"%{escape_like('% off_')}%").alias("lit"),
        F.col("m").like("%5_\\%%").alias("wild"),
        py_ts_str(F.col("t0")).alias("s0"), py_ts_str(F.col("t1")).alias("s1"),
        percent(F.lit(12), F.lit(42)).alias("p"), percent(F.lit(0), F.lit(0)).alias("p0"),
        thousands(F.lit(1234567)).alias("th"), html_escape(F.lit("<a href='x'>&</a>")).alias("h")).first()
    assert r.lit and r.wild
    assert (r.s0, r.s1) == (str(dt.datetime(2024, 1, 1, 0, 0, 7)), str(dt.datetime(2024, 1, 1, 0, 0, 7, 180000)))
    assert (r.p, r.p0, r.th) == (28.57, 0.0, "1,234,567")
    assert r.h == "&lt;a href=&#x27;x&#x27;&gt;&amp;&lt;/a&gt;"


def test_priority_and_rank(spark):
    df = spark.createDataFrame([("0",), ("4",), ("7",), ("9",), (None,)], "p string")
    out = df.select(priority_to_severity(F.col("p")).alias("s")).collect()
    assert [r.s for r in out] == ["emerg", "warning", "debug", "9", None]
    ranks = spark.createDataFrame([("emerg",), ("debug",), ("odd",), (None,)], "s string") \
        .select(severity_rank(F.col("s")).alias("r")).collect()
    assert [r.r for r in ranks] == [0, 7, 99, 99]
