"""Content fingerprint and numeric id of a log row.

The fingerprint is the SHA-256 hex digest of
``ts|hostname|unit|severity|pid|message`` where every value is rendered the
way Python's ``str()`` renders it: NULL is ``None`` and a timestamp is
``YYYY-MM-DD HH:MM:SS`` with ``.ffffff`` only when the microseconds are not
zero. The numeric id is the first 8 digest bytes read as a big-endian signed
64-bit integer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def py_ts_str(ts: Column) -> Column:
    """Python ``str(datetime)`` of a TIMESTAMP_NTZ column (NULL stays NULL)."""
    return F.when(F.date_format(ts, "SSSSSS") == F.lit("000000"),
                  F.date_format(ts, "yyyy-MM-dd HH:mm:ss")) \
            .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def py_str(c: Column) -> Column:
    """Python ``str()`` of a string/integer column: NULL becomes ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def fingerprint(ts: Column, hostname: Column, unit: Column, severity: Column,
                pid: Column, message: Column) -> Column:
    parts = [F.coalesce(py_ts_str(ts), F.lit("None"))] + [
        py_str(c) for c in (hostname, unit, severity, pid, message)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def id_from_fingerprint(fp: Column) -> Column:
    """First 16 hex digits as a signed 64-bit integer (two's complement)."""
    return F.conv(F.substring(fp, 1, 16), 16, -10).cast("long")


def with_fingerprint(df: DataFrame, overwrite_id: bool = True) -> DataFrame:
    """Attach ``fingerprint`` (and ``id`` from it) to a parsed log DataFrame."""
    fp = fingerprint(F.col("ts"), F.col("hostname"), F.col("unit"), F.col("severity"),
                     F.col("pid"), F.col("message"))
    out = df.withColumn("fingerprint", fp)
    if overwrite_id or "id" not in df.columns:
        out = out.withColumn("id", id_from_fingerprint(F.col("fingerprint")))
    return out
