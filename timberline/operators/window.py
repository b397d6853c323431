"""The trailing time window every operator applies (F2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.params import as_timestamp

# Name of the optional date partition column of stored tables. When present the
# window also prunes partitions: Catalyst does not derive a predicate on a
# partition column from one on ``ts``.
PARTITION_COLUMN = "day"


def since_start(as_of, since_seconds: int) -> dt.datetime:
    return as_timestamp(as_of) - dt.timedelta(seconds=since_seconds)


def ts_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal (driver tables are read as timestamp_ntz)."""
    return F.lit(as_timestamp(value)).cast("timestamp_ntz")


def in_window(df: DataFrame, as_of, since_seconds: int | None, ts_col: str = "ts") -> DataFrame:
    """Rows with ``ts >= as_of - since`` (lower bound only, like the reference)."""
    if since_seconds is None:
        return df
    start = since_start(as_of, since_seconds)
    out = df.filter(F.col(ts_col) >= ts_lit(start))
    if PARTITION_COLUMN in df.columns:
        out = out.filter(F.col(PARTITION_COLUMN) >= F.lit(start.date()))
    return out
