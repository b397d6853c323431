"""Log search and value discovery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions import escape_like, severity_at_most
from timberline.operators.window import in_window
from timberline.params import Discover, LogQuery

QUERY_COLUMNS = ["id", "ts", "hostname", "source", "unit", "severity", "pid", "message"]


def log_filter(logs: DataFrame, q: LogQuery, as_of) -> DataFrame:
    """All predicates of QUERY_LOGS, conjunctive; absent parameters add nothing."""
    df = in_window(logs, as_of, q.since)
    preds = []
    sev = severity_at_most(F.col("severity"), q.min_severity)
    if sev is not None:
        preds.append(sev)
    for name in ("source", "unit", "hostname"):
        v = getattr(q, name)
        if v is not None:
            preds.append(F.col(name) == F.lit(v))
    if q.contains is not None:
        # A backslash is an ordinary character of the text, never an escape.
        text = escape_like(q.contains) if q.literal_contains else q.contains.replace("\\", "\\\\")
        # ILIKE keeps % and _ inside the text as wildcards unless literal.
        preds.append(F.col("message").ilike(f"%{text}%"))
    if preds:
        df = df.filter(reduce(lambda a, b: a & b, preds))
    return df


def query_logs(logs: DataFrame, q: LogQuery, as_of) -> DataFrame:
    """filtered, ordered (ts then id, D9) and limited log rows.

    ``orderBy(..).limit(n)`` plans as TakeOrderedAndProject: every partition
    keeps its own top ``n`` and only those reach the final merge.
    """
    df = log_filter(logs, q, as_of).select(*QUERY_COLUMNS)
    if q.order == "asc":
        keys = [F.col("ts").asc(), F.col("id").asc()]
    else:
        keys = [F.col("ts").desc(), F.col("id").desc()]
    return df.orderBy(*keys).limit(q.limit)


def discover(logs: DataFrame, d: Discover, as_of) -> DataFrame:
    """A1: value counts of one column in the window; NULL is its own group.

    Ordered by count desc, value asc (both NULLS LAST), top ``limit``. The
    aggregation is partial per partition, so a hot value costs one row per task.
    """
    col = d.column
    counts = (in_window(logs, as_of, d.since)
              .groupBy(F.col(col).alias("value"))
              .agg(F.count(F.lit(1)).alias("count")))
    return counts.orderBy(F.col("count").desc_nulls_last(),
                          F.col("value").asc_nulls_last()).limit(d.limit)


def fetch_logs_by_ids(logs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """rows of ``logs`` whose id is in ``ids`` (a semi join, ids deduplicated
    by the join itself; Catalyst broadcasts the id side when it is small)."""
    keys = ids.select(F.col(id_col).alias("_fetch_id"))
    return logs.join(keys, logs["id"] == keys["_fetch_id"], "left_semi")
