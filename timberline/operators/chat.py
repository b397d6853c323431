"""Chat history and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.window import since_start, ts_lit

HISTORY_LIMIT = 50


def chat_history(chat: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """the newest ``limit`` messages, newest first (top-k, id breaks ties)."""
    return chat.select("id", "timestamp", "role", "content", "session_id") \
               .orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(limit)


def chat_stats(chat: DataFrame, as_of) -> DataFrame:
    """Total messages, messages per role (``role: n`` sorted by role) and
    messages of the last hour before ``as_of``. Two partial aggregations folded
    into one row without a join."""
    recent = F.col("timestamp") >= ts_lit(since_start(as_of, 3600))
    totals = chat.agg(F.count(F.lit(1)).alias("total_messages"),
                      F.count_if(recent).alias("recent_messages_1h"))
    by_role = chat.groupBy("role").agg(F.count(F.lit(1)).alias("n")) \
                  .agg(F.sort_array(F.collect_list(F.struct(F.col("role").isNull(), "role", "n"))).alias("_roles"))
    u = totals.unionByName(by_role, allowMissingColumns=True)
    row = u.agg(*[F.max(c).alias(c) for c in u.columns])
    return row.select(
        F.coalesce("total_messages", F.lit(0)).alias("total_messages"),
        F.array_join(F.transform(F.coalesce("_roles", F.array()), lambda r: F.concat(
            F.coalesce(r["role"], F.lit("None")), F.lit(": "), r["n"].cast("string"))), ", ").alias("messages_by_role"),
        F.coalesce("recent_messages_1h", F.lit(0)).alias("recent_messages_1h"))
