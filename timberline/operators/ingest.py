"""Duplicate-free incremental ingest.

A batch of parsed rows gets a content fingerprint and id, is deduplicated
inside itself (first by ``seq`` wins, on fingerprint then on cursor), and
loses every row whose id, fingerprint or cursor is already stored.
"""

from __future__ import annotations

import json
import math
import uuid

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline import versions
from timberline.functions import fingerprint, id_from_fingerprint, json_or_wrap, py_ts_str, with_fingerprint
from timberline.operators.cursor_keys import CursorKeys
from timberline.operators.window import PARTITION_COLUMN, ts_lit
from timberline.schema import INGEST_STATE, LOGS
from timberline.session import discard, land, scratch_path, stored


def prepare_batch(parsed: DataFrame, wrap_raw: bool = False) -> DataFrame:
    """Attach fingerprint and id (X1, X2). Parsers already deliver ``raw`` as
    JSON text; ``wrap_raw`` applies X6 to rows from any other origin."""
    df = parsed
    if wrap_raw and "raw" in df.columns:
        df = df.withColumn("raw", json_or_wrap(F.col("raw")))
    return with_fingerprint(df, overwrite_id=True)


def _first_by(df: DataFrame, keys, order_col: str) -> DataFrame:
    """One row per ``keys``: the one with the smallest ``order_col``.

    ``min_by`` over a struct aggregates partially on the map side, so a key that
    repeats in a third of the batch is reduced to one row per task before the
    shuffle (a window ``row_number`` would send all its rows to one task).
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(row, F.col(order_col)).alias("_r")).select("_r.*")


def dedup_batch(batch: DataFrame, order_col: str = "seq") -> DataFrame:
    """K1 within a batch: first row per fingerprint, then first per non-NULL
    cursor (NULL cursors never conflict)."""
    by_fp = _first_by(batch, ["fingerprint"], order_col)
    cursor_key = [F.col("cursor").isNull().alias("_nocursor"),
                  F.coalesce(F.col("cursor"), F.col("fingerprint")).alias("_ckey")]
    return _first_by(by_fp, cursor_key, order_col)


MAX_DAYS = 1000


def _days_of(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Restrict a date-partitioned table to the days of the batch.

    Exact for content: a stored row with the same fingerprint has the same ``ts``, hence the
    same day. The days come from one small aggregate over the batch and become a static
    partition filter, so only their folders are listed and read; beyond ``MAX_DAYS`` days
    the span from the first to the last stands for them.
    """
    if PARTITION_COLUMN not in existing.columns:
        return existing
    days = [r["d"] for r in batch.select(F.to_date("ts").alias("d")).distinct().orderBy("d").limit(MAX_DAYS + 1).collect()]
    day = F.col(PARTITION_COLUMN)
    if len(days) <= MAX_DAYS:
        return existing.filter(day.isin([d for d in days if d is not None]))
    span = batch.agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi")).first()
    return existing.filter(day.between(F.lit(span["lo"]), F.lit(span["hi"])))


def new_rows(batch: DataFrame, existing: DataFrame | None, days_from: DataFrame | None = None,
             keys: CursorKeys | None = None) -> DataFrame:
    """K1 against the table: drop rows whose fingerprint (and so id) or non-NULL cursor is
    already stored. The fingerprint check reads the batch's days only; a cursor may have been
    stored on any day: ``keys`` (synced with the table) answers from the buckets of the batch's
    possible conflicts; without it the check reads the one cursor column of the whole table. Rows
    without a cursor are keyed by their fingerprint there, so they spread over all tasks and
    match nothing. ``days_from`` (default: the batch) supplies the days."""
    if existing is None:
        return batch
    days_from = batch if days_from is None else days_from
    recent = _days_of(existing, days_from)
    out = batch.join(recent.select("fingerprint").filter(F.col("fingerprint").isNotNull()), "fingerprint", "left_anti")
    if keys is not None:
        return without_held(out, days_from, keys)
    return _without_cursors(out, existing.select("cursor"))


def _without_cursors(rows: DataFrame, cursors: DataFrame) -> DataFrame:
    known = cursors.filter(F.col("cursor").isNotNull()) \
        .select(F.struct(F.lit(True).alias("real"), F.col("cursor").alias("key")).alias("_ckey"))
    key = F.struct(F.col("cursor").isNotNull().alias("real"), F.coalesce("cursor", "fingerprint").alias("key"))
    return rows.withColumn("_ckey", key).join(known, "_ckey", "left_anti").drop("_ckey")


def without_held(rows: DataFrame, batch: DataFrame, keys: CursorKeys) -> DataFrame:
    """``rows`` of ``batch`` without those whose cursor the key table holds."""
    return _without_cursors(rows, keys.held(batch))


def ingest_rows(parsed: DataFrame, existing: DataFrame | None, order_col: str = "seq",
                days_from: DataFrame | None = None) -> DataFrame:
    """K1 end to end: the rows an insert with ON CONFLICT DO NOTHING would add."""
    return new_rows(dedup_batch(prepare_batch(parsed), order_col), existing, days_from)


def to_table_rows(df: DataFrame) -> DataFrame:
    """Project to the ``logs`` schema (missing columns NULL, G2) plus the date
    partition column."""
    return ensure_columns(df, LOGS).select(*[f.name for f in LOGS.fields]) \
        .withColumn(PARTITION_COLUMN, F.to_date("ts"))


def append(df: DataFrame, path: str) -> None:
    """Append to a Parquet ``logs`` table partitioned by date and sorted by ts
    inside files (the index the reference keeps on ts becomes row-group stats).
    Ranges of (day, ts) follow the data, so a large day is several tasks and files."""
    (to_table_rows(df).repartitionByRange(PARTITION_COLUMN, "ts").sortWithinPartitions(PARTITION_COLUMN, "ts")
     .write.mode("append").partitionBy(PARTITION_COLUMN).parquet(path))


def cursor_state(batch: DataFrame, prior: DataFrame | None, as_of, order_col: str = "seq",
                 source_col: str = "source_name") -> DataFrame:
    """K2: last non-NULL cursor per source (by ``order_col``) merged into the
    prior state; sources without a new cursor keep theirs."""
    new = (batch.filter(F.col("cursor").isNotNull())
           .groupBy(F.col(source_col).alias("source"))
           .agg(F.max_by("cursor", order_col).alias("_new")))
    if prior is None:
        prior = batch.sparkSession.createDataFrame([], INGEST_STATE)
    merged = prior.join(new, "source", "full_outer")
    return merged.select(
        "source",
        F.coalesce("_new", "cursor").alias("cursor"),
        F.when(F.col("_new").isNotNull(), ts_lit(as_of)).otherwise(F.col("updated_at")).alias("updated_at"))


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add every column of ``schema`` the frame lacks, as typed NULLs."""
    missing = [f for f in schema.fields if f.name not in df.columns]
    for f in missing:
        df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


def backfill_ids(df: DataFrame) -> DataFrame:
    """G1: fill a missing ``id`` from the fingerprint, or from the fingerprint of
    the row's columns when that is NULL too (every part NULL-safe, D12)."""
    df = ensure_columns(df, LOGS)
    fp = F.coalesce(F.col("fingerprint"),
                    fingerprint(F.col("ts"), F.col("hostname"), F.col("unit"), F.col("severity"),
                                F.col("pid"), F.col("message")))
    return df.withColumn("id", F.coalesce(F.col("id"), id_from_fingerprint(fp)))


def clear_table(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """K9: replace a Parquet table by an empty one with the same schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def to_ndjson(df: DataFrame) -> DataFrame:
    """K7: one JSON object per row in a ``value`` column, fields in column
    order; NULL fields are kept; timestamps are written ``YYYY-MM-DD
    HH:MM:SS`` with ``.ffffff`` only when the microseconds are not zero."""
    cols = [py_ts_str(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """K2: the newest complete version of the cursor state, or None before the first."""
    newest = versions.latest(spark, path)
    return None if newest is None else spark.read.schema(INGEST_STATE).parquet(newest)


def update_state(spark: SparkSession, path: str, merge: Callable[[DataFrame | None], DataFrame]) -> None:
    """K2: publish ``merge(newest state)`` as a new version. A second writer waits for the first
    and merges into its result; a crash at any point leaves the version before it in place."""
    def make(newest: str | None) -> DataFrame:
        return merge(None if newest is None else spark.read.schema(INGEST_STATE).parquet(newest))

    versions.publish(spark, path, make)


def write_state(state: DataFrame, path: str) -> None:
    """K2: replace the state by ``state``, as a new version."""
    update_state(state.sparkSession, path, lambda prior: state)


ROW = "_row"  # the place of a row in a landed batch; unique, but not dense
BROADCAST_ROWS = 1_000_000  # places of rows that are sent to every task
RANGE_ROWS = 200_000  # rows whose order one task finds


def fresh_places(batch: DataFrame, existing: DataFrame | None, order_col: str, source_col: str, keys: CursorKeys | None) -> DataFrame:
    """``dedup_batch`` and ``new_rows`` of a written batch on its narrow columns: ``_row``, order and source
    of the rows to add. ``keys`` stand for the table's cursors.

    One grouping by fingerprint finds the first row of each and whether the table holds it, one by
    cursor the same. A row whose fingerprint is held still stands for its cursor, as in ``dedup_batch``. Texts and raw
    lines are not shuffled; fingerprints are as bytes."""
    first = F.struct(F.col(order_col), ROW, F.col("cursor"), F.col(source_col))
    rows = batch.select(F.unhex("fingerprint").alias("fp"), first.alias("r"), F.lit(False).alias("held"))
    cursors = None
    if existing is not None:
        stored_fp = F.unhex("fingerprint")
        rows = rows.unionByName(_days_of(existing, batch).filter(F.lower(F.hex(stored_fp)) == F.col("fingerprint"))
                                .select(stored_fp.alias("fp"), F.lit(True).alias("held")), allowMissingColumns=True)
        cursors = existing.select("cursor").filter(F.col("cursor").isNotNull())
    if keys is not None:
        cursors = keys.held(batch)
    by_fp = rows.groupBy("fp").agg(F.min("r").alias("r"), F.bool_or("held").alias("held")).filter(F.col("r").isNotNull())
    real = F.col("r.cursor").isNotNull()
    key = F.struct(real.alias("real"), F.coalesce(F.col("r.cursor"), F.col(f"r.{ROW}").cast("string")).alias("key"))
    r = F.struct(f"r.{order_col}", f"r.{ROW}", "held", f"r.{source_col}")
    rows = by_fp.select(key.alias("key"), r.alias("r"), F.lit(False).alias("held"))
    if cursors is not None:
        rows = rows.unionByName(cursors.select(F.struct(F.lit(True).alias("real"), F.col("cursor").alias("key")).alias("key"),
                                               F.lit(True).alias("held")), allowMissingColumns=True)
    by_cursor = rows.groupBy("key").agg(F.min("r").alias("r"), F.bool_or("held").alias("held"))
    return by_cursor.filter(F.col("r").isNotNull() & ~F.col("held") & ~F.col("r.held")).select(f"r.{ROW}", f"r.{order_col}", f"r.{source_col}")


def _up_to(fresh: DataFrame, limit: int, n: int, order_col: str, scratch: str):
    """The condition that holds for the first ``limit`` of the ``n`` landed rows ``fresh``, in input order.

    The rows are divided by ranges of their order, and only the range that holds the last row is ordered: no task sees
    all of them. Rows of one order value follow their place in the batch."""
    order = [order_col, ROW]
    ranged = fresh.select(*order).repartitionByRange(max(2, math.ceil(n / RANGE_ROWS)), *order)
    ranged = land(ranged.withColumn("part", F.spark_partition_id()), f"{scratch}/order")
    before = 0
    for part in ranged.groupBy("part").count().orderBy("part").collect():  # one row a range
        if before + part["count"] >= limit:
            break
        before += part["count"]
    edge = ranged.filter(F.col("part") == part["part"]).orderBy(*order).limit(limit - before)
    last = edge.agg(F.max(F.struct(*order)).alias("at")).first()["at"]
    types = dict(fresh.select(*order).dtypes)
    return F.struct(*order) <= F.struct(*[F.lit(last[c]).cast(types[c]).alias(c) for c in order])


def pick(batch: DataFrame, fresh: DataFrame, kept: int, n: int) -> DataFrame:
    """The rows of a landed batch of ``n`` whose places are in ``fresh`` (``kept`` of them), with the smaller
    of what is kept and what is left sent to all tasks where it is small."""
    if kept == 0:
        return batch.filter(F.lit(False))
    if kept == n:
        return batch
    if n - kept <= BROADCAST_ROWS:
        left = batch.select(ROW).join(fresh.select(ROW), ROW, "left_anti")
        return batch.join(F.broadcast(left), ROW, "left_anti")
    places = fresh.select(ROW)
    return batch.join(F.broadcast(places) if kept <= BROADCAST_ROWS else places, ROW, "left_semi")


class UnreadableBatch(RuntimeError):
    """The input of an ingest could not be read to its end; nothing of it was stored."""


def _kept_as(state: DataFrame, key: str, value: str, as_of) -> DataFrame:
    """The state with one row replaced."""
    row = state.sparkSession.range(1).select(F.lit(key).alias("source"), F.lit(value).alias("cursor"), ts_lit(as_of).alias("updated_at"))
    return state.filter(F.col("source") != F.lit(key)).unionByName(row)


def _positions_before(batch: DataFrame, order_col: str, reached, known: dict, end: dict) -> dict:
    """The positions to resume from when rows after ``reached`` were left for the next run."""
    done = {r["file_path"]: r["p"] for r in batch.filter(F.col(order_col) <= F.lit(reached)).groupBy("file_path")
            .agg(F.max("next_at").alias("p")).collect()}  # one row a file, as in the positions themselves
    return {f: done.get(f, min(known.get(f, 0), p)) for f, p in end.items()}


def ingest_into(parsed: DataFrame, table_path: str, state_path: str | None, as_of,
                sources: list[str], order_col: str = "seq", source_col: str = "source_name",
                limit: int | None = None, keys: CursorKeys | None = None,
                positions: tuple[str, dict, dict] | None = None) -> dict:
    """INGEST end to end (K1, K2, A12): append the new rows of ``parsed`` to the
    ``day``-partitioned Parquet table at ``table_path``, advance the cursor
    state at ``state_path`` and return ``{source: (parsed_rows, inserted_rows)}``.

    ``limit`` (S11) stores the first rows, in input order, of those that are new. The cursor then
    stops at the last row stored, and so do ``positions`` (state key, where the input began
    and where it ends, by file): what was left is read by the next run. ``keys`` is the table's cursor key table.

    The batch is written once into the shared folder, and so are the places of its new rows: the input is
    evaluated once, and the counts are those of the written rows, whatever tasks ran again.
    """
    spark = parsed.sparkSession
    scratch = scratch_path(spark, f"ingest-{uuid.uuid4().hex}")
    try:
        try:
            batch = land(prepare_batch(parsed).withColumn(ROW, F.monotonically_increasing_id()), f"{scratch}/batch", "zstd")
        except PySparkException as exc:
            raise UnreadableBatch(str(exc)) from exc
        except Py4JJavaError as exc:  # failures of tasks that PySpark has no class for
            raise UnreadableBatch(exc.java_exception.getMessage()) from exc
        existing = stored(spark, table_path)
        if keys is not None:
            keys.sync(existing)
        fresh = land(fresh_places(batch, existing, order_col, source_col, None if existing is None else keys), f"{scratch}/fresh")

        def count(df: DataFrame) -> dict:
            return {r[0]: r[1] for r in df.groupBy(source_col).agg(F.count(F.lit(1))).collect()}  # one row for each source

        seen, found = count(batch), count(fresh)
        rows = pick(batch, fresh, sum(found.values()), sum(seen.values()))
        kept, reached = found, None
        if limit is not None and sum(found.values()) >= limit:
            within = _up_to(fresh, limit, sum(found.values()), order_col, scratch) if limit else F.lit(False)
            fresh, rows = fresh.filter(within), rows.filter(within)
            kept, reached = count(fresh), fresh.agg(F.max(order_col)).first()[0]
        append(rows, table_path)
        if state_path is not None:
            done, end = batch, positions and positions[2]
            if limit is not None and sum(found.values()) >= limit:
                done = batch.filter(F.col(order_col) <= F.lit(reached))
                end = positions and _positions_before(batch, order_col, reached, positions[1], positions[2])

            def merged(prior: DataFrame | None) -> DataFrame:
                state = cursor_state(done, prior, as_of, order_col, source_col)
                return state if positions is None else _kept_as(state, positions[0], json.dumps(end, sort_keys=True), as_of)

            update_state(spark, state_path, merged)
    finally:
        discard(spark, scratch)
    return {s: (seen.get(s, 0), kept.get(s, 0)) for s in sources}
