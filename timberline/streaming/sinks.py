"""Idempotent micro-batch sinks for ``foreachBatch``.

Each micro-batch is written into its own ``epoch=<batch id>`` partition with
dynamic partition overwrite. When a batch is replayed after a failure (lost
executor, restarted driver) Spark hands ``foreachBatch`` the same batch id, so
the replay replaces that partition instead of appending a second copy.
"""

from __future__ import annotations

import uuid

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline import versions
from timberline.operators.window import PARTITION_COLUMN
from timberline.session import discard, file_system, stored

EPOCH = "epoch"


def write_epoch(df: DataFrame, path: str, epoch_id: int, partition_by: list[str] | None = None) -> None:
    """Write one micro-batch under ``epoch=<id>`` (below any ``partition_by``
    columns); dynamic overwrite replaces exactly the partitions of this batch."""
    (df.withColumn(EPOCH, F.lit(int(epoch_id)))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*(partition_by or []), EPOCH).parquet(path))


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The table written by an epoch sink (without the epoch column), compacted epochs included. When
    nothing was written yet: an empty frame of ``schema``, or None."""
    df = live(spark, path)
    if df is None:
        return spark.createDataFrame([], schema) if schema is not None else None
    return df.drop(EPOCH)


def read_other_epochs(spark: SparkSession, path: str, epoch_id: int, days: list | None = None) -> DataFrame | None:
    """Rows of all *other* epochs: what a replayed epoch must be checked against. With ``days``,
    only these days' folders are listed and read."""
    df = live(spark, path, days)
    if df is None:
        return None
    return df.filter(~F.col(EPOCH).eqNullSafe(F.lit(int(epoch_id)))).drop(EPOCH)


# --- compaction: versioned lists of what stands for the small files --------------------

MANIFEST_SCHEMA = "upto long, folder string"


def manifest(spark: SparkSession, path: str, version: str | None = None) -> tuple[int, list[str]]:
    """The last epoch that was compacted (-1: none) and the folders that hold the compacted rows."""
    version = version or versions.latest(spark, f"{path}/_manifest")
    if version is None:
        return -1, []
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(version).collect()  # one row a folder: FAN_IN at most
    return max(r["upto"] for r in rows), sorted(r["folder"] for r in rows)


def _folders(spark: SparkSession, base: str, days: list | None) -> DataFrame | None:
    """The partitioned table under ``base``, or only its folders of ``days``."""
    if days is None:
        return stored(spark, base)
    found = [f"{base}/day={d}" for d in days if d is not None]
    found = [f for f in found if (at := file_system(spark, f))[0].exists(at[1])]
    return spark.read.option("basePath", base).parquet(*found) if found else None


def live(spark: SparkSession, path: str, days: list | None = None) -> DataFrame | None:
    """The rows of the table as the newest manifest defines them: its compacted folders (epoch
    NULL) and the small files of the epochs after it. None: no rows."""
    path = path.rstrip("/")
    upto, folders = manifest(spark, path)
    parts = [df for f in folders if (df := _folders(spark, f"{path}/_compacted/{f}", days)) is not None]
    parts = [df.withColumn(EPOCH, F.lit(None).cast("long")) for df in parts]
    small = _folders(spark, path, days)
    if small is not None:
        small = small.withColumn(EPOCH, F.col(EPOCH).cast("long"))
        parts.append(small.filter(F.col(EPOCH) > upto) if upto >= 0 else small)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


FAN_IN = 8  # compacted folders that are merged into one


def compact(spark: SparkSession, path: str, upto: int | None = None, sort_by: str = "ts") -> int:
    """Rewrite the small files of the closed epochs as few large ones, while the stream runs.

    The rows of the epochs after the last manifest up to ``upto`` (default: all but the newest
    epoch, the only one that can be replayed) are written into a new folder that readers ignore; one
    rename then publishes the manifest that names it, and from that moment stands for the old
    files, which ``vacuum`` deletes later. A crash before the rename leaves an unnamed folder, a
    crash after it old files that no reader counts. After ``FAN_IN`` folders all compacted rows
    are merged into one folder. Returns the last compacted epoch."""
    path = path.rstrip("/")

    def make(version: str | None) -> DataFrame | None:
        done, folders = manifest(spark, path, version) if version else (-1, [])
        small = stored(spark, path)
        if small is None:
            return None
        last = small.agg(F.max(EPOCH).alias("e")).first()["e"]
        to = min(last - 1, last - 1 if upto is None else upto)
        rows = small.filter((F.col(EPOCH) > done) & (F.col(EPOCH) <= to)).drop(EPOCH)
        if to <= done or rows.isEmpty():
            return None
        if len(folders) + 1 >= FAN_IN:
            olds = [spark.read.parquet(f"{path}/_compacted/{f}") for f in folders]
            rows, folders = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows, *olds]), []
        name = uuid.uuid4().hex[:12]
        keys = [c for c in (PARTITION_COLUMN, sort_by) if c in rows.columns]
        ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else rows
        writer = ordered.write.partitionBy(PARTITION_COLUMN) if PARTITION_COLUMN in rows.columns else ordered.write
        writer.parquet(f"{path}/_compacted/{name}")
        return spark.createDataFrame([(int(to), f) for f in [*folders, name]], MANIFEST_SCHEMA).coalesce(1)

    versions.publish(spark, f"{path}/_manifest", make)
    return manifest(spark, path)[0]


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the small files that the newest manifest stands for and compacted folders that it does
    not name. Run it when no reader uses an older manifest and no compaction runs. Returns the folders deleted."""
    path = path.rstrip("/")
    upto, folders = manifest(spark, path)
    if upto < 0:
        return 0
    fs, _ = file_system(spark, path)
    old = []
    for pattern in (f"{path}/{EPOCH}=*", f"{path}/{PARTITION_COLUMN}=*/{EPOCH}=*"):
        found = fs.globStatus(file_system(spark, pattern)[1]) or []
        old += [p for s in found if int((p := s.getPath().toString()).rsplit("=", 1)[1]) <= upto]
    kept = fs.globStatus(file_system(spark, f"{path}/_compacted/*")[1]) or []
    old += [s.getPath().toString() for s in kept if s.getPath().getName() not in folders]
    for p in old:
        discard(spark, p)
    return len(old)
