"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every operator relies on: UTC wall time for TIMESTAMP_NTZ columns,
# adaptive execution for partition coalescing and skew-join splitting.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Delete a reliable checkpoint's files once its DataFrame is gone, so
    # materialized intermediates do not pile up in the shared folder.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "timberline") -> SparkSession:
    """Return (or create) a session with the library's required settings.

    On a cluster the master and partition counts come from the submitter; the
    arguments exist for local runs and tests.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir`` (or None)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    return d or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's checkpoint dir; only when none is configured (local runs,
    tests) fall back to a fresh scratch folder."""
    d = checkpoint_dir(spark)
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return d
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    d = tempfile.mkdtemp(prefix="timberline-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint dir for written intermediate tables
    (state tables, streaming checkpoints)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the per-session settings the operators rely on to a session made
    elsewhere (the driver's, a notebook's): UTC wall time and a checkpoint dir."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def land(df, path: str, compression: str = "snappy"):
    """Write ``df`` once under ``path`` (in the shared folder) and read it back."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and the path as it names it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table."""
    fs, jpath = file_system(spark, path)
    fs.delete(jpath, True)


def stored(spark: SparkSession, path: str):
    """The Parquet table at ``path``, or None where there is none. Only a missing or empty
    folder counts as none: any other failure to read is raised."""
    fs, jpath = file_system(spark, path)
    if not fs.exists(jpath) or not any(
            not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(jpath)):
        return None
    return spark.read.parquet(path)


def materialize(df):
    """Compute a small intermediate result once and cut its lineage: a reliable
    checkpoint into the shared checkpoint folder (survives executor loss, unlike
    a local checkpoint). Used where several branches read the same aggregate."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
