"""File sources: discovery by glob, pruning by size and age, line reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.window import ts_lit
from timberline.params import as_timestamp

DEFAULT_PATTERNS = ("*.log",)
DEFAULT_MAX_FILE_MB = None  # no file is left out unless the caller sets a limit; see skipped_files


def read_lines(spark: SparkSession, paths, patterns=DEFAULT_PATTERNS,
               max_size_mb: int | None = DEFAULT_MAX_FILE_MB, modified_since=None,
               recursive: bool = False) -> DataFrame:
    """Lines of the log files under ``paths``.

    Directories are expanded with the glob ``patterns`` (``pathGlobFilter``);
    explicit files are always kept. Files larger than ``max_size_mb`` or last
    modified before ``modified_since`` are pruned through the ``_metadata``
    columns, so the filter is decided per file, not per line. Blank lines are
    skipped. Output: ``file_path, file_size, file_mtime, line_pos, value``
    where ``line_pos`` increases along a file split (input order).
    Note: undecodable bytes become U+FFFD rather than being removed.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if patterns:
        pats = list(patterns)
        glob = pats[0] if len(pats) == 1 else "{" + ",".join(pats) + "}"
        reader = reader.option("pathGlobFilter", glob)
    df = reader.text(paths).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("file_mtime"),
        F.monotonically_increasing_id().alias("line_pos"),
        F.col("value"))
    if max_size_mb is not None:
        df = df.filter(F.col("file_size") <= F.lit(int(max_size_mb) * 1024 * 1024))
    if modified_since is not None:
        cutoff = as_timestamp(modified_since)
        df = df.filter(F.col("file_mtime").cast("timestamp_ntz") >= ts_lit(cutoff))
    return df.filter(F.trim(F.col("value")) != "")


def list_files(spark: SparkSession, paths, patterns=DEFAULT_PATTERNS,
               max_size_mb: int | None = DEFAULT_MAX_FILE_MB, modified_since=None) -> DataFrame:
    """S4/S5 as a file listing: one row per kept file (file_path, file_size,
    file_mtime). Uses the ``binaryFile`` source with only its metadata columns
    selected, so file contents are never read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.format("binaryFile")
    if patterns:
        pats = list(patterns)
        reader = reader.option("pathGlobFilter", pats[0] if len(pats) == 1 else "{" + ",".join(pats) + "}")
    df = reader.load(paths).select(F.col("path").alias("file_path"), F.col("length").alias("file_size"),
                                   F.col("modificationTime").alias("file_mtime"))
    if max_size_mb is not None:
        df = df.filter(F.col("file_size") <= F.lit(int(max_size_mb) * 1024 * 1024))
    if modified_since is not None:
        df = df.filter(F.col("file_mtime").cast("timestamp_ntz") >= ts_lit(as_timestamp(modified_since)))
    return df


def skipped_files(spark: SparkSession, paths, patterns=DEFAULT_PATTERNS, max_size_mb: int | None = None) -> DataFrame:
    """The files that ``max_size_mb`` leaves out, so that a caller who sets a limit sees
    what was not read (no rows without a limit)."""
    every = list_files(spark, paths, patterns)
    over = F.lit(False) if max_size_mb is None else F.col("file_size") > F.lit(int(max_size_mb) * 1024 * 1024)
    return every.filter(over)
