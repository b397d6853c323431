"""Shared helpers of the operators: Arrow batches, column handling, written intermediates."""

from __future__ import annotations

import ctypes
import uuid

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.session import prepare, scratch_path

ROW = "row__"  # holds a document's own columns while an operator adds its results


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size, so that a batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def nest(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` in one struct, so that no result column can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))


def unnest(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


def land(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table into the shared folder and read it back: computed once,
    short lineage, and still there when executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def giving_back(run: Callable) -> Callable:
    """A map step after whose task the Python worker gives its free memory back to the system. Workers
    outlive their tasks, and what they keep stands beside the JVM of later stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return task


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the given columns (numpy arrays, lists or Arrow arrays)."""
    arrays = [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
