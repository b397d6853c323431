"""Stored cursors by bucket, with Bloom filters (K1, K11): a conflict check that does not read history.

Beside a log table, ``keys/bucket=<b>`` holds its cursors by hash and ``blooms`` a Bloom filter for
every bucket and every step in which files were added. An ingest tests its cursors against the filters (about
``BITS`` bits a cursor instead of the cursor itself) and reads only the buckets of those that may be
there, to decide exactly. A batch of new cursors reads next to no bucket.

The keys follow the table and never lead it: a stream names the folders of each epoch and takes in
those of committed epochs (``sync_epochs``), without listing the table. For other writers ``sync`` lists the table's data files, reads the
cursor column of those it has not covered yet, and notes them as covered last. A crash
anywhere leaves files uncovered, which the next sync reads again (a cursor held twice changes nothing); rows
that another writer added are found the same way. A filter has no false negatives, so no
conflict is missed.

A bucket's filter is one row and a task holds the filters of one bucket: choose ``buckets`` so that a bucket
gets some millions of cursors.
"""

from __future__ import annotations

import sys
import uuid

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.session import discard, file_system, land, materialize, scratch_path, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 64
BITS = 12
PROBES = 6  # bits set for each cursor: about 0.5 % of absent cursors pass

_BLOOM = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())])


def _spots(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each key: PROBES steps of an odd stride from its first hash."""
    a, b = h1.view(np.uint64), h2.view(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(PROBES)])


def _hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table["h1"].to_numpy(), table["h2"].to_numpy()


def _filter(keys: pa.Table) -> pa.Table:
    """The Bloom filter of a bucket's new cursors."""
    size = 8 * max(8, keys.num_rows * BITS // 8)
    bits = np.zeros(size, dtype=bool)
    bits[_spots(*_hashes(keys), size).ravel()] = True
    return pa.table([pa.array([keys["bucket"][0].as_py()], pa.int32()), pa.array([keys.num_rows], pa.int64()),
                     pa.array([np.packbits(bits).tobytes()], pa.binary())], schema=_BLOOM)


def _maybe(keys: pa.Table, blooms: pa.Table) -> pa.Table:
    """The cursors of a bucket that one of its filters may hold."""
    hit = np.zeros(keys.num_rows, dtype=bool)
    for raw in blooms["bits"]:
        packed = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
        at = _spots(*_hashes(keys), 8 * len(packed))
        hit |= ((packed[at >> np.uint64(3)] >> (7 - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=0)
    return keys.select(["bucket", "cursor"]).filter(pa.array(hit))


class CursorKeys:
    """The key table of one log table, under ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _keyed(self, cursors: DataFrame) -> DataFrame:
        rows = cursors.where(F.col("cursor").isNotNull()).select("cursor")
        return rows.withColumn("h1", F.xxhash64("cursor")).withColumn("h2", F.xxhash64("cursor", F.lit(1))) \
            .withColumn("bucket", F.pmod("h1", F.lit(self.buckets)).cast("int"))

    def _base(self) -> str:
        """The folder of the newest generation."""
        fs, jpath = file_system(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []
        return f"{self.path}/{max((n for n in names if n.startswith('g-')), default='g-000000')}"

    def _write(self, keyed: DataFrame, base: str) -> None:
        keyed.select("bucket", "cursor").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{base}/keys")
        keyed.groupBy("bucket").applyInArrow(_filter, "bucket int, n long, bits binary") \
            .write.mode("append").parquet(f"{base}/blooms")

    def covered(self) -> set[str]:
        """The data files whose cursors are held (as many names as Spark lists to read the table)."""
        df = stored(self.spark, f"{self._base()}/covered")
        return set() if df is None else {r["file"] for r in df.select("file").toLocalIterator()}

    def cover(self, files: list[str]) -> None:
        """Note files as covered."""
        self.spark.createDataFrame([(f,) for f in files], "file string").coalesce(1) \
            .write.mode("append").parquet(f"{self._base()}/covered")

    def sync(self, table: DataFrame | None, wanted: Callable[[str], bool] = lambda file: True) -> int:
        """Take in the table's files that are not covered yet (of those ``wanted``); their number."""
        if table is None:
            return 0
        known = self.covered()
        fresh = [f for f in table.inputFiles() if f not in known and wanted(f)]
        if fresh:
            self._add(fresh)
            self.cover(fresh)
        return len(fresh)

    def _add(self, paths: list[str]) -> None:
        scratch = scratch_path(self.spark, f"cursor-keys-{uuid.uuid4().hex[:12]}")
        self._write(land(self._keyed(self.spark.read.schema("cursor string").parquet(*paths)), scratch), self._base())
        discard(self.spark, scratch)

    def note_epoch(self, epoch: int, paths: list[str]) -> None:
        """Name the folders that a stream's epoch wrote, before the epoch is committed. A replay names them again."""
        self.spark.createDataFrame([(p,) for p in paths], "path string").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/pending/{epoch:012d}")

    def sync_epochs(self, before: int) -> int:
        """Take in the folders of the epochs before ``before`` that were named and not yet taken in;
        nothing else of the table is listed or read."""
        fs, jpath = file_system(self.spark, f"{self.path}/pending")
        names = [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []
        done = [n for n in names if int(n) < before]
        if done:
            folders = [f"{self.path}/pending/{n}" for n in done]
            paths = [r["path"] for r in self.spark.read.schema("path string").parquet(*folders).collect()]  # a few epochs' days
            if paths:
                self._add(paths)
            for f in folders:
                discard(self.spark, f)
        return len(done)

    def candidates(self, batch: DataFrame) -> DataFrame:
        """``bucket, cursor`` of the batch's distinct cursors that may be stored."""
        blooms = stored(self.spark, f"{self._base()}/blooms")
        if blooms is None:
            return self.spark.createDataFrame([], "bucket int, cursor string")
        keys = self._keyed(batch.select("cursor").distinct())
        return keys.groupBy("bucket").cogroup(blooms.groupBy("bucket")).applyInArrow(_maybe, "bucket int, cursor string")

    def held(self, batch: DataFrame) -> DataFrame:
        """The cursors of ``batch`` that are stored, exactly. Reads the buckets of the candidates."""
        keys = stored(self.spark, f"{self._base()}/keys")
        if keys is None:
            return self.spark.createDataFrame([], "cursor string")
        maybe = materialize(self.candidates(batch))
        buckets = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]  # at most ``buckets``
        return maybe.select("cursor").join(keys.where(in_buckets(F.col("bucket"), buckets)).select("cursor"), "cursor", "left_semi")

    def merge(self) -> None:
        """Rewrite the keys of many small steps as one file and one filter a bucket. The new generation
        is complete before it is renamed into place, so a crash leaves the old one."""
        old = self._base()
        keys = stored(self.spark, f"{old}/keys")
        if keys is None:
            return
        aside = f"{self.path}/_next-{uuid.uuid4().hex[:12]}"
        again = land(self._keyed(keys.select("cursor").distinct()), f"{aside}/_rows")
        self._write(again, aside)
        stored(self.spark, f"{old}/covered").coalesce(1).write.parquet(f"{aside}/covered")
        discard(self.spark, f"{aside}/_rows")
        number = int(old.rsplit("g-", 1)[1]) + 1
        fs, place = file_system(self.spark, f"{self.path}/g-{number:06d}")
        if fs.exists(place) or not fs.rename(file_system(self.spark, aside)[1], place):
            raise OSError(f"the merged keys could not be put in place under {self.path}")
        discard(self.spark, old)


def in_buckets(bucket: Column, buckets: list[int]) -> Column:
    return bucket.isin(buckets) if buckets else F.lit(False)
