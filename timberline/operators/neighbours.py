"""Approximate nearest neighbours (V3) beside the exact search: an inverted file of coarse cells.

``build`` places centroids by k-means on a bounded sample, puts *every* vector into the cell of
its nearest centroid and writes the vectors partitioned by cell. A search ranks the centroids
on the driver and reads only the folders of the nearest cells (a static partition filter); the
vectors read are ranked by their exact distance. ``calibrate`` measures on a
query sample, against the exact answer, how many cells reach a wanted recall and stores that
number with the index, so that a search without ``probes`` keeps the recall that was measured.

``search_many`` answers a stated set of queries against all rows. Queries and vectors of a cell
meet in blocks of bounded size (a cell or a set of queries may hold a third of all rows: both
sides are divided by hash until a block fits), each block keeps the ``k`` nearest of each of its
queries, and the blocks' winners are merged. ``exact_many`` is the same work
over all blocks, without cells: the brute-force answer that recall is measured against.

On the driver: the centroids (``MAX_CELLS`` at most) and one count for each cell.
"""

from __future__ import annotations

import json
import sys
import uuid

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.operators.vectors import search as exact_search
from timberline.params import SearchParams
from timberline.session import land, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_CELLS = 4096
SAMPLE_ROWS = 50_000  # rows that the centroids are fitted on, about
BLOCK_ROWS = 4096  # vectors, and queries, that meet in one block at most, about
CALIBRATION_QUERIES = 200


@dataclass(frozen=True)
class VectorIndex:
    """A written index: vectors by cell, and the centroids (one row each of ``cell, centroid``)."""

    path: str
    centroids: np.ndarray
    probes: int
    schema: T.StructType

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def nearest_cells(self, query: list[float], probes: int) -> list[int]:
        return np.argsort(_squared(np.asarray([query], dtype=np.float64), self.centroids)[0], kind="stable")[:probes].tolist()


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _usable(embedding: Column, dim: int) -> Column:
    """Vectors of the index's length without missing or undefined values; others have no distance."""
    return (F.size(embedding) == dim) & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x))


def _cells(centroids: np.ndarray, probes: int):
    """The nearest ``probes`` cells of each vector, nearest first."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            d = _squared(_matrix(b, dim), centroids)
            near = np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))

    return F.arrow_udf(run, "array<int>")


def fit(vectors: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 17) -> np.ndarray:
    """Centroids of a sample of about ``sample_rows`` rows, chosen by a hash of the id. By default
    the square root of the number of rows, at most ``MAX_CELLS``. No usable vector: no centroid."""
    first = vectors.where(F.size("embedding") > 0).select(F.size("embedding").alias("d")).first()
    if first is None:
        return np.zeros((0, 1))
    usable = vectors.where(_usable(F.col("embedding"), first["d"]))
    n = usable.count()
    if not n:
        return np.zeros((0, 1))
    cells = min(MAX_CELLS, cells or max(1, int(n ** 0.5)))
    share = min(1.0, max(sample_rows, cells) / n)
    drawn = usable.where(F.pmod(F.xxhash64("log_id", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))
    if n <= cells or drawn.isEmpty():
        drawn = usable.limit(cells)
    if cells == 1:  # k-means asks for two at least
        return np.asarray([drawn.select(Summarizer.mean(array_to_vector("embedding"))).first()[0].toArray()])
    model = KMeans(k=cells, seed=seed, maxIter=12, initSteps=2).fit(drawn.select(array_to_vector("embedding").alias("features")))
    return np.asarray(model.clusterCenters(), dtype=np.float64)


def build(vectors: DataFrame, path: str, cells: int | None = None, recall: float = 0.95, k: int = 10,
          sample_rows: int = SAMPLE_ROWS) -> VectorIndex:
    """Write the index of all ``vectors`` under ``path`` and calibrate it. Rows without a usable
    vector are left out (they have no distance to anything)."""
    spark = vectors.sparkSession
    centroids = fit(vectors, cells, sample_rows)
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>") \
        .coalesce(1).write.parquet(f"{path}/centroids")
    usable = vectors.where(_usable(F.col("embedding"), centroids.shape[1]))
    placed = usable.withColumn("cell", _cells(centroids, 1)("embedding")[0]) if len(centroids) else usable.limit(0).withColumn("cell", F.lit(0))
    # Ranges follow the data: a cell with many vectors becomes several tasks and files.
    placed.repartitionByRange("cell", F.xxhash64("log_id")).write.partitionBy("cell").parquet(f"{path}/vectors")
    probes = calibrate(spark, VectorIndex(path, centroids, 1, placed.schema), recall, k) if len(centroids) else 1
    spark.createDataFrame([(probes, placed.schema.json())], "probes int, columns string").coalesce(1).write.parquet(f"{path}/probes")
    return VectorIndex(path, centroids, probes, placed.schema)


def load(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # MAX_CELLS at most
    centroids = np.asarray([r["centroid"] for r in rows], dtype=np.float64) if rows else np.zeros((0, 1))
    stored = spark.read.parquet(f"{path}/probes").first()
    return VectorIndex(path, centroids, stored["probes"], T.StructType.fromJson(json.loads(stored["columns"])))


def search(spark: SparkSession, index: VectorIndex, query: list[float], p: SearchParams, as_of, probes: int | None = None) -> DataFrame:
    """The nearest vectors of one query among those of the nearest cells; columns of the exact
    search. Metadata filters may leave fewer than ``n_results`` there: the next cells are read until
    the hits suffice or all cells are read."""
    ranked = index.nearest_cells(query, len(index.centroids))
    take = probes or index.probes
    while True:
        found = exact_search(index.vectors(spark).where(F.col("cell").isin(ranked[:take])), query, p, as_of)
        if take >= len(ranked) or found.count() >= p.n_results:
            return found
        take *= 2


# --- many queries -------------------------------------------------------------------

_HITS = "query_id long, log_id long, distance double"


def _block_hits(k: int, dim: int):
    """The k nearest vectors of each query of a block."""
    schema = pa.schema([("query_id", pa.int64()), ("log_id", pa.int64()), ("distance", pa.float64())])

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return schema.empty_table()
        asked, known = _matrix(queries["embedding"], dim), _matrix(vectors["embedding"], dim)
        qid, vid = queries["query_id"].to_numpy(), vectors["log_id"].to_numpy()
        order = np.argsort(vid, kind="stable")  # equal distances go by id
        known, vid = known[order], vid[order]
        out = []
        for lo in range(0, len(asked), 256):
            d = np.round(_squared(asked[lo : lo + 256], known), 9)
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            rows = np.arange(len(near))[:, None]
            out.append((np.repeat(qid[lo : lo + 256], near.shape[1]), vid[near].ravel(), d[rows, near].ravel()))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return run


def _parts(rows: DataFrame, block_rows: int, name: str) -> DataFrame:
    """``cell`` and how many blocks its rows make: one row for each cell."""
    return rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))


def _meet(queries: DataFrame, vectors: DataFrame, k: int, dim: int, block_rows: int) -> DataFrame:
    """``query_id, log_id, distance, rank``: each query against the vectors of its cells."""
    sizes = _parts(vectors, block_rows, "v_parts").join(_parts(queries, block_rows, "q_parts"), "cell")

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """Each row into its own part by hash, and beside each part of the other side."""
        mine = F.pmod(F.xxhash64(key, F.lit(3)), F.col(f"{own}_parts")).cast("int").alias(f"{own}_part")
        beside = F.explode(F.sequence(F.lit(0), F.col(f"{other}_parts") - 1)).alias(f"{other}_part")
        return rows.join(sizes, "cell").select("cell", key, "embedding", mine, beside)

    keys = ["cell", "q_part", "v_part"]
    hits = dealt(queries, "query_id", "q", "v").groupBy(*keys).cogroup(dealt(vectors, "log_id", "v", "q").groupBy(*keys)) \
        .applyInArrow(_block_hits(k, dim), _HITS)
    w = Window.partitionBy("query_id").orderBy("distance", "log_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_many(spark: SparkSession, index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` nearest indexed vectors of every row of ``queries`` (``query_id, embedding``)
    within its nearest cells: ``query_id, log_id, distance, rank``. A query without a usable vector
    has no hits."""
    if not len(index.centroids):
        return spark.createDataFrame([], _HITS + ", rank int")
    dim = index.centroids.shape[1]
    near = _cells(index.centroids, min(probes or index.probes, len(index.centroids)))
    asked = queries.where(_usable(F.col("embedding"), dim)).withColumn("cells", near("embedding"))
    asked = land(asked.select("query_id", "embedding", F.explode("cells").alias("cell")), _scratch(spark, "asked"))
    return _meet(asked, index.vectors(spark).select("cell", "log_id", "embedding"), k, dim, block_rows)


def exact_many(queries: DataFrame, vectors: DataFrame, k: int = 10, dim: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The exact answer of ``search_many``: all queries against all vectors, in blocks."""
    if dim is None:
        dim = vectors.select(F.max(F.size("embedding")).alias("d")).first()["d"] or 1
    one = F.lit(0).alias("cell")
    return _meet(queries.where(_usable(F.col("embedding"), dim)).select("query_id", "embedding", one),
                 vectors.where(_usable(F.col("embedding"), dim)).select("log_id", "embedding", one), k, dim, block_rows)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact hits that were found."""
    both = exact.join(found.select("query_id", "log_id", F.lit(1).alias("hit")), ["query_id", "log_id"], "left")
    row = both.agg(F.count("hit").alias("hit"), F.count(F.lit(1)).alias("n")).first()
    return row["hit"] / row["n"] if row["n"] else 1.0


def calibrate(spark: SparkSession, index: VectorIndex, wanted: float, k: int, n_queries: int = CALIBRATION_QUERIES) -> int:
    """The fewest cells whose vectors hold the share ``wanted`` of the exact ``k`` nearest, over
    about ``n_queries`` indexed rows chosen by a hash of the id. A hit is lost only if its cell
    isn't read, so one exact answer tells the recall for every number of cells."""
    vectors = index.vectors(spark).select("log_id", "embedding", "cell")
    n = vectors.count()
    dim = index.centroids.shape[1]
    draw = F.pmod(F.xxhash64("log_id", F.lit(29)), F.lit(1 << 30)) < min(1.0, n_queries / n) * (1 << 30)
    queries = land(vectors.where(draw).select(F.col("log_id").alias("query_id"), "embedding"), _scratch(spark, "calibration"))
    exact = exact_many(queries, vectors, k, dim).select("query_id", "log_id")
    order = queries.select("query_id", _cells(index.centroids, len(index.centroids))("embedding").alias("cells"))
    # Where the cell of each exact hit stands in its query's order: at most n_queries * k rows.
    place = exact.join(vectors.select("log_id", "cell"), "log_id").join(order, "query_id") \
        .select(F.array_position("cells", F.col("cell")).alias("place")).toPandas()["place"].to_numpy()
    if not len(place):
        return len(index.centroids)
    reached = np.cumsum(np.bincount(place, minlength=len(index.centroids) + 1)) / len(place)
    return int(np.searchsorted(reached, wanted - 1e-12))


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
