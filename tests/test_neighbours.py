"""Approximate neighbours: recall against the exact answer, only probed cells read, hot cells."""

import random
import re

import numpy as np
import pytest

from timberline.operators import neighbours, vectors
from timberline.params import SearchParams

AS_OF = "2024-01-31 00:00:00"
DIM = 16


def frame(spark, matrix, ids=None):
    ids = range(len(matrix)) if ids is None else ids
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix, strict=True)]
    return spark.createDataFrame(rows, "log_id long, embedding array<float>").selectExpr(
        "log_id", "embedding", "timestamp_ntz'2024-01-30 00:00:00' AS ts", "'s' AS source",
        "if(log_id % 2 = 0, 'even', 'odd') AS unit", "'info' AS severity")


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(30, DIM)) * 4
    return centers[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, DIM)) * 0.3


@pytest.fixture(scope="module")
def index(spark, clustered, tmp_path_factory):
    return neighbours.build(frame(spark, clustered), str(tmp_path_factory.mktemp("ann") / "index"), cells=40)


def brute(matrix, queries, k):
    d = ((queries[:, None, :] - matrix[None]) ** 2).sum(2)
    return [sorted(range(len(matrix)), key=lambda j, i=i: (round(d[i, j], 9), j))[:k] for i in range(len(queries))]


def test_every_row_is_indexed_and_reload_is_equal(spark, index, clustered):
    assert index.vectors(spark).count() == len(clustered)
    again = neighbours.load(spark, index.path)
    assert again.probes == index.probes and np.array_equal(again.centroids, index.centroids)


def test_exact_many_equals_brute_force(spark, clustered):
    asked = spark.createDataFrame([(i, [float(x) for x in np.float32(clustered[i])]) for i in range(0, 3000, 100)],
                                  "query_id long, embedding array<float>")
    stored = np.float32(clustered).astype(np.float64)
    want = brute(stored, stored[::100], 7)
    for block_rows in (150, 4096):
        rows = neighbours.exact_many(asked, frame(spark, clustered), 7, block_rows=block_rows).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append(r.log_id)
        assert [got[i] for i in range(0, 3000, 100)] == want


def test_recall_reaches_the_wanted_share(spark, index, clustered):
    rng = np.random.default_rng(9)
    near = clustered[rng.integers(0, 3000, 120)] + rng.normal(size=(120, DIM)) * 0.2
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(near)], "query_id long, embedding array<float>")
    found = neighbours.search_many(spark, index, asked, 10, block_rows=500)
    exact = neighbours.exact_many(asked, frame(spark, clustered), 10)
    assert index.probes < len(index.centroids) / 4  # clustered rows need few cells
    assert neighbours.recall(found, exact) >= 0.9
    assert neighbours.recall(neighbours.search_many(spark, index, asked, 10, probes=len(index.centroids)), exact) == 1.0


def test_rows_without_structure_need_more_cells(spark, tmp_path):
    matrix = np.random.default_rng(1).normal(size=(1500, DIM))
    index = neighbours.build(frame(spark, matrix), str(tmp_path / "flat"), cells=20)
    asked = frame(spark, matrix).where("log_id % 20 = 0").selectExpr("log_id AS query_id", "embedding")
    exact = neighbours.exact_many(asked, frame(spark, matrix), 10)
    assert index.probes > 2 and neighbours.recall(neighbours.search_many(spark, index, asked, 10), exact) >= 0.9


def test_one_query_reads_only_its_cells(spark, index, clustered):
    query = [float(x) for x in clustered[5]]
    found = neighbours.search(spark, index, query, SearchParams(n_results=10), AS_OF)
    exact = vectors.search(frame(spark, clustered), query, SearchParams(n_results=10), AS_OF)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [tuple(r) for r in exact.orderBy("rank").collect()]
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().executedPlan().toString()
    cells = index.nearest_cells(query, index.probes)
    assert re.search(r"PartitionFilters: \[cell#\d+ (IN \(|= )", plan), plan
    read = {re.search(r"cell=(\d+)", f).group(1) for f in index.vectors(spark).where(f"cell IN ({','.join(map(str, cells))})").inputFiles()}
    assert len(read) <= 40 and len(cells) < 10


def test_filters_widen_the_search(spark, index, clustered):
    query = [float(x) for x in clustered[5]]
    p = SearchParams(n_results=100, unit="odd")
    found = neighbours.search(spark, index, query, p, AS_OF, probes=1)
    assert found.count() == 100
    assert neighbours.search(spark, index, query, SearchParams(n_results=5, unit="none"), AS_OF, probes=1).count() == 0


def test_hot_cell_and_repeated_vectors(spark, tmp_path):
    rng = random.Random(2)
    matrix = [[1.0, 0.0]] * 600 + [[rng.random() * 9, rng.random() * 9] for _ in range(600)]
    index = neighbours.build(frame(spark, matrix), str(tmp_path / "hot"), cells=8)
    asked = frame(spark, matrix).where("log_id < 200").selectExpr("log_id AS query_id", "embedding")
    found = neighbours.search_many(spark, index, asked, 5, block_rows=50).collect()
    assert len(found) == 1000 and {r.log_id for r in found} == {0, 1, 2, 3, 4}  # equal distances go by id


def test_unusable_vectors_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [3.0, 4.0]), (6, [3.0, 4.0])]
    odd = spark.createDataFrame(rows, "log_id long, embedding array<float>")
    index = neighbours.build(odd, str(tmp_path / "odd"))
    assert sorted(r.log_id for r in index.vectors(spark).collect()) == [1, 6, 6]
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 2.0, 3.0])], "query_id long, embedding array<float>")
    assert {r.query_id for r in neighbours.search_many(spark, index, asked, 2, probes=9).collect()} == {1}
    empty = neighbours.build(odd.limit(0), str(tmp_path / "empty"))
    assert neighbours.search_many(spark, empty, asked).count() == 0 and empty.vectors(spark).count() == 0
