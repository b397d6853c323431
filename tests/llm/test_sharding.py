"""Sharding: every row once, nearly equal bytes, gapless slots, hot groups divided."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import sharding


def check(rows, docs, shards, tolerance):
    size = {}
    by_shard = defaultdict(list)
    assert Counter((r.row__.doc_id, r.text_crc32, r["size"]) for r in rows) == Counter(
        (d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in docs)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        size[r.shard] = size.get(r.shard, 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert set(by_shard) <= set(range(shards))
    mean = sum(size.values()) / shards
    assert max(abs(size.get(s, 0) - mean) for s in range(shards)) <= tolerance * mean


def test_sample_table(spark, sample):
    docs = spark.createDataFrame(sample, "doc_id long, text string")
    check(sharding.shard(docs).collect(), sample, 16, 0.1)


def test_a_third_of_all_rows_are_one_text(spark):
    docs = [(i, f"text number {i} " + "w" * (i % 50)) for i in range(4000)] + [(7, "the same row") for _ in range(2000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = sharding.shard(frame, 16).collect()
    check(rows, docs, 16, 0.01)
    # Texts that fit a range lie in few shards; the copies fill whole shards instead of one task.
    copies = Counter(r.shard for r in rows if r.row__.text == "the same row")
    assert max(copies.values()) <= 6000 // 16 * 3


def test_same_input_same_shards(spark, sample):
    docs = spark.createDataFrame(sample, "doc_id long, text string")
    one, two = (sorted((r.row__.doc_id, r.shard, r.slot) for r in sharding.shard(docs, 5).collect()) for _ in range(2))
    assert one == two


def test_awkward_rows(spark, odd, empty):
    docs = odd.withColumn("shard", F.lit("mine")).withColumn("slot", F.lit(None).cast("int")).withColumn("range", F.lit(1))
    rows = sharding.shard(docs.union(docs.withColumn("doc_id", F.lit(None).cast("long"))), 3).collect()
    assert len(rows) == 20 and {r.row__.shard for r in rows} == {"mine"}
    assert sorted(r.slot for r in rows if r.shard == rows[0].shard)[0] == 0
    assert sharding.shard(empty).count() == 0
    one = sharding.shard(odd.limit(1)).collect()
    assert [(r["size"], r.text_crc32, r.slot) for r in one] == [(1, 0, 0)]


def test_written_shards(spark, sample, tmp_path):
    docs = spark.createDataFrame(sample, "doc_id long, text string")
    sharding.write(sharding.shard(docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(sample)
    assert back.where("shard = 2").orderBy("slot").select("slot").toPandas()["slot"].tolist() == list(
        range(back.where("shard = 2").count()))


def test_splitters_order_pairs():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 6, 40), rng.integers(0, 9, 40)
    s = sharding.Splitters(a, b)
    k1, k2 = rng.integers(-1, 8, 500), rng.integers(-1, 10, 500)
    pairs = list(zip(s.k1.tolist(), s.k2.tolist(), strict=True))
    want = [sum(p <= (x, y) for p in pairs) for x, y in zip(k1.tolist(), k2.tolist(), strict=True)]
    assert s.find(k1, k2).tolist() == want


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_deal_is_even(shards):
    size = np.random.default_rng(2).integers(1, 100, 3000)
    load = np.bincount(sharding.deal(size, shards), weights=size, minlength=shards)
    assert load.max() - load.min() <= 100
    assert len(sharding.deal(np.zeros(0, dtype=np.int64), shards)) == 0
