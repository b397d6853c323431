"""Sharding by sampled splitters: shards of nearly equal bytes, made of ranges of a key.

Documents are ordered by (hash of the text, hash of the row), so copies of a text are neighbours.
A size-weighted sample of keys gives quantile boundaries, many for each shard; every document
falls into a range between two boundaries, and the exact bytes of all ranges are summed. Ranges
of more than twice their share (long documents, texts copied very often) are sampled again by
both parts of the key and subdivided until none of them can be divided. Consecutive ranges make
a shard: a range goes to the shard in whose share of the bytes its middle lies, so that a shard is
off by at most half a range at either end; while moving one range from the largest shard to the
smallest brings them closer, the best such range moves. A slot is a document's place in its shard.

Bounds: the driver gets about ``SAMPLES`` keys for each range and one total for each range; ranges are
``RANGES_A_SHARD`` for each shard, more where a range would pass ``RANGE_BYTES``, ``MAX_RANGES`` at
most before subdividing. Only ranges are numbered in one task, never a shard or a text's copies.

Defined results: a null text has no bytes and size 1; equal texts stay in one range unless the
range is overfull. Repeated rows are rows of their own. Null ids count as values. Fewer documents than shards leave
shards empty; a document larger than a shard's share is not cut. Columns of the input are kept in one struct. The
same stored input gives the same shards and slots.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.llm.common import ROW, land, nest, small_batches

RANGES_A_SHARD = 256
RANGE_BYTES = 64 << 20
MAX_RANGES = 1 << 16
SAMPLES = 8
_LOWEST = np.iinfo(np.int64).min


class Splitters:
    """Sorted boundaries (k1, k2); a key belongs to the range after the last boundary not above it."""

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        pairs = np.unique(np.stack([k1, k2], axis=1).astype(np.int64), axis=0)
        self.k1, self.k2 = pairs[:, 0].copy(), pairs[:, 1].copy()

    def __len__(self) -> int:
        return len(self.k1)

    def find(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        lo = np.searchsorted(self.k1, k1, side="left")
        hi = np.searchsorted(self.k1, k1, side="right")
        tied = np.flatnonzero(lo < hi)
        out = hi.astype(np.int64)
        order = tied[np.argsort(lo[tied], kind="stable")]
        edge = np.flatnonzero(np.concatenate([[True], lo[order][1:] != lo[order][:-1]])) if len(order) else []
        for rows in np.split(order, edge[1:]) if len(order) else []:  # one step for each k1 of a boundary
            a, b = lo[rows[0]], hi[rows[0]]
            out[rows] = a + np.searchsorted(self.k2[a:b], k2[rows], side="right")
        return out

    def column(self) -> Column:
        @F.arrow_udf("int")
        def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for a, b in batches:
                yield pa.array(self.find(a.to_numpy(), b.to_numpy()).astype(np.int32))

        return find("k1", "k2")

    def with_more(self, k1: np.ndarray, k2: np.ndarray) -> Splitters:
        return Splitters(np.concatenate([self.k1, k1]), np.concatenate([self.k2, k2]))


def _quantiles(k1: np.ndarray, k2: np.ndarray, weight: np.ndarray, parts: int) -> np.ndarray:
    """Positions (in key order) of the boundaries that cut the weighted keys into ``parts``."""
    order = np.lexsort((k2, k1))
    total = np.cumsum(weight[order])
    if not len(total):
        return order
    at = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts, side="left")
    return order[np.unique(np.minimum(at, len(order) - 1))]


def _sample(rows: DataFrame, rate: float | Column, draw: int) -> pd.DataFrame:
    """Keys drawn with probability min(1, size * rate), and the bytes that each stands for."""
    chance = F.least(F.lit(1.0), F.col("size") * rate)
    u = F.pmod(F.xxhash64("k2", "k1", F.lit(draw)), F.lit(1 << 40)) / float(1 << 40)
    return rows.where(u < chance).withColumn("weight", F.col("size") / chance) \
        .select("k1", "k2", "weight", *[c for c in ("range",) if c in rows.columns]).toPandas()


def _measured(rows: DataFrame, splitters: Splitters) -> pd.DataFrame:
    """Exact bytes and rows of each range that has any, in key order."""
    out = rows.withColumn("range", splitters.column()).groupBy("range") \
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return out.toPandas().sort_values("range", ignore_index=True)


def split(rows: DataFrame, total: int, ranges: int) -> tuple[Splitters, pd.DataFrame]:
    """Boundaries of about ``ranges`` ranges over ``rows`` (k1, k2, size), and what each range holds."""
    drawn = _sample(rows, SAMPLES * ranges / total, 0)
    k1, weight = drawn["k1"].to_numpy(np.int64), drawn["weight"].to_numpy(np.float64)
    at = _quantiles(k1, drawn["k2"].to_numpy(np.int64), weight, ranges)
    splitters = Splitters(k1[at], np.full(len(at), _LOWEST))
    held = _measured(rows, splitters)
    share, before = total / ranges, None
    while True:
        over = held[(held["bytes"] > 2 * share) & (held["n"] > 1)]
        if over.empty or (before is not None and over[["bytes", "n"]].values.tolist() == before):
            return splitters, held
        before = over[["bytes", "n"]].values.tolist()
        wide = rows.withColumn("range", splitters.column()).where(F.col("range").isin(over["range"].tolist()))
        drawn = _sample(wide, 4 * SAMPLES / share, 1 + len(splitters))
        for number, keys in drawn.groupby("range"):
            parts = -(-int(over.loc[over["range"] == number, "bytes"].iloc[0]) // int(share + 1))
            a, b = keys["k1"].to_numpy(np.int64), keys["k2"].to_numpy(np.int64)
            at = _quantiles(a, b, keys["weight"].to_numpy(np.float64), parts)
            splitters = splitters.with_more(a[at], b[at])
        held = _measured(rows, splitters)


def deal(size: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each range, given the bytes of the ranges in key order."""
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    out = np.minimum((end - size / 2) * shards / max(total, 1), shards - 1).astype(np.int64)
    load = np.bincount(out, weights=size, minlength=shards)
    while len(size):
        most, least = int(load.argmax()), int(load.argmin())
        gap = load[most] - load[least]
        own = np.flatnonzero((out == most) & (size < gap))
        if not len(own):
            return out
        pick = own[np.abs(size[own] - gap / 2).argmin()]
        out[pick] = least
        load[most] -= size[pick]
        load[least] += size[pick]
    return out


def shard(docs: DataFrame, shards: int = 16, carry: Sequence[str] | None = None) -> DataFrame:
    """``row__`` (the ``carry`` columns of the document, all by default), ``size``, ``text_crc32``,
    ``shard`` and ``slot`` of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(f"{ROW}.text").cast("string"), F.lit(""))
    kept = F.struct(*[F.col(f"{ROW}.`{c}`") for c in (docs.columns if carry is None else carry)])
    keyed = land(nest(docs).select(
        kept.alias(ROW), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("k1"), F.xxhash64(F.col(f"{ROW}.doc_id"), F.monotonically_increasing_id()).alias("k2")),
        "shard-keys")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    ranges = max(RANGES_A_SHARD * shards, min(MAX_RANGES, total // RANGE_BYTES))
    keys = keyed.select("k1", "k2", "size")
    splitters, held = split(keys, total, ranges) if total else (
        Splitters(np.zeros(0), np.zeros(0)), pd.DataFrame({"range": [], "bytes": [], "n": []}))
    held["shard"] = deal(held["bytes"].to_numpy(np.int64), shards)
    held["before"] = held.groupby("shard")["n"].cumsum() - held["n"]
    places = spark.createDataFrame(pa.table({k: pa.array(held[k].to_numpy(np.int64)) for k in ("range", "shard", "before")}))
    # One row for each range: bounded by the ranges, see above.
    placed = keyed.withColumn("range", splitters.column().cast("long")).join(F.broadcast(places), "range")
    within = F.row_number().over(W.partitionBy("range").orderBy("k1", "k2"))
    return placed.select(ROW, "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                         (F.col("before") + within - 1).alias("slot"))


def write(sharded: DataFrame, path: str) -> None:
    """Write the documents under ``path`` in one folder a shard, in the order of their slots:
    ``row__`` and ``slot`` in each file. Ranges of (shard, slot) are dealt to tasks."""
    (sharded.select(ROW, "slot", "shard").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
