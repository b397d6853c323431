"""Lookups between blocks of documents and buckets of keys, without a hot key.

Documents are dealt into blocks of about ``rows`` by a hash. Each block reduces its own keys to
distinct ones and sends them to buckets by hash, as packed arrays; a bucket sees a key at most
once from each block, however many documents hold it, and answers the blocks that asked. Blocks
and buckets grow in number, not in size, with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import ROW, nest, small_batches

BLOCK_ROWS = 2048


def into_blocks(docs: DataFrame, rows: int = BLOCK_ROWS, **extra) -> tuple[DataFrame, int]:
    """``block, doc_id, text`` and the ``extra`` columns (of the nested document), and the number of blocks."""
    small_batches(docs.sparkSession)
    n = max(1, -(-docs.count() // rows))
    text = F.coalesce(F.col(f"{ROW}.text").cast("string"), F.lit(""))
    doc_id = F.col(f"{ROW}.doc_id").cast("long")
    block = F.pmod(F.xxhash64(doc_id, text), F.lit(n)).cast("int")
    columns = [c.alias(k) for k, c in extra.items()]
    return nest(docs).select(block.alias("block"), doc_id.alias("doc_id"), text.alias("text"), *columns), n


def ids(column: pa.ChunkedArray) -> np.ndarray:
    """Document ids; null is larger than any other."""
    return column.combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)


def packed(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def unpacked(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype=dtype) for x in column]


def joined(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)


def deal(keys: np.ndarray, buckets: int, *values: np.ndarray) -> Iterator[tuple]:
    """(bucket, packed keys, packed values...) of distinct keys."""
    bucket = ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    bucket, keys = bucket[order], keys[order]
    values = [v[order] for v in values]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield (int(bucket[a]), packed(keys[a:b]), *[packed(v[a:b]) for v in values])


def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
