"""Text search over a stored log table by trigram filters of its files.

Beside the table a filter is kept for every data file: one bit for each trigram of lower-cased message
bytes, folded into ``BITS`` bits. A message that holds a text holds all its trigrams, so a file
without one of them cannot match ``ILIKE '%text%'`` and is not read. The query then runs
on the files left, with the same predicate as always; the filters only save reading.

Only plain runs of three or more ASCII characters between the wildcards ``%`` and ``_`` are used (a
``_`` or a letter outside ASCII cuts a run): texts without such a run read all files. Files that are not
covered yet are always read, so rows appended after ``build`` are found.
"""

from __future__ import annotations

import re
import sys

from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.query import query_logs
from timberline.params import LogQuery
from timberline.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 1 << 17
_SCHEMA = "file string, bits array<long>"
_FILTER = pa.schema([("file", pa.string()), ("bits", pa.list_(pa.int64()))])
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _places(data: np.ndarray) -> np.ndarray:
    """The bit of the trigram that begins at each byte but the last two."""
    code = data[:-2].astype(np.uint64) << np.uint64(16) | data[1:-1].astype(np.uint64) << np.uint64(8) | data[2:].astype(np.uint64)
    return ((code * _FOLD) >> np.uint64(40)) % np.uint64(BITS)


def _row(file: str, bits: np.ndarray) -> pa.RecordBatch:
    words = np.packbits(bits, bitorder="little").view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))
    return pa.RecordBatch.from_arrays([pa.array([file]), lists], schema=_FILTER)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter of each file that a task reads, or of the part it reads."""
    file, bits = None, np.zeros(BITS, dtype=bool)
    for b in batches:
        names = b.column(0).dictionary_encode()
        code = names.indices.to_numpy()
        for lo, hi in _runs(code):
            name = names.dictionary[code[lo]].as_py()
            if name != file:
                if file is not None:
                    yield _row(file, bits)
                file, bits = name, np.zeros(BITS, dtype=bool)
            text = b.column(1).slice(lo, hi - lo)
            ends = np.cumsum(np.asarray([0, *(len(x) for x in (t.as_buffer() for t in text))]))
            data = np.frombuffer(b"".join(t.as_py() for t in text), dtype=np.uint8)
            if len(data) < 3:
                continue
            inside = np.ones(len(data), dtype=bool)  # trigrams end in the message they begin in
            for back in (1, 2):
                inside[ends[1:][ends[1:] >= back] - back] = False
            bits[_places(data)[inside[:-2]]] = True
    if file is not None:
        yield _row(file, bits)


def _runs(code: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]])) if len(code) else []
    yield from zip(edge[:-1], edge[1:], strict=True)


def _union(parts: pa.Table) -> pa.Table:
    """One filter for a file that several tasks read."""
    words = np.stack([x.values.to_numpy() for x in parts["bits"]])
    return pa.Table.from_batches([_row(parts["file"][0].as_py(), np.unpackbits(np.bitwise_or.reduce(words).view(np.uint8), bitorder="little"))])


def _name(path: str) -> str:
    """A file's name, however the path is written."""
    return re.sub(r"^file:/*", "/", unquote(path))


def build(spark: SparkSession, table_path: str, index_path: str) -> int:
    """Add the filters of the table's files that have none yet; their number. A crash leaves files
    without a filter, which are read by every search until the next build."""
    table = stored(spark, table_path)
    if table is None:
        return 0
    known = covered(spark, index_path)
    fresh = [f for f in table.inputFiles() if _name(f) not in known]
    if fresh:
        rows = spark.read.schema("message string").parquet(*fresh).select(
            F.col("_metadata.file_path").alias("file"), F.lower(F.coalesce("message", F.lit(""))).cast("binary").alias("text"))
        rows.mapInArrow(_filters, _SCHEMA).groupBy("file").applyInArrow(_union, _SCHEMA).write.mode("append").parquet(index_path)
    return len(fresh)


def covered(spark: SparkSession, index_path: str) -> set[str]:
    """The files that have a filter (as many names as Spark lists to read the table)."""
    index = stored(spark, index_path)
    return set() if index is None else {_name(r["file"]) for r in index.select("file").toLocalIterator()}


def needed(q: LogQuery) -> list[int]:
    """The bits that a file with a match has set."""
    text = q.contains or ""
    runs = re.findall(r"[\x00-\x7f]{3,}", text if q.literal_contains else re.sub(r"[%_]", "�", text))
    return sorted({int(p) for run in runs for p in _places(np.frombuffer(run.lower().encode(), dtype=np.uint8))})


def search(spark: SparkSession, table_path: str, index_path: str, q: LogQuery, as_of) -> DataFrame:
    """QUERY_LOGS over the stored table, reading only files that may hold ``q.contains``."""
    table = stored(spark, table_path)
    if table is None:
        raise FileNotFoundError(table_path)
    bits, index = needed(q), stored(spark, index_path)
    if not bits or index is None:
        return query_logs(table, q, as_of)
    masks: dict[int, int] = {}
    for p in bits:
        masks[p // 64] = masks.get(p // 64, 0) | 1 << p % 64
    may = F.lit(True)
    for word, mask in masks.items():
        signed = F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")
        may = may & (F.get("bits", word).bitwiseAND(signed) == signed)
    chosen = {_name(r["file"]) for r in index.where(may).select("file").toLocalIterator()}
    known = covered(spark, index_path)
    files = [f for f in table.inputFiles() if _name(f) in chosen or _name(f) not in known]
    if not files:
        return query_logs(table.limit(0), q, as_of)
    return query_logs(spark.read.schema(table.schema).option("basePath", table_path).parquet(*files), q, as_of)
