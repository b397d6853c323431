"""Log lines by position (S7, S13): a Spark data source that reads text files from byte to byte.

``log_lines`` gives every complete line with its file, the byte it begins at and the byte after it.
A range of a file is divided into tasks of ``SPLIT_BYTES``; a task reads the lines that begin in its
part, in blocks of bounded size, as Arrow batches. Resuming is a position for each file and not a time,
so a line that was written late with an old timestamp is read like any other. The
last line of a file that is still written (no line end yet) waits for the next read; a
file shorter than its position was replaced and is read from its start. New files have no position.

Batch: ``ends`` gives the position after the last complete line of each file, and ``read_between`` the
lines up to there; the caller stores the ends with the rows. Stream: the offsets are the same positions
in the query's checkpoint, so a restarted query repeats and loses nothing.

Files are found and opened through Arrow's file systems, by path or by URI. A line must fit a task's memory.
"""

from __future__ import annotations

import fnmatch
import json
import sys

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Shipped to executors by value, so the workers need pyarrow but not this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "file_path string, line_at long, next_at long, value string"
SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
DEFAULT_PATTERNS = ("*.log",)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _files(paths: Sequence[str], patterns: Sequence[str]) -> Iterator[tuple[str, int]]:
    """Name and size of the files given and of those below the folders given that match a pattern."""
    for path in paths:
        fs, inner = _open(path)
        info = fs.get_file_info(inner)
        if info.type == pafs.FileType.File:
            yield path, info.size
        elif info.type == pafs.FileType.Directory:
            head = path.rstrip("/")
            base = inner.rstrip("/")
            for f in fs.get_file_info(pafs.FileSelector(inner, recursive=True)):
                below = f.path[len(base):]
                hidden = any(part.startswith(("_", ".")) for part in below.split("/"))
                if f.type == pafs.FileType.File and not hidden and any(fnmatch.fnmatch(f.base_name, p) for p in patterns):
                    yield head + below, f.size
        else:
            raise FileNotFoundError(path)


def _last_line_end(path: str, size: int, low: int) -> int:
    """The byte after the last line end before ``size``, at least ``low``."""
    fs, inner = _open(path)
    with fs.open_input_file(inner) as f:
        hi = size
        while hi > low:
            lo = max(low, hi - (1 << 16))
            at = f.read_at(hi - lo, lo).rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            hi = lo
    return low


def ends(paths: str | Sequence[str], known: dict[str, int] | None = None, patterns: Sequence[str] = DEFAULT_PATTERNS) -> dict[str, int]:
    """Where each file's complete lines end now, given the positions already known."""
    known = known or {}
    out = {}
    for path, size in _files([paths] if isinstance(paths, str) else paths, patterns):
        start = known.get(path, 0)
        out[path] = size if size == start else _last_line_end(path, size, start if size > start else 0)
    return out


def _ranges(start: dict[str, int], end: dict[str, int]) -> list[LineRange]:
    """The parts of the files between two positions, for one task each."""
    out = []
    for path, stop in sorted(end.items()):
        at = start.get(path, 0)
        at = 0 if at > stop else at
        out += [LineRange(path, lo, min(lo + SPLIT_BYTES, stop), lo == at, stop) for lo in range(at, stop, SPLIT_BYTES)]
    return out


@dataclass
class LineRange(InputPartition):
    """Lines that begin in bytes ``lo`` to ``hi`` of a file whose complete lines end at ``stop``."""

    path: str
    lo: int
    hi: int
    is_start: bool  # a line begins at ``lo``
    stop: int


def _batch(path: str, at: int, data: bytes) -> pa.RecordBatch:
    """The lines of whole lines ``data`` that begins at byte ``at``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    stop = np.flatnonzero(raw == 10)
    keep = raw != 10
    before = stop[(stop > 0)] - 1
    keep[before[raw[before] == 13]] = False  # \r\n
    length = np.concatenate([[0], np.cumsum(keep)[stop]])
    text = pa.StringArray.from_buffers(len(stop), pa.py_buffer(length.astype(np.int32)), pa.py_buffer(raw[keep]))
    begin = np.concatenate([[0], stop[:-1] + 1])
    return pa.RecordBatch.from_arrays([pa.array([path] * len(stop), pa.string()), pa.array(at + begin), pa.array(at + stop + 1), text],
                                      names=["file_path", "line_at", "next_at", "value"])


def _lines(part: LineRange) -> Iterator[pa.RecordBatch]:
    fs, inner = _open(part.path)
    with fs.open_input_file(inner) as f:
        at, left = part.lo, b""
        if not part.is_start:  # the line that reaches into this part belongs to the one before
            at -= 1
            while True:
                block = f.read_at(min(1 << 16, part.stop - at), at)
                gap = block.find(b"\n")
                if gap >= 0 or not block:
                    at += gap + 1 if gap >= 0 else 0
                    break
                at += len(block)
        pos = at
        while at < part.hi:
            block = f.read_at(min(BLOCK_BYTES, part.stop - pos), pos)
            if not block:
                return
            pos += len(block)
            left += block
            cut = left.rfind(b"\n") + 1
            if pos >= part.hi:  # the last line that begins in this part may end beyond it
                last = left.find(b"\n", max(0, part.hi - 1 - at)) + 1
                cut = last or cut
                if cut:
                    yield _batch(part.path, at, left[:cut])
                    if last:
                        return
            elif cut:
                yield _batch(part.path, at, left[:cut])
            at, left = at + cut, left[cut:]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.start, self.end = json.loads(options["start"]), json.loads(options["end"])

    def partitions(self):
        return _ranges(self.start, self.end)

    def read(self, partition):
        return _lines(partition) if partition is not None else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.paths, self.patterns = json.loads(options["paths"]), json.loads(options["patterns"])
        self.known: dict[str, int] = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        # Files that were removed keep their positions: an offset never loses a file.
        self.known = {**self.known, **ends(self.paths, self.known, self.patterns)}
        return self.known

    def partitions(self, start, end):
        self.known = {**self.known, **end}
        return _ranges(start, {p: stop for p, stop in end.items() if start.get(p, 0) != stop})

    def read(self, partition):
        return _lines(partition)


class LogLines(DataSource):
    @classmethod
    def name(cls):
        return "log_lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def read_between(spark: SparkSession, start: dict[str, int], end: dict[str, int]) -> DataFrame:
    """The non-blank lines between two positions, with ``file_path, line_at, next_at``."""
    spark.dataSource.register(LogLines)
    df = spark.read.format("log_lines").option("start", json.dumps(start)).option("end", json.dumps(end)).load()
    return df.filter(F.trim("value") != "")


def stream(spark: SparkSession, paths: str | Sequence[str], patterns: Sequence[str] = DEFAULT_PATTERNS) -> DataFrame:
    """A streaming frame of the lines that files get, resumed by position from the query's checkpoint."""
    spark.dataSource.register(LogLines)
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.readStream.format("log_lines").option("paths", json.dumps(paths)).option("patterns", json.dumps(list(patterns))).load()
    return df.filter(F.trim("value") != "")
