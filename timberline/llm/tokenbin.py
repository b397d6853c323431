"""Token ids as Parquet list columns with selective reads.

Documents are range-partitioned by doc_id, tokenized inside the tasks and written in order:
``doc_id, part, at, n_tokens, tokens``, with an end id after each document. Token ids are
dictionary-encoded lists, the other columns delta-encoded; row groups and pages have stated
sizes and page indexes, so a reader fetches the documents of an id range, or the metadata
columns alone, without the rest. ``part`` numbers the files in id order and ``at`` counts the
ids before a document in its file, so its place in the whole corpus needs one sum per file.

Defined results: a null text is empty (its end id alone); repeated doc_ids lie next to each
other in the order of their texts; a null doc_id comes first; an empty table writes no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timberline.llm.common import nest, small_batches
from timberline.llm.words import SPACED, HashIndex, Words, slices, split_words, text_buffers
from timberline.session import scratch_path

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
BROADCAST_FILES = 100_000
CACHE_WORDS = 500_000  # words whose ids a Python worker remembers (about 70 bytes each)
CACHE_PIECES = 500_000  # the same of pieces

_BYTES = np.arange(256)
_LATIN = (_BYTES >= 0x80) & (_BYTES <= 0xBF) | (_BYTES == 0xC3)  # letters À to ÿ in UTF-8: C3 and a second byte
_LATIN[[0x97, 0xB7]] = False  # but for × and ÷
# Plain words: letters of ASCII and Latin-1, and printable ASCII without ' and <.
_PLAIN = (_BYTES > 0x20) & (_BYTES < 0x7F) & (_BYTES != ord("'")) & (_BYTES != ord("<")) | _LATIN
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A) | (_BYTES >= 0x80) & (_BYTES <= 0x9E) & (_BYTES != 0x97)
_LOWER = (_BYTES + 32 * _UPPER).astype(np.uint8)  # of a plain word's bytes
_DIGIT = 1
_KIND = np.where((_BYTES >= 0x30) & (_BYTES <= 0x39), _DIGIT, 0).astype(np.int8)  # of a lower-cased byte
_KIND[(_BYTES >= 0x61) & (_BYTES <= 0x7A) | _LATIN] = 2


class IdRuns:
    """Runs of ids remembered by a 64-bit hash: a hash index beside one pool of ids."""

    def __init__(self) -> None:
        self.index = HashIndex()
        self.first = self.size = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        """Append the runs of the hashes that ``index`` numbered last."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.first = np.concatenate([self.first, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(ids)


class WordEncoder:
    """Ids of white-space-separated words by the tokenizers library, remembered by word hash.

    Valid for tokenizers that drop white space, lower-case and split into pieces of letters,
    single digits and others before byte-level BPE: a text's ids are then its words' ids in
    order. New words of plain characters are cut into pieces, which are remembered too; the
    new pieces of a call go to the BPE model as one text, in which tokens with the
    end-of-word suffix end the pieces. All other words, or all if the model has no such
    suffix, go one by one through the whole tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, CharDelimiterSplit, Sequence

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)  # of pieces joined by blanks
        self.bare.pre_tokenizer = Sequence([CharDelimiterSplit(" "), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocab = self.bare.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=-1) + 1, dtype=bool)
        if self.suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(self.suffix)]] = True
        self.words, self.pieces = IdRuns(), IdRuns()

    def _new_pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of pieces, each followed by another byte in ``data``."""
        size = end - start + 1
        text = data[ranges(start, size)]
        text[np.cumsum(size) - 1] = 0x20
        ids = np.array(self.bare.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, dtype=np.int32)
        edge = np.flatnonzero(self.ends[ids]) + 1
        if len(edge) != len(size) or edge[-1] != len(ids):
            raise ValueError(f"{len(size)} pieces got {len(edge)} tokens ending in {self.suffix}")
        return ids, np.diff(edge, prepend=0)

    def _plain(self, text: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of plain words that begin at ``first`` of ``text``."""
        text = _LOWER[text]
        kind = _KIND[text]
        cut = kind == _DIGIT
        cut[1:] |= kind[1:] != kind[:-1]
        cut[first] = True
        cut = np.flatnonzero(cut)
        text = np.append(np.insert(text, cut, 0x20), np.uint8(0x20))
        w = split_words(text, np.array([0, len(text)]), SPACED)
        if len(self.pieces.index) > CACHE_PIECES:
            self.pieces = IdRuns()
        p = self.pieces
        number, spots = p.index.number_all(w.hash)
        if len(spots):
            p.add(*self._new_pieces(text, w.start[spots], w.end[spots]))
        size = p.size[number]
        total = np.concatenate([[0], np.cumsum(size)])
        n = np.diff(total[np.searchsorted(cut, np.append(first, len(kind)))])
        return p.pool[ranges(p.first[number], size)], n

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these bytes one after another, and the ids of each word."""
        length = end - start
        first = np.cumsum(length) - length
        text = data[ranges(start, length)]
        plain = np.logical_and.reduceat(_PLAIN[text], first) if self.suffix else np.zeros(len(start), dtype=bool)
        if plain.all():
            return self._plain(text, first)
        hard = [data[a:b].tobytes().decode() for a, b in zip(start[~plain].tolist(), end[~plain].tolist(), strict=True)]
        done = [e.ids for e in self.tokenizer.encode_batch_fast(hard, add_special_tokens=False)]
        size = np.zeros(len(start), dtype=np.int64)
        size[~plain] = np.fromiter(map(len, done), dtype=np.int64, count=len(done))
        if plain.any():
            kept = length[plain]
            easy, size[plain] = self._plain(text[np.repeat(plain, length)], np.cumsum(kept) - kept)
        ids = np.zeros(int(size.sum()), dtype=np.int32)
        at = np.cumsum(size) - size
        ids[ranges(at[~plain], size[~plain])] = np.fromiter(chain.from_iterable(done), dtype=np.int32)
        if plain.any():
            ids[ranges(at[plain], size[plain])] = easy
        return ids, size

    def runs(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """For each word, where its ids begin in the pool of ``words`` and how many they are."""
        if len(self.words.index) > CACHE_WORDS:
            self.words = IdRuns()
        number, spots = self.words.index.number_all(w.hash)
        if len(spots):
            self.words.add(*self.encode(w.data, w.start[spots], w.end[spots]))
        return self.words.first[number], self.words.size[number]


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (n[0] of them), first[1], ...: flat indexes of many runs."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def encode_texts(encoder: WordEncoder, data: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of consecutive texts, an end id after each, and the ids of each text."""
    w = split_words(data, bounds, SPACED)
    first, size = encoder.runs(w)
    total = np.concatenate([[0], np.cumsum(size)])
    n = total[w.first[1:]] - total[w.first[:-1]]
    out = np.full(int(n.sum()) + len(n), end_id, dtype=np.int32)
    # Each text's ids move on by the end ids before it.
    out[ranges(total[w.first[:-1]] + np.arange(len(n)), n)] = encoder.words.pool[ranges(first, size)]
    return out, n + 1


def _writer_task(path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(path), TaskContext.get().partitionId(), 0
        for b in batches:
            data, bounds = text_buffers(b.column(1))
            for lo, hi in slices(bounds):
                ids, n = encode_texts(encoder, data, bounds[lo : hi + 1], end_id)
                edge = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)),
                     pa.array(at + edge[:-1]), pa.array(n), lists], names=["doc_id", "part", "at", "n_tokens", "tokens"])
                at += int(edge[-1])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, files: int | None = None) -> None:
    """Write the token files of all documents under ``path`` in ascending doc_id order."""
    small_batches(docs.sparkSession)
    files = files or max(1, docs.rdd.getNumPartitions())
    rows = nest(docs).select("row__.doc_id", F.coalesce(F.col("row__.text").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ranged = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    tokens = ranged.mapInArrow(_writer_task(tokenizer, end_id),
                               f"doc_id {kind}, part int, at long, n_tokens long, tokens array<int>")
    (tokens.write.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true")
     .option("parquet.block.size", str(ROW_GROUP_BYTES)).option("parquet.page.size", str(PAGE_BYTES))
     .option("compression", "zstd").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored documents with ``start``, the ids of all documents before each. Selecting
    columns or filtering on doc_id reads only those columns, row groups and pages."""
    stored = spark.read.parquet(path)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    if len(stored.inputFiles()) <= BROADCAST_FILES:  # one row for each file
        parts = F.broadcast(parts)
    return stored.join(parts, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"),
                                             "n_tokens", "tokens")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("tokens")
        edge = lists.offsets.to_numpy()
        ids = memoryview(lists.values.to_numpy().astype("<u4")).cast("B")
        crc = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("start"), pa.array(np.diff(edge).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, from the files' ids."""
    small_batches(spark)
    rows = read(spark, path).select("doc_id", "start", "tokens")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_checksums, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession) -> str:
    return scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
